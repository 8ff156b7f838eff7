"""Parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults, media extensions, and folders that recursive listings leave out.
MEDIA_EXTENSIONS = (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv")
RESERVED_FOLDERS = ("duplicate_videos", "watched_videos", "skipped_videos")
CACHE_NAME = ".video_hashes_cache"
WATCHED_NAME = ".watched_videos"


@dataclass(frozen=True)
class Params:
    """Immutable; values outside their domains raise ValueError."""

    num_frames: int = 20
    hash_size: int = 8
    threshold: float = 90.0
    skip_duration: int = 20

    def __post_init__(self):
        if not 0 <= self.threshold <= 100:
            raise ValueError("threshold must lie between 0 and 100")
        if self.num_frames <= 0:
            raise ValueError("num_frames must be positive")
        if self.hash_size <= 1:
            raise ValueError("hash_size must be above 1")
        if self.skip_duration < 0:
            raise ValueError("skip_duration must not be negative")

    @property
    def bits(self) -> int:
        return self.hash_size**2

    @property
    def words(self) -> int:
        """64-bit words of one frame's hash."""
        return -(-self.bits // 64)
