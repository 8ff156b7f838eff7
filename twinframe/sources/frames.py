"""Files of grey frames, of which single frames are read by seeking.

A header (mark, number of frames, height, width, frames a second) and the frames' numbers, each 32 bits.
A frame that the file is too short for, or that holds ``UNREADABLE``, cannot be read.
"""

from __future__ import annotations

import os
import struct

import numpy as np

HEADER = struct.Struct("<4sIHHd")
MARK = b"TFR1"
UNREADABLE = 0xFFFFFFFF


class FrameFile:
    """An opened file, as ``sources.decode`` wants it."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        head = self.file.read(HEADER.size)
        if len(head) < HEADER.size or head[:4] != MARK:
            self.file.close()
            raise OSError(f"{path} holds no frames")
        _, self.frames, self.height, self.width, self.fps = HEADER.unpack(head)

    def read(self, index: int):
        size = self.height * self.width
        self.file.seek(HEADER.size + 4 * size * index)
        data = self.file.read(4 * size)
        if len(data) < 4 * size:
            return None
        grey = np.frombuffer(data, dtype="<u4").reshape(self.height, self.width)
        return None if (grey == UNREADABLE).any() else grey.astype(float)

    def close(self) -> None:
        self.file.close()


def write_frames(path: str, frames: np.ndarray, fps: float, missing: int = 0, mtime: float | None = None) -> None:
    """A file of ``frames`` (number, height, width), without its last ``missing`` bytes."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    n, height, width = frames.shape
    data = HEADER.pack(MARK, n, height, width, fps) + frames.astype("<u4").tobytes()
    with open(path, "wb") as f:
        f.write(data[: len(data) - missing])
    if mtime is not None:
        os.utime(path, (mtime, mtime))
