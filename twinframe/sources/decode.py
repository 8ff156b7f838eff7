"""Decoding and hashing of media files, in Arrow batches, with the decoder as a parameter.

A decoder is a callable that opens a path and gives an object with ``frames``, ``fps``,
``read(index)`` (a grey array, or None) and ``close()``. OpenCV's is used where it is installed.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame

from twinframe.params import Params


class ArrayMedia:
    """Frames kept as an array file (.npz with ``frames`` and ``fps``), whatever its extension."""

    def __init__(self, path: str):
        with open(path, "rb") as f, np.load(f) as z:
            self.data, self.fps = z["frames"], float(z["fps"])
        self.frames = len(self.data)

    def read(self, index: int):
        x = self.data[index]
        return None if np.isnan(x).any() else x

    def close(self) -> None:
        pass


class VideoMedia:
    """OpenCV's reader."""

    def __init__(self, path: str):
        import cv2

        self.cv2, self.cap = cv2, cv2.VideoCapture(path)
        if not self.cap.isOpened():
            raise OSError(f"cannot open {path}")
        self.frames, self.fps = int(self.cap.get(cv2.CAP_PROP_FRAME_COUNT)), self.cap.get(cv2.CAP_PROP_FPS)

    def read(self, index: int):
        self.cap.set(self.cv2.CAP_PROP_POS_FRAMES, index)
        ok, frame = self.cap.read()
        if not ok:
            return None
        small = self.cv2.resize(frame, (32, 32), interpolation=self.cv2.INTER_AREA)
        return self.cv2.cvtColor(small, self.cv2.COLOR_BGR2GRAY).astype(float)

    def close(self) -> None:
        self.cap.release()


def frame_hash(grey: np.ndarray, size: int) -> list[int]:
    """Average hash of a grey frame: means of a size x size grid, bits where above their mean, as signed 64-bit words."""
    rows = np.array_split(np.asarray(grey, dtype=float), size, axis=0)
    grid = np.array([[c.mean() for c in np.array_split(r, size, axis=1)] for r in rows]) if grey.shape != (size, size) else np.asarray(grey, dtype=float)
    bits = (grid > grid.mean()).ravel()
    words = [int("".join("01"[int(b)] for b in bits[i : i + 64]), 2) for i in range(0, len(bits), 64)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def sample_indices(total: int, k: int) -> list[int]:
    return np.linspace(0, max(0, total - 1), k, dtype=int).tolist()


def hash_media(path: str, params: Params, open_media=VideoMedia) -> tuple[str, str, list[int] | None]:
    """``(status, reason, hashes)``: ok, skipped (short), failed or vanished."""
    try:
        m = open_media(path)
    except FileNotFoundError:
        return "vanished", "not found", None
    except Exception as e:  # a file that no decoder reads is a result, not an error
        return ("failed", f"not opened: {type(e).__name__}", None) if os.path.exists(path) else ("vanished", "not found", None)
    try:
        # Without a usable frame rate nothing is known to be long enough, unless no length is asked for.
        long_enough = m.frames / m.fps >= params.skip_duration if (m.fps or 0) > 0 else params.skip_duration <= 0
        if not long_enough or m.frames < params.num_frames:
            return "skipped", "short", None
        at = sample_indices(m.frames, params.num_frames)
        if at[-1] > 0 and m.read(at[-1]) is None:
            return "failed", "last frame unreadable", None
        out = []
        for i in at:
            frame = m.read(i)
            if frame is None:
                return "failed", "frame unreadable", None
            out += frame_hash(frame, params.hash_size)
        return "ok", "", out
    except Exception as e:  # one damaged file must not end the job
        return ("failed", f"not decoded: {type(e).__name__}", None) if os.path.exists(path) else ("vanished", "not found", None)
    finally:
        m.close()


def hash_files(files: DataFrame, params: Params, open_media=VideoMedia, partitions: int | None = None) -> DataFrame:
    """``(path, mtime, status, reason, hashes)`` of ``files(path, mtime)``, spread evenly since files differ in cost."""

    def run(batches):
        import pandas as pd

        for b in batches:
            got = [hash_media(p, params, open_media) for p in b["path"]]
            yield pd.DataFrame({"path": b["path"], "mtime": b["mtime"], "status": [g[0] for g in got], "reason": [g[1] for g in got], "hashes": [g[2] for g in got]})

    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "mtime").repartition(n).mapInPandas(run, "path string, mtime double, status string, reason string, hashes array<bigint>")
