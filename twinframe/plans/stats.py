"""Measured times, a line of CSV for each run."""

from __future__ import annotations

import csv
import os


def append_stats(path: str, stats: dict, fields: list[str]) -> None:
    """A line for a run; the first one is preceded by the names, and what was not measured is N/A."""
    new = not os.path.exists(path) or os.path.getsize(path) == 0
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fieldnames=fields, restval="N/A", extrasaction="ignore")
        if new:
            out.writeheader()
        out.writerow(stats)
