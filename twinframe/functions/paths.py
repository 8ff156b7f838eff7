"""POSIX path functions and size texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinframe.params import MEDIA_EXTENSIONS, RESERVED_FOLDERS


def basename(path) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path) -> Column:
    """From the last dot of the name on, unless only dots stand before it."""
    return F.regexp_extract(path, r"(?:^|/)\.*[^./][^/]*(\.[^./]*)$", 1)


def stem(path) -> Column:
    name = basename(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(path)))


def is_media(path) -> Column:
    return F.lower(extension(path)).isin(*MEDIA_EXTENSIONS)


def in_reserved_folder(relative) -> Column:
    """Whether a path relative to the listed folder lies below a folder that recursive listings leave out."""
    return relative.rlike(f"(?:^|/)(?:{'|'.join(RESERVED_FOLDERS)})/")


#: Units and the number of bytes from which each is used, largest first.
SIZES = (("TB", 1024.0**4), ("GB", 1024.0**3), ("MB", 1024.0**2), ("KB", 1024.0))


def two_decimals(x) -> Column:
    """A double with two decimals, as text: the nearest to its exact binary value, of two equally near the even one.

    ``format_string`` rounds the shortest decimal form half up instead. The hundredfold of a fraction is the
    sum of two doubles: each half of its bits times 100 is exact, and so is the rest of their sum.
    """
    x = x.cast("double")
    # Each step is a field of a one-element array, so that it is computed once.
    step = lambda at, /, **new: F.transform(at, lambda v: F.struct(*(f(v).alias(k) for k, f in new.items())))
    s = step(F.array(F.abs(x) - F.floor(F.abs(x))), x=lambda v: v, c=lambda v: v * 134217729.0)
    s = step(s, x=lambda v: v["x"], high=lambda v: v["c"] - (v["c"] - v["x"]))
    s = step(s, a=lambda v: v["high"] * 100.0, b=lambda v: (v["x"] - v["high"]) * 100.0)
    s = step(s, a=lambda v: v["a"], b=lambda v: v["b"], s=lambda v: v["a"] + v["b"])
    s = step(s, s=lambda v: v["s"], rest=lambda v: v["b"] - (v["s"] - v["a"]), whole=lambda v: F.floor(v["s"]))
    half = lambda v: v["s"] - v["whole"] - 0.5
    up = lambda v: (half(v) > 0) | ((half(v) == 0) & ((v["rest"] > 0) | ((v["rest"] == 0) & (v["whole"] % 2 == 1))))
    n = F.transform(s, lambda v: v["whole"] + F.when(up(v), 1).otherwise(0))[0]
    whole = F.floor(F.abs(x)) + F.when(n == 100, 1).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(F.abs(x) < float(1 << 62), text).when(x.isNotNull(), F.format_string("%.2f", x))


def human_size(size) -> Column:
    """Bytes as text: 0 B, else two decimals in the largest of B to TB that leaves 1 or more."""
    value = size.cast("double")
    out, unit_of = F.lit(1.0), F.lit(" B")
    for unit, least in reversed(SIZES):
        out, unit_of = F.when(value >= least, F.lit(least)).otherwise(out), F.when(value >= least, F.lit(f" {unit}")).otherwise(unit_of)
    return F.when(size.isNull(), "File not found").when(size == 0, "0 B").otherwise(F.concat(two_decimals(value / out), unit_of))


def human_size_text(size) -> str:
    """The same of one Python value; numbers may be given as text, and what is no number is an invalid size."""
    try:
        value = float(size)
    except (TypeError, ValueError):
        return "Invalid size"
    if value == 0:
        return "0 B"
    unit, least = next((x for x in SIZES if value >= x[1]), ("B", 1.0))
    return f"{value / least:.2f} {unit}"
