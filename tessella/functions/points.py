"""Texts of an Arrow array as vectors of code points, and classes of code points.

A class is a body of Java's character classes, and Java says which code points it
holds, so vectors and the text expressions agree on letters and white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

POINTS = 0x110000
#: Bytes of text that are taken at once; a longer text is taken alone.
SLICE = 1 << 17


@cache
def classes(*bodies: str) -> np.ndarray:
    """For each code point a byte whose bit i tells whether ``bodies[i]`` holds it."""
    if len(bodies) > 8:
        raise ValueError("a byte holds eight classes")
    points = SparkSession.active().range(POINTS).where("id not between 55296 and 57343")
    # A letter before the point: a byte order mark at the start would be taken away.
    text = F.decode(F.unhex(F.concat(F.lit("00000061"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32")
    bits = sum((F.shiftleft(text.rlike(f"(?s)^a[{body}]").cast("int"), i) for i, body in enumerate(bodies)), F.lit(0))
    held = points.select("id", bits.alias("bits")).where("bits != 0").toArrow()
    out = np.zeros(POINTS, np.uint8)
    out[held["id"].to_numpy()] = held["bits"].to_numpy()
    return out


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of at most ``most`` bytes (or one row), each with its first place."""
    ends, first, most = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy(), 0, most or SLICE
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, texts.slice(first, stop - first)
        first = stop


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one text after another, and each one's bounds: text
    i lies from bound i to bound i + 1.  A null is like an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    try:
        points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:  # each byte outside UTF-8 counts, and no text reaches into the next
        rows = [str(raw[a:b], "utf-8", "replace") for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])]
        return np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum([len(t) for t in rows], dtype=np.int64)])
    bounds = offsets - offsets[0]
    if len(points) < len(raw):
        bounds = before((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[bounds]
    return points, bounds


def before(marks: np.ndarray) -> np.ndarray:
    """How much of ``marks`` lies before each place, and before the end."""
    out = np.zeros(len(marks) + 1, np.int64 if marks.dtype != bool else np.int32)
    np.cumsum(marks, out=out[1:], dtype=out.dtype)
    return out


def runs(marks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true; a bound cuts a run."""
    starts, stops = marks.copy(), marks.copy()
    starts[1:] &= ~marks[:-1]
    stops[:-1] &= ~marks[1:]
    first, last = bounds[:-1][bounds[:-1] < len(marks)], bounds[1:][bounds[1:] > 0] - 1
    starts[first], stops[last] = marks[first], marks[last]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def any_in(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether some place between two bounds is marked."""
    return np.diff(np.searchsorted(np.flatnonzero(marks), bounds)) > 0
