"""Whole texts as ragged numpy arrays, and the Arrow plumbing that feeds them.

Texts arrive in Arrow batches; they are worked on in slices of at most
``SLICE_BYTES`` of UTF-8 (one longer text makes a slice of its own), so a
worker's memory follows the slice and not the batch.  A null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sparkshelf import session

SLICE_BYTES = 1 << 18
BATCH_BYTES = "4m"

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shift, multiply, twice)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of 64-bit ``values``; equal spans have equal hashes wherever they stand."""
    power, inverse = _power_tables(len(values))
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


class Texts:
    """UTF-8 bytes of some texts one after another (``data``) and where each begins and ends (``bounds``)."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        n = len(column)
        bounds = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self.n = n

    def counts(self, positions: np.ndarray) -> np.ndarray:
        """How many of the ascending byte positions lie in each text."""
        at = np.searchsorted(positions, self.bounds)
        return np.diff(at)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def code_points(self) -> np.ndarray:
        return self.sums((self.data & 0xC0) != 0x80)

    def edges(self) -> np.ndarray:
        """True at the byte positions (and at the end) where a text begins or ends."""
        at = np.zeros(len(self.data) + 1, bool)
        at[self.bounds] = True
        return at

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of bytes with ``inside``, none of which crosses texts."""
        edge = self.edges()
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans of ``[^\\x20\\x09-\\x0D]+``."""
        return self.runs(~_SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        data = LOWER[self.data] if fold else self.data
        return span_hashes(_BYTE[data], starts, ends)

    def lists(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``limit`` bytes of ``column``; one longer text is a part by itself."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) if batch.num_rows else np.zeros(0, int)
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < batch.num_rows:
        yield batch.slice(first)


def map_slices(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Applies ``work`` to every slice; it returns the columns of ``schema`` (in that order) or None."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                made = work(part)
                if made is not None:
                    yield made if isinstance(made, pa.RecordBatch) else pa.RecordBatch.from_arrays([made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in names], names)

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, unless the session says otherwise: rows are texts, and batches stand in memory on both sides.

    Unions forget how their parts are dealt out: with adaptive execution the parts can be coalesced differently.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, BATCH_BYTES)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these lengths: each element's row, and its place within the row."""
    counts = np.asarray(counts, np.int64)
    rows = np.repeat(np.arange(len(counts)), counts)
    firsts = np.cumsum(counts) - counts
    return rows, np.arange(len(rows)) - firsts[rows]


def cut(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder, so that a lost executor costs no recomputation of what led to them."""
    small_batches(df.sparkSession)
    return session.cut(df)
