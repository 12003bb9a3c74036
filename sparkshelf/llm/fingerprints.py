"""Order MinHash fingerprints (operator 9).

A text is read as its code-point k-mers, each with its occurrence number, so
that repeated k-mers count.  For each of ``SKETCHES`` hash functions the
``TUPLE`` smallest are kept, put back into text order and hashed together; a
fingerprint is these hashes.  Two fingerprints are as alike as their share of
equal places, which falls with edit distance and, unlike a plain MinHash, with
changed order.

Texts shorter than K are one k-mer.  Null and empty texts have no k-mers: the
empty fingerprint, like only to another one (likeness 1).  Neighbours are by
ascending id, null ids first, ties by text.  Repeated rows stay rows.  A very long
text is fingerprinted whole, by blocks of hash functions.  Of equal hashes the k-mer
that stands earlier is taken.  An empty table gives no rows; other columns, whatever
their names, are not read.  Rows of one id stand in one range, so a table in which
most rows share an id or have none is worked on by one task there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkshelf.llm.ragged import U64, cut, mix64, small_batches

K, SKETCHES, TUPLE = 8, 128, 2
_SEEDS = mix64(np.arange(1, 256, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_STEP = U64(0x100000001B3)
_BLOCK = 1 << 15  # numbers worked on at once, few enough for a core's own cache


def fingerprint(text: str, k: int = K, sketches: int = SKETCHES, take: int = TUPLE) -> np.ndarray:
    """``sketches`` 32-bit values; none for an empty text."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    if not len(chars):
        return np.zeros(0, np.uint32)
    width = min(k, len(chars))
    grams = np.zeros(len(chars) - width + 1, U64)
    mixed = mix64(chars + U64(1))
    for i in range(width):
        grams *= _STEP
        grams += mixed[i : len(chars) - width + 1 + i]
    order = np.argsort(grams, kind="stable")
    sorted_grams = grams[order]
    first = np.flatnonzero(np.append(True, sorted_grams[1:] != sorted_grams[:-1]))
    occurrence = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
    numbered = np.empty(len(grams), U64)
    numbered[order] = mix64(sorted_grams + mix64(occurrence.astype(U64) + U64(77)))
    take = min(take, len(numbered))
    places = np.empty((sketches, take), np.int64)
    block = max(1, _BLOCK // len(numbered))
    held = np.empty((min(block, sketches), len(numbered)), U64)
    for s in range(0, sketches, block):
        seeds = _SEEDS[s : min(s + block, sketches), None]
        ranks = np.multiply(numbered[None, :], seeds, out=held[: len(seeds)])  # the numbers are mixed, the product orders them by its upper bits
        rows = np.arange(len(ranks))
        for t in range(take):  # ties go to the earlier place
            at = ranks.argmin(axis=1)
            places[s : s + block, t] = at
            ranks[rows, at] = U64(0xFFFFFFFFFFFFFFFF)
    places.sort(axis=1)  # text order
    h = np.arange(1, sketches + 1, dtype=U64)
    for t in range(take):
        h = mix64(h * _STEP + numbered[places[:, t]])
    return h.astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places; two empty fingerprints are alike, an empty and another are not."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES, take: int = TUPLE) -> DataFrame:
    """Each document with the fingerprints of itself and its edited text, and its likeness to that and to the next document.

    The texts are shuffled once.  Cuts of the ids into ranges come first, from
    the ids alone; the first document of each range goes to the range before it
    too, so that every document meets the next one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"))).where("doc_id IS NOT NULL")
    marks = sorted(set(ids.stat.approxQuantile("doc_id", [i / ranges for i in range(ranges)], 0.25 / ranges))) if ids.head(1) else []
    # exact ids at which ranges begin; as many as shuffle partitions ask for, whatever the rows
    cuts = [int(r[0]) for r in ids.where(F.col("doc_id").isin([int(m) for m in marks])).distinct().collect()] if marks else []
    cuts = sorted(cuts)
    last = cuts[-1] if cuts else None
    lows = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    def number(batches):
        for b in batches:
            n = np.searchsorted(lows.value, np.asarray(b.column(0).fill_null(np.iinfo(np.int64).min)), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n.astype(np.int32))], [*b.schema.names, "_range"])

    ranged = rows.mapInArrow(number, "doc_id long, text string, _range int")
    # the first documents of all ranges, also as guests in the range before; of ties all go, the first is used
    guests = F.when(F.col("doc_id").isin(cuts) if cuts else F.lit(False), F.array(F.struct(F.col("_range").alias("_at"), F.lit(False).alias("_guest")), F.struct((F.col("_range") - 1).alias("_at"), F.lit(True).alias("_guest")))).otherwise(
        F.array(F.struct(F.col("_range").alias("_at"), F.lit(False).alias("_guest")))
    )
    very_first = rows.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(len(cuts)).alias("_at"), F.lit(True).alias("_guest"))
    dealt = ranged.select("doc_id", "text", F.explode(guests).alias("_g")).select("doc_id", "text", "_g._at", "_g._guest").unionByName(very_first.withColumn("_at", F.col("_at").cast("int")))
    dealt = dealt.repartition("_at").sortWithinPartitions("_at", "_guest", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        previous = None  # (range, id, text, fingerprint)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def row(at, text, mine, following, theirs):
            changed = edited(text, following)
            other = mine if changed == text else fingerprint(changed, k, sketches, take)
            return at, len(text), hashlib.sha256(changed.encode()).hexdigest(), mine.byteswap().tobytes().hex(), other.byteswap().tobytes().hex(), likeness(mine, other), likeness(mine, theirs)

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for b in batches:
            out = []
            for at, text, where, guest in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "_at", "_guest")), strict=True):
                if previous is not None and previous[0] != where:
                    previous = None
                if previous is None and guest:
                    continue
                prints = previous[3] if previous is not None and previous[2] == text else fingerprint(text, k, sketches, take)
                if previous is not None:
                    out.append(row(*previous[1:], text, prints))
                previous = None if guest else (where, at, text, prints)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
