"""Sparse rankings of a stated query set against all documents, without a posting leaving its task.

Two passes over the texts.  The first adds up the collection's size, its length
and the frequencies of the queries' terms (partial sums per task).  The second
turns a slice of documents into a matrix of term weights, ``TERMS`` columns at a
time, multiplies it with the queries' term incidence, and keeps the best k documents
of the slice for every query; only these are shuffled.  Several weights are taken in
one pass.  Queries beyond ``QUERIES`` are worked off in groups of that many, and the
incidence is held as lists (terms by query), so a task's memory is bounded.

Excluded pairs stay distributed: a slice keeps k and as many more as the item has
exclusions, and these go by a join before the final cut.

Null texts are documents without terms: they count in the collection and are
never found.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkshelf.functions.text import SEPARATORS
from sparkshelf.operators.ranking import B, K1, POOL, top_k

QUERIES, SLICE, TERMS = 2048, 1 << 19, 4096


@lru_cache(1)
def _separator() -> np.ndarray:
    import re

    pattern = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), SEPARATORS), re.ASCII)
    out = np.zeros(0x110000, bool)
    for c in [*range(0x3100), *range(0xFE00, 0x10000)]:
        out[c] = pattern.fullmatch(chr(c)) is not None
    return out


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bigram code and count of every distinct bigram of each text, and the texts' lengths in bigrams."""
    pieces = [t or "" for t in texts]
    chars = np.frombuffer(("\n".join(pieces) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in pieces])
    row = np.repeat(np.arange(len(pieces)), sizes)
    gap = _separator()[chars]
    before = np.append(True, gap[:-1])
    pair = np.flatnonzero(~gap[:-1] & ~gap[1:])
    single = np.flatnonzero(~gap[:-1] & gap[1:] & before[:-1])
    at = np.concatenate([pair, single])
    code = chars[at] << 21
    code[: len(pair)] |= chars[pair + 1]
    code[len(pair) :] |= 0x1FFFFF
    key, tf = np.unique(row[at] << 42 | code, return_counts=True)
    return key >> 42, key & ((1 << 42) - 1), tf, np.bincount(row[at], minlength=len(pieces))


def _slices(batch: pa.RecordBatch):
    texts = batch.column("text").to_pylist()
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > SLICE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, texts[first:]


class Collection:
    """What the first pass finds: n, avgdl and, by sorted term code, df."""

    def __init__(self, docs: DataFrame, codes: np.ndarray):
        def work(batches):
            n, total, df = 0, 0, np.zeros(len(codes), np.int64)
            for b in batches:
                for _, texts in _slices(b):
                    _, code, _, lengths = counted(texts)
                    at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                    n, total = n + len(texts), total + int(lengths.sum())
                    if len(codes):
                        df += np.bincount(at[codes[at] == code], minlength=len(codes))
            found = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], codes[found])), pa.array(np.append([n, total], df[found]))], ["code", "n"])

        # a row per term of the queries
        sums = {r["code"]: r["n"] for r in docs.select("text").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
        self.n, self.avgdl = sums.get(-2, 0), sums.get(-1, 0) / max(1, sums.get(-2, 0))
        self.codes, self.df = codes, np.array([sums.get(c, 0) for c in codes.tolist()], float)


def rank(docs: DataFrame, queries: DataFrame, k: int = POOL, weight: str = "bm25", exclude: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """item, id, score, rank for docs (id, text) and queries (item, text); ids and items are numbers.

    ``weight``: bm25, or overlap (shared distinct bigrams over the root of the length).
    """
    return rank_by(docs, queries, k, (weight,), exclude, k1, b).drop("method")


def rank_by(docs: DataFrame, queries: DataFrame, k: int = POOL, weights: tuple[str, ...] = ("bm25", "overlap"), exclude: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """method, item, id, score, rank for every weight, in one pass over the texts."""
    asked = iter(queries.select("item", "text").orderBy("item").toLocalIterator())
    out = None
    while group := [(r["item"], r["text"]) for r in islice(asked, QUERIES)]:
        part = _ranked(docs, group, k, weights, exclude, k1, b)
        out = part if out is None else out.unionByName(part)
    return _ranked(docs, [], k, weights, exclude, k1, b) if out is None else out


def _ranked(docs, asked, k, weights, exclude, k1, b) -> DataFrame:
    spark = docs.sparkSession
    items = np.array([i for i, _ in asked], np.int64)
    q_row, q_code, _, _ = counted([t for _, t in asked]) if asked else (np.zeros(0, np.int64),) * 4
    codes = np.unique(q_code)
    order = np.argsort(q_code, kind="stable")
    term, who = np.searchsorted(codes, q_code[order]), q_row[order]
    found = Collection(docs, codes)
    idf = np.log1p((found.n - found.df + 0.5) / (found.df + 0.5))
    more = np.zeros(len(items), np.int64)
    if exclude is not None:
        mine = spark.createDataFrame([(i,) for i in items.tolist()], "item long")
        exclude = exclude.select("item", "id").join(F.broadcast(mine), "item", "left_semi").distinct()  # at most QUERIES items
        counts = {r["item"]: r["count"] for r in exclude.groupBy("item").count().collect()}
        more = np.array([counts.get(i, 0) for i in items.tolist()], np.int64)
    held = spark.sparkContext.broadcast((codes, term, who, idf, found.avgdl, items, more))

    def work(batches):
        codes, term, who, idf, avgdl, items, more = held.value
        blocks = []
        for low in range(0, len(codes), TERMS):
            a, z = np.searchsorted(term, [low, low + TERMS])
            blocks.append((low, term[a:z] - low, who[a:z]))
        dense = {}

        def incidence(low, rows, columns):
            has = dense.get(low)
            if has is None:
                has = np.zeros((min(TERMS, len(codes) - low), len(items)))
                has[rows, columns] = 1.0
                if not dense:  # one block is kept, more are made again for each slice
                    dense[low] = has
            return has

        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for first, texts in _slices(batch):
                row, code, tf, lengths = counted(texts)
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                row, at, tf = row[known], at[known], tf[known]
                mine = ids[first : first + len(texts)]
                out_m, out_i, out_d, out_s = [], [], [], []
                for method in weights:
                    if method == "bm25":
                        value = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / avgdl)) if len(at) else tf
                    else:
                        value = 1 / np.sqrt(lengths[row])
                    scores = np.zeros((len(texts), len(items)))
                    for low, rows, columns in blocks:
                        inside = (at >= low) & (at < low + TERMS)
                        matrix = np.zeros((len(texts), min(TERMS, len(codes) - low)))
                        matrix[row[inside], at[inside] - low] = value[inside]
                        scores += matrix @ incidence(low, rows, columns)
                    scores = np.round(scores, 9)
                    for j, item in enumerate(items.tolist()):
                        s = scores[:, j]
                        keep, top = np.flatnonzero(s > 0), k + int(more[j])
                        if len(keep) > top:
                            edge = np.partition(s[keep], len(keep) - top)[len(keep) - top]
                            keep = keep[s[keep] >= edge]
                        keep = keep[np.lexsort((mine[keep], -s[keep]))[:top]]
                        out_m += [method] * len(keep)
                        out_i += [item] * len(keep)
                        out_d += mine[keep].tolist()
                        out_s += s[keep].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out_m, pa.string()), pa.array(out_i, pa.int64()), pa.array(out_d, pa.int64()), pa.array(out_s, pa.float64())], ["method", "item", "id", "score"])

    best = docs.select("id", "text").where("id IS NOT NULL").mapInArrow(work, "method string, item long, id long, score double")
    if exclude is not None:
        best = best.join(exclude, ["item", "id"], "left_anti").select("method", "item", "id", "score")
    return top_k(best, k, ("method", "item"))
