"""Variable-length bytes (seven bits each, low ones first) for gaps between sorted ids: a compact form of postings for export."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def encode(numbers: Iterable[int] | np.ndarray) -> bytes:
    n = np.asarray(numbers if isinstance(numbers, np.ndarray) else list(numbers), np.uint64)
    return encoded(n)[0]


def encoded(n: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of all numbers, and where each one's end."""
    n = n.astype(np.uint64)
    if not len(n):
        return b"", np.zeros(0, np.int64)
    sizes = np.ones(len(n), np.int64)
    for k in range(1, 10):
        sizes += n >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]), np.uint8)
    for k in range(int(sizes.max())):
        here = sizes > k
        more = (sizes[here] > k + 1).astype(np.uint8) << 7
        out[(ends - sizes)[here] + k] = (n[here] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes(), ends


def decode(data: bytes) -> list[int]:
    return _numbers(data).tolist()


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.append(0, np.flatnonzero(raw < 128)[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts)


def pack(postings: DataFrame, block: int = 4096) -> DataFrame:
    """term, block, postings, packed: gap and tf of each posting (term, id, tf); a new gap count starts with every ``block`` ids of a term's range.

    A term's postings are packed in blocks of ids, so that no list stands in one task as a whole.
    """

    def work(key, table):
        ids, tfs = np.asarray(table.column("id")), np.asarray(table.column("tf"))
        order = np.lexsort((tfs, ids))
        gaps = np.diff(ids[order], prepend=key[1].as_py() * block)
        numbers = np.column_stack([gaps, tfs[order]]).reshape(-1)
        return pa.table({"term": [key[0].as_py()], "block": [key[1].as_py()], "postings": pa.array([len(ids)], pa.int64()), "packed": pa.array([encode(numbers)], pa.binary())})

    blocks = postings.where("id >= 0").selectExpr("term", f"CAST(id DIV {block} AS long) AS block", "CAST(id AS long) id", "CAST(tf AS long) tf")
    return blocks.groupBy("term", "block").applyInArrow(work, "term string, block long, postings long, packed binary")


def unpack(packed: DataFrame, block: int = 4096) -> DataFrame:
    """term, id, tf again."""

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            numbers = [_numbers(data) for data in b.column("packed").to_pylist()]
            ids = [k * block + np.cumsum(x[::2]) for k, x in zip(b.column("block").to_pylist(), numbers, strict=True)]
            terms = b.column("term").take(pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in ids])))
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.concatenate(ids)), pa.array(np.concatenate([x[1::2] for x in numbers]))], ["term", "id", "tf"])

    return packed.select("term", "block", "packed").mapInArrow(work, "term string, id long, tf long")


def _runs(term: np.ndarray, ids: np.ndarray, tf: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Term, block, postings and packed bytes of each (term, block) of postings in any order; those of one term and id are added up."""
    order = np.lexsort((ids, term))
    term, ids, tf = term[order], ids[order], tf[order]
    new = np.append(True, (term[1:] != term[:-1]) | (ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    if len(at) < len(ids):
        term, ids, tf = term[at], ids[at], np.add.reduceat(tf, at)
    blocks = ids // block
    starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (blocks[1:] != blocks[:-1]))) if len(ids) else at
    gaps = np.diff(ids, prepend=0)
    gaps[starts] = ids[starts] - blocks[starts] * block
    data, ends = encoded(np.column_stack([gaps, tf]).reshape(-1))
    edges = np.append(0, ends[np.append(starts[1:], len(ids)) * 2 - 1]) if len(ids) else np.zeros(1, np.int64)
    return term[starts], blocks[starts], np.diff(np.append(starts, len(ids))), [data[a:z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def unpacked(packed: pa.ChunkedArray | pa.Array, blocks: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of packed postings: each posting's row, id and tf."""
    data = packed.to_pylist()
    numbers = _numbers(b"".join(data))
    raw = np.frombuffer(b"".join(data), np.uint8) < 128
    upto = np.append(0, np.cumsum([len(d) for d in data]))
    n = np.diff(np.append(0, np.cumsum(raw))[upto]) // 2
    gaps, row = numbers[::2], np.repeat(np.arange(len(data)), n)
    total = np.cumsum(gaps)
    first = np.append(0, np.cumsum(n))[:-1]
    before = np.append(0, total)[np.minimum(first, len(total))]
    return row, total - before[row] + blocks[row] * block, numbers[1::2]


def pack_texts(docs: DataFrame, block: int = 4096, held: int = 1 << 22) -> DataFrame:
    """``pack`` of the bigrams of docs (id, text), without a posting leaving its task unpacked.

    A task counts and packs what it reads; packed pieces are shuffled by block and
    joined.  A block holds the postings of at most ``block`` ids.
    """
    from sparkshelf.operators.sparse_blocks import _slices, counted

    def pieces(batches):
        parts, n = [], 0

        def made():
            code, ids, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
            found, blocks, _, data = _runs(code, ids, tf, block)
            names, which = np.unique(found, return_inverse=True)
            terms = pa.array([chr(c >> 21) + (chr(c & 0x1FFFFF) if c & 0x1FFFFF != 0x1FFFFF else "") for c in names.tolist()], pa.string()).take(pa.array(which))
            for a in range(0, len(data), 1 << 16):
                yield pa.RecordBatch.from_arrays([terms[a : a + (1 << 16)], pa.array(blocks[a : a + (1 << 16)]), pa.array(data[a : a + (1 << 16)], pa.binary())], ["term", "block", "packed"])

        for b in batches:
            ids = np.asarray(b.column("id"))
            for first, texts in _slices(b):
                row, code, tf, _ = counted(texts)
                parts.append((code, ids[first : first + len(texts)][row], tf))
                n += len(tf)
                if n > held:
                    yield from made()
                    parts, n = [], 0
        if n:
            yield from made()

    def whole(key, table):
        names = table.column("term").combine_chunks().dictionary_encode()
        row, ids, tf = unpacked(table.column("packed"), np.asarray(table.column("block")), block)
        term, blocks, n, data = _runs(np.asarray(names.indices).astype(np.int64)[row], ids, tf, block)
        return pa.table([names.dictionary.take(pa.array(term)), pa.array(blocks), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["term", "block", "postings", "packed"])

    made = docs.where("id IS NOT NULL").selectExpr("CAST(id AS long) id", "text").mapInArrow(pieces, "term string, block long, packed binary")
    return made.groupBy("block").applyInArrow(whole, "term string, block long, postings long, packed binary")
