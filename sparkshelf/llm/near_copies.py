"""MinHash near-dedup with SetSketch registers (operator 4).

Documents link where the Jaccard similarity of their word-shingle sets reaches a
threshold; components of links are the groups.

* Each text gives the 128-bit key of its set and ``REGISTERS`` SetSketch
  registers ``floor(1 - log_b(min Exp(a)))``, cut to a byte.  Equal sets have
  equal keys and become one class, so exact copies never meet as pairs.
* Classes that agree in all registers of a band share a bucket.  In each bucket
  every class is paired with one pivot, the least by a hash of its key, so that
  the buckets of a group share pivots, and a class meets few of them.
* Pairs are judged by the joint likelihood of their registers given both exact
  set sizes, and dropped only if the threshold lies ``DOUBT`` below the best
  similarity in log-likelihood (six standard deviations).
* Classes joined by allowed pairs form a cluster, and all classes of a cluster
  meet, in blocks, by their exact sets.  In clusters of more than ``LARGE_CLUSTER``
  classes each class is verified with its likeliest partner first, and only
  classes of different components meet.
* Classes of different clusters that share a bucket are judged by registers (small
  buckets by a join, large ones in blocks) and verified.  A task that compares
  blocks gives links or allowed pairs only, so no row is made for each pair of a
  group.

Null and blank texts have empty sets and link with nothing; a text with fewer
words than a shingle is one shingle.  Null ids take part and never name a group
that has another id.  Repeated rows are rows of one class.  A very long text is
worked on whole.  Pivots that tie in their hash are ordered by key, so reruns agree.
An empty table gives no rows; other columns, whatever their names, are left alone.

``SMALL_BUCKET``, ``LARGE_CLUSTER`` and ``PARTITION_ROWS`` choose between plans that
give the same links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkshelf.llm.ragged import U64, Texts, cut, map_slices, mix64, slices, small_batches

WIDTH, THRESHOLD = 2, (80, 100)
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, DOUBT = 1.1, 20.0, 18.0
SMALL_BUCKET, BLOCK, PAIRS, LARGE_CLUSTER, PARTITION_ROWS = 12, 256, 8192, 2048, 200_000
_SEEDS = mix64(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SPREAD = U64(0xD6E8FEB86659FD93)


def shingle_sets(texts: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, ascending within each, and how many each has."""
    starts, ends = texts.words()
    words = texts.hashes(starts, ends, fold=True)
    at = np.searchsorted(starts, texts.bounds)
    counts = np.diff(at)
    row = np.repeat(np.arange(texts.n), counts)
    rolled = np.zeros(len(words), U64)
    last = at[1:][row]  # past the text's last word
    place = np.arange(len(words))
    for i in range(width):
        take = np.minimum(place + i, len(words) - 1)
        part = mix64(words[take] + U64(2 * i + 1))
        rolled = rolled * U64(0x9FB21C651E98DF25) + np.where(place + i < last, part, U64(0))
    # whole shingles, or the first place of a text that is shorter than one
    keep = (place + width <= last) | ((counts[row] < width) & (place == at[:-1][row]))
    row, rolled = row[keep], mix64(rolled[keep])
    order = np.lexsort((rolled, row))
    row, rolled = row[order], rolled[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (rolled[1:] != rolled[:-1])
    return rolled[new], np.bincount(row[new], minlength=texts.n)


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128-bit keys of sets; None for empty ones."""
    full = np.flatnonzero(counts)
    keys: list[bytes | None] = [None] * len(counts)
    if len(full):
        firsts = (np.cumsum(counts) - counts)[full]
        a = np.add.reduceat(mix64(hashes ^ U64(0x51ED270B9B6C1B35)), firsts)
        b = np.add.reduceat(mix64(hashes + U64(0x632BE59BD9B4E019)), firsts)
        both = np.stack([mix64(a + counts[full].astype(U64)), b], 1).astype(">u8").tobytes()
        for k, i in enumerate(full.tolist()):
            keys[i] = both[16 * k : 16 * k + 16]
    return keys


def registers(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """REGISTERS bytes for each set, zeros for empty ones."""
    out = np.zeros((len(counts), REGISTERS), np.uint8)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    firsts = (np.cumsum(counts) - counts)[full]
    for i in range(REGISTERS):
        x = hashes * _SEEDS[i]
        x ^= x >> U64(32)
        x *= _SPREAD
        x ^= x >> U64(29)
        least = np.minimum.reduceat(x, firsts).astype(np.float64) + 1
        h = -np.log1p(-np.minimum(least / 2.0**64, 1 - 2.0**-53)) / RATE
        out[full, i] = np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, 255).astype(np.uint8)
    return out


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, doubt: float = DOUBT) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood Jaccard similarity of register rows, and whether the threshold may be reached."""
    na, nb = na.astype(float), nb.astype(float)
    u, v = na / (na + nb), nb / (na + nb)
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - more - less

    def p(x):  # the chance that one register exceeds the other
        return np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1.0)

    def value(j):
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + equal * np.log(np.maximum(1 - x - y, 1e-12))

    top = np.minimum(na, nb) / np.maximum(na, nb)
    low, high = np.zeros(len(na)), top.copy()
    for _ in range(30):  # the likelihood is concave
        x, y = low + (high - low) / 3, high - (high - low) / 3
        right = value(x) < value(y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    best = (low + high) / 2
    able = top >= threshold - 1e-9
    return best, able & ((best >= threshold) | (value(np.full(len(na), threshold)) >= value(best) - doubt))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def work(part: pa.RecordBatch):
        hashes, counts = shingle_sets(Texts(part.column("text")), width)
        sketch = registers(hashes, counts).tobytes()
        return {"doc_id": part.column("doc_id"), "n_shingles": counts.astype(np.int64), "key": pa.array(set_keys(hashes, counts), pa.binary()), "regs": [sketch[REGISTERS * i : REGISTERS * (i + 1)] for i in range(len(counts))]}

    return map_slices(docs.selectExpr(f"CAST(`{id_col}` AS long) doc_id", f"`{text_col}` text"), "text", work, "doc_id long, n_shingles long, key binary, regs binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """key, band (a hash of its number and registers), place (its number): a row per class and band."""

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(U64)
            band = np.arange(1, BANDS + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                band = mix64(band * U64(0x100000001B3) + regs[:, :, r])
            keys = b.column("key").take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(band.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows))], ["key", "band", "place"])

    return classes.select("key", "regs").mapInArrow(work, "key binary, band long, place int")


def _judged(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b, likeness of the pairs that the registers allow."""
    left, right = (classes.select(F.col("key").alias(x), F.col("regs").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")

    def work(batches):
        for t in batches:
            if not t.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            j, keep = likely(ra, rb, np.asarray(t.column("na")), np.asarray(t.column("nb")), threshold)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep), pa.array(j).filter(keep)], ["a", "b", "likeness"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(work, "a binary, b binary, likeness double")


def _keyed_texts(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """key, text of non-empty sets, each key once in a partition."""

    def work(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys = set_keys(*shingle_sets(Texts(part.column("text")), width))
                new = []
                for i, k in enumerate(keys):
                    if k is not None and k not in seen:
                        seen.add(k)
                        new.append(i)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), part.column("text").take(pa.array(new))], ["key", "text"])

    return docs.selectExpr(f"`{text_col}` text").mapInArrow(work, "key binary, text string")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "tb"):
                sides = []
                for c in ("ta", "tb"):
                    hashes, counts = shingle_sets(Texts(part.column(c)), width)
                    sides.append((hashes, np.append(0, np.cumsum(counts))))
                good = []
                for i in range(part.num_rows):
                    x, y = (h[at[i] : at[i + 1]] for h, at in sides)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(threshold[1] * shared >= threshold[0] * (len(x) + len(y) - shared))
                good = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], ["a", "b"])

    left, right = (texts.select(F.col("key").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(work, "a binary, b binary")


def _across_blocks(marked: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b of different clusters that share a bucket and that their registers allow, each pair once.

    ``marked``: band, place, key, cluster, n (classes in the bucket).
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = marked.withColumn("own", F.pmod(F.xxhash64("key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("band", "place", "key", "cluster", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).join(classes.select("key", "regs", "n_shingles"), "key")

    def compare(table):
        out_a, out_b = [], []
        keys, clusters = table.column("key").to_pylist(), table.column("cluster").to_pylist()
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)[order]
        size, own = np.asarray(table.column("n_shingles"))[order], np.asarray(table.column("own"))[order]
        x, y, place = table.column("x")[0].as_py(), table.column("y")[0].as_py(), table.column("place")[0].as_py()
        cluster = _numbered(clusters)[order]
        keys = [keys[i] for i in order]
        rows = max(1, PAIRS // len(keys))
        for first in range(0, len(keys), rows):
            mine = np.arange(first, min(first + rows, len(keys)))
            # two of one block meet where both blocks are theirs, others where the blocks differ
            meet = (cluster[mine, None] != cluster) & (np.arange(len(keys)) > mine[:, None])
            if x != y:
                meet &= own[mine, None] != own
            i, j = np.nonzero(meet)
            i += first
            agree = (regs[i] == regs[j]).reshape(-1, BANDS, ROWS).all(2)
            once = agree.argmax(1) == place  # only in the first bucket that they share
            i, j = i[once], j[once]
            if len(i):
                _, keep = likely(regs[i], regs[j], size[i], size[j], threshold)
                out_a += [keys[k] for k in i[keep].tolist()]
                out_b += [keys[k] for k in j[keep].tolist()]
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return dealt.groupBy("band", "x", "y").applyInArrow(compare, "a binary, b binary")


def _numbered(values: list) -> np.ndarray:
    number = {v: i for i, v in enumerate(dict.fromkeys(values))}
    return np.array([number[v] for v in values], np.int64)


def _within_clusters(members: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) between components of a cluster, found by the exact sets of all its classes.

    ``members``: cluster, label, key.  Components of ``BLOCK`` classes or more have
    blocks of their own, smaller ones share blocks; blocks meet in pairs, but not
    two of one component.  A task gives at most one link for each two components.
    """
    sizes = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    totals = sizes.groupBy("cluster").agg(F.sum(F.when(F.col("c") < BLOCK, F.col("c")).otherwise(0)).alias("rest"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("cluster", "rest")
    spread = F.xxhash64("key")
    large = F.col("c") >= BLOCK
    placed = members.join(sizes, ["cluster", "label"]).join(totals, "cluster")
    placed = placed.select(
        "cluster", "label", "key", F.when(large, F.col("label")).alias("owner"),
        F.concat_ws("-", F.when(large, F.hex("label")).otherwise(""), F.pmod(spread, F.when(large, F.ceil(F.col("c") / BLOCK)).otherwise(F.ceil(F.col("rest") / BLOCK))).cast("string")).alias("block"),
    )
    placed = cut(placed)
    blocks = cut(placed.select("cluster", "block", "owner").distinct())
    x, y = (blocks.select("cluster", F.col("block").alias(n), F.col("owner").alias(f"o{n}")) for n in "xy")
    meets = x.join(y, "cluster").where("x <= y AND (ox IS NULL OR oy IS NULL OR ox != oy)").select("cluster", "x", "y")
    sides = meets.select("cluster", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    dealt = placed.join(sides, ["cluster", "block"]).join(texts, "key").select("cluster", "x", "y", "block", "label", "key", "text")

    def compare(table):
        keys, block = table.column("key").to_pylist(), np.array(table.column("block").to_pylist())
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        label = _numbered(table.column("label").to_pylist())
        hashes, counts = shingle_sets(Texts(table.column("text")), width)
        ids = np.unique(hashes, return_inverse=True)[1]
        firsts = np.cumsum(counts) - counts
        marked = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        joined = np.arange(label.max() + 1)  # components put together here
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out_a, out_b = [], []
        for i in left.tolist():
            others = right[joined[label[right]] != joined[label[i]]]
            if not len(others):
                continue
            mine = ids[firsts[i] : firsts[i] + counts[i]]
            marked[mine] = True
            shared = np.add.reduceat(marked[ids], firsts)[others]
            marked[mine] = False
            near = others[threshold[1] * shared >= threshold[0] * (counts[i] + counts[others] - shared)]
            for j in near.tolist():
                if joined[label[i]] != joined[label[j]]:
                    joined[joined == joined[label[j]]] = joined[label[i]]
                    out_a.append(keys[i])
                    out_b.append(keys[j])
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return dealt.groupBy("cluster", "x", "y").applyInArrow(compare, "a binary, b binary")


def _forest(edges: DataFrame) -> DataFrame:
    """key, label: the least key that the edges (a, b) of its own partition reach from it."""

    def work(batches):
        seen = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not seen:
            return
        table = pa.concat_tables(seen).combine_chunks()
        ends = pa.concat_arrays([table.column(c).chunk(0) for c in "ab"]).dictionary_encode()
        order = pa.compute.array_sort_indices(ends.dictionary)
        keys = ends.dictionary.take(order)
        rank = np.empty(len(keys), np.int64)
        rank[np.asarray(order)] = np.arange(len(keys))
        a, b = rank[np.asarray(ends.indices)].reshape(2, -1)
        root = np.arange(len(keys))
        while True:  # every root takes the least root that an edge leads to, then all point to where that points
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([keys, keys.take(pa.array(root))], ["key", "label"])

    return edges.mapInArrow(work, "key binary, label binary")


def components(links: DataFrame) -> DataFrame:
    """key, label (least key reachable) of every key in links (a, b).

    Links are contracted: each partition's links become a forest, which is the
    result where one partition holds them all.  Otherwise each key takes its least
    label, then the label of that, and links go on between what is pointed at, so
    that each round leaves far fewer.
    """
    labels = None
    while True:
        edges, parts = _settled(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        forest = _forest(edges)
        if parts == 1:
            point = cut(forest)
        else:
            stars = cut(forest)
            least = stars.groupBy("key").agg(F.min("label").alias("label"))
            point = cut(least.join(least.select(F.col("key").alias("label"), F.col("label").alias("far")), "label").select("key", F.col("far").alias("label")))
            links = stars.where("key != label")
            for x, c in (("a", "key"), ("b", "label")):
                links = links.join(point.select(F.col("key").alias(c), F.col("label").alias(x)), c).drop(c)
        if labels is None:
            labels = point
        else:
            onward = point.select(F.col("key").alias("label"), F.col("label").alias("next"))
            labels = cut(labels.join(onward, "label", "left").select("key", F.coalesce("next", "label").alias("label")))
        if parts == 1:
            return labels


def _settled(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpointed, in as few partitions as its counted rows need; how many those are."""
    df = cut(df)
    parts = max(1, -(-df.count() // PARTITION_ROWS))
    return df.coalesce(parts), parts


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, key) and classes (key, label, first_id, component_id)."""
    least = threshold[0] / threshold[1]
    small_batches(docs.sparkSession)
    rows = cut(signatures(docs, id_col, text_col, width))
    classes = cut(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")))
    buckets = _buckets(classes)
    pivots = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key"), F.col("key").alias("key")))["key"].alias("pivot")).where("n > 1").drop("n")
    met = buckets.join(pivots, "band").where("key != pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
    judged = cut(_judged(met, classes, least))
    # classes that share a bucket with another: the only texts that will be needed
    shared = cut(buckets.join(pivots.select("band"), "band").select("key", "band", "place"))
    some = shared.select("key").distinct()
    texts = _keyed_texts(docs, text_col, width).join(some, "key").groupBy("key").agg(F.first("text").alias("text"))
    texts = cut(texts)

    # classes joined by pairs that the registers allow
    clusters = components(judged).withColumnRenamed("label", "cluster")
    large = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_CLUSTER).select("cluster")
    members = clusters.select("cluster", F.col("key").alias("label"), "key")
    links = None
    if large.head(1):
        # there, each class with its likeliest partner first, so that few components are left to compare
        inside = judged.join(clusters.select(F.col("key").alias("a"), "cluster"), "a").join(large, "cluster", "left_semi")
        ends = inside.select(F.col("a").alias("key"), "a", "b", "likeness").union(inside.select("b", "a", "b", "likeness"))
        first = ends.groupBy("key").agg(F.max(F.struct("likeness", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
        links = cut(_verified(first, texts, width, threshold))
        members = clusters.join(components(links), "key", "left").select("cluster", F.coalesce("label", "key").alias("label"), "key")
    found = _within_clusters(members, texts, width, threshold)
    links = found if links is None else links.union(found)
    # classes of different clusters that share a bucket
    marked = shared.join(clusters, "key", "left").withColumn("cluster", F.coalesce("cluster", "key"))
    mixed = marked.groupBy("band").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y"), F.count(F.lit(1)).alias("n")).where("x != y").select("band", "n")
    marked = cut(marked.join(mixed, "band"))
    a, b = (marked.where(F.col("n") <= SMALL_BUCKET).select("band", F.col("key").alias(x), F.col("cluster").alias(f"c{x}")) for x in "ab")
    rest = a.join(b, "band").where("a < b AND ca != cb").select("a", "b").distinct()
    large = _across_blocks(marked.where(F.col("n") > SMALL_BUCKET), classes, least)
    rest = cut(_judged(rest, classes, least).select("a", "b").union(large).distinct())
    labels = components(links.union(_verified(rest, texts, width, threshold)))

    grouped = classes.select("key", "first_id").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = grouped.join(labels.select("key"), "key", "left_semi").groupBy("label").agg(F.min("first_id").alias("component_id"))
    grouped = grouped.join(named, "label", "left").select("key", "label", "first_id", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.drop("regs"), cut(grouped)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows, classes = near_groups(docs, id_col, text_col, width, threshold)
    out = rows.join(classes.select("key", "component_id"), "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents, all columns, one of each group: that with the least id (any one of repeated rows); empty sets all stay."""
    from pyspark.sql import Window

    _, classes = near_groups(docs, id_col, text_col, width, threshold)
    winners = classes.where(F.when(F.col("component_id").isNull(), F.col("key") == F.col("label")).otherwise(F.col("first_id").eqNullSafe(F.col("component_id")))).select(F.col("key").alias("_key"), F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("_id"))
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def work(batches):
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                keys = set_keys(*shingle_sets(Texts(part.column(at)), width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], [*part.schema.names, "_key"])

    schema = plain.withColumn("_key", F.lit(b"").cast("binary")).schema
    schema["_key"].nullable = True
    keyed = plain.mapInArrow(work, schema).withColumn("_id", F.coalesce(F.col(f"c{names.index(id_col)}").cast("string"), F.lit("")))
    empty = keyed.where("_key IS NULL")
    full = keyed.where("_key IS NOT NULL").join(winners, ["_key", "_id"], "left_semi")
    full = full.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_id").orderBy(F.lit(0)))).where("_n = 1").drop("_n")
    return full.unionByName(empty).drop("_key", "_id").toDF(*names)


#: The same as ``near_copies`` with its defaults, for DuckDB, by all pairs that share a shingle: for small tables.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN [w[CAST(i AS BIGINT)] || ' ' || w[CAST(i + 1 AS BIGINT)] FOR i IN range(1, len(w))] ELSE w END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS (SELECT s.doc_id, s.s, n.n FROM s JOIN n USING (doc_id)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
one AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""
