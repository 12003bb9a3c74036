"""Best-fit packing (operator 3): bin completion with branch and bound over a census of lengths.

Pieces of the same length are interchangeable, so the corpus enters the search
as its exact count of pieces per length: at most ``capacity`` numbers, whatever
its size.  The search returns fillings with multiplicities; pieces are then
dealt to them by their rank among the pieces of their length, which two-level
counts give without bringing a length to one task.

The incumbent is best-fit decreasing on the census.  While it needs more
sequences than the lower bound, a depth-first search takes the largest piece left
and enumerates the undominated fillings of the rest of its sequence, the fullest
first, each as often as it goes and every lesser number of times; a branch ends
where its waste, or the lower bound of what it leaves, cannot beat the incumbent.
Fillings come one at a time from the sums that the pieces left can reach, so none is
left out and no list of them is held.  ``effort`` (nodes, and 64 candidate fillings
each, after the first way down) is the search's only limit; it bounds time, every
piece is packed either way, and with ``effort=None`` the result is the least number.

Null texts are empty; an empty document is its closing id alone.  Repeated rows
(and copies a mix made) are packed as often as they occur.  Empty tables give no
rows.  A very long text is encoded whole and cut into pieces.  Pieces that tie in
length are dealt by id, piece, start and checksum, so reruns agree.  Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.llm.bpe import bpe
from sparkshelf.llm.ragged import Texts, cut, map_slices, small_batches
from sparkshelf.llm.token_counts import vocabulary

CAPACITY, END = 2048, 0
EFFORT, DUALS = 3000, 12

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit_decreasing(census: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Each piece, longest first, into the fullest sequence that takes it; equal sequences are handled together."""
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, many: int, filling: Filling) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append([many, filling])

    for length in sorted(census, reverse=True):
        left = census[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                put(*((capacity - fit * length, left // fit, ((length, fit),)) if left >= fit else (capacity - left * length, 1, ((length, left),))))
                left -= fit * (left // fit) if left >= fit else left
                continue
            room = rooms[at]
            group = open_by_room[room][-1]
            fit = min(room // length, left)
            many = min(group[0], left // fit)
            put(room - fit * length, many, (*group[1], (length, fit)))
            left -= many * fit
            group[0] -= many
            if not group[0]:
                open_by_room[room].remove(group)
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.remove(room)
    return [(many, filling) for groups in open_by_room.values() for many, filling in groups]


def lower_bound(census: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bounds that pieces over half a sequence give."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in census.items():
        counts[length] = n
    volume = counts * np.arange(capacity + 1)
    many, total = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(volume))
    bound = -(-int(total[-1]) // capacity)
    half = capacity // 2
    k = np.arange(half + 1)
    large, middle = many[-1] - many[capacity - k + 1], many[capacity - k + 1] - many[half + 1]
    small = total[half + 1] - total[k] - (middle * capacity - (total[capacity - k + 1] - total[half + 1]))
    return max(bound, int((large + middle + np.maximum(0, -(-small // capacity))).max()))


def dual_bound(census: dict[int, int], capacity: int) -> int:
    """The largest bound that rounded-down multiples (dual feasible functions) give, small pieces below each cut taken as nothing and large ones as whole."""
    lengths, counts = np.array(list(census), np.int64), np.array(list(census.values()), np.int64)
    bound = 0
    for cut_off in range(capacity // 2 + 1):
        size = np.where(lengths > capacity - cut_off, capacity, np.where(lengths < cut_off, 0, lengths))
        for k in range(1, DUALS + 1):
            q, r = np.divmod((k + 1) * size, capacity)
            bound = max(bound, -(-int((counts * np.where(r, q * capacity, k * size)).sum()) // (k * capacity)))
    return bound


class Fillings:
    """The fillings that pieces, ``counts`` of the ascending ``lengths``, can give.

    ``reach[i]`` has bit s set where pieces of the first i lengths add up to s.
    """

    def __init__(self, lengths: list[int], counts: list[int], capacity: int):
        self.lengths, self.counts, self.capacity = lengths, counts, capacity
        self.most, self.reach = [0] * len(lengths), [1] * (len(lengths) + 1)
        self.seen = 0
        self.follow(range(len(lengths)))

    def follow(self, changed) -> None:
        """To be called after the counts at these places have changed."""
        low = len(self.lengths)
        for i in changed:
            most = min(self.counts[i], self.capacity // self.lengths[i])
            if most != self.most[i]:
                self.most[i], low = most, min(low, i)
        every = (1 << self.capacity + 1) - 1
        for i in range(low, len(self.lengths)):
            sums, left, step = self.reach[i], self.most[i], 1
            while left:
                n = min(left, step)
                sums |= sums << n * self.lengths[i] & every
                left, step = left - n, 2 * step
            self.reach[i + 1] = sums

    def exact(self, i: int, total: int, chosen: Filling = ()):
        """Fillings of exactly ``total`` by the first i lengths, longest pieces first, as (place, how many)."""
        self.seen += 1
        if not total:
            yield chosen
            return
        i = min(i, bisect_right(self.lengths, total))
        while i and self.reach[i] >> total & 1:
            i -= 1
            x = self.lengths[i]
            for n in range(min(self.most[i], total // x), 0, -1):
                if self.reach[i] >> total - n * x & 1:
                    yield from self.exact(i, total - n * x, (*chosen, (i, n)))

    def left_out(self, inside: dict[int, int], low: int, high: int) -> bool:
        """Whether a piece of a length from low to high stays outside."""
        for i in range(bisect_left(self.lengths, low), bisect_right(self.lengths, high)):
            if self.counts[i] > inside.get(i, 0):
                return True
        return False

    def dominated(self, filling: Filling, slack: int) -> bool:
        """Whether a piece left out could come in, in place of nothing, of one shorter piece or of two."""
        inside = dict(filling)
        have = sorted(self.lengths[i] for i in inside)
        twice = {self.lengths[i] for i, n in filling if n > 1}
        pairs = {x + y for k, x in enumerate(have) for y in have[k:] if x != y or x in twice}
        return self.left_out(inside, 1, slack) or any(self.left_out(inside, x + 1, x + slack) for x in have) or any(self.left_out(inside, x, x + slack) for x in pairs)

    def undominated(self, room: int, allowed):
        """(slack, filling), the fullest first, up to a slack of ``allowed()``, which may fall meanwhile."""
        slack = 0
        while slack <= min(room, allowed()):
            if self.reach[-1] >> room - slack & 1:
                for filling in self.exact(len(self.lengths), room - slack):
                    if not self.dominated(filling, slack):
                        yield slack, filling
            slack += 1


def pack_census(census: dict[int, int], capacity: int = CAPACITY, effort: int | None = EFFORT) -> list[tuple[int, Filling]]:
    """Fillings with multiplicities that use up the census in as few sequences as the search finds; the least number with ``effort`` None."""
    census = {x: n for x, n in census.items() if n}
    best = best_fit_decreasing(census, capacity)
    best_n, bound = sum(m for m, _ in best), lower_bound(census, capacity)
    if best_n > bound:
        bound = max(bound, dual_bound(census, capacity))
    lengths = sorted(census)
    counts = [census[x] for x in lengths]
    total = sum(x * n for x, n in census.items())
    fillings = Fillings(lengths, counts, capacity)
    path: list[tuple[int, Filling]] = []  # of places, not lengths
    used = waste = nodes = 0
    way_back = None  # what had been spent when the search first turned back

    def change(sign: int, many: int, filling: Filling) -> None:
        for i, n in filling:
            counts[i] += sign * many * n
        fillings.follow(i for i, _ in filling)

    def allowed() -> int:
        return (best_n - 1) * capacity - total - waste

    def branches(top: int):
        """Slack, how many times, and the filling with the largest piece, whose count stands one lower while this goes on."""
        for slack, filling in fillings.undominated(capacity - lengths[top], allowed):
            need = dict(filling)
            most = min([counts[i] // n for i, n in filling if i != top] + [(counts[top] + 1) // (need.get(top, 0) + 1)])
            need[top] = need.get(top, 0) + 1
            for many in range(most, 0, -1):
                if slack * many <= allowed():
                    yield slack, many, tuple(sorted(need.items(), reverse=True))

    # a frame: the place of its largest piece, its branches, and the branch taken
    stack: list[list] = []
    entering = best_n > bound
    while best_n > bound and (entering or stack) and (effort is None or way_back is None or nodes + fillings.seen // 64 < effort + way_back):
        if entering:
            nodes += 1
            top = max((i for i, n in enumerate(counts) if n), default=-1)
            if top < 0:
                best, best_n = [(many, tuple((lengths[i], n) for i, n in filling)) for many, filling in path], used
            elif allowed() >= 0 and used + lower_bound({lengths[i]: n for i, n in enumerate(counts) if n}, capacity) < best_n:
                change(-1, 1, ((top, 1),))
                stack.append([top, branches(top), None])
            entering = False
            continue
        top, options, taken = stack[-1]
        if taken:
            way_back = nodes + fillings.seen // 64 if way_back is None else way_back
            slack, many, filling = taken
            change(1, many, filling)
            change(-1, 1, ((top, 1),))
            used, waste = used - many, waste - slack * many
            path.pop()
        stack[-1][2] = taken = next(options, None)
        if taken is None:
            change(1, 1, ((top, 1),))
            stack.pop()
            continue
        slack, many, filling = taken
        change(1, 1, ((top, 1),))
        change(-1, many, filling)
        used, waste = used + many, waste + slack * many
        path.append((many, filling))
        entering = True
    return best


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and ``end``, cut only where longer than ``capacity``."""

    def work(part: pa.RecordBatch):
        ids, counts = bpe(vocabulary(tokenizer)).encode(Texts(part.column("text")))
        ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")  # after each document's
        sizes = counts + 1
        many = -(-sizes // capacity)
        rows = np.repeat(np.arange(len(sizes)), many)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        first = sizes - (many - 1) * capacity  # the first piece takes what the full ones leave
        start = np.where(piece, first[rows] + (piece - 1) * capacity, 0)
        length = np.where(piece, capacity, first[rows])
        at = (np.cumsum(sizes) - sizes)[rows] + start
        crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        return {"doc_id": part.column("doc_id").take(pa.array(rows)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64)}

    return map_slices(docs.selectExpr(f"CAST(`{id_col}` AS long) doc_id", f"`{text_col}` text"), "text", work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, effort: int | None = EFFORT, tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut_pieces = cut(pieces(docs, id_col, text_col, capacity, tokenizer, end).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    cells = cut(cut_pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    census = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    runs, ranks, first = [], dict.fromkeys(census, 0), 0
    for many, filling in pack_census(census, capacity, effort):
        offset = 0
        for length, n in filling:
            runs.append((length << 44 | ranks[length], ranks[length], first, n, offset))
            ranks[length] += many * n
            offset += n * length
        first += many
    if not runs:
        runs = [(0, 0, 0, 1, 0)]
    table = spark.sparkContext.broadcast(np.array(sorted(runs), np.int64).T)  # its rows follow the lengths, not the corpus
    before = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = (
        cut_pieces.withColumn("_place", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")))
        .join(before, ["length", "_bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_place") - 1).alias("_rank"))
    )

    def deal(batches):
        keys, ranks, firsts, many, offsets = table.value
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            q, r = np.divmod(rank - ranks[at], many[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(firsts[at] + q), pa.array(offsets[at] + r * length)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
