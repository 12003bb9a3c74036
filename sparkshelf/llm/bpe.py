"""Byte-level BPE over ragged arrays: pre-tokens by code-point classes, merges by rank-synchronous array passes.

``Bpe(path)`` reads a tokenizers ``.json`` file (byte-level BPE, one optional
special token) and gives, for a slice of texts, the ids that the library gives
with ``add_special_tokens=False``.

Pre-tokens are found for a whole slice at once.  Each distinct one is encoded
once and remembered (``MEMORY_WORDS`` at most, then forgotten and refilled), so
the merges run only over pre-tokens that are new to the worker: all of them lie
in one ragged array, and every pass applies, in each sequence, its lowest-ranked
pair at all its places.  A pre-token over ``LONG`` bytes (a run of base64, say) is
merged by itself in the same order, but a pass touches only the places of its
rank and their neighbours, so its time follows its length and not passes times length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np

from sparkshelf.llm.ragged import U64, Texts, mix64, ragged, span_hashes

MEMORY_WORDS, LONG = 1 << 20, 1024
_SLOTS = 21
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and 64-bit value of every code point."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = _LETTER
        elif k == "N":
            kind[c] = _NUMBER
    # Unicode White_Space
    kind[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return kind, mix64(np.arange(1, 0x110001, dtype=U64) * U64(0x9E3779B97F4A7C15))


def pre_tokens(chars: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for code points ``chars`` of texts that begin or end where ``edge`` (one longer) is true.

    The pattern: a contraction of 's 't 're 've 'm 'll 'd; letters, digits or other
    signs, each with at most one blank before; white space, whose last
    character before a visible one stands apart.
    """
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[0][chars]
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    start[0] = start[n] = True
    # the end of white space before something visible
    ends = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n]) + 1
    start[ends - 1] = True
    start[ends[chars[ends - 1] == 0x20]] = False
    # contractions: a single apostrophe that starts a pre-token, then letters
    at = np.flatnonzero((chars[: n - 1] == 0x27) & start[: n - 1] & (kind[1:] == _LETTER) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(at):
        first = chars[at + 1]
        short = np.isin(first, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        two = np.minimum(at + 2, n - 1)
        second = np.where((at + 2 < n) & ~edge[two], chars[two], 0)
        long = ((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        start[at[short | long] + 1] = False
        start[at[short] + 2] = True
        start[at[long] + 3] = True
    return np.flatnonzero(start[:n])


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        special = [t for t in model.get("added_tokens", []) if t.get("special")]
        self.special = (special[0]["content"].encode(), special[0]["id"]) if special else None
        # the printable stand-ins of bytes in byte-level vocabularies
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.bytes = np.array([vocab[stand[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pairs = [(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in keys]
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.slot_key, self.slot_word = np.zeros(1 << _SLOTS, U64), np.zeros(1 << _SLOTS, np.int32)
        self.lengths, self.places, self.ids, self.used = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0
        if self.special:
            self._remember([0], np.array([1]), np.array([self.special[1]]))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of surviving symbols by word, and all symbols, of words encoded together; words over LONG bytes one at a time."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._merge_batch(words)
        short = [w for w in words if len(w) <= LONG]
        counts, symbols = self._merge_batch(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts, out, at, k = np.append(0, np.cumsum(counts)), [], 0, set(long)
        for i, w in enumerate(words):
            if i in k:
                out.append(self._merge_long(w))
            else:
                out.append(symbols[parts[at] : parts[at + 1]])
                at += 1
        return np.array([len(x) for x in out], np.int64), np.concatenate(out)

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The symbols of one word: places wait under their pair's rank, the lowest rank's merge together, and only places next to them are looked at again."""
        symbols = self.bytes[np.frombuffer(word, np.uint8)]
        n, none = len(symbols), len(self.keys)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n + 1, bool)
        alive[n] = False
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            key = symbols[places] << 32 | symbols[after[places]]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            known = self.keys[at] == key
            places, rank = places[known], self.ranks[at[known]]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            for part in np.split(places, np.flatnonzero(np.diff(rank)) + 1) if len(places) else ():
                r = int(rank[0])
                rank = rank[len(part) :]
                if r not in waiting:
                    heapq.heappush(heap, r)
                    waiting[r] = []
                waiting[r].append(part)

        wait(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(r)))
            left, right = self.pairs[r]
            places = places[alive[places]]
            places = places[after[places] < n]
            places = places[(symbols[places] == left) & (symbols[after[places]] == right)]
            if not len(places):
                continue
            if left == right:  # of a a a, the first two merge
                chain = np.flatnonzero(np.append(True, after[places[:-1]] != places[1:]))
                place = np.arange(len(places)) - np.repeat(chain, np.diff(np.append(chain, len(places))))
                places = places[place % 2 == 0]
            gone = after[places]
            symbols[places] = self.made[r]
            alive[gone] = False
            after[places] = after[gone]
            inner = places[after[places] < n]
            before[after[inner]] = inner
            wait(np.unique(np.concatenate([inner, before[places][before[places] >= 0]])))
        return symbols[alive[:n]]

    def _merge_batch(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.array([len(w) for w in words], np.int64)
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        rows, _ = ragged(counts)
        out_counts = np.zeros(len(words), np.int64)
        done_rows, done_symbols = [], []
        while len(symbols):
            same = rows[1:] == rows[:-1]
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], len(self.keys))
            rank = np.append(rank, len(self.keys))  # of the pair that begins at each symbol
            firsts = np.flatnonzero(np.append(True, ~same))
            lowest = np.minimum.reduceat(rank, firsts)
            sizes = np.diff(np.append(firsts, len(symbols)))
            active = np.repeat(lowest < len(self.keys), sizes)
            if not active.all():  # finished sequences leave
                done_rows.append(rows[~active])
                done_symbols.append(symbols[~active])
                keep = np.flatnonzero(active)
                rank, low, rows, symbols = rank[keep], np.repeat(lowest, sizes)[keep], rows[keep], symbols[keep]
            else:
                low = np.repeat(lowest, sizes)
            if not len(symbols):
                break
            hits = np.flatnonzero(rank == low)
            chain = np.flatnonzero(np.append(True, np.diff(hits) != 1))  # of a a a, the first two merge
            place = np.arange(len(hits)) - np.repeat(chain, np.diff(np.append(chain, len(hits))))
            hits = hits[place % 2 == 0]
            symbols[hits] = self.made[rank[hits]]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            symbols, rows = symbols[stay], rows[stay]
        if done_rows:
            rows, symbols = np.concatenate(done_rows), np.concatenate(done_symbols)
            symbols = symbols[np.argsort(rows, kind="stable")]
            out_counts = np.bincount(rows, minlength=len(words))
        return out_counts, symbols

    def _remember(self, hashes: list[int], counts: np.ndarray, symbols: np.ndarray) -> None:
        first, new = len(self.known), len(hashes)
        while first + new > len(self.lengths):
            self.lengths, self.places = np.resize(self.lengths, 2 * len(self.lengths)), np.resize(self.places, 2 * len(self.places))
        while self.used + len(symbols) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.lengths[first : first + new] = counts
        self.places[first : first + new] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(symbols)] = symbols
        self.used += len(symbols)
        self.known.update(zip(hashes, range(first, first + new), strict=True))

    def words(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The remembered number of every pre-token in order, and how many each text has."""
        raw = texts.data.tobytes()
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((texts.data & 0xC0) != 0x80)
        bounds = np.searchsorted(lead, texts.bounds)
        edge = np.zeros(len(chars) + 1, bool)
        edge[bounds] = True
        specials = []
        if self.special and self.special[0] in raw:
            name = self.special[0]
            at = raw.find(name)
            while at >= 0:
                a = int(np.searchsorted(lead, at))
                b = a + len(name.decode())
                if not edge[a + 1 : b].any():  # not across two texts
                    edge[a] = edge[b] = True
                    specials.append((a, b))
                    at = raw.find(name, at + len(name))
                else:
                    at = raw.find(name, at + 1)
        starts = pre_tokens(chars, edge)
        ends = np.append(starts[1:], len(chars)) if len(starts) else starts
        hashes = span_hashes(_classes()[1][chars], starts, ends)
        if specials:
            a, b = np.array(specials).T
            within = np.searchsorted(a, starts, "right") - 1
            inside = (within >= 0) & (starts < b[np.maximum(within, 0)])
            head = inside & (starts == a[np.maximum(within, 0)])
            keep = ~inside | head
            hashes = np.where(head, U64(0), hashes)[keep]
            starts, ends = starts[keep], ends[keep]
        counts = np.diff(np.searchsorted(starts, bounds))
        if len(self.known) > MEMORY_WORDS:
            self.forget()
        slot = (hashes >> U64(64 - _SLOTS)).astype(np.int64)
        number = self.slot_word[slot]
        missed = np.flatnonzero(self.slot_key[slot] != hashes)
        if len(missed):
            unique, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            listed = unique.tolist()
            new = [k for k, h in enumerate(listed) if h not in self.known]
            if new:
                at = missed[first[new]]
                where = np.append(lead, len(raw))
                spans = zip(where[starts[at]].tolist(), where[ends[at]].tolist(), strict=True)
                self._remember([listed[k] for k in new], *self.merge([raw[x:y] for x, y in spans]))
            found = np.array([self.known[h] for h in listed], np.int32)
            number[missed] = found[back]
            into = (unique >> U64(64 - _SLOTS)).astype(np.int64)
            self.slot_key[into], self.slot_word[into] = unique, found
        return number, counts

    def count(self, texts: Texts) -> np.ndarray:
        """Tokens of each text."""
        number, counts = self.words(texts)
        total = np.zeros(len(number) + 1, np.int64)
        np.cumsum(self.lengths[number], out=total[1:])
        at = np.append(0, np.cumsum(counts))
        return total[at[1:]] - total[at[:-1]]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and how many each text has."""
        number, counts = self.words(texts)
        lengths = self.lengths[number]
        rows, place = ragged(lengths)
        ids = self.ids[self.places[number][rows] + place]
        total = np.append(0, np.cumsum(lengths, dtype=np.int64))
        at = np.append(0, np.cumsum(counts))
        return ids, total[at[1:]] - total[at[:-1]]


@lru_cache(2)
def bpe(path: str) -> Bpe:
    """One per worker process."""
    return Bpe(path)
