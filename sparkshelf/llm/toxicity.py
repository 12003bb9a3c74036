"""Toxicity by a weighted lexicon (operator 7).

Texts are folded code point by code point: case, accents, full-width and other
look-alike letters of Greek and Cyrillic, and digits and signs that stand for
letters.  The lexicon holds word beginnings; one Aho-Corasick pass finds them and
the exception phrases, and a hit within an exception phrase does not count.  A
text's weights, as a sum and per word, give its score through a fitted logistic
curve.

The lexicon's weights are log-odds of labelled documents, learned from at most
``SAMPLE`` documents of each label (those with the least hash of their id); the
curve is fitted on the same ones, weighed back to the counts of all labelled rows.
Only the text enters a score.  Without labelled rows of both kinds every score is
0.  Null and empty texts are scored as texts without hits, and so is any text
without lexicon words; very long texts are scored whole.  Ids labelled twice count by
their largest label; an id with several texts is learned from once, by the least of
them; every row, repeated or with a null id, is scored.  An empty table gives no rows.
Of tables with more columns, id and text (id and label) alone are read.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkshelf.llm.ragged import Texts, map_slices, small_batches

SAMPLE = 8000
PREFIXES = range(3, 10)
SUPPORT, ODDS, LEXICON = 6, 12.0, 4000  # of an entry: toxic sample documents and odds, at least; and the strongest entries that are kept
PREDICT = 0.7
#: Phrases in which lexicon words mean no offence; fixed values, folded like texts.
EXCEPTIONS = ("idiot proof", "idiot light", "trash can", "trash bin", "trash bag", "trash collection", "take out the trash", "clown fish", "clownfish", "class clown", "stupid simple", "keep it simple stupid", "pathetic fallacy", "sympathetic", "pond scum", "scumble")
#: Look-alikes of Latin letters, and digits and signs that stand for letters; fixed values.
LOOK_ALIKE = {
    "аạαａ": "a", "вβ": "b", "сϲ": "c", "ԁ": "d", "еεє": "e", "ɡ": "g", "һн": "h", "іιїı": "i", "јϳ": "j", "кκ": "k", "ӏ": "l", "мμ": "m", "пη": "n", "оοσө": "o", "рρ": "p", "ԛ": "q", "гя": "r", "ѕ": "s", "тτ": "t", "υцս": "u", "ѵν": "v", "ѡω": "w", "хχ": "x", "уγ": "y", "ᴢζ": "z",
    "0": "o", "1!|": "i", "3€": "e", "4@": "a", "5$": "s", "7+": "t", "8": "b", "9": "g",
}


def fold_table() -> np.ndarray:
    """A byte for every code point: a-z, a blank for what ends words, or 128 and up for other letters and digits."""
    table = np.full(0x110000, 32, np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch)[:1].lower()
        base = unicodedata.normalize("NFKD", base)[:1] if base else ch
        if "a" <= base <= "z":
            table[c] = ord(base)
        elif unicodedata.category(ch)[0] in "LNM":
            table[c] = 128 + c % 127
    for group, letter in LOOK_ALIKE.items():
        for ch in group:
            table[[ord(ch), ord(ch.upper()) if len(ch.upper()) == 1 else ord(ch)]] = ord(letter)
    return table


_SIGNS = np.frombuffer("!|€@$+".encode("utf-32-le"), np.uint32)
_table: list[np.ndarray] = []


def fold(text: str) -> str:
    """As long as the text in code points, with a blank before and after."""
    if not _table:
        _table.append(fold_table())
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _table[0][chars]
    sign = np.isin(chars, _SIGNS)
    if sign.any():  # signs stand for letters only right before letters or digits
        after = np.append(chars[1:], 32)
        out[sign & ((_table[0][after] == 32) | np.isin(after, _SIGNS))] = 32
    return " " + out.tobytes().decode("latin-1") + " "


class Lexicon:
    """weights: word beginning -> weight; curve: intercept and slopes of the two features."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float] | None, exceptions=EXCEPTIONS):
        self.weights, self.curve, self.exceptions, self.automaton = weights, curve, exceptions, None

    def __getstate__(self):
        return self.weights, self.curve, self.exceptions

    def __setstate__(self, state):
        self.__init__(*state)

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """Where lexicon entries begin, without those in exception phrases, the longest at each place."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for w in self.weights:
                self.automaton.add_word(" " + w, (w, False))
            for e in self.exceptions:
                self.automaton.add_word(fold(e).rstrip(), (e, True))
            self.automaton.make_automaton()
        found: dict[int, str] = {}
        spared: list[tuple[int, int]] = []
        for end, (entry, exception) in self.automaton.iter(folded):
            start = end - len(entry)
            if exception:
                spared.append((start, end))
            elif len(found.get(start, "")) < len(entry):
                found[start] = entry
        spared.sort()
        firsts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        at = {s: bisect_right(firsts, s) for s in found}
        return [(s, w) for s, w in found.items() if not at[s] or reach[at[s] - 1] < s]

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(self.weights[w] for _, w in self.hits(folded))
        return np.log1p(total), np.log1p(200 * total / (len(folded.split()) + 20))

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + features @ np.array(self.curve[1:]), -40, 40)))


def _prefixes(text: str) -> set[str]:
    words = set(fold(text).split())
    return {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression with a small ridge, by Newton steps; slopes are never negative."""
    design = np.column_stack([np.ones(len(x)), x])
    theta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + np.array([0, 0.05, 0.05]) * theta
        hessian = design.T @ (design * (weight * p * (1 - p) + 1e-9)[:, None]) + np.diag([1e-9, 0.05, 0.05])
        move = np.linalg.solve(hessian, gradient)
        theta -= move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return float(theta[0]), float(max(theta[1], 0.0)), float(max(theta[2], 0.0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, support: int = SUPPORT, size: int = LEXICON) -> Lexicon:
    """From labelled documents; ``labels`` (id, label) are those that may be learned from."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Lexicon({}, None)
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * sample ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # a row per id, however often it is repeated

    def count(batches):
        clean, toxic = Counter(), Counter()
        n = [0, 0]
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                (toxic if label else clean).update(_prefixes(text))
                n[1 if label else 0] += 1
        entries = list(toxic)  # what no toxic document has is no candidate
        yield pa.RecordBatch.from_arrays([pa.array(["", *entries], pa.string()), pa.array([n[1], *(toxic[e] for e in entries)], pa.int64()), pa.array([n[0], *(clean[e] for e in entries)], pa.int64())], ["entry", "toxic", "clean"])
        others = [e for e in clean if e not in toxic]
        yield pa.RecordBatch.from_arrays([pa.array(others, pa.string()), pa.array([0] * len(others), pa.int64()), pa.array([clean[e] for e in others], pa.int64())], ["entry", "toxic", "clean"])

    counted = texts.select("text", "label").mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = counted.where("entry = ''").first()
    if seen is None or not seen["toxic"] or not seen["clean"]:
        return Lexicon({}, None)
    odds = F.log(((F.col("toxic") + 0.5) / (seen["toxic"] + 1)) / ((F.col("clean") + 0.5) / (seen["clean"] + 1)))
    # the strongest entries, so many at most, come to the driver
    best = counted.where(f"entry != '' AND toxic >= {support}").withColumn("weight", odds).where(F.col("weight") >= float(np.log(ODDS))).orderBy(F.desc("weight"), "entry").limit(size).collect()
    weights: dict[str, float] = {}
    toxic_of: dict[str, int] = {}
    for r in sorted(best, key=lambda r: len(r["entry"])):  # a longer entry only where it says more than its beginning
        shorter = next((r["entry"][:n] for n in range(len(r["entry"]) - 1, 2, -1) if r["entry"][:n] in weights), None)
        if shorter is None or r["weight"] > weights[shorter] + 0.7:
            weights[r["entry"]], toxic_of[r["entry"]] = r["weight"], r["toxic"]
    lexicon = Lexicon(weights, None)

    def describe(batches):
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column("text").to_pylist()], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), b.column("label")], ["a", "b", "label"])

    rows = texts.select("text", "label").mapInArrow(describe, "a double, b double, label int").collect()  # at most 2 * sample rows
    x, y = np.array([[r["a"], r["b"]] for r in rows]), np.array([r["label"] for r in rows], float)
    order = np.lexsort((y, x[:, 1], x[:, 0]))  # sums in one order whatever the tasks'
    x, y = x[order], y[order]
    weight = np.where(y > 0, totals[1] / max(1, (y > 0).sum()), totals[0] / max(1, (y == 0).sum()))
    lexicon.curve = _logistic(x, y, weight)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""

    def work(part: pa.RecordBatch):
        x = np.array([lexicon.features(t.decode()) for t in Texts(part.column("text")).lists()], float).reshape(-1, 2)
        return {"doc_id": part.column("doc_id"), "score": lexicon.score(x)}

    return map_slices(docs.selectExpr(f"CAST(`{id_col}` AS long) doc_id", f"`{text_col}` text"), "text", work, "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out ids are not looked at."""
    lexicon = learn(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col, sample)
    return score(docs, lexicon, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
