"""Secret scans through a trigram inverted index (operator 2).

For each rule a Boolean query of trigrams is derived from its regex: what every
match must contain, by the regex's own syntax tree.  Each slice of texts is an
index segment: the postings of all trigrams that some rule needs (folded to
lower case) come from one pass over the bytes, a rule's postings are intersected
and united as its query says, and the regex runs over the candidates alone.
Rules without mandatory trigrams scan every text.  Segments are built where the
texts are read, so nothing is shuffled and nothing depends on other segments.

Null texts are empty.  Rows, repeated ones too, are kept one for one; other
columns are not read.  Spans are code points, end exclusive, of whole matches; of
those that begin at one place the kinds stand in the order in which they are listed.
A very long text is a segment by itself.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkshelf.llm.ragged import LOWER, Texts, map_slices, slices, small_batches

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before 3.11
    import sre_constants as sre
    import sre_parse as parser

#: A private key runs to the END line of its BEGIN line; where that is missing, or another key begins before it, over the header lines and base64 that follow.
_BEGIN = r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----"
_TO_END = r"[^-]*(?:-(?!----(?:BEGIN|END) )[^-]*)*-----END \1-----"
_BREAK = r"(?:\s|\\[nr])"  # also as written in a string literal
_BODY = rf"[ \t\r]*(?:\n[A-Za-z-]+:[^\n]*)*(?:{_BREAK}+[A-Za-z0-9+/=]{{16,}})+(?:(?:\r?\n|\\n)=?[A-Za-z0-9+/]{{1,15}}={{0,2}}(?=\s*(?:\n|\Z)|[\"'\\])){{0,2}}"

#: kind, regex, least length of (group, characters); the first three are the base kinds.
RULES: tuple[tuple[str, str, tuple[int, int]], ...] = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", (2, 12)),
    ("access", r"AKIA[A-Z0-9]+", (0, 18)),
    ("hex", r"[0-9a-f]+", (0, 16)),
    ("private_key", rf"{_BEGIN}(?:{_TO_END}|{_BODY}|)", (0, 1)),
    ("github", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})", (0, 1)),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", (0, 1)),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", (0, 1)),
    ("google", r"AIza[A-Za-z0-9_-]{35}", (0, 1)),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", (0, 1)),
    ("npm", r"npm_[A-Za-z0-9]{36}", (0, 1)),
    ("bearer", r"(?ai:authorization:\x20*bearer\x20+[A-Za-z0-9._~+/-]{16,}=*)", (0, 1)),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@", (0, 1)),
)
BASE = 3
#: At most so many strings stand for a part of a regex before it is cut to its trigrams.
_EXACT, _CLASS = 24, 12

#: A query: ("all",), ("gram", t), ("and", queries) or ("or", queries).
ALL = ("all",)


def _both(kind: str, queries: Iterable[tuple]) -> tuple:
    flat: list[tuple] = []
    for q in queries:
        flat += q[1] if q[0] == kind else [q]
    if kind == "and":
        flat = [q for q in flat if q != ALL]
        if not flat:
            return ALL
    elif ALL in flat:
        return ALL
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _grams(strings: set[str]) -> tuple:
    """What a text has that contains one of the strings."""
    return _both("or", [_both("and", [("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> tuple:
    """A query on lower-cased trigrams that every text with a match answers."""

    def walk(nodes) -> tuple[set[str] | None, tuple]:
        """All strings that the nodes match, if few, and otherwise None; and what a text must have besides."""
        query, runs, exact = ALL, {""}, True  # runs: what may stand right before this place
        for op, arg in nodes:
            strings, inner = None, ALL
            if op is sre.AT:
                continue
            if op is sre.LITERAL and arg < 128:
                strings = {chr(arg).lower()}
            elif op is sre.IN:
                strings = characters(arg)
            elif op is sre.SUBPATTERN:
                strings, inner = walk(arg[3])
            elif op is sre.BRANCH:
                made = [walk(x) for x in arg[1]]
                if all(s is not None for s, _ in made):
                    strings = set().union(*(s for s, _ in made))
                else:
                    inner = _both("or", [q if s is None else _grams(s) for s, q in made])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, body = arg
                s, q = walk(body)
                if s is not None and high == 1:
                    strings = s if low else s | {""}
                elif low:
                    inner = q if s is None else _grams(s)
            query = _both("and", [query, inner])
            if strings is not None and len(strings) * len(runs) <= _EXACT:
                runs = {a + b for a in runs for b in strings}
                continue
            query, exact = _both("and", [query, _grams(runs)]), False
            runs = strings or {""}
        return (runs, query) if exact else (None, _both("and", [query, _grams(runs)]))

    def characters(items) -> set[str] | None:
        chars: set[str] = set()
        for kind, x in items:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] < 128:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return chars if len(chars) <= _CLASS and all(c.isascii() for c in chars) else None

    strings, query = walk(parser.parse(pattern))
    return query if strings is None else _both("and", [query, _grams(strings)])


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(pattern), least, trigram_query(pattern)) for kind, pattern, least in rules]
        grams: dict[str, int] = {}

        def collect(q):
            if q[0] == "gram":
                grams.setdefault(q[1], len(grams))
            elif q[0] in ("and", "or"):
                for x in q[1]:
                    collect(x)

        for *_, q in self.rules:
            collect(q)
        self.grams = grams
        codes = np.array([int.from_bytes(g.encode()) for g in grams], np.int64)
        self.codes, self.order = np.sort(codes), np.argsort(codes)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[codes] = True

    def postings(self, texts: Texts) -> list[np.ndarray]:
        """By gram, the texts that have it, ascending."""
        d = LOWER[texts.data].astype(np.uint32)
        if len(d) < 3:
            return [np.zeros(0, np.int64)] * len(self.grams)
        code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
        at = np.flatnonzero(self.wanted[code])
        row = np.searchsorted(texts.bounds, at, "right") - 1
        inside = at + 3 <= texts.bounds[row + 1]
        pair = np.unique(self.order[np.searchsorted(self.codes, code[at[inside]])] * np.int64(texts.n + 1) + row[inside])
        gram, row = np.divmod(pair, texts.n + 1)
        ends = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        return [row[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def candidates(self, query: tuple, postings: list[np.ndarray], everything: np.ndarray) -> np.ndarray:
        if query == ALL:
            return everything
        if query[0] == "gram":
            return postings[self.grams[query[1]]]
        parts = [self.candidates(q, postings, everything) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        out = min(parts, key=len)
        for p in parts:
            if not len(out):
                break
            out = np.intersect1d(out, p, assume_unique=True)
        return out

    def scan(self, texts: Texts, strings: list[str]) -> list[list[tuple[int, int, str]]]:
        """By text, (start, number of the rule, end, kind) in order."""
        found: list[list] = [[] for _ in strings]
        postings, everything = self.postings(texts), np.arange(texts.n)
        for number, (kind, regex, (group, least), query) in enumerate(self.rules):
            for i in self.candidates(query, postings, everything).tolist():
                for m in regex.finditer(strings[i]):
                    if m.end(group) - m.start(group) >= least:
                        found[i].append((m.start(), number, m.end(), kind))
        for x in found:
            x.sort()
        return found


@lru_cache(4)
def scanner(rules=RULES) -> Scanner:
    return Scanner(rules)


def _said(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans of every row."""

    def work(part: pa.RecordBatch):
        texts = Texts(part.column("text"))
        found = scanner(rules).scan(texts, [x or "" for x in part.column("text").to_pylist()])
        base = [[s for s in x if s[1] < BASE] for x in found]
        many = np.array([[sum(s[1] == k for s in x) for k in range(BASE)] for x in base], np.int64).reshape(-1, BASE)
        return {"doc_id": part.column("doc_id"), "n_assign": many[:, 0], "n_access": many[:, 1], "n_hex": many[:, 2], "base_sha256": [hashlib.sha256(_said(x).encode()).hexdigest() for x in base], "spans": [_said(x) for x in found], "n_spans": np.array([len(x) for x in found], np.int64)}

    return map_slices(docs.selectExpr(f"CAST(`{id_col}` AS long) doc_id", f"`{text_col}` text"), "text", work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]", rules=RULES) -> DataFrame:
    """The documents, all columns as they are, with each stretch of overlapping spans replaced by ``mask``; a null text stays null."""
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None
    names, kinds = docs.columns, docs.schema

    def clean(text: str, spans) -> str:
        out, last = [], 0
        for a, _, b, _ in spans:
            if a >= last:
                out += [text[last:a], mask]
            last = max(last, b)
        return "".join(out) + text[last:]

    def work(part: pa.RecordBatch):
        strings = part.column(at).to_pylist()
        found = scanner(rules).scan(Texts(part.column(at)), [x or "" for x in strings])
        if not any(found):
            return part
        columns = list(part.columns)
        changed = [clean(t, s) if s else t for t, s in zip(strings, found, strict=True)]
        columns[at] = pa.array(changed, part.column(at).type)
        if size is not None:
            lengths = part.column(size).to_pylist()
            columns[size] = pa.array([len(c) if s else n for c, s, n in zip(changed, found, lengths, strict=True)], part.column(size).type)
        return pa.RecordBatch.from_arrays(columns, names)

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the names

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                made = work(part)
                yield pa.RecordBatch.from_arrays(list(made.columns), [f"c{i}" for i in range(len(names))])

    return plain.mapInArrow(run, plain.schema).toDF(*[f.name for f in kinds])
