"""Text scalars as Column expressions: segments, character bigrams, sentences, hygiene, highlighting.

All count code points.  Null in gives null out, except where said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, and with it the signs that bigrams are never cut across; fixed values, good for Java and RE2.
SPACE = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SEPARATORS = rf"[、。・「」『』（）()［］\[\]〔〕，．：；:;？?！!／/{SPACE}]+"


def segments(text: Column | str) -> Column:
    """Pieces between separators, empty ones left out."""
    return F.filter(F.split(text, SEPARATORS), lambda x: x != "")


def _cut(segment: Column) -> Column:
    return F.when(F.length(segment) == 1, F.array(segment)).otherwise(F.transform(F.sequence(F.lit(1), F.length(segment) - 1), lambda i: F.substring(segment, i, F.lit(2))))


def bigram_list(text: Column | str) -> Column:
    """All character bigrams in order; a segment of one character is itself."""
    return F.flatten(F.transform(segments(text), _cut))


def bigrams(text: Column | str) -> Column:
    """Distinct bigrams in order of first appearance."""
    return F.array_distinct(bigram_list(text))


def token_length(text: Column | str) -> Column:
    """Number of bigrams, without making them."""
    return F.aggregate(segments(text), F.lit(0).cast("long"), lambda n, s: n + F.greatest(F.length(s) - 1, F.lit(1)))


def substantive_length(text: Column | str) -> Column:
    return F.length(F.regexp_replace(text, SEPARATORS, "")).cast("long")


def sentences(text: Column | str) -> Column:
    """Cut after the ideographic full stop, which stays; trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, "(?<=。)"), lambda s: F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", "")), lambda s: s != "")


def without_space(text: Column | str) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def strip_caption(text: Column | str) -> Column:
    """Without one leading and one trailing parenthesis."""
    return F.regexp_replace(F.regexp_replace(text, "^[（(]", ""), "[）)]$", "")


#: Scripts and characters that do not belong into the prose; fixed values.
FOREIGN = {
    "cyrillic": "[Ѐ-ӿԀ-ԯ]",
    "hangul": "[가-힯ᄀ-ᇿ㄰-㆏]",
    "greek": "[Ͱ-Ͽ]",
    "full_width_latin": "[Ａ-Ｚａ-ｚ]",
    "control": "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]",
}
ALLOW_MARK = "text-hygiene:allow"


def violations(line: Column, kinds: dict[str, str] = FOREIGN, mark: str = ALLOW_MARK) -> Column:
    """Names of the kinds found in a line; none where the line has the mark."""
    found = F.array_compact(F.array(*[F.when(line.rlike(regex), F.lit(name)) for name, regex in kinds.items()]))
    return F.when(line.contains(mark), F.array().cast("array<string>")).otherwise(found)


def highlight(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Marks terms of two characters or more; where several begin, the first in the list."""
    import re

    usable = [re.escape(t) for t in terms if len(t) > 1]
    return F.regexp_replace(text, "(" + "|".join(usable) + ")", f"{before}$1{after}") if usable else text


def prefixed(text: Column, prefix: str = "query: ") -> Column:
    return F.concat(F.lit(prefix), text)


def strip_ansi(text: Column) -> Column:
    """Without the escape codes that colour a terminal."""
    return F.regexp_replace(text, "\\x1b\\[[0-9;]*[A-Za-z]", "")


def fixed(value: Column, digits: int = 4, width: int = 0) -> Column:
    """A number with so many digits after the point, without signs between thousands, padded on the left."""
    out = F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    return F.when(F.length(out) < width, F.lpad(out, width, " ")).otherwise(out)


def short_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def version_at_least(version: Column, *parts: int) -> Column:
    """Compares dotted numbers part by part, the shorter the lower; a version with a part that is no number counts as 0."""
    numbers = F.transform(F.split(F.coalesce(version, F.lit("0")), "\\."), lambda x: x.try_cast("int"))
    whole = F.when(F.exists(numbers, lambda x: x.isNull()), F.array(F.lit(0))).otherwise(numbers)
    return whole >= F.array(*[F.lit(p) for p in parts])
