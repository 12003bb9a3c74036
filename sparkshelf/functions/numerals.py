"""Kanji numerals and article labels (1 to 9999)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "一二三四五六七八九"
UNITS = {"千": 1000, "百": 100, "十": 10}
NUMERAL = "[一二三四五六七八九十百千]+"


def kanji_to_int(text: Column) -> Column:
    """A unit without a digit before it counts once; of several digits in a row the last holds; anything else is null."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))

    def step(state: Column, ch: Column) -> Column:
        digit = F.instr(F.lit(DIGITS), ch)
        unit = F.coalesce(*[F.when(ch == u, F.lit(v)) for u, v in UNITS.items()], F.lit(0))
        return F.struct((state["total"] + F.greatest(state["digit"], F.lit(1)) * unit).alias("total"), F.when(unit > 0, F.lit(0)).otherwise(digit).alias("digit"))

    value = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda s: s["total"] + s["digit"])
    return F.when(text.rlike(f"^{NUMERAL}$"), value)


def int_to_kanji(n: Column) -> Column:
    """No digit one before a unit; null outside 1 to 9999."""

    def digit(value: Column) -> Column:
        return F.substring(F.lit(DIGITS), value.cast("int"), F.lit(1))

    parts = []
    for unit, value in UNITS.items():
        q = F.floor(n / value) % 10
        parts.append(F.when(q > 1, F.concat(digit(q), F.lit(unit))).when(q == 1, F.lit(unit)).otherwise(""))
    ones = n % 10
    parts.append(F.when(ones > 0, digit(ones)).otherwise(""))
    return F.when((n >= 1) & (n <= 9999), F.concat(*parts))


def label_to_number(label: Column) -> Column:
    """A label with any number of branches to numbers joined by underscores; null if it is none."""
    head = kanji_to_int(F.regexp_extract(label, f"^第({NUMERAL})条", 1))
    tail = F.regexp_extract(label, f"^第{NUMERAL}条((?:の{NUMERAL})*)$", 1)
    numbers = F.transform(F.filter(F.split(tail, "の"), lambda x: x != ""), kanji_to_int)
    return F.when(label.rlike(f"^第{NUMERAL}条(?:の{NUMERAL})*$"), F.concat_ws("_", head.cast("string"), F.transform(numbers, lambda x: x.cast("string"))))


def number_to_label(number: Column) -> Column:
    parts = F.split(number, "_")
    branches = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit("の"), int_to_kanji(x.try_cast("int"))))
    return F.concat(F.lit("第"), int_to_kanji(parts[0].try_cast("int")), F.lit("条"), F.array_join(branches, ""))
