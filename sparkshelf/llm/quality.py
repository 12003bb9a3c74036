"""Quality rules by robust multivariate outliers (operator 1).

Each text's statistics are counted in one pass over ragged arrays and turned into
a vector (``VECTOR``).  For every language and source the minimum covariance
determinant gives location and scatter, and a document goes if its Mahalanobis
distance exceeds ``CUTOFF``.

The determinant is minimised by concentration steps over all rows.  A step gives
every row its squared distance, cut into steps of 2**(1/16), and keeps the moments
per group and step (bounded, summed before the shuffle); the nearest steps that
hold ``COVERAGE`` of the group's rows give its next estimate.  Steps of equal
distance enter whole, so ties and recomputation cannot change the result.  Two
deterministic starts run side by side (all rows; rows near the medians) and the
smaller determinant wins.  ``FLOORS``, deviations that mean nothing for a vector's
entries, are added to every scatter, so that a uniform group rejects no one for
trifles.  Groups under ``LEAST`` rows use their language's estimate, and small
languages that of all rows; a table under ``LEAST`` rows rejects no one.

``CUTOFF`` is a distance: its square, 49, is the 1 - 7.5e-9 quantile of chi-square
with six degrees of freedom, so that of clean documents with heavier tails than the
normal's few go.  Each of ``STEPS`` concentration steps lowers the determinant; on
clean groups the third changes it little.  All of these are parameters.

Null texts have no words and fail the base rule, as empty ones do.  Null
languages and sources are groups.  Repeated rows count as often as they occur.  A
very long text gives one vector like any other.  An empty table has no estimates and
gives no rows.  Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkshelf.llm.ragged import _SPACE, U64, Texts, cut, map_slices, mix64, slices

VECTOR = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "marks")
FLOORS = (0.06, 0.03, 0.06, 0.06, 0.03, 0.05)
CUTOFF = 7.0
COVERAGE, STEPS, LEAST = 0.75, 3, 100
BROADCAST_GROUPS = 20_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?@^_~=+\\/{}[]()\"")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"v_{v} double" for v in VECTOR)
STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]


def statistics(column: pa.Array) -> list[pa.Array]:
    """The columns STATS of some texts."""
    t = Texts(column)
    starts, ends = t.words()
    at = np.searchsorted(starts, t.bounds)
    n_words = np.diff(at)
    row = np.repeat(np.arange(t.n), n_words)
    lead = (t.data & 0xC0) != 0x80
    word_chars = t.sums(lead & ~_SPACE[t.data])
    n_symbols = t.sums(_SYMBOL[t.data])
    # lines with a word that equal an earlier line of the text
    line_starts, line_ends = _lines(t)
    has = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has], line_ends[has]
    line_row = np.searchsorted(t.bounds, line_starts, "right") - 1
    line_key = mix64(t.hashes(line_starts, line_ends) ^ mix64(line_row.astype(U64) + U64(1)))
    _, first = np.unique(line_key, return_index=True)
    later = np.ones(len(line_key), bool)
    later[first] = False
    n_dup = np.bincount(line_row[later], minlength=t.n)
    n_lines = np.bincount(line_row, minlength=t.n)
    # words in three-word windows that occur twice or more
    words = t.hashes(starts, ends)
    whole = np.flatnonzero(np.arange(len(words)) + 3 <= at[1:][row])
    key = mix64(mix64(mix64(words[whole] + U64(1)) + words[np.minimum(whole + 1, len(words) - 1)]) + words[np.minimum(whole + 2, len(words) - 1)]) ^ mix64(row[whole].astype(U64) + U64(1))
    _, back, many = np.unique(key, return_inverse=True, return_counts=True)
    twice = whole[many[back] > 1]
    covered = np.zeros(len(words) + 1, bool)
    for i in range(3):
        covered[twice + i] = True
    n_repeat = np.bincount(row[covered[:-1]], minlength=t.n)

    chars = np.maximum(word_chars, 1)
    values = (
        np.log(np.maximum(word_chars, 1) / np.maximum(n_words, 1)),
        np.log1p(10 * n_symbols / chars),
        n_dup / np.maximum(n_lines, 1),
        n_repeat / np.maximum(n_words, 1),
        np.log1p(5 * t.sums(_CAPITAL[t.data]) / chars),
        np.log1p(10 * t.sums(_MARK[t.data]) / chars),
    )
    return [pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat)] + [pa.array(v.astype(float)) for v in values]


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(t.data == 10)
    starts = np.unique(np.concatenate([t.bounds[:-1][t.bounds[:-1] < t.bounds[1:]], breaks + 1]))
    starts = starts[starts < len(t.data)]
    next_break = np.append(breaks, len(t.data))[np.searchsorted(breaks, starts)]
    return starts, np.minimum(next_break, t.bounds[np.searchsorted(t.bounds, starts, "right")])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _group(*parts: str | None) -> Column:
    """A name for a language and source, a language, or all rows; nulls are values of their own."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(p)), F.lit("-")) for p in parts if p]) if parts else F.lit("*")


def _levels(rows: DataFrame) -> DataFrame:
    levels = F.array(F.concat(F.lit("2"), _group("lang", "source")), F.concat(F.lit("1"), _group("lang")), F.lit("0"))
    return rows.select(F.explode(levels).alias("group"), *[f"v_{v}" for v in VECTOR])


def _attach(rows: DataFrame, params: DataFrame, many: int, *on: str) -> DataFrame:
    """Joins the estimates, a row per group, broadcast only if they are few; a larger table is joined by shuffle, split if skewed."""
    return rows.join(F.broadcast(params) if many <= BROADCAST_GROUPS else params, list(on))


_P = len(VECTOR)
_ESTIMATE = "group string, start int, n long, logdet double, mean array<double>, unmix array<double>"


def _distance(mean: str = "mean", unmix: str = "unmix") -> Column:
    """Squared Mahalanobis distance: the scatter's inverse Cholesky factor (rows after one another) times the offset."""
    total = F.lit(0.0)
    for i in range(_P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(unmix)[i * _P + j] * (F.col(f"v_{VECTOR[j]}") - F.col(mean)[j])
        total = total + part * part
    return total


def _moments() -> list[Column]:
    v = [F.col(f"v_{x}") for x in VECTOR]
    return [F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in v], *[F.sum(v[i] * v[j]) for i in range(_P) for j in range(i + 1)]).alias("m")]


def _estimated(bins: DataFrame, coverage: float) -> DataFrame:
    """Estimates from moments (group, start, step, n, m): those of the nearest steps that hold ``coverage`` of the rows."""
    floors = np.diag(np.square(FLOORS))

    def work(key, table):
        order = np.argsort(np.asarray(table.column("step")), kind="stable")
        n = np.asarray(table.column("n"))[order]
        m = np.array(table.column("m").to_pylist())[order]
        held = np.cumsum(n)
        last = int(np.searchsorted(held, coverage * held[-1] - 1e-9))
        h, total = float(held[last]), m[: last + 1].sum(0)
        mean = total[:_P] / h
        second = np.zeros((_P, _P))
        second[np.tril_indices(_P)] = total[_P:] / h
        second = np.tril(second) + np.tril(second, -1).T
        scatter = second - np.outer(mean, mean)
        low = np.linalg.cholesky(scatter + floors + 1e-12 * np.eye(_P))
        return pa.table({"group": [key[0].as_py()], "start": pa.array([key[1].as_py()], pa.int32()), "n": [int(held[-1])], "logdet": [2 * float(np.log(np.diag(low)).sum())], "mean": [mean.tolist()], "unmix": [np.linalg.inv(low).reshape(-1).tolist()]})

    return bins.groupBy("group", "start").applyInArrow(work, _ESTIMATE)


def estimates(rows: DataFrame, coverage: float = COVERAGE, steps: int = STEPS) -> tuple[DataFrame, int]:
    """group, n, mean, unmix for each language and source ("2..."), language ("1...") and all rows ("0"), and how many.

    ``rows``: lang, source and the vector.
    """
    leveled = _levels(rows)
    v = [f"v_{x}" for x in VECTOR]
    # the first start has all rows, the second the medians with median deviations as scales
    middle = leveled.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.percentile_approx(x, 0.5, 200) for x in v]).alias("mean"), F.array(*[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.75)), 200) for x in v]).alias("q"))
    unmix = F.array(*[1 / F.sqrt(F.pow((F.col("q")[i][1] - F.col("q")[i][0]) / 1.349, 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0) for i in range(_P) for j in range(_P)])
    second = middle.select("group", F.lit(1).alias("start"), "n", F.lit(0.0).alias("logdet"), "mean", unmix.alias("unmix"))
    first = _estimated(leveled.groupBy("group").agg(*_moments()).withColumns({"start": F.lit(0), "step": F.lit(0)}), 1.0)
    now = cut(first.unionByName(second))
    many = now.count()
    for _ in range(steps):
        step = F.floor(16 * F.log2(_distance() + 1e-9)).cast("int").alias("step")
        bins = _attach(leveled, now, many, "group").select("group", "start", step, *v).groupBy("group", "start", "step").agg(*_moments())
        now = cut(_estimated(bins, coverage))
    best = now.groupBy("group").agg(F.min_by(F.struct("n", "mean", "unmix"), F.struct("logdet", "start")).alias("x"))
    return cut(best.select("group", "x.n", "x.mean", "x.unmix")), many


def judged(rows: DataFrame, found: tuple[DataFrame, int], cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """``rows`` (lang, source, STATS and any more) with base_failed, distance, kept."""
    params, many = found
    levels = [params.where(F.col("group").startswith(str(k)) & (F.col("n") >= least)).select(F.col("group").alias(f"_g{k}"), F.struct("mean", "unmix").alias(f"_e{k}")) for k in (2, 1, 0)]
    out = rows.withColumns({"_g2": F.concat(F.lit("2"), _group("lang", "source")), "_g1": F.concat(F.lit("1"), _group("lang")), "_g0": F.lit("0")})
    for k, level in zip((2, 1, 0), levels, strict=True):
        out = out.join(F.broadcast(level) if many <= BROADCAST_GROUPS else level, f"_g{k}", "left")
    out = out.withColumn("_e", F.coalesce("_e2", "_e1", "_e0"))
    distance = F.when(F.col("_e").isNull(), F.lit(0.0)).otherwise(F.sqrt(_distance("_e.mean", "_e.unmix")))
    out = out.withColumn("distance", distance).drop("_g0", "_g1", "_g2", "_e0", "_e1", "_e2", "_e")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def work(part: pa.RecordBatch):
        return pa.RecordBatch.from_arrays([*part.columns[:3], *statistics(part.column("text"))], ["doc_id", "lang", "source", *STAT_NAMES])

    chosen = docs.selectExpr(f"CAST(`{id_col}` AS long) doc_id", f"CAST(`{lang_col}` AS string) lang", f"CAST(`{source_col}` AS string) source", f"`{text_col}` text")
    return map_slices(chosen, "text", work, "doc_id long, lang string, source string, " + STATS)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, coverage: float = COVERAGE, steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept of every row.  Rows that fail the base rule take no part in the estimates."""
    rows = cut(measured(docs, id_col, text_col, lang_col, source_col))
    out = judged(rows, estimates(rows.where(~base_failed()), coverage, steps), cutoff, least)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("distance", 6).alias("distance"), "kept")


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, coverage: float = COVERAGE, steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """The documents that pass, all columns as they are.

    Texts are not shuffled: their statistics are counted once for the estimates
    and once more beside each row that is judged.
    """
    rows = cut(measured(docs, docs.columns[0] if "doc_id" not in docs.columns else "doc_id", text_col, lang_col, source_col).drop("doc_id"))
    found = estimates(rows.where(~base_failed()), coverage, steps)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(text_col)}"

    def work(batches):
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, *statistics(part.column(at))], [*part.schema.names, *STAT_NAMES])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", " + STATS
    wide = plain.mapInArrow(work, shape).withColumns({"lang": F.col(f"c{names.index(lang_col)}").cast("string"), "source": F.col(f"c{names.index(source_col)}").cast("string")})
    return judged(wide, found, cutoff, least).where("kept").select(*plain.columns).toDF(*names)
