"""Append-only event logs: parsing with physical line numbers, corrections, validation, guarded appending, star schema.

A log is a file of JSON lines.  Rows are keyed by (file, line); ``data`` stays JSON
text, so that a value keeps its own spelling, and ``kinds`` says of what kind each of
its top-level fields is.
"""

from __future__ import annotations

import json
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkshelf.functions.text import version_at_least
from sparkshelf.session import cut

#: event: required fields and the kind of their values; fixed values.
FIELDS = {
    "loop_start": {"goal": "s", "spec_refs": "l", "scaffold_version": "s", "agent": "s"},
    "stage_end": {"stage": "i", "stage_name": "s", "result": "s"},
    "test_run": {"command": "s", "passed": "i", "failed": "i"},
    "failure": {"code": "s", "severity": "s", "detected_stage": "i", "summary": "s", "resolution": "s"},
    "escalation": {"reason": "s", "question": "s"},
    "commit": {"sha": "s", "kind": "s"},
    "loop_end": {"outcome": "s", "failure_count": "i", "summary": "s"},
    "correction": {"supersedes": "i", "reason": "s"},
}
#: Allowed values; fixed values.
ALLOWED = {
    ("stage_end", "result"): ("pass", "fail", "skip"),
    ("loop_end", "outcome"): ("success", "partial", "aborted"),
    ("commit", "kind"): ("feat", "fix", "test", "docs", "refactor", "chore", "data", "spec"),
}
#: Fields of every record; fixed values.
ENVELOPE = ("v", "ts", "project", "loop_id", "event", "data")
BREAKS = r"\r\n|\n|\r"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text of every line that is not blank; a log is one loop's, so a file is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", BREAKS, -1)).alias("p", "text"))
    return files.where(F.col("text").rlike(r"\S")).select("file", (F.col("p") + 1).cast("long").alias("line"), "text")


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """file: the names of all logs under ``path``; Spark's readers leave empty files out, the store's listing doesn't."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [x.getPath().getName() for x in found if x.isFile()]
    return spark.createDataFrame([(x,) for x in names if x.endswith(".jsonl")], "file string")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """kind (code, severity, resolution), code, category, category_name, name, definition from a taxonomy file."""
    info = "struct<category:string,name:string,definition:string>"
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", f"categories map<string,string>, codes map<string,{info}>, severities map<string,string>, resolutions array<string>").alias("t"))
    codes = one.select("t.categories", F.explode("t.codes").alias("code", "i")).select(F.lit("code").alias("kind"), "code", "i.category", F.col("categories")[F.col("i.category")].alias("category_name"), "i.name", "i.definition")
    severities = one.select(F.explode("t.severities").alias("code", "definition")).select(F.lit("severity").alias("kind"), "code", "definition")
    resolutions = one.select(F.lit("resolution").alias("kind"), F.explode("t.resolutions").alias("code"))
    return codes.unionByName(severities, allowMissingColumns=True).unionByName(resolutions, allowMissingColumns=True)


def parse(lines: DataFrame) -> DataFrame:
    """file, line, ok (it is a JSON object), the envelope, ``data`` as JSON text, ``missing`` (envelope fields that are not there) and ``kinds`` (top-level field of ``data`` to the type of its value)."""
    schema = ", ".join(f"{c} string" for c in ENVELOPE)
    parsed = lines.withColumn("_r", F.from_json("text", schema, {"mode": "PERMISSIVE"})).withColumn("_v", F.try_parse_json("text"))
    ok = F.col("_v").isNotNull() & F.ltrim("text").startswith("{")
    there = {c: F.try_variant_get("_v", f"$.{c}", "variant") for c in ENVELOPE}
    missing = F.array_compact(F.array(*[F.when(there[c].isNull(), F.lit(c)) for c in ENVELOPE]))
    kinds = F.when(F.col("_r.data").startswith("{"), F.transform_values(F.from_json("_r.data", "map<string,variant>"), lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))))
    return parsed.select("file", "line", ok.alias("ok"), *[F.when(ok, F.col("_r")[c]).alias(c) for c in ENVELOPE], F.when(ok, missing).alias("missing"), F.when(ok, kinds).alias("kinds"))


def value(field: str) -> Column:
    return F.get_json_object("data", f"$.{field}")


def _fits(kind: Column, said: Column, value: Column) -> Column:
    """Whether a value of the type ``said`` is a string (s), a list (l) or an integer (i; true and false are integers too)."""
    # a decimal without a fraction is either a number with a point or too long for a long
    whole = said.isin("BIGINT", "BOOLEAN") | (said.rlike(r"^DECIMAL\((19|[23]\d),0\)$") & ~value.contains("."))
    return F.coalesce(F.when(kind == "s", said == "STRING").when(kind == "l", said.startswith("ARRAY")).otherwise(whole), F.lit(False))


def _integer(field: str) -> Column:
    return F.when(_fits(F.lit("i"), F.col("kinds")[field], value(field)), value(field).try_cast("long"))


def corrections(parsed: DataFrame) -> DataFrame:
    """Corrections with the event of the line they name and ``fault``: target, nested or twice; null if they hold."""
    target = _integer("supersedes")
    own = parsed.where("ok AND event = 'correction'").select("file", "line", target.alias("target"))
    lines = parsed.where("ok").select("file", F.col("line").alias("target"), F.col("event").alias("voided"), F.lit(True).alias("there"))
    both = own.join(lines, ["file", "target"], "left")
    fault = F.when(F.col("there").isNull() | (F.col("target") >= F.col("line")), "target").when(F.col("voided") == "correction", "nested")
    both = both.withColumn("fault", fault)
    first = F.row_number().over(Window.partitionBy("file", "target", F.col("fault").isNull()).orderBy("line"))
    return both.withColumn("_n", first).withColumn("fault", F.when(F.col("fault").isNull() & (F.col("_n") > 1), "twice").otherwise(F.col("fault"))).select("file", "line", "target", "voided", "fault")


def effective(parsed: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """What holds after all corrections: neither corrections nor what they void.  ``corrected``: ``corrections(parsed)``, where it is at hand."""
    gone = (corrections(parsed) if corrected is None else corrected).where("fault IS NULL").select("file", F.col("target").alias("line"))
    return parsed.where("ok AND NOT event <=> 'correction'").join(gone, ["file", "line"], "left_anti")


def record_violations(parsed: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """file, line, rule, field of each violation within a record.  ``taxonomy``: kind, code, as of ``read_taxonomy``."""
    spark = parsed.sparkSession
    rules = [(event, [(field, kind, ALLOWED.get((event, field))) for field, kind in fields.items()]) for event, fields in FIELDS.items()]
    rules = F.broadcast(spark.createDataFrame(rules, "event string, _rules array<struct<field:string,kind:string,allowed:array<string>>>"))  # a row per event
    known = F.broadcast(taxonomy.agg(*[F.collect_set(F.when(F.col("kind") == kind, F.col("code"))).alias(f"_{kind}") for kind in ("code", "severity", "resolution")]))  # one row of a few dozen codes
    rows = parsed.join(rules, "event", "left").join(known).withColumn("_said", F.from_json("data", "map<string,string>"))

    def told(rule: str, field: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), field.alias("field")))

    def of_field(r: Column) -> Column:
        kind, said = F.col("kinds")[r["field"]], F.col("_said")[r["field"]]
        there = F.map_contains_key("kinds", r["field"])
        allowed = (kind == "STRING") & F.array_contains(r["allowed"], said)
        return F.array(told("field_missing", r["field"], ~there), told("field_type", r["field"], there & ~_fits(r["kind"], kind, said)), told("field_value", r["field"], there & r["allowed"].isNotNull() & ~F.coalesce(allowed, F.lit(False))))

    failed = F.col("event") == "failure"
    ref, ref_kind = F.col("_said")["harness_ref"], F.col("kinds")["harness_ref"]
    nothing = F.coalesce(ref, F.lit("")).isin("", "[]", "{}") | (ref.isin("0", "false") & (ref_kind != "STRING"))
    rest = [told(f"{kind}_unknown", F.lit(kind), failed & F.col("_said")[kind].isNotNull() & ~F.array_contains(f"_{kind}", F.col("_said")[kind])) for kind in ("code", "severity", "resolution")]
    rest.append(told("harness_ref", F.lit("harness_ref"), failed & (F.col("_said")["resolution"] == "harness_fix") & nothing))
    one = lambda rule, field: F.array(F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field")))
    found = (
        F.when(~F.col("ok"), one("json", ""))
        .when(F.size("missing") > 0, F.transform("missing", lambda c: F.struct(F.lit("envelope").alias("rule"), c.alias("field"))))
        .when(F.col("_rules").isNull(), one("unknown_event", "event"))
        .when(F.col("kinds").isNull(), one("data_not_object", "data"))
        .otherwise(F.array_compact(F.concat(F.flatten(F.transform("_rules", of_field)), F.array(*rest))))
    )
    return rows.select("file", "line", F.explode(found).alias("x")).select("file", "line", "x.rule", "x.field")


def file_violations(parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file, rule, severity, n of each violation of a whole file or of its order.  ``files`` (file): all logs, so that empty ones are found."""
    parsed = cut(parsed)
    corrected = cut(corrections(parsed))
    stem = F.regexp_replace("file", "\\.[^.]*$", "")
    order = Window.partitionBy("file").orderBy("line")
    good = parsed.where("ok")
    name = good.where((F.col("loop_id") != stem) & (F.col("loop_id") != "")).select("file", F.lit("loop_id").alias("rule"), F.lit("error").alias("severity"))
    late = good.withColumn("_p", F.lag(F.coalesce("ts", F.lit(""))).over(order)).where(F.col("_p") > F.coalesce("ts", F.lit(""))).select("file", F.lit("ts_order").alias("rule"), F.lit("error").alias("severity"))
    held = cut(effective(parsed, corrected)).withColumn("_strict", version_at_least(F.col("v"), 1, 2))
    same = held.where("project = loop_id").select("file", F.lit("project_is_loop").alias("rule"), F.when(F.col("_strict"), "error").otherwise("warning").alias("severity"))
    mixed = held.where("project IS NOT NULL").groupBy("file").agg(F.countDistinct("project").alias("n"), F.max("_strict").alias("s")).where("n > 1").select("file", F.lit("projects").alias("rule"), F.when(F.col("s"), "error").otherwise("warning").alias("severity"))
    budget = corrected.where("voided IS NOT NULL").groupBy("file", F.col("voided").alias("event")).agg(F.count(F.lit(1)).alias("budget"))
    ends = held.where("event = 'loop_end'").groupBy("file").agg(F.min("line").alias("end"), F.count(F.lit(1)).alias("ends"), F.min_by(value("failure_count"), "line").alias("declared"), F.min_by(F.col("kinds")["failure_count"], "line").alias("declared_kind"))
    after = held.join(ends.select("file", "end"), "file").where("line > end").groupBy("file", "event").agg(F.count(F.lit(1)).alias("n")).join(budget, ["file", "event"], "left").where("n > coalesce(budget, 0)")
    shape = held.groupBy("file").agg(F.min_by("event", "line").alias("head"), F.count_if(F.col("event") == "failure").alias("failures")).join(ends, "file", "left")
    declared = F.col("declared")
    wrong_count = declared.isNotNull() & ~F.coalesce((F.when(F.col("declared_kind") == "BOOLEAN", F.when(declared == "true", 1).otherwise(0)).when(F.col("declared_kind") != "STRING", declared.try_cast("double")) == F.col("failures")), F.lit(False))
    error = lambda df, rule: df.select("file", F.lit(rule).alias("rule"), F.lit("error").alias("severity"))
    parts = [name, late, same, mixed, error(shape.where("NOT head <=> 'loop_start'"), "first_event"), error(shape.where("ends > 1"), "loop_ends"), error(shape.where(wrong_count), "failure_count"), error(after, "after_end"), error(parsed.where("ok").select("file").distinct().join(held.select("file").distinct(), "file", "left_anti"), "nothing_holds")]
    parts += [error(corrected.where("fault IS NOT NULL").select("file", "fault"), "correction")]
    if files is not None:
        parts.append(error(files.join(parsed.select("file"), "file", "left_anti"), "no_records"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("file", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def flat(parsed: DataFrame) -> DataFrame:
    """A row per record, corrections too, with a column ``data_...`` for every field that an event can have; lists and objects as JSON text."""
    names = list(dict.fromkeys([f for fields in FIELDS.values() for f in fields] + ["introduced_stage", "harness_ref"]))
    return parsed.where("ok").select("file", "line", "v", "ts", "project", "loop_id", "event", *[value(f).alias(f"data_{f}") for f in names])


def fact_loops(held: DataFrame) -> DataFrame:
    """A row per project and loop: start, end, goal, counts, and what the last test run said."""
    last = lambda event, x: F.max_by(F.when(F.col("event") == event, x), F.when(F.col("event") == event, F.struct("file", "line")))
    many = lambda event: F.count_if(F.col("event") == event)
    return held.groupBy("project", "loop_id").agg(
        last("loop_start", F.col("ts")).alias("started_at"), last("loop_end", F.col("ts")).alias("ended_at"),
        *[last("loop_start", value(f)).alias(f) for f in ("goal", "scaffold_version", "agent")], last("loop_end", value("outcome")).alias("outcome"),
        many("failure").alias("n_failures"), many("commit").alias("n_commits"), many("test_run").alias("n_test_runs"),
        *[last("test_run", value(f)).alias(f"last_tests_{f}") for f in ("passed", "failed")],
    )


def fact_failures(held: DataFrame) -> DataFrame:
    fields = ("code", "severity", "detected_stage", "introduced_stage", "summary", "resolution", "harness_ref")
    return held.where("event = 'failure'").select("file", "line", "ts", "project", "loop_id", *[value(f).alias(f) for f in fields])


def two_strike(failures: DataFrame) -> DataFrame:
    """Failures by code; from two on a lasting fix is needed."""
    by = failures.groupBy("code").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.max(F.col("harness_ref") != ""), F.lit(False)).alias("has_hc_ref"))
    return by.select("code", "total", (F.col("total") >= 2).alias("needs_hc"), "has_hc_ref")


def summary(held: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Each loop's facts and its failures, in order, as text with the taxonomy's names; what a record lacks is a question mark."""
    names = F.broadcast(taxonomy.where("kind = 'code'").select("code", "name"))  # a few dozen rows
    held = cut(held)
    told = fact_failures(held).join(names, "code", "left")
    line = F.format_string("[%s] %s (%s): %s -> %s%s", *[F.coalesce(c, F.lit("?")) for c in ("severity", "code", "name", "summary", "resolution")], F.when(F.col("harness_ref") != "", F.concat(F.lit(" -> "), "harness_ref")).otherwise(""))
    by = told.groupBy("project", "loop_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", line.alias("said")))), lambda x: x["said"]), "\n").alias("failures"))
    by = by.toDF("_project", "_loop", "failures")
    return fact_loops(held).join(by, F.col("project").eqNullSafe(F.col("_project")) & F.col("loop_id").eqNullSafe(F.col("_loop")), "left").drop("_project", "_loop")


def export(parsed: DataFrame, taxonomy: DataFrame) -> dict[str, DataFrame]:
    """The five tables of the star schema; ``sinks.write_csv`` writes each."""
    parsed = cut(parsed)
    held = cut(effective(parsed))
    failures = fact_failures(held)
    codes = taxonomy.where("kind = 'code'").select("code", "category", "category_name", "name", "definition")
    return {"fact_events": flat(parsed), "fact_loops": fact_loops(held), "fact_failures": failures, "dim_failure_taxonomy": codes, "view_two_strike": two_strike(failures)}


def data_of(pairs: list[str], event: str) -> dict:
    """``key=value`` arguments as an object: JSON where a value parses and its field is no string by rule, else text."""
    text = {f for f, kind in FIELDS.get(event, {}).items() if kind == "s"}
    out = {}
    for pair in pairs:
        key, sign, raw = pair.partition("=")
        if not sign:
            raise ValueError(f"not key=value: {pair!r}")
        try:
            out[key] = raw if key in text else json.loads(raw)
        except json.JSONDecodeError:
            out[key] = raw
    return out


def now(zone: str = "Asia/Tokyo") -> str:
    return datetime.now(ZoneInfo(zone)).isoformat(timespec="seconds")


def judged(parsed: DataFrame, new: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """What appending each record would meet: file, line (the record's number), refused (the rule, or null) and warned (or null).

    ``new``: file, line, text, records that are each judged by themselves against the
    log (``parsed``).  Refused are violations of the record's own rules, another
    project than the log's, corrections of what is not there to be corrected, and
    records after the loop's end that replace no voided one.  Warnings count the
    failures of a code in all logs.
    """
    own, parsed = cut(parse(new)), cut(parsed)
    corrected = cut(corrections(parsed))
    broken = record_violations(own, taxonomy).groupBy("file", "line").agg(F.min("rule").alias("_rule"))
    held = cut(effective(parsed, corrected))
    head = held.groupBy("file").agg(F.min_by("project", "line").alias("_project"), F.max(F.when(F.col("event") == "loop_end", F.col("line"))).alias("_held_end"))
    ends = parsed.where("ok AND event = 'loop_end'").groupBy("file").agg(F.max("line").alias("_end"))
    voided = corrected.where("voided IS NOT NULL").groupBy("file", F.col("voided").alias("event")).agg(F.count(F.lit(1)).alias("_voided"))
    after = parsed.where("ok").join(ends, "file").where("line > _end").groupBy("file", "event").agg(F.count(F.lit(1)).alias("_replaced"))
    target = F.when(F.col("event") == "correction", _integer("supersedes"))
    rows = own.join(broken, ["file", "line"], "left").join(head, "file", "left").join(voided, ["file", "event"], "left").join(after, ["file", "event"], "left")
    there = held.select("file", F.col("line").alias("_target"), F.lit(True).alias("_there"))
    rows = rows.withColumn("_target", target).join(there, ["file", "_target"], "left")
    counts = fact_failures(held).groupBy(F.col("code").alias("_code")).agg(F.count(F.lit(1)).alias("_prior"))
    rows = rows.join(counts, (F.col("event") == "failure") & (value("code") == F.col("_code")), "left")
    correcting = F.col("event") == "correction"
    refused = (
        F.when(F.col("_rule").isNotNull(), F.col("_rule"))
        .when(~correcting & (F.col("project") != F.col("_project")), "other_project")
        .when(correcting & F.col("_there").isNull(), "nothing_to_correct")
        .when(~correcting & F.col("_held_end").isNotNull() & (F.coalesce("_replaced", F.lit(0)) >= F.coalesce("_voided", F.lit(0))), "loop_ended")
    )
    total, unfixed = F.coalesce("_prior", F.lit(0)) + 1, F.coalesce(value("harness_ref"), F.lit("")) == ""
    warned = F.when(F.col("event") == "failure", F.when((value("severity") == "S1") & unfixed, "severe_without_fix").when(total == 2, "second_strike").when((total > 2) & unfixed, "strike_without_fix"))
    return rows.select("file", "line", refused.alias("refused"), F.when(refused.isNull(), warned).alias("warned"))


def append(spark: SparkSession, folder: str, loop: str, text: str, taxonomy: DataFrame) -> tuple[str | None, str | None]:
    """Judges one record and, unless it is refused, writes the loop's log with it to the end; (refused, warned).

    The log is replaced by a whole new file, since stores of objects cannot append.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = files.Path(f"{folder.rstrip('/')}/{loop}.jsonl")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path.getParent())
    have = any(store.listStatus(path.getParent()))
    lines = read_lines(spark, folder) if have else spark.createDataFrame([], "file string, line long, text string")
    said = judged(parse(lines), spark.createDataFrame([(f"{loop}.jsonl", 0, text)], "file string, line long, text string"), taxonomy).first()
    if said.refused is None:
        before = spark.read.text(str(path), wholetext=True).first()[0] if store.exists(path) else ""
        fresh = files.Path(f"{folder.rstrip('/')}/.{loop}.new")
        out = store.create(fresh, True)
        out.write(bytearray((before + ("" if before.endswith("\n") or not before else "\n") + text + "\n").encode()))
        out.close()
        store.delete(path, False)
        store.rename(fresh, path)
    return said.refused, said.warned
