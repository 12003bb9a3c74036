"""Queries on event logs generated from the orders table (a log per customer, faults included), and on the events table, batch and streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkshelf.operators import eventlog
from sparkshelf.session import table
from sparkshelf.streaming import events as streams

#: Resolutions and severities of a taxonomy; fixed values.
RESOLUTIONS = ("retry", "rollback", "escalate", "harness_fix", "spec_fix", "test_fix", "accepted")
SEVERITIES = ("S1", "S2", "S3")
CODES = [("F00", "code", "wrong branch"), ("F01", "harness", "missing check"), ("F02", "spec", "unclear"), ("F03", "code", "old state")]
TAXONOMY = [("code", c, kind, f"all {kind}", name, f"about {name}") for c, kind, name in CODES] + [("severity", x, None, None, None, "how bad") for x in SEVERITIES] + [("resolution", x, None, None, None, None) for x in RESOLUTIONS]

_EVENTS = {
    "loop_start": """'{"goal": "g' || c || '", "spec_refs": ["a"], "scaffold_version": "1.' || (k % 4) || '", "agent": "n"}'""",
    "test_run": """'{"command": "t", "passed": ' || (k % 9) || ', "failed": ' || (k % 3) || '}'""",
    "failure": """'{"code": "F0' || (k % 5) || '", "severity": "S' || (1 + k % 4) || '", "detected_stage": ' || (k % 7) || ', "summary": "s' || k || '", "resolution": "' || CASE k % 8 """
    + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(RESOLUTIONS))
    + """ ELSE 'mended' END || '"' || CASE WHEN k % 3 = 0 THEN ', "harness_ref": "H' || (k % 50) || '"' WHEN k % 3 = 1 THEN ', "harness_ref": ""' ELSE '' END || '}'""",
    "commit": """'{"sha": "72817e' || (k % 10) || '", "kind": "' || CASE k % 4 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'spec' ELSE 'style' END || '"}'""",
    "stage_end": """'{"stage": ' || CASE k % 5 WHEN 0 THEN '"1"' WHEN 1 THEN 'true' WHEN 2 THEN '2.5' ELSE '' || k % 7 END || ', "stage_name": "n", "result": "' || CASE k % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'skip' ELSE 'maybe' END || '"}'""",
    "correction": """'{"supersedes": ' || (line - 1 - k % 3) || ', "reason": "r"}'""",
    "escalation": """'{"reason": "r", "question": null}'""",
    "loop_end": """'{"outcome": "' || CASE k % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' ELSE 'lost' END || '", "failure_count": ' || CASE WHEN k % 5 = 0 THEN '"1"' ELSE '' || k % 3 END || ', "summary": "s"}'""",
}
#: Log lines, in words that both engines understand: file, line, last (whether it is the log's last), text.
GENERATED = f"""
SELECT 'loop_' || c || '.jsonl' AS file, CAST(line AS BIGINT) AS line, line = n AS last, CASE
    WHEN fault = 0 THEN '{{broken' WHEN fault = 1 THEN '  ' WHEN fault = 2 THEN '{{"v": "1.2", "ts": "t9"}}'
    ELSE '{{"v": "' || CASE WHEN fault = 4 THEN '1.1' ELSE '1.2' END || '", "ts": "t' || CASE WHEN fault = 9 THEN '' ELSE lpad('' || line, 6, '0') END || '", "project": ' || CASE WHEN fault IN (3, 4) THEN '"loop_' || c || '"' WHEN fault = 8 THEN 'null' WHEN fault = 11 THEN '"other"' ELSE '"shelf"' END
        || ', "loop_id": "loop_' || CASE WHEN fault = 10 THEN 'x' ELSE '' || c END || '", "event": ' || CASE WHEN fault = 5 THEN '"guess"' WHEN fault = 13 THEN 'null' ELSE '"' || event || '"' END || ', "data": '
        || CASE WHEN fault = 6 THEN '5' WHEN fault = 12 THEN '{{}}' WHEN fault = 7 THEN '{{"command": 5, "passed": "3", "x": {{"passed": 3, "failed": 1, "command": "c"}}}}' ELSE CASE event {" ".join(f"WHEN '{e}' THEN {x}" for e, x in _EVENTS.items())} END END || '}}' END AS text
FROM (SELECT *, CASE WHEN line = 1 AND c % 11 <> 0 THEN 'loop_start' WHEN line >= n - c % 3 AND c % 5 <> 0 THEN CASE c % 3 WHEN 1 THEN CASE WHEN line = n - 1 THEN 'loop_end' ELSE 'failure' END WHEN 2 THEN CASE line - n WHEN -2 THEN 'loop_end' WHEN -1 THEN 'correction' ELSE 'failure' END ELSE 'loop_end' END
        ELSE CASE k % 8 WHEN 0 THEN 'failure' WHEN 1 THEN 'test_run' WHEN 2 THEN 'commit' WHEN 3 THEN 'stage_end' WHEN 4 THEN 'correction' WHEN 5 THEN 'failure' WHEN 6 THEN 'test_run' ELSE 'escalation' END END AS event
    FROM (SELECT o_custkey AS c, o_orderkey AS k, (o_orderkey * 31 + o_custkey * 17) % 83 AS fault, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) AS a) AS b
"""


def _generated(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(GENERATED).where(F.col("text").rlike(r"\S"))


def _parsed(spark, sf_dir):
    return eventlog.parse(_generated(spark, sf_dir).select("file", "line", "text"))


def _taxonomy(spark):
    return spark.createDataFrame(TAXONOMY, "kind string, code string, category string, category_name string, name string, definition string")


def log_effective(spark, sf_dir):
    return eventlog.effective(_parsed(spark, sf_dir)).select("file", "line", "event", "project", "loop_id")


def log_corrections(spark, sf_dir):
    return eventlog.corrections(_parsed(spark, sf_dir))


def log_violations(spark, sf_dir):
    return eventlog.record_violations(_parsed(spark, sf_dir), _taxonomy(spark))


def log_file_violations(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("loop_"), "c_custkey", F.lit(".jsonl")).alias("file"))
    return eventlog.file_violations(_parsed(spark, sf_dir), files)


def log_judged(spark, sf_dir):
    """Each log's last line, judged for appending to the lines before."""
    lines = _generated(spark, sf_dir)
    return eventlog.judged(eventlog.parse(lines.where("NOT last").drop("last")), lines.where("last").drop("last"), _taxonomy(spark))


def fact_events(spark, sf_dir):
    return eventlog.flat(_parsed(spark, sf_dir))


def fact_loops(spark, sf_dir):
    return eventlog.fact_loops(eventlog.effective(_parsed(spark, sf_dir)))


def loop_summary(spark, sf_dir):
    return eventlog.summary(eventlog.effective(_parsed(spark, sf_dir)), _taxonomy(spark))


def fact_failures(spark, sf_dir):
    return eventlog.fact_failures(eventlog.effective(_parsed(spark, sf_dir)))


def two_strike(spark, sf_dir):
    return eventlog.export(_parsed(spark, sf_dir), _taxonomy(spark))["view_two_strike"]


def taxonomy_dim(spark, sf_dir):
    """The dimension with each code's failures."""
    tables = eventlog.export(_parsed(spark, sf_dir), _taxonomy(spark))
    counts = tables["fact_failures"].groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return tables["dim_failure_taxonomy"].join(counts, "code", "left").select("code", "category", "category_name", "name", F.coalesce("n", F.lit(0)).alias("n"))


def event_windows(spark, sf_dir):
    """Counts and sums of the events table by day and type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def stream_windows(spark, sf_dir):
    """The same from a stream, closed by its watermark or at its end."""
    out = streams.drain(streams.windowed(streams.read(spark, f"{sf_dir}/events.parquet")))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_sessions(spark, sf_dir):
    """Sessions of users with gaps of half an hour, from a stream."""
    return streams.drain(streams.sessions(streams.read(spark, f"{sf_dir}/events.parquet"))).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = [log_effective, log_corrections, log_violations, log_file_violations, log_judged, fact_events, fact_loops, loop_summary, fact_failures, two_strike, taxonomy_dim, event_windows, stream_windows, stream_sessions]


def _parsed_sql(where: str = "true") -> str:
    has = ", ".join(f"json_extract(j, '$.{c}') IS NOT NULL AS has_{c}" for c in eventlog.ENVELOPE)
    own = ", ".join(f"json_extract_string(j, '$.{c}') AS {c}" for c in eventlog.ENVELOPE if c != "data")
    return f"""lines AS (SELECT * FROM ({GENERATED}) WHERE regexp_matches(text, '\\S')),
recs AS (SELECT file, line, last, coalesce(json_type(j) = 'OBJECT', false) AS ok, {own}, j -> '$.data' AS data, {has} FROM (SELECT *, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM lines)),
parsed AS (SELECT * FROM recs WHERE ok AND {where}),
corr0 AS (SELECT file, line, CASE WHEN json_type(data, '$.supersedes') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(data, '$.supersedes') AS BIGINT) END AS target FROM parsed WHERE event = 'correction'),
corr1 AS (SELECT c.file, c.line, c.target, t.event AS voided, CASE WHEN t.line IS NULL OR c.target >= c.line THEN 'target' WHEN t.event = 'correction' THEN 'nested' END AS fault FROM corr0 c LEFT JOIN parsed t ON t.file = c.file AND t.line = c.target),
corr AS (SELECT file, line, target, voided, CASE WHEN fault IS NULL AND row_number() OVER (PARTITION BY file, target, fault IS NULL ORDER BY line) > 1 THEN 'twice' ELSE fault END AS fault FROM corr1),
held AS (SELECT * FROM parsed p WHERE event IS DISTINCT FROM 'correction' AND NOT EXISTS (SELECT 1 FROM corr c WHERE c.file = p.file AND c.target = p.line AND c.fault IS NULL)),
tax(kind, code, category, category_name, name, definition) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in t) + ")" for t in TAXONOMY)})"""


def _get(field: str) -> str:
    return f"json_extract_string(data, '$.{field}')"


def _records_sql() -> str:
    """Each rule as a statement of its own over recs."""
    known = ", ".join(f"'{e}'" for e in eventlog.FIELDS)
    there = " AND ".join(f"has_{c}" for c in eventlog.ENVELOPE)
    types = {"s": "('VARCHAR')", "l": "('ARRAY')", "i": "('BIGINT', 'UBIGINT', 'BOOLEAN')"}
    parts = ["SELECT file, line, 'json' AS rule, '' AS field FROM recs WHERE NOT ok"]
    parts += [f"SELECT file, line, 'envelope', '{c}' FROM recs WHERE ok AND NOT has_{c}" for c in eventlog.ENVELOPE]
    parts.append(f"SELECT file, line, 'unknown_event', 'event' FROM recs WHERE ok AND {there} AND coalesce(event NOT IN ({known}), true)")
    parts.append(f"SELECT file, line, 'data_not_object', 'data' FROM recs WHERE ok AND {there} AND event IN ({known}) AND json_type(data) <> 'OBJECT'")
    sound = f"FROM recs WHERE ok AND {there} AND json_type(data) = 'OBJECT' AND event"
    for event, fields in eventlog.FIELDS.items():
        for field, kind in fields.items():
            parts.append(f"SELECT file, line, 'field_missing', '{field}' {sound} = '{event}' AND json_type(data, '$.{field}') IS NULL")
            parts.append(f"SELECT file, line, 'field_type', '{field}' {sound} = '{event}' AND json_type(data, '$.{field}') NOT IN {types[kind]}")
            if (event, field) in eventlog.ALLOWED:
                parts.append(f"SELECT file, line, 'field_value', '{field}' {sound} = '{event}' AND json_type(data, '$.{field}') IS NOT NULL AND coalesce({_get(field)} NOT IN {eventlog.ALLOWED[event, field]}, true)")
    for kind in ("code", "severity", "resolution"):
        parts.append(f"SELECT file, line, '{kind}_unknown', '{kind}' {sound} = 'failure' AND {_get(kind)} IS NOT NULL AND {_get(kind)} NOT IN (SELECT code FROM tax WHERE kind = '{kind}')")
    parts.append(f"SELECT file, line, 'harness_ref', 'harness_ref' {sound} = 'failure' AND {_get('resolution')} = 'harness_fix' AND coalesce({_get('harness_ref')}, '') = ''")
    return "\nUNION ALL ".join(parts)


_LAST = lambda event, x: f"arg_max_null({x}, file || lpad(CAST(line AS VARCHAR), 9, '0')) FILTER (event = '{event}')"
_LOOPS = f"""SELECT project, loop_id, {_LAST("loop_start", "ts")} AS started_at, {_LAST("loop_end", "ts")} AS ended_at, {", ".join(f"{_LAST('loop_start', _get(f))} AS {f}" for f in ("goal", "scaffold_version", "agent"))}, {_LAST("loop_end", _get("outcome"))} AS outcome,
    count(*) FILTER (event = 'failure') AS n_failures, count(*) FILTER (event = 'commit') AS n_commits, count(*) FILTER (event = 'test_run') AS n_test_runs, {", ".join(f"{_LAST('test_run', _get(f))} AS last_tests_{f}" for f in ("passed", "failed"))} FROM held GROUP BY project, loop_id"""
_FAILS = f"SELECT file, line, ts, project, loop_id, {', '.join(f'{_get(f)} AS {f}' for f in ('code', 'severity', 'detected_stage', 'introduced_stage', 'summary', 'resolution', 'harness_ref'))} FROM held WHERE event = 'failure'"
_FLAT = list(dict.fromkeys([f for fields in eventlog.FIELDS.values() for f in fields] + ["introduced_stage", "harness_ref"]))
_FILES = r"""good AS (SELECT * FROM parsed), stem AS (SELECT *, regexp_replace(file, '\.[^.]*$', '') AS stem FROM good),
ends AS (SELECT file, min(line) AS last_line, count(*) AS ends, arg_min(json_extract(data, '$.failure_count'), line) AS declared FROM held WHERE event = 'loop_end' GROUP BY file),
budget AS (SELECT file, voided AS event, count(*) AS n FROM corr WHERE voided IS NOT NULL GROUP BY ALL),
found AS (
    SELECT file, 'loop_id' AS rule, 'error' AS severity FROM stem WHERE loop_id <> stem AND loop_id <> ''
    UNION ALL SELECT file, 'ts_order', 'error' FROM (SELECT file, coalesce(ts, '') AS ts, lag(coalesce(ts, '')) OVER (PARTITION BY file ORDER BY line) AS before FROM good) WHERE before > ts
    UNION ALL SELECT file, 'project_is_loop', CASE WHEN v >= '1.2' THEN 'error' ELSE 'warning' END FROM held WHERE project = loop_id
    UNION ALL SELECT file, 'projects', CASE WHEN max(v) >= '1.2' THEN 'error' ELSE 'warning' END FROM held WHERE project IS NOT NULL GROUP BY file HAVING count(DISTINCT project) > 1
    UNION ALL SELECT file, 'first_event', 'error' FROM held GROUP BY file HAVING coalesce(arg_min(coalesce(event, ''), line) <> 'loop_start', true)
    UNION ALL SELECT file, 'loop_ends', 'error' FROM ends WHERE ends > 1
    UNION ALL SELECT e.file, 'failure_count', 'error' FROM ends e JOIN (SELECT file, count(*) FILTER (event = 'failure') AS n FROM held GROUP BY file) f USING (file) WHERE json_type(declared) = 'VARCHAR' OR (json_type(declared) <> 'NULL' AND CAST(declared AS DOUBLE) <> n)
    UNION ALL SELECT file, 'after_end', 'error' FROM (SELECT h.file, h.event, count(*) AS n FROM held h JOIN ends USING (file) WHERE h.line > last_line GROUP BY ALL) LEFT JOIN (SELECT file, event, n AS allowed FROM budget) USING (file, event) WHERE n > coalesce(allowed, 0)
    UNION ALL SELECT DISTINCT file, 'nothing_holds', 'error' FROM good WHERE file NOT IN (SELECT file FROM held)
    UNION ALL SELECT file, 'correction', 'error' FROM corr WHERE fault IS NOT NULL
    UNION ALL SELECT 'loop_' || c_custkey || '.jsonl', 'no_records', 'error' FROM customer WHERE 'loop_' || c_custkey || '.jsonl' NOT IN (SELECT file FROM recs))"""
_JUDGED = f"""bad AS (SELECT file, line, min(rule) AS rule FROM ({_records_sql()}) GROUP BY ALL),
head AS (SELECT file, arg_min(project, line) AS project, max(line) FILTER (event = 'loop_end') AS held_end FROM held WHERE project IS NOT NULL GROUP BY file),
firsts AS (SELECT file, min(line) AS l FROM held GROUP BY file), ended AS (SELECT file, max(line) FILTER (event = 'loop_end') AS held_end FROM held GROUP BY file),
first_project AS (SELECT h.file, h.project FROM held h JOIN firsts f ON h.file = f.file AND h.line = f.l),
late AS (SELECT p.file, p.event, count(*) AS n FROM parsed p JOIN (SELECT file, max(line) AS e FROM parsed WHERE event = 'loop_end' GROUP BY file) USING (file) WHERE line > e GROUP BY ALL),
gone AS (SELECT file, voided AS event, count(*) AS n FROM corr WHERE voided IS NOT NULL GROUP BY ALL),
strikes AS (SELECT {_get("code")} AS code, count(*) AS n FROM held WHERE event = 'failure' GROUP BY ALL),
asked AS (SELECT r.*, b.rule, f.project AS first_project, e.held_end, coalesce(l.n, 0) AS replaced, coalesce(g.n, 0) AS voided, coalesce(s.n, 0) + 1 AS total,
    EXISTS (SELECT 1 FROM held h WHERE h.file = r.file AND json_type(r.data, '$.supersedes') IN ('BIGINT', 'UBIGINT') AND CAST(h.line AS VARCHAR) = json_extract_string(r.data, '$.supersedes')) AS there
    FROM recs r LEFT JOIN bad b USING (file, line) LEFT JOIN first_project f ON f.file = r.file LEFT JOIN ended e ON e.file = r.file LEFT JOIN late l ON l.file = r.file AND l.event = r.event LEFT JOIN gone g ON g.file = r.file AND g.event = r.event
    LEFT JOIN strikes s ON r.event = 'failure' AND s.code = json_extract_string(r.data, '$.code') WHERE r.last),
said AS (SELECT *, CASE WHEN rule IS NOT NULL THEN rule WHEN event <> 'correction' AND project <> first_project THEN 'other_project' WHEN event = 'correction' AND NOT there THEN 'nothing_to_correct' WHEN event <> 'correction' AND held_end IS NOT NULL AND replaced >= voided THEN 'loop_ended' END AS refused FROM asked)
SELECT file, line, refused, CASE WHEN refused IS NULL AND event = 'failure' THEN CASE WHEN {_get("severity")} = 'S1' AND coalesce({_get("harness_ref")}, '') = '' THEN 'severe_without_fix' WHEN total = 2 THEN 'second_strike' WHEN total > 2 AND coalesce({_get("harness_ref")}, '') = '' THEN 'strike_without_fix' END END AS warned FROM said"""
PARSED = _parsed_sql()
SQL = {
    "log_effective": f"WITH {PARSED} SELECT file, line, event, project, loop_id FROM held",
    "log_corrections": f"WITH {PARSED} SELECT * FROM corr",
    "log_violations": f"WITH {PARSED} {_records_sql()}",
    "log_file_violations": f"WITH {PARSED}, {_FILES} SELECT file, rule, severity, count(*) AS n FROM found GROUP BY ALL",
    "log_judged": f"WITH {_parsed_sql('NOT last')}, {_JUDGED}",
    "fact_events": f"WITH {PARSED} SELECT file, line, v, ts, project, loop_id, event, {', '.join(f'{_get(f)} AS data_{f}' for f in _FLAT)} FROM parsed",
    "fact_loops": f"WITH {PARSED} {_LOOPS}",
    "loop_summary": f"""WITH {PARSED}, l AS ({_LOOPS}), f AS (SELECT project, loop_id, string_agg('[' || coalesce(severity, '?') || '] ' || coalesce(code, '?') || ' (' || coalesce(name, '?') || '): ' || coalesce(summary, '?') || ' -> ' || coalesce(resolution, '?') || CASE WHEN harness_ref <> '' THEN ' -> ' || harness_ref ELSE '' END, chr(10) ORDER BY file, line) AS failures
        FROM (SELECT f.*, t.name FROM ({_FAILS}) f LEFT JOIN (SELECT code, name FROM tax WHERE kind = 'code') t USING (code)) GROUP BY ALL) SELECT l.*, f.failures FROM l LEFT JOIN f ON l.project IS NOT DISTINCT FROM f.project AND l.loop_id = f.loop_id""",
    "fact_failures": f"WITH {PARSED} {_FAILS}",
    "two_strike": f"WITH {PARSED} SELECT code, count(*) AS total, count(*) >= 2 AS needs_hc, coalesce(max(harness_ref <> ''), false) AS has_hc_ref FROM ({_FAILS}) GROUP BY code",
    "taxonomy_dim": f"WITH {PARSED} SELECT code, category, category_name, tax.name, count(f.line) AS n FROM tax LEFT JOIN ({_FAILS}) f USING (code) WHERE tax.kind = 'code' GROUP BY ALL",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
