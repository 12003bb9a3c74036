"""Streams over an events table (event_id, ts, user_id, event_type, value): windows, sessions, late rows, running alerts, landing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sparkshelf.session import scratch


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of the parquet files that ``path`` names; new files are taken up as they land."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and type, closed by the watermark."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of a user that end after a gap."""
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def late_rows(events: DataFrame, allowed: str = "0 seconds") -> DataFrame:
    """event_id, user_id, ts, behind (microseconds): rows that come, in the order of ids, later than ``allowed`` after a row of their user with a greater time.

    The state of a user is the greatest time so far.  Of equal ids of a user the earlier time comes first, whatever the order in
    which a shuffle brings them; a row without a time is never late and leaves the state as it is.
    """
    grace = pd.Timedelta(allowed) // pd.Timedelta("1us")

    def work(key, parts, state):
        rows = pd.concat(list(parts)).sort_values(["event_id", "at"]).reset_index(drop=True)
        lowest = state.get[0] if state.exists else -(1 << 62)
        greatest = rows["at"].fillna(lowest).astype("int64").cummax().clip(lower=lowest)
        seen = greatest.shift(1, fill_value=lowest)
        state.update((int(greatest.iloc[-1]),))
        late = seen - rows["at"] > grace
        at = rows["at"][late].astype("int64")
        yield pd.DataFrame({"event_id": rows["event_id"][late], "user_id": key[0], "at": at, "behind": seen[late] - at})

    narrow = events.select("event_id", "user_id", F.unix_micros("ts").alias("at"))
    out = narrow.groupBy("user_id").applyInPandasWithState(work, "event_id long, user_id long, at long, behind long", "at long", "append", GroupStateTimeout.NoTimeout)
    return out.select("event_id", "user_id", F.timestamp_micros("at").alias("ts"), "behind")


def alerts(events: DataFrame, threshold: int, by: str = "event_type") -> DataFrame:
    """A row for each key, once, when its rows reach ``threshold``; the state of a key is its count."""

    def work(key, parts, state):
        before = state.get[0] if state.exists else 0
        after = before + sum(len(p) for p in parts)
        state.update((after,))
        reached = before < threshold <= after
        yield pd.DataFrame({"key": [key[0]] * reached, "reached": [threshold] * reached})

    # only counts go to the state's task
    return events.select(F.col(by).cast("string").alias("key")).groupBy("key").applyInPandasWithState(work, "key string, reached long", "n long", "append", GroupStateTimeout.NoTimeout)


def without_corrected(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """Records (file, line, ts, event, target) that no correction names as its target, given out when the watermark has passed; corrections themselves go."""
    rows = records.withWatermark("ts", delay)
    gone = rows.where("event = 'correction'").select(F.col("file").alias("_file"), F.col("target").alias("_line"), F.col("ts").alias("_ts"))
    own = rows.where("event != 'correction'")
    joined = own.join(gone, (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line")) & (F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= F.col("ts") + F.expr(f"INTERVAL {delay}")), "leftOuter")
    return joined.where("_line IS NULL").drop("_file", "_line", "_ts")


def land(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends what the watermark has closed to Parquet files, each batch once; what is there now, or for good."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything that the stream gives on what is there now, as a table in the shared folder: the last state of a complete stream, all rows of an appending one."""
    path = scratch(stream.sparkSession, "drained")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    keep(stream.sparkSession.createDataFrame([], stream.schema), -1)  # a stream without rows gives a table without rows
    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
    return found.select(*stream.columns)
