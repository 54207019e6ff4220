"""Streaming forms of hourly totals and deduplication: events read as a file stream, run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows as S
from .registry import query, table


def stream(spark, d):
    static = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    s = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    return s.select(*static.columns).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def streaming_hourly(spark, d):
    out = S.tumbling_totals(stream(spark, d), "ts", ["event_type"], "value", late="0 seconds")
    done = S.run_to_table(out, "complete")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY user_id""")
def streaming_dedup(spark, d):
    twice = stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    done = S.run_to_table(S.deduplicated(twice, "ts", ["event_id"], "60 days"))
    return done.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, run""")
def streaming_sessions(spark, d):
    done = S.run_to_table(S.sessions(stream(spark, d), "ts", "user_id", "4 hours", "0 seconds"), "complete")
    return done.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")
