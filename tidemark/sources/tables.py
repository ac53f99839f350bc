"""The domain's tables, derived from a folder of Parquet tables.

clock: one row per event of a series (idx from 0, us: integer microseconds, strength).
signal: small equidistant series (k from 0, x). frame: one spectral frame per row. block: level intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Start of the events' clock: 2024-01-01, in microseconds.
EPOCH_US = 1_704_067_200_000_000
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with us, microseconds since the clock's start; ts carries no zone and is read as UTC."""
    found = table(spark, sf_dir, "events")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz")) - F.lit(EPOCH_US)
    return found.select("event_id", "user_id", "event_type", "value", us.alias("us"))


def clock(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Each user's events as an event clock; with ``kind`` the clock of one type of event."""
    found = events(spark, sf_dir)
    if kind:
        found = found.where(F.col("event_type") == kind)
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    return found.select(F.col("user_id").alias("series"), (F.row_number().over(order) - 1).cast("long").alias("idx"), "us", F.col("value").alias("strength"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of event values per event type, zero where nothing happened."""
    found = events(spark, sf_dir)
    hours = found.groupBy(F.col("event_type").alias("series"), F.floor(F.col("us") / HOUR_US).alias("k")).agg(F.sum("value").alias("x"))
    spine = found.select(F.col("event_type").alias("series")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))))
    return spine.join(hours, ["series", "k"], "left").select("series", "k", F.round(F.coalesce("x", F.lit(0.0)), 2).alias("x"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as magnitude spectra: series (label), frame (order within it) and bins."""
    found = table(spark, sf_dir, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    return found.select(F.col("label").alias("series"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("bins"))


def blocks(spark: SparkSession, sf_dir: str, of: str = "l_extendedprice") -> DataFrame:
    """Weekly level blocks per line status: start and end in days, and the mean price (or other column) as level."""
    found = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    week = F.floor(day / 7)
    return found.groupBy(F.col("l_linestatus").alias("series"), week.alias("week")).agg(F.round(F.avg(of), 2).alias("level")).select("series", (F.col("week") * 7).alias("start"), (F.col("week") * 7 + 7).alias("end"), "level")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as bars: bar (order from 0) and pulses (lines of the order)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pulses"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    found = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return found.select(F.col("o_custkey").alias("series"), (F.row_number().over(order) - 1).cast("long").alias("bar"), "pulses", F.col("o_totalprice").alias("score"))


#: The same tables as SQL, for the stated results.
CLOCK_SQL = "clock AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) - 1704067200000000 AS us, value AS strength FROM events)"
REF_SQL = "refclock AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) - 1704067200000000 AS us, value AS strength FROM events WHERE event_type = 'view')"
SIGNAL_SQL = (
    "signal AS (SELECT s.series, k.k, round(coalesce(h.x, 0.0), 2) AS x FROM (SELECT DISTINCT event_type AS series FROM events) s "
    "CROSS JOIN (SELECT unnest(range(0, 720)) AS k) k LEFT JOIN (SELECT event_type AS series, (epoch_us(ts) - 1704067200000000) // 3600000000 AS k, sum(value) AS x FROM events GROUP BY ALL) h "
    "ON s.series = h.series AND k.k = h.k)"
)
FRAMES_SQL = "frames AS (SELECT label AS series, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS bins FROM embeddings)"
BINS_SQL = "bins AS (SELECT series, frame, unnest(bins) AS m, generate_subscripts(bins, 1) - 1 AS bin FROM frames)"
BLOCKS_SQL = "blocks AS (SELECT l_linestatus AS series, week * 7 AS start, week * 7 + 7 AS \"end\", round(avg(l_extendedprice), 2) AS level FROM (SELECT *, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) // 7 AS week FROM lineitem) GROUP BY l_linestatus, week)"
BARS_SQL = (
    "bars AS (SELECT o_custkey AS series, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS bar, pulses, o_totalprice AS score "
    "FROM orders JOIN (SELECT l_orderkey, count(*) AS pulses FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"
)
