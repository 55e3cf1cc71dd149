"""Queries of keyed streams over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.plans.registry import query, read
from maskwright.scratch import scratch_path
from maskwright.streaming import jobs

#: A table is replayed as a stream whose rows are never late.
_NEVER = "10000 days"
_SIX_HOURS = 6 * 3_600_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.with_keyed_state(spark)
    rows = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(out: DataFrame, name: str) -> DataFrame:
    """The rows of a stream that takes what is there and ends."""
    spark = out.sparkSession
    path = scratch_path(spark, name)
    out.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/table")


@query("select user_id, event_id, event_type from (select *, row_number() over w as n, lag(event_type) over w as p from events window w as (partition by user_id order by ts, event_id)) where n = 1 or event_type is distinct from p")
def stream_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another type than their user's event before."""
    texts = _events(spark, sf_dir).select("user_id", "ts", "event_id", F.col("event_type").alias("text"))
    out = jobs.changed(texts, "user_id", seq="event_id", late=_NEVER)
    return _run(out, "changed").select("user_id", "event_id", F.col("text").alias("event_type"))


@query(
    f"""with recursive o as (select user_id, event_id, event_type, epoch_ms(ts) as ms, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    f as (select user_id, rn, event_id, event_type as last, ms as at_ms, true as kept from o where rn = 1
        union all select o.user_id, o.rn, o.event_id, case when o.event_type != f.last or o.ms - f.at_ms >= {_SIX_HOURS} then o.event_type else f.last end,
            case when o.event_type != f.last or o.ms - f.at_ms >= {_SIX_HOURS} then o.ms else f.at_ms end, o.event_type != f.last or o.ms - f.at_ms >= {_SIX_HOURS} from f join o on o.user_id = f.user_id and o.rn = f.rn + 1)
    select user_id, event_id from f where kept"""
)
def stream_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events but those that repeat the type of their user's last accepted one within six hours of it."""
    texts = _events(spark, sf_dir).select("user_id", "ts", "event_id", F.col("event_type").alias("text"))
    out = jobs.accepted(texts, "user_id", seq="event_id", millis=_SIX_HOURS, late=_NEVER)
    return _run(out, "accepted").select("user_id", "event_id")


_KIND = "case when event_id % 10 = 9 then 'adopt' when event_id % 10 < 4 then 'paste' else 'see' end"


@query(
    f"""with e as (select user_id, event_id, event_type as token, 'p' || event_id % 3 as place, {_KIND} as kind from events),
    k as (select *, count(*) filter (kind = 'adopt') over (partition by user_id order by event_id) as claims from e),
    p as (select *, count(*) filter (kind = 'paste') over (partition by user_id, claims, token order by event_id) as pastes from k where kind != 'adopt'),
    m as (select *, lag(place) over (partition by user_id, claims, token order by event_id) as origin from p where pastes > 0)
    select user_id, event_id, token, origin, place from m where kind = 'see' and origin != place"""
)
def stream_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that sessions move to where they see them; the events run a second time, which adds nothing."""
    # from a second after 1970 on: Spark's watermark begins there, and a row at or before it counts as late
    f = lambda rows: rows.select("user_id", F.timestamp_seconds(F.col("event_id") + 1).alias("ts"), F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"), F.col("event_type").alias("token"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("place"))
    first = _run(jobs.moves(f(_events(spark, sf_dir)), "user_id", late=_NEVER), "moves")
    left = jobs.filed(f(read(spark, sf_dir, "events")), "user_id")
    again = _run(jobs.moves(f(_events(spark, sf_dir)), "user_id", initial=left, late=_NEVER), "moves-again")
    return first.unionAll(again).select("user_id", F.col("seq").alias("event_id"), "token", "origin", "place")
