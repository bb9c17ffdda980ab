"""Track and pose tables derived from the driver's events and embeddings, in Spark and as DuckDB SQL.

``obs``: seq_id, track_id, frame_idx, box x1 y1 x2 y2 and conf, one row for each track and frame. ``keypoints``: seq_id,
track_id, frame_idx, joint j (0 to 16), x, y and score s. The values carry no physical meaning; they exercise the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Half-day bucket of the first frame, and frames in a sequence.
FIRST_BUCKET, FRAMES = 39446, 60

OBS_SQL = """
raw_obs as (
  select cast(user_id as bigint) as track_id, cast(user_id % 7 as bigint) as seq_id,
    cast(floor(epoch(ts) / 43200.0) as bigint) - 39446 as frame_idx, value, event_id,
    row_number() over (partition by user_id, cast(floor(epoch(ts) / 43200.0) as bigint) order by event_id) as rn
  from events),
obs as (
  select seq_id, track_id, frame_idx, (track_id * 7 % 240) + value * 0.25 as x1, cast(100 + (track_id * 3 % 60) as double) as y1,
    (track_id * 7 % 240) + value * 0.25 + 60.0 as x2, cast(220 + (track_id * 3 % 60) as double) + value * 0.1 as y2,
    cast(event_id % 97 as double) / 97 as conf
  from raw_obs where rn = 1)
"""

KEYPOINTS_SQL = """
kp as (
  select cast(vec_id % 20 % 7 as bigint) as seq_id, cast(vec_id % 20 as bigint) as track_id, cast(floor(vec_id / 20.0) as bigint) as frame_idx, cast(j as int) as j,
    500 + 400 * cast(embedding[3 * j + 1] as double) as x, 300 + 400 * cast(embedding[3 * j + 2] as double) as y,
    least(1.0::double, 6 * abs(cast(embedding[3 * j + 3] as double))) as s
  from embeddings, range(0, 17) as t(j))
"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 43200.0)
    rows = events.select(F.col("user_id").cast("long").alias("track_id"), (F.col("user_id") % 7).cast("long").alias("seq_id"), (bucket - FIRST_BUCKET).cast("long").alias("frame_idx"), "value", "event_id")
    first = Window.partitionBy("track_id", "frame_idx").orderBy("event_id")
    left, top = F.col("track_id") * 7 % 240, F.col("track_id") * 3 % 60
    return (
        rows.withColumn("rn", F.row_number().over(first))
        .where("rn = 1")
        .select(
            "seq_id", "track_id", "frame_idx",
            (left + F.col("value") * 0.25).alias("x1"), (100 + top).cast("double").alias("y1"),
            (left + F.col("value") * 0.25 + 60.0).alias("x2"), ((220 + top).cast("double") + F.col("value") * 0.1).alias("y2"),
            ((F.col("event_id") % 97).cast("double") / 97).alias("conf"),
        )
    )


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    at = lambda k: F.get("embedding", 3 * F.col("j") + k).cast("double")
    return vectors.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(16)))).select(
        (F.col("vec_id") % 20 % 7).cast("long").alias("seq_id"), (F.col("vec_id") % 20).cast("long").alias("track_id"), F.floor(F.col("vec_id") / 20.0).cast("long").alias("frame_idx"), "j",
        (500 + 400 * at(0)).alias("x"), (300 + 400 * at(1)).alias("y"), F.least(F.lit(1.0), 6 * F.abs(at(2))).alias("s"),
    )
