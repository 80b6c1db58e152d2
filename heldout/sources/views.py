"""Trial-shaped views over the given parquet tables.

Every registered query starts from one of these lazy views, so its work grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGETS = ("target_valence", "target_arousal")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per row of ``events``: subject = user, stimulus = the key in props."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "value",
        "cast(get_json_object(props, '$.k') as bigint) AS k", "least(value, 500D) / 500 AS level",
    )
    return e.selectExpr(
        "concat('ev:', event_id) AS trial_uid",
        "'ev' AS dataset_id",
        "concat('u', user_id) AS subject_uid",
        "concat('k', k) AS stimulus_uid",
        "event_type AS context",
        "0.5D * k / 99.0D + 0.3D * level + 0.2D * (user_id % 7) / 6 AS target_valence",
        "0.5D * ((k * 37) % 100) / 99.0D + 0.3D * ((user_id * 13) % 11) / 10 + 0.2D * level AS target_arousal",
        "event_id % 17 <> 0 AS label_available",
        "event_id", "user_id", "k", "value",
    )


def trials_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trials spread over three datasets that share no identities."""
    t = trials(spark, sf_dir)
    keep = [c for c in t.columns if c not in ("dataset_id", "subject_uid", "stimulus_uid")]
    return t.selectExpr(
        "concat('d', user_id % 3) AS dataset_id",
        "concat('d', user_id % 3, ':', subject_uid) AS subject_uid",
        "concat('d', user_id % 3, ':', stimulus_uid) AS stimulus_uid",
        *keep,
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trial_uid`` with a 64-wide vector: trial i uses vector i modulo the vector count."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    t = trials(spark, sf_dir).select("trial_uid", "event_id").crossJoin(n)
    return (
        t.withColumn("vec_id", F.col("event_id") % F.col("n"))
        .join(e, "vec_id")
        .select("trial_uid", F.col("embedding").cast("array<double>").alias("features"), "label")
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user logs: view = cue, click = stimulus, signup = marker, purchase = rating."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('u', user_id) AS recording",
        "unix_micros(cast(ts as timestamp)) / 1e6D AS onset",
        "event_id AS sample",
        "event_type AS kind",
        "cast(get_json_object(props, '$.k') as bigint) AS k",
        "value",
        "unix_micros(cast(ts as timestamp)) div 86400000000 AS day",
    )
