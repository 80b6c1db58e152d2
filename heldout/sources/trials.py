"""Trial, feature and prediction tables: reading, alignment and ordered writing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.functions.checks import EvaluationError, blank, guard_none, guard_unique, require_columns

MANIFEST = ("trial_uid", "dataset_id", "subject_id", "stimulus_uid", "context")


def read_delimited(spark: SparkSession, path: str, *, sep: str = "\t") -> DataFrame:
    """A headed TSV/CSV file, plain or gzipped, every column read as text."""
    names = spark.read.csv(path, sep=sep, header=True, inferSchema=False).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, sep=sep, header=True, schema=schema)


def union_manifests(tables: Sequence[DataFrame], *, validate: bool = True) -> DataFrame:
    """Union trial manifests; absent ``label_available`` means every row is labelled."""
    if not tables:
        raise EvaluationError("no trial table was given")
    prepared = []
    for df in tables:
        require_columns(df, MANIFEST)
        if "label_available" not in df.columns:
            df = df.withColumn("label_available", F.lit(True))
        elif dict(df.dtypes)["label_available"] == "string":
            df = df.withColumn("label_available", F.lower("label_available").isin("true", "1", "yes"))
        prepared.append(df.withColumn("subject_uid", F.concat_ws(":", "dataset_id", "subject_id")))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), prepared)
    if validate:
        guard_unique(out, ["trial_uid"])
    return out


def load_trials(spark: SparkSession, paths: Sequence[str], *, validate: bool = True) -> DataFrame:
    tables = [
        spark.read.parquet(p) if p.endswith(".parquet") else read_delimited(spark, p) for p in paths
    ]
    return union_manifests(tables, validate=validate)


def feature_view(df: DataFrame, view: str = "foundation", *, channels: int = 1, bands: int = 1) -> DataFrame:
    """``features`` as stored, as channel-major (channel, band) values, or as mean and sd per band."""
    if view in ("foundation", "channel"):
        return df
    if view != "global":
        raise EvaluationError(f"unknown feature view {view!r}")
    pick = "transform(sequence(0, {c} - 1), c -> element_at(features, c * {b} + j + 1))".format(c=channels, b=bands)
    mean = f"aggregate({pick}, 0D, (a, v) -> a + v) / {channels}"
    sd = f"sqrt(aggregate({pick}, 0D, (a, v) -> a + (v - {mean}) * (v - {mean})) / {channels})"
    keep = [c for c in df.columns if c != "features"]
    seq = f"sequence(0, {bands} - 1)"
    return df.selectExpr(
        *keep, f"concat(transform({seq}, j -> {mean}), transform({seq}, j -> {sd})) AS features"
    )


def feature_faults(df: DataFrame) -> DataFrame:
    """One row: trial count, repeated trials, distinct widths, non-finite vectors."""
    per_trial = df.selectExpr(
        "trial_uid",
        "size(features) AS width",
        "exists(features, x -> x is null or isnan(x) or abs(x) = double('inf')) AS bad",
    ).groupBy("trial_uid").agg(
        F.count(F.lit(1)).alias("n"), F.min("width").alias("lo"), F.max("width").alias("hi"), F.expr("count_if(bad)").alias("bad")
    )
    return per_trial.agg(
        F.count(F.lit(1)).alias("trials"),
        F.expr("count_if(n > 1)").alias("repeated_trials"),
        F.min("lo").cast("bigint").alias("min_width"),
        F.max("hi").cast("bigint").alias("max_width"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("nonfinite_rows"),
    )


def load_features(spark: SparkSession, path: str, view: str = "foundation", **geometry) -> DataFrame:
    df = spark.read.parquet(path).selectExpr("trial_uid", "cast(features as array<double>) AS features")
    faults = feature_faults(df).first()
    if faults.repeated_trials or faults.nonfinite_rows or faults.min_width != faults.max_width:
        raise EvaluationError(f"invalid feature table: {faults.asDict()}")
    return feature_view(df, view, **geometry)


def align_predictions(
    inputs: dict[str, tuple[DataFrame, str]],
    *,
    targets: Sequence[str] = ("valence", "arousal"),
    validate: bool = True,
) -> DataFrame:
    """Join prediction tables one to one on (protocol, seed, trial_uid).

    ``inputs`` maps a label to (table, model prefix).  Metadata and truth must be
    identical in every table.
    """
    if len(inputs) < 2:
        raise EvaluationError("at least two prediction tables are required")
    keys = ["protocol", "seed", "trial_uid"]
    meta = [*keys, "dataset_id", "subject_id", "stimulus_uid", "context", *[f"target_{t}" for t in targets]]
    out = reference = None
    for label, (df, model) in inputs.items():
        columns = [f"{model}_{t}" for t in targets]
        require_columns(df, [*meta, *columns])
        named = [F.col(c).alias(f"{label}_{t}") for c, t in zip(columns, targets)]
        if validate:
            guard_unique(df, keys)
        if out is None:
            out, reference = df.select(*meta, *named), df.select(*meta)
            continue
        if validate:
            other = df.select(*meta)
            guard_none(reference.exceptAll(other).unionByName(other.exceptAll(reference)), "metadata is not aligned")
        out = out.join(df.select(*keys, *named), keys)
    return out


def feature_support(features: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of counts: archived, used, ignored and missing trials."""
    both = features.select("trial_uid").withColumn("f", F.lit(1)).join(
        expected.select("trial_uid").distinct().withColumn("e", F.lit(1)), "trial_uid", "full_outer"
    )
    return both.agg(
        F.count("f").alias("archive_trial_count"),
        F.expr("count_if(f = 1 and e = 1)").alias("used_labelled_trial_count"),
        F.expr("count_if(f = 1 and e is null)").alias("ignored_unlabelled_trial_count"),
        F.expr("count_if(f is null)").alias("missing_trial_count"),
    )


def align_feature_support(features: DataFrame, expected: DataFrame, *, validate: bool = True) -> DataFrame:
    """Keep the expected trials; a missing one is an error, extras are dropped and counted."""
    require_columns(features, ["trial_uid"])
    if validate:
        guard_unique(features, ["trial_uid"])
        missing = feature_support(features, expected).first().missing_trial_count
        if missing:
            raise EvaluationError(f"feature table misses {missing} expected trials")
    return features.join(expected.select("trial_uid"), "trial_uid", "left_semi")


def merge_feature_shards(shards: Sequence[DataFrame], manifest: DataFrame, *, validate: bool = True) -> DataFrame:
    """Union disjoint shards and check them against the manifest's exact trial set."""
    out = reduce(lambda a, b: a.unionByName(b), shards)
    if validate:
        guard_unique(out, ["trial_uid"])
        counts = feature_support(out, manifest).first()
        if counts.missing_trial_count or counts.ignored_unlabelled_trial_count:
            raise EvaluationError(f"shards do not match the manifest: {counts.asDict()}")
    return out.join(manifest.select("trial_uid", "position"), "trial_uid")


def ordered_layout(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Globally sorted partitions: the physical layout of every deterministic table."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_ordered(df: DataFrame, path: str, keys: Sequence[str], *, fmt: str = "parquet", partition_by=()) -> None:
    """Committed, sorted output as parquet, CSV or TSV (the text forms may be gzipped)."""
    writer = ordered_layout(df, keys).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
        return
    name, _, codec = fmt.partition(".")
    options = {"header": True, "sep": "\t" if name == "tsv" else ","}
    if codec:
        options["compression"] = "gzip"
    writer.csv(path, **options)


def eligible_trials(df: DataFrame, *, validate: bool = True) -> DataFrame:
    """Labelled, alignment-verified trials of positive duration."""
    require_columns(df, ["trial_uid", "label_available", "alignment_status", "duration_s"])
    out = df.filter("label_available and alignment_status = 'verified' and duration_s > 0")
    if validate:
        guard_unique(out, ["trial_uid"])
    return out


def ensure_entity_uids(df: DataFrame) -> DataFrame:
    """Fill absent subject and stimulus identities with dataset-qualified defaults."""
    require_columns(df, ["dataset_id", "subject_id"])

    def filled(column: str, default):
        return F.when(blank(column), default).otherwise(F.col(column)) if column in df.columns else default

    subject = F.concat_ws(":", "dataset_id", "subject_id")
    missing = F.concat_ws(":", "dataset_id", F.lit("unavailable"))
    stimulus = (
        F.when(blank("stimulus_id"), missing).otherwise(F.concat_ws(":", "dataset_id", F.col("stimulus_id").cast("string")))
        if "stimulus_id" in df.columns
        else missing
    )
    return df.withColumns({"subject_uid": filled("subject_uid", subject), "stimulus_uid": filled("stimulus_uid", stimulus)})


def exclude_subjects(df: DataFrame, excluded: DataFrame, *, column: str = "subject_uid", validate: bool = True):
    """Rows left and rows dropped; an excluded id that never occurs is an error."""
    ids = excluded.select(column).distinct()
    if validate:
        guard_none(ids.join(df, column, "left_anti"), "unknown excluded subject")
    return df.join(ids, column, "left_anti"), df.join(ids, column, "left_semi")


def file_availability(df: DataFrame, listing: DataFrame, *, path: str = "path") -> DataFrame:
    """``available`` from the current listing; paths leaving the root never count."""
    present = listing.select(F.col("path").alias("_present")).distinct()
    inside = ~F.col(path).rlike(r"^/|(^|/)\.\.(/|$)")
    return df.join(present, F.col(path) == F.col("_present"), "left").withColumn(
        "available", F.coalesce(inside & F.col("_present").isNotNull(), F.lit(False))
    ).drop("_present")
