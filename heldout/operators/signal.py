"""Sample-level jobs: epochs, re-referencing, band power, pooling and feature views."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heldout.functions.checks import EvaluationError, guard_none
from heldout.functions.joins import attach_groups

# Fixed bands in Hz, [low, high).
BANDS = (("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 45.0))
TINY = float(np.finfo(np.float64).tiny)
BLOCK_SECONDS = 30
SALTS = 4  # tasks that the vectors of one key are dealt to


def cut_epochs(samples: DataFrame, trials: DataFrame, *, bucket: int = 4096, validate: bool = True) -> DataFrame:
    """Samples inside each trial's ``[start, stop)``, with their position in the epoch.

    A range join through buckets of the sample index: a trial is listed once per
    bucket it touches, so the join is an equi-join on (recording, bucket).
    """
    if validate:
        size = samples.groupBy("recording").agg((F.max("sample_idx") + 1).alias("_n"))
        bad = trials.join(size, "recording", "left").filter("start < 0 or stop <= start or stop > coalesce(_n, 0)")
        guard_none(bad.select("recording", "trial_uid", "start", "stop"), "trial exceeds recording bounds")
    wide = trials.selectExpr("recording", "trial_uid", "start", "stop", f"explode(sequence(start div {bucket}, (stop - 1) div {bucket})) AS _bucket")
    keyed = samples.withColumn("_bucket", F.expr(f"sample_idx div {bucket}"))
    return keyed.join(wide, ["recording", "_bucket"]).filter("sample_idx >= start and sample_idx < stop").selectExpr(
        "recording", "trial_uid", "channel", "sample_idx - start AS position", "value"
    )


def average_reference(epochs: DataFrame) -> DataFrame:
    """Subtract the mean over channels at every sample of a trial."""
    mean = epochs.groupBy("trial_uid", "position").agg(F.avg("value").alias("_ref"))
    return epochs.join(mean, ["trial_uid", "position"]).withColumn("value", F.col("value") - F.col("_ref")).drop("_ref")


def _window_power(fs: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x")
            sizes = x.value_lengths().to_numpy(zero_copy_only=False)
            flat, start = x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            out = np.full((batch.num_rows, len(BANDS)), np.nan)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                v = np.stack([flat[start[i]:start[i + 1]] for i in rows])
                v = v - v.mean(1, keepdims=True)
                hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
                density = np.abs(np.fft.rfft(v * hann, axis=1)) ** 2 / (fs * (hann**2).sum())
                density[:, 1:(None if size % 2 else -1)] *= 2
                freq = np.fft.rfftfreq(size, 1 / fs)
                for j, (_, low, high) in enumerate(BANDS):
                    pick = (freq >= low) & (freq < high)
                    if pick.sum() >= 2:
                        out[rows, j] = np.trapezoid(density[:, pick], freq[pick], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("trial_uid"), batch.column("channel"), pa.array(list(out), pa.list_(pa.float64()))], names=["trial_uid", "channel", "power"]
            )

    return run


def log_bandpower(epochs: DataFrame, *, fs: float, window_s: float = 2.0) -> DataFrame:
    """Log band power by Welch's method: ``(trial_uid, channel, band, value)``.

    Half-overlapping Hann windows, mean removed per window, one-sided density,
    trapezoid per band, mean over windows, then the log.  A sample belongs to at
    most two windows, so an epoch is spread over (trial, channel, window) rows
    of bounded length and long epochs are never gathered.
    """
    if fs <= 2 * BANDS[-1][2]:
        raise EvaluationError("the highest band lies above half the sampling rate")
    full = int(round(window_s * fs))
    size = epochs.groupBy("trial_uid", "channel").agg(
        F.count(F.lit(1)).alias("_len"), F.expr("count_if(value is null or isnan(value) or abs(value) = double('inf'))").alias("_bad")
    )
    rows = attach_groups(epochs.select("trial_uid", "channel", "position", "value"), size, ["trial_uid", "channel"], how="inner", spread="position")
    rows = rows.selectExpr(
        "trial_uid", "channel", "position",
        "if(_len < 2 or _bad > 0, raise_error('an epoch needs two or more finite samples'), cast(value as double)) AS value",
        "_len", f"least(_len, {full}L) AS _seg",
    ).selectExpr("*", "_seg - _seg div 2 AS _step", "(_len - _seg div 2) div (_seg - _seg div 2) AS _windows")
    first = "cast(greatest(0, ceil((position - _seg + 1) / _step)) as bigint)"
    spread = rows.selectExpr("*", f"{first} AS _a", "least(_windows - 1, position div _step) AS _b").filter("_a <= _b").selectExpr(
        "trial_uid", "channel", "position", "value", "explode(sequence(_a, _b)) AS window"
    )
    # at most ``full`` samples per window
    windows = spread.groupBy("trial_uid", "channel", "window").agg(
        F.expr("transform(array_sort(collect_list(struct(position, value))), e -> e.value)").alias("x")
    )
    power = windows.select("trial_uid", "channel", "x").mapInArrow(_window_power(fs), "trial_uid string, channel string, power array<double>")
    names = ", ".join(f"'{b[0]}'" for b in BANDS)
    long = power.selectExpr("trial_uid", "channel", "posexplode(power) AS (i, p)").groupBy("trial_uid", "channel", "i").agg(F.avg("p").alias("p"))
    return long.selectExpr(
        "trial_uid", "channel", f"element_at(array({names}), i + 1) AS band",
        f"if(isnan(p), raise_error('too few frequency bins in a band'), ln(greatest(p, {TINY!r}D))) AS value",
    )


def global_band_summary(bandpower: DataFrame) -> DataFrame:
    """Mean and population sd over channels per band."""
    return bandpower.groupBy("trial_uid", "band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def trial_block_features(seconds: DataFrame, *, block: int = BLOCK_SECONDS) -> DataFrame:
    """One-second values to per-block channel means and block-wide mean and sd per band.

    ``channel`` is NULL in the block-wide rows.  A recording with missing
    seconds or a partial last block is an error.
    """
    check = seconds.groupBy("recording").agg(F.max("second").alias("m"), F.min("second").alias("lo"), F.count_distinct("second").alias("n"))
    guard_none(check.filter(f"lo <> 0 or n <> m + 1 or n % {block} <> 0"), "non-contiguous one-second values")
    rows = seconds.withColumn("block", F.expr(f"second div {block}"))
    r, b, c, a = (F.col(x) for x in ("recording", "block", "band", "channel"))
    return rows.groupingSets([[r, b, c, a], [r, b, c]], r, b, c, a).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def inspect_blocks(seconds: DataFrame, expected: DataFrame, *, block: int = BLOCK_SECONDS) -> DataFrame:
    """Complete blocks, trailing seconds, non-finite blocks and status per recording."""
    rows = seconds.selectExpr(
        "recording", "second", f"second div {block} AS block", "value is null or isnan(value) or abs(value) = double('inf') AS bad"
    )
    per_block = rows.groupBy("recording", "block").agg(F.max("second").alias("m"), F.expr("bool_or(bad)").alias("bad"))
    per = per_block.groupBy("recording").agg((F.max("m") + 1).alias("n"), F.expr("count_if(bad)").alias("bad_blocks"))
    return expected.join(per, "recording", "left").selectExpr(
        "recording", "expected_trials", f"coalesce(n, 0) div {block} AS observed_trials", f"coalesce(n, 0) % {block} AS trailing_seconds",
        f"if(coalesce(n, 0) % {block} = 0, coalesce(bad_blocks, 0L), 0L) AS nonfinite_trials",
    ).selectExpr(
        "*", "if(trailing_seconds = 0 and observed_trials = expected_trials and nonfinite_trials = 0, 'verified', 'source_inconsistent_excluded') AS status"
    )


def _run_sums(whole: bool):
    """Sums over runs of equal ``_key`` of rows sorted by it: of vectors ``v`` with weight ``w``, or of such sums."""

    def add(state: list, parts: Sequence[np.ndarray]) -> None:
        short = len(parts[0]) - len(state[0])
        if short > 0:
            state[:] = [np.append(s, np.zeros(short)) for s in state]
        for s, p in zip(state, parts):
            s[: len(p)] += p

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        names = batch.column("_key").to_pylist()
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        columns = [batch.column(c) for c in (("a", "b", "n") if whole else ("v",))]
        lengths = columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = [c.flatten() for c in columns]
        if whole:
            values = [f.to_numpy(zero_copy_only=False) for f in flat]
        else:
            w = batch.column("w")
            known = np.repeat(w.is_valid().to_numpy(zero_copy_only=False), lengths) & flat[0].is_valid().to_numpy(zero_copy_only=False)
            weight = np.repeat(w.fill_null(0).to_numpy(zero_copy_only=False).astype(float), lengths)
            v = flat[0].to_numpy(zero_copy_only=False).astype(float)
            counted = np.repeat(w.is_valid().to_numpy(zero_copy_only=False), lengths)
            values = [np.where(known, weight * np.where(known, v, 0), 0), np.where(counted, weight, 0), known.astype(float)]
        if len(set(lengths.tolist())) == 1 and lengths[0]:
            blocks = [np.add.reduceat(x.reshape(len(names), -1), starts, axis=0) for x in values]
            yield from ((names[at], [x[i] for x in blocks]) for i, at in enumerate(starts))
        else:
            ends = np.cumsum(lengths)
            yield from ((names[i], [x[ends[i] - lengths[i] : ends[i]] for x in values]) for i in range(len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state, schema = [], None, None

        def out():
            lists = [pa.array([k for k, _ in done], schema), *[pa.array([s[i] for _, s in done], pa.list_(pa.float64())) for i in range(3)]]
            done.clear()
            return pa.RecordBatch.from_arrays(lists, names=["_key", "a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema.field("_key").type
            for key, parts in rows(batch):
                if state is None or key != state[0]:
                    if state is not None:
                        done.append(state)
                    if len(done) >= 1024:
                        yield out()
                    state = (key, [np.zeros(0)] * 3)
                add(state[1], parts)
        if state is not None:
            done.append(state)
            yield out()

    return run


def pool_vectors(vectors: DataFrame, *, weight: str | None = None, key: str = "trial_uid", vector: str = "vector") -> DataFrame:
    """Weighted elementwise mean of the window or token vectors of a trial.

    Vectors are sent whole, once, to one of ``SALTS`` tasks of their key; only sums go on from there.
    """
    w = f"cast({weight} as double)" if weight else "1D"
    rows = vectors.selectExpr(f"{key} AS _key", f"{w} AS w", f"{vector} AS v", f"spark_partition_id() % {SALTS} AS _salt")
    kind = dict(rows.dtypes)["_key"]
    shape = f"_key {kind}, a array<double>, b array<double>, n array<double>"
    part = rows.repartition("_key", "_salt").sortWithinPartitions("_key", "_salt").select("_key", "w", "v").mapInArrow(_run_sums(False), shape)
    total = part.repartition("_key").sortWithinPartitions("_key").mapInArrow(_run_sums(True), shape)
    return total.filter("size(a) > 0").selectExpr(
        f"_key AS {key}", f"transform(sequence(0, size(a) - 1), i -> if(n[i] > 0, a[i] / b[i], cast(null as double))) AS {vector}"
    )


def concat_modalities(left: DataFrame, right: DataFrame, *, width: int, key: str = "trial_uid", vector: str = "vector") -> DataFrame:
    """Two pooled modalities side by side, zeros where a trial lacks one."""
    both = left.withColumnRenamed(vector, "_a").join(right.withColumnRenamed(vector, "_b"), key, "full_outer")
    zero = f"array_repeat(0D, {width})"
    return both.selectExpr(key, f"concat(coalesce(_a, {zero}), coalesce(_b, {zero})) AS {vector}")


def enumerate_views(spark: SparkSession, channels: Sequence[str], bands: Sequence[str], regions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Full, and only / leave-one-out per band and region, with their channel-major indices."""
    for names in (channels, bands, list(regions)):
        if not names or len(set(names)) != len(names) or not all(names):
            raise EvaluationError("each name is needed once and can't be empty")
    members = [c for r in regions.values() for c in r]
    if sorted(members) != sorted(channels):
        raise EvaluationError("regions must partition the channels exactly")
    rows = [("full", "full", "full", "all", list(range(len(channels) * len(bands))))]
    for axis, groups in (("band", {b: None for b in bands}), ("region", regions)):
        for name, inside in groups.items():
            hit = [
                (b == name) if axis == "band" else (c in inside)
                for c in channels for b in bands
            ]
            for mode in ("only", "leave_out"):
                index = [i for i, h in enumerate(hit) if h == (mode == "only")]
                if not index:
                    raise EvaluationError(f"view {axis}_{name}_{mode} selects no features")
                rows.append((f"{axis}_{name}_{mode}", axis, name, mode, index))
    return spark.createDataFrame(rows, "view_id string, axis string, name string, mode string, indices array<int>")


def feature_views(features: DataFrame, views: DataFrame) -> DataFrame:
    """Every view of every feature row in one pass."""
    return features.crossJoin(F.broadcast(views.select("view_id", "indices"))).selectExpr(
        *[c for c in features.columns if c != "features"], "view_id", "transform(indices, i -> features[i]) AS features"
    )


def select_channels(samples: DataFrame, *, pattern: str | None = None, excluded: Sequence[str] = (), expected: int | None = None) -> DataFrame:
    """Keep matching channels (case-insensitive exclusion); a wrong channel count per recording is an error."""
    kept = samples
    if pattern:
        kept = kept.filter(F.col("channel").rlike(f"^(?:{pattern})$"))
    if excluded:
        kept = kept.filter(~F.upper("channel").isin(*[e.upper() for e in excluded]))
    if expected is not None:
        counts = kept.groupBy("recording").agg(F.count_distinct("channel").alias("n"))
        all_ids = samples.select("recording").distinct().join(counts, "recording", "left")
        guard_none(all_ids.filter(f"coalesce(n, 0) <> {expected}"), f"expected {expected} channels")
    return kept


def one_second_windows(intervals: DataFrame, *, first: int = 5, second: int = 10) -> DataFrame:
    """Trial intervals to one row per second with a split by trial position."""
    return intervals.filter("end_s > start_s").selectExpr(
        "recording", "position", "label", "explode(sequence(0L, end_s - start_s - 1)) AS window_offset_seconds",
        f"case when position < {first} then 'train' when position < {second} then 'validation' else 'test' end AS split",
    )
