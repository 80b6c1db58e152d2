"""Leak-free train / validation / test assignment by identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.functions.checks import EvaluationError, guard_complete, guard_none, guard_unique, require_columns
from heldout.functions.hashing import hash_rank, ordered_index, seeded_hash
from heldout.functions.materialize import materialize
from heldout.functions.joins import attach_groups
from heldout.functions.formulas import half_even_count

SECOND_AXIS_SEED = 100_003
STRATUM_SEED = 1009


def _fractions(validation: float, test: float) -> None:
    if validation <= 0 or test <= 0:
        raise EvaluationError("both held-out shares must be above zero")
    if validation + test >= 1:
        raise EvaluationError("the held-out shares together must be less than one")


def _validate(df: DataFrame, columns: Sequence[str], validate: bool) -> None:
    require_columns(df, ["trial_uid", *columns])
    if validate:
        guard_unique(df, ["trial_uid"])
        guard_complete(df, columns)


def three_way(rank: str, count: str, validation: float, test: float) -> Column:
    """Split of the group at ``rank`` out of ``count``: test first, then validation.

    Counts are rounded half to even, at least one each.  When nothing would be
    left for training, test shrinks first and then validation.  Fewer than
    three groups cannot be split.
    """
    v = f"greatest(1L, cast(bround({count} * {float(validation)!r}D, 0) as bigint))"
    t = f"greatest(1L, cast(bround({count} * {float(test)!r}D, 0) as bigint))"
    t2 = f"if({t} + {v} >= {count}, greatest(1L, {count} - {v} - 1), {t})"
    t3 = f"if({t2} + {v} >= {count}, {count} - 2, {t2})"
    v3 = f"if({t2} + {v} >= {count}, 1L, {v})"
    return F.expr(
        f"case when {count} < 3 then raise_error('a three-way split needs at least three groups') "
        f"when {rank} <= {t3} then 'test' when {rank} <= {t3} + {v3} then 'validation' else 'train' end"
    )


def group_partition(
    df: DataFrame,
    group: str,
    *,
    seeds: Sequence[int],
    validation: float = 0.1,
    test: float = 0.2,
    stratum: str | None = None,
    split: str = "split",
    offset: int = 0,
) -> DataFrame:
    """One row per (seed, group) with the split of the whole group."""
    _fractions(validation, test)
    seed_rows = F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds]))
    by = ["seed"]
    if stratum is None:
        groups = df.select(group).distinct().withColumn("seed", seed_rows)
        effective = F.col("seed") + offset
    else:
        groups = df.select(group, stratum).distinct()
        index = ordered_index(groups, stratum, "_stratum_index")
        groups = attach_groups(groups, index, [stratum], how="inner", spread=group).withColumn("seed", seed_rows)
        effective = F.col("seed") + offset + STRATUM_SEED * F.col("_stratum_index")
        by.append(stratum)
    hashed = groups.withColumn("_hash", seeded_hash(effective, group, F.col(group)))
    ranked = hash_rank(hashed, hash_column="_hash", tie=group, by=by, rank="_rank", count="_n")
    keep = ["seed", group] + ([stratum] if stratum else [])
    return ranked.select(*keep, three_way("_rank", "_n", validation, test).alias(split))


def group_holdout(
    df: DataFrame,
    group: str,
    *,
    seeds: Sequence[int] = (11,),
    validation: float = 0.1,
    test: float = 0.2,
    validate: bool = True,
) -> DataFrame:
    """Hold out whole groups: ``(trial_uid, split, protocol, seed)``."""
    _validate(df, [group], validate)
    part = group_partition(df, group, seeds=seeds, validation=validation, test=test)
    out = attach_groups(df.select("trial_uid", group), part, [group], how="inner")
    return out.select("trial_uid", "split", F.lit(f"{group}_held_out").alias("protocol"), "seed")


def stratified_group_holdout(
    df: DataFrame,
    group: str,
    stratum: str,
    *,
    seeds: Sequence[int] = (11,),
    validation: float = 0.1,
    test: float = 0.2,
    validate: bool = True,
) -> DataFrame:
    """Group holdout inside each stratum; a group in two strata is an error."""
    _validate(df, [group, stratum], validate)
    if validate:
        spread = df.groupBy(group).agg(F.min(stratum).alias("a"), F.max(stratum).alias("b")).filter("a <> b")
        guard_none(spread, "identity groups span several strata")
    part = group_partition(df, group, seeds=seeds, validation=validation, test=test, stratum=stratum)
    out = attach_groups(df.select("trial_uid", group, stratum), part, [group, stratum], how="inner")
    return out.select("trial_uid", "split", F.lit(f"{group}_held_out").alias("protocol"), "seed")


def double_holdout(
    df: DataFrame,
    first: str = "subject_uid",
    second: str = "stimulus_uid",
    *,
    seeds: Sequence[int] = (11,),
    validation: float = 0.1,
    test: float = 0.2,
    stratum: str | None = None,
    validate: bool = True,
) -> DataFrame:
    """Keep a split only where both identity axes agree; other rows are excluded."""
    if first == second:
        raise EvaluationError("double holdout needs two different identity columns")
    columns = [first, second] + ([stratum] if stratum else [])
    _validate(df, columns, validate)
    common = dict(seeds=seeds, validation=validation, test=test, stratum=stratum)
    a = group_partition(df, first, split="_a", **common)
    b = group_partition(df, second, split="_b", offset=SECOND_AXIS_SEED, **common)
    extra = [stratum] if stratum else []
    out = attach_groups(df.select("trial_uid", *columns), a, [first, *extra], how="inner")
    out = attach_groups(out, b, [second, *extra, "seed"], how="inner")
    return out.select(
        "trial_uid",
        F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("excluded").alias("split"),
        F.lit(f"{first}_and_{second}_held_out").alias("protocol"),
        "seed",
    )


def context_transfer(
    df: DataFrame,
    *,
    source: str,
    target: str,
    subject: str = "subject_uid",
    context: str = "context",
    seeds: Sequence[int] = (11,),
    validation: float = 0.15,
    test: float = 0.2,
    validate: bool = True,
) -> DataFrame:
    """Train and validate in one context, test in another, with disjoint subjects."""
    if source == target:
        raise EvaluationError("context transfer needs two different contexts")
    _validate(df, [subject, context], validate)
    if validate:
        found = {r[0] for r in df.filter(F.col(context).isin(source, target)).select(context).distinct().collect()}
        if {source, target} - found:
            raise EvaluationError(f"missing context values: {sorted({source, target} - found)}")
    part = group_partition(df, subject, seeds=seeds, validation=validation, test=test, split="_s")
    out = attach_groups(df.select("trial_uid", subject, context), part, [subject], how="inner")
    split = (
        F.when((F.col(context) == source) & F.col("_s").isin("train", "validation"), F.col("_s"))
        .when((F.col(context) == target) & (F.col("_s") == "test"), "test")
        .otherwise("excluded")
    )
    return out.select(
        "trial_uid",
        split.alias("split"),
        F.lit(f"{source}_to_{target}_subject_held_out").alias("protocol"),
        "seed",
    )


def context_only_transfer(
    df: DataFrame,
    *,
    source: str,
    target: str,
    subject: str = "subject_uid",
    context: str = "context",
    family: str = "condition_family",
    seed: int = 11,
    validation: float = 0.15,
    validate: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Same participants on both sides; validation is sampled per (subject, family).

    A family with a single source trial is an error, or with ``strict=False``
    trains on it: nothing is left to validate with.
    """
    if source == target:
        raise EvaluationError("context transfer needs two different contexts")
    if not 0 < validation < 0.5:
        raise EvaluationError("the validation share must lie above 0 and below 0.5")
    _validate(df, [subject, context, family], validate)
    pool = df.filter(F.col(context) == source).select("trial_uid", subject, family)
    hashed = pool.withColumn("_hash", seeded_hash(seed, "context_only", F.col("trial_uid")))
    ranked = hash_rank(hashed, hash_column="_hash", tie="trial_uid", by=[subject, family], rank="_r", count="_n", digits=2)
    take = F.least(half_even_count(F.col("_n"), validation), F.col("_n") - 1)
    split = F.when(F.col("_r") <= take, "validation").otherwise("train")
    if strict:
        split = F.when(F.col("_n") < 2, F.raise_error(F.lit("each participant-condition family needs two source trials"))).otherwise(split)
    from_source = ranked.select("trial_uid", split.alias("split"))
    rest = df.filter(F.col(context) != source).select(
        "trial_uid", F.when(F.col(context) == target, "test").otherwise("excluded").alias("split")
    )
    return from_source.unionByName(rest).select(
        "trial_uid", "split", F.lit(f"{source}_to_{target}_context_only").alias("protocol"),
        F.lit(seed).cast("bigint").alias("seed"),
    )


def trial_random_holdout(df: DataFrame, *, stratum: str = "dataset_id", seeds=(11,), validation=0.1, test=0.2, validate=True):
    """Random trials inside each stratum: the protocol that ignores identity."""
    _validate(df, [stratum], validate)
    part = group_partition(df, "trial_uid", seeds=seeds, validation=validation, test=test, stratum=stratum)
    return part.select("trial_uid", "split", F.lit("trial_random").alias("protocol"), "seed")


def context_or_dataset_holdout(df: DataFrame, *, seeds=(11,), validation=0.1, test=0.2, columns=("context", "dataset_id")):
    """Group holdout on each column that has at least three values."""
    sizes = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    parts = [
        group_holdout(df, c, seeds=seeds, validation=validation, test=test, validate=False)
        for c in columns
        if sizes[c] >= 3
    ]
    if not parts:
        raise EvaluationError("no column has three groups")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_batch(df: DataFrame, *, seeds: Sequence[int], stratum: str = "dataset_id", validate: bool = True) -> DataFrame:
    """All strict protocols and seeds in one table, sized for partitioned writing."""
    _validate(df, ["subject_uid", "stimulus_uid", stratum], validate)
    subject = stratified_group_holdout(df, "subject_uid", stratum, seeds=seeds, validate=False)
    stimulus = stratified_group_holdout(df, "stimulus_uid", stratum, seeds=seeds, validate=False)
    joint = double_holdout(df, seeds=seeds, validation=0.2, stratum=stratum, validate=False)
    random = trial_random_holdout(df, stratum=stratum, seeds=seeds, validate=False)
    return subject.unionByName(stimulus).unionByName(joint).unionByName(random)


def split_batch_audit(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows and labelled rows per (protocol, seed, split)."""
    labelled = F.col("label_available").cast("bigint")
    return (
        assignment.join(df.select("trial_uid", "label_available"), "trial_uid")
        .groupBy("protocol", "seed", "split")
        .agg(F.count(F.lit(1)).alias("trials"), F.sum(labelled).alias("labelled"))
    )


def coverage_blocks(df: DataFrame, *, folds: int, seed: int, first="subject_uid", second="stimulus_uid", keep: Sequence[str] = ()) -> DataFrame:
    """``folds`` diagonal blocks: fold f tests (f, f), validates (f+1, f+1), trains on the rest.

    An identity's block is its hash rank modulo ``folds``; a row is used for
    training only if neither identity is in the test or validation block.
    Columns to ``keep`` go along, which spares a join on ``trial_uid``.
    """
    if folds < 3:
        raise EvaluationError("coverage blocks need at least three folds")
    axes = {}
    for column, shift in ((first, 0), (second, SECOND_AXIS_SEED)):
        groups = df.select(column).distinct().withColumn("_hash", seeded_hash(seed + shift, column, F.col(column)))
        ranked = hash_rank(groups, hash_column="_hash", tie=column, rank="_r")
        axes[column] = ranked.select(column, ((F.col("_r") - 1) % folds).cast("int").alias(f"_block_{column}"))
    columns = dict.fromkeys(("trial_uid", first, second, *keep))
    out = attach_groups(df.select(*columns), axes[first], [first], how="inner")
    out = attach_groups(out, axes[second], [second], how="inner")
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    a, b, f = F.col(f"_block_{first}"), F.col(f"_block_{second}"), F.col("fold")
    nxt = (f + 1) % folds
    split = (
        F.when((a == f) & (b == f), "test")
        .when((a == nxt) & (b == nxt), "validation")
        .when((a != f) & (b != f) & (a != nxt) & (b != nxt), "train")
        .otherwise("excluded")
    )
    return out.select("trial_uid", "fold", split.alias("split"), F.lit(seed).cast("bigint").alias("seed"), *keep)


ROLE_FRACTIONS = (("validation", 0.15), ("test", 0.2), ("tuning", 0.2))


def identity_roles(df: DataFrame, column: str, *, seed: int, fractions=ROLE_FRACTIONS, least: int = 2) -> DataFrame:
    """Disjoint identity roles in hash order, ``max(least, floor(n * fraction))`` each; the rest fit."""
    groups = df.select(column).distinct().withColumn("_hash", seeded_hash(seed, column, F.col(column)))
    ranked = hash_rank(groups, hash_column="_hash", tie=column, rank="_r", count="_n")
    role, bound = None, F.lit(0)
    for name, fraction in fractions:
        bound = bound + F.greatest(F.lit(least), F.floor(F.col("_n") * F.lit(float(fraction))))
        hit = F.col("_r") <= bound
        role = F.when(hit, name) if role is None else role.when(hit, name)
    too_few = bound >= F.col("_n")
    return ranked.select(
        column,
        F.when(too_few, F.raise_error(F.lit("too few identities for the roles"))).otherwise(role.otherwise("fit")).alias("role"),
    )


def split_audit(df: DataFrame, assignment: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coverage, split counts and pairwise identity overlap as ``(metric, part, value)``."""
    require_columns(df, ["trial_uid", *columns])
    require_columns(assignment, ["trial_uid", "split"])
    assignment = materialize(assignment.select("trial_uid", "split"))
    marked = df.select("trial_uid", *columns).join(assignment, "trial_uid", "full_outer")
    per_row = df.select("trial_uid", F.lit(1).alias("t"), F.lit(0).alias("a")).unionByName(
        assignment.select("trial_uid", F.lit(0).alias("t"), F.lit(1).alias("a"))
    )
    coverage = per_row.groupBy("trial_uid").agg(F.sum("t").alias("t"), F.sum("a").alias("a")).agg(
        F.count_if(F.col("a") == 0).alias("unassigned"),
        F.count_if(F.col("t") == 0).alias("unknown"),
        F.count_if(F.col("a") > 1).alias("repeated"),
        F.count_if(F.col("t") > 0).alias("trials"),
    )
    out = coverage.unpivot([], ["unassigned", "unknown", "repeated", "trials"], "part", "value").select(
        F.lit("coverage").alias("metric"), "part", F.col("value").cast("bigint").alias("value")
    )
    counts = assignment.groupBy("split").agg(F.count(F.lit(1)).alias("value"))
    out = out.unionByName(counts.select(F.lit("split_count").alias("metric"), F.col("split").alias("part"), "value"))
    pairs = (("train", "validation"), ("train", "test"), ("validation", "test"))
    if not columns:
        return out
    # one row per (column, identity) and one aggregation for all columns
    cells = ", ".join(f"struct('overlap:{c}' AS metric, cast(`{c}` as string) AS identity)" for c in columns)
    seen = marked.selectExpr("split", f"inline(array({cells}))").groupBy("metric", "identity").agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "validation", "test")]
    )
    overlap = seen.groupBy("metric").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    long = overlap.unpivot(["metric"], [f"{a}_{b}" for a, b in pairs], "part", "value")
    return out.unionByName(long.select("metric", "part", F.coalesce(F.col("value"), F.lit(0)).alias("value")))


def strict_partitions(df: DataFrame, assignment: DataFrame, isolated: Sequence[str]) -> DataFrame:
    """Constraint table ``(check, violations)`` for one protocol's assignment."""
    parts = ("train", "validation", "test")
    known = F.col("split").isin(*parts, "excluded")
    base = assignment.agg(
        F.count_if(~known).alias("unknown_split"),
        F.greatest(F.count_distinct("seed") - 1, F.lit(0)).alias("several_seeds"),
        *[
            F.greatest(F.lit(2) - F.count_if(F.col("split") == p), F.lit(0)).alias(f"missing_{p}_rows")
            for p in parts
        ],
    )
    names = ["unknown_split", "several_seeds", *[f"missing_{p}_rows" for p in parts]]
    out = base.unpivot([], names, "check", "violations").select("check", F.col("violations").cast("bigint"))
    audit = split_audit(df, assignment, isolated)
    uncovered = audit.filter("metric = 'coverage' AND part <> 'trials'").select(
        F.concat(F.lit("trial_"), F.col("part")).alias("check"), F.col("value").alias("violations")
    )
    repeats = (
        audit.filter("metric LIKE 'overlap:%' AND part LIKE '%test'")
        .groupBy(F.concat(F.substring_index("metric", ":", -1), F.lit("_repeats_in_test")).alias("check"))
        .agg(F.sum("value").alias("violations"))
    )
    return out.unionByName(uncovered).unionByName(repeats)
