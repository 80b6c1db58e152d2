"""Exposure cells: how many labelled rows of a test identity a predictor may use.

The whole (seed, participant dose, stimulus dose) grid is compiled at once.  A
trial's base role, its rank in the calibration and exposure pools and the doses
at which it is given up as a donor are computed once; a cell is then a pure
row expression over them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.functions.checks import EvaluationError, guard_none, guard_unique, require_columns
from heldout.functions.hashing import first_per_group, hash_rank, seeded_hash, support_digest
from heldout.functions.joins import attach_groups
from heldout.functions.materialize import materialize

TARGETS = ("target_valence", "target_arousal")
SPLITS = ("train", "validation", "test", "excluded")
DONOR_SEED = 1009
PIECE = 512  # donors of one point that stand in one row, about
LIST_LENGTH = 64  # first length of the candidate lists


def fixed_support(
    trials: DataFrame, strict: DataFrame, *, pmax: int, smax: int, subject="subject_uid", stimulus="stimulus_uid",
    context="context", targets: Sequence[str] = TARGETS, validate: bool = True,
) -> DataFrame:
    """Assigned trials with ``in_test`` (fixed support) and ``pool`` (candidate rows of eligible identities).

    Eligible identities have at least the maximum dose of excluded candidate
    rows, and are taken once from the surviving test rows.
    """
    if pmax < 0 or smax < 0:
        raise EvaluationError("a dose counts rows and can't be below zero")
    keep = ["trial_uid", subject, stimulus, *([context] if context in trials.columns else []), *targets]
    require_columns(trials, keep)
    require_columns(strict, ["trial_uid", "split", "seed"])
    rows = materialize(trials.select(*keep).join(strict.select("trial_uid", "split", "seed"), "trial_uid"))
    if validate:
        guard_unique(rows, ["seed", "trial_uid"])
        guard_none(rows.filter(~F.col("split").isin(*SPLITS)), f"split must be one of {SPLITS}")
        for column in (subject, stimulus):
            parts = rows.filter("split <> 'excluded'").groupBy("seed", column).agg(F.count_distinct("split").alias("n"))
            guard_none(parts.filter("n > 1"), f"{column} values stand both in the test part and outside it")
    test = rows.filter("split = 'test'")
    held = {
        axis: test.select("seed", column).distinct().withColumn(f"_held_{axis}", F.lit(True))
        for axis, column in (("p", subject), ("s", stimulus))
    }
    excluded = rows.filter("split = 'excluded'").select("seed", "trial_uid", subject, stimulus)
    marked = attach_groups(attach_groups(excluded, held["p"], ["seed", subject]), held["s"], ["seed", stimulus])
    pools = marked.selectExpr(
        "seed", "trial_uid", subject, stimulus,
        "case when _held_p and _held_s is null then 'participant' when _held_s and _held_p is null then 'stimulus' end AS pool",
    ).filter("pool is not null")
    eligible = {}
    for pool, column, least in (("participant", subject, pmax), ("stimulus", stimulus, smax)):
        eligible[column] = pools.filter(F.col("pool") == pool).groupBy("seed", column).agg(
            F.count(F.lit(1)).alias("_n")
        ).filter(F.col("_n") >= max(least, 1)).select("seed", column)
    kept = test.select("seed", "trial_uid", subject, stimulus)
    for column in (subject, stimulus):
        kept = kept.join(eligible[column], ["seed", column], "left_semi")
    kept = materialize(kept)
    if validate:
        small = rows.select("seed").distinct().join(kept.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), "seed", "left")
        guard_none(small.filter("coalesce(n, 0) < 4"), "the fixed support is down to three test rows or fewer")
    usable = pools.filter("pool = 'participant'").join(kept.select("seed", subject).distinct(), ["seed", subject], "left_semi")
    usable = usable.unionByName(
        pools.filter("pool = 'stimulus'").join(kept.select("seed", stimulus).distinct(), ["seed", stimulus], "left_semi")
    )
    marks = kept.selectExpr("seed", "trial_uid", "true AS in_test", "cast(null as string) AS pool").unionByName(
        usable.selectExpr("seed", "trial_uid", "false AS in_test", "pool")
    )
    return rows.join(marks, ["seed", "trial_uid"], "left").selectExpr(*rows.columns, "coalesce(in_test, false) AS in_test", "pool")


def nested_dose_sample(pool: DataFrame, identity: str, *, axis: str, dose: int, by: Sequence[str] = ("seed",)) -> DataFrame:
    """The first ``dose`` rows of each identity in hash order; a smaller dose is ``dose_rank <= d``."""
    hashed = pool.withColumn("_h", seeded_hash(F.col("seed"), axis, F.col(identity), F.col("trial_uid")))
    return first_per_group(
        hashed, by=[*by, identity], order=["_h", "trial_uid"], limit=dose, rank="dose_rank", spread="trial_uid"
    ).drop("_h")


def _grid(level: Column | str, *coordinates: str) -> list[str]:
    return [f"cast(floor({c} * shiftleft(1, {level})) as int)" for c in coordinates]


def _donor_points(donors: DataFrame, block: Sequence[str], targets: Sequence[str], limit: int, ties: str) -> DataFrame:
    """Donors by the point of their targets: ``(block, _d_targets, piece, n, donors)``, each row with a bounded list.

    With ties by donor every addition wants the donors of a point in the same
    order, so the first ``limit`` of it are enough (no ``want`` exceeds it).
    With ties by pair the order differs by addition: all donors of a point stay,
    in pieces of about ``PIECE``.
    """
    at = [*block, *[f"_d_{t}" for t in targets]]
    d = donors.selectExpr(*block, "trial_uid AS donor_uid", *[f"{t} AS _d_{t}" for t in targets])
    if ties == "donor":
        d = d.withColumn("_tie", seeded_hash(F.col("seed"), "donor", F.col("donor_uid")))
        first = first_per_group(d, by=at, order=["_tie", "donor_uid"], limit=limit, spread="donor_uid")
        rows = first.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("_tie", "donor_uid"))).alias("donors")).withColumn("piece", F.lit(0))
    else:
        n = d.groupBy(*at).agg(F.expr(f"cast(ceil(count(1) / {PIECE}) as int) AS _pieces"))
        d = attach_groups(d, n, at, how="inner", spread="donor_uid").withColumn("piece", F.expr("cast(pmod(xxhash64(donor_uid), _pieces) as int)"))
        rows = d.groupBy(*at, "piece").agg(F.collect_list(F.struct(F.lit("").alias("_tie"), "donor_uid")).alias("donors"))
    return materialize(rows.select(*at, "piece", F.size("donors").cast("bigint").alias("n"), "donors"))


def _candidates(additions: DataFrame, points: DataFrame, block: Sequence[str], targets: Sequence[str], limit: int, ties: str) -> DataFrame:
    """The ``want`` nearest donors of each addition inside its block, ties by hash.

    Donors are counted on nested grids, as fine as their points are many.  An
    addition searches the finest grid whose 3x3 neighbourhood holds enough
    donors: all of its nearest donors then lie in the 7x7 neighbourhood.  The
    points there are met without their donors, ring by ring of growing distance,
    until they hold ``want``; only those points' donors, ``want`` of each list
    at most, become pairs.
    """
    u, v = f"_d_{targets[0]}", f"_d_{targets[-1]}"
    finest = min(24, max(4, math.ceil(math.log2(max(1, points.count())) / 2) + 2))
    box = points.agg(*[f(c).alias(f"_{n}_{i}") for i, c in enumerate((u, v)) for n, f in (("lo", F.min), ("hi", F.max))])
    # both axes share one scale, so that a cell has the same side in each
    span = "greatest(_hi_0 - _lo_0, _hi_1 - _lo_1)"
    unit = lambda *names: [f"if({span} > 0, ({c} - _lo_{i}) / {span} * 0.999999D, 0D) AS _g{i}" for i, c in enumerate(names)]
    at = [*block, *[f"_d_{t}" for t in targets], "piece"]
    d = points.crossJoin(box).selectExpr(*at, "n", *unit(u, v))
    a = additions.crossJoin(box).selectExpr(
        *dict.fromkeys([*block, "trial_uid", "seed", "dose_seed", "stimulus_dose", "want"]), *[f"{t} AS _a_{t}" for t in targets], *unit(targets[0], targets[-1])
    )
    counts = d.selectExpr(*block, f"{_grid(str(finest), '_g0')[0]} AS x", f"{_grid(str(finest), '_g1')[0]} AS y", "n").groupBy(*block, "x", "y").agg(
        F.sum("n").alias("n")
    )
    counts = counts.selectExpr(*block, "x", "y", "n", f"explode(sequence(0, {finest})) AS level").selectExpr(
        *block, "level", f"shiftright(x, {finest} - level) AS x", f"shiftright(y, {finest} - level) AS y", "n"
    ).groupBy(*block, "level", "x", "y").agg(F.sum("n").alias("n"))
    gx, gy = _grid("level", "_g0", "_g1")
    key = ["stimulus_dose", "trial_uid", *[b for b in block if b != "stimulus_dose"]]
    near = a.selectExpr(*a.columns, f"explode(sequence(0, {finest})) AS level").selectExpr(
        *dict.fromkeys([*key, "want"]), "level", f"{gx} AS cx", f"{gy} AS cy"
    ).selectExpr(*dict.fromkeys([*key, "want"]), "level", "inline(array(" + ", ".join(
        f"struct(cx + {i} AS x, cy + {j} AS y)" for i in (-1, 0, 1) for j in (-1, 0, 1)) + "))")
    level = near.join(counts, [*block, "level", "x", "y"], "left").groupBy(*key, "level").agg(
        F.sum("n").alias("n"), F.first("want").alias("want")
    ).groupBy(*key).agg(F.expr("coalesce(max(level) filter (where n >= want), 0) AS level"))
    search = a.join(level, key).selectExpr(*a.columns, "level", f"{gx} AS cx", f"{gy} AS cy").selectExpr(
        *a.columns, "level", "explode(sequence(cx - 3, cx + 3)) AS x", "cy"
    ).selectExpr(*a.columns, "level", "x", "explode(sequence(cy - 3, cy + 3)) AS y").drop("_g0", "_g1")
    used = level.select("level").distinct()  # one row per level of the grid
    keyed = d.crossJoin(used).selectExpr(*at, "n", "level", f"{gx} AS x", f"{gy} AS y")
    square = " + ".join(f"(_d_{t} - _a_{t}) * (_d_{t} - _a_{t})" for t in targets)
    one = "seed, stimulus_dose, trial_uid"
    rings = search.join(keyed, [*block, "level", "x", "y"]).selectExpr(
        *dict.fromkeys([*at, "seed", "dose_seed", "stimulus_dose", "trial_uid", "want"]), "n", f"sqrt({square}) AS distance"
    ).selectExpr("*", f"sum(n) over (partition by {one} order by distance) - sum(n) over (partition by {one}, distance) AS closer").filter("closer < want")
    if ties == "donor":
        first = "slice(donors, 1, cast(want as int))"
    else:
        first = "slice(array_sort(transform(donors, d -> struct(sha2(concat_ws(':', dose_seed, 'donor', trial_uid, d.donor_uid), 256) AS _tie, d.donor_uid AS donor_uid))), 1, cast(want as int))"
    pairs = rings.drop("n", "closer").join(points.drop("n"), at).selectExpr("seed", "stimulus_dose", "trial_uid", "want", "distance", f"inline({first})")
    return first_per_group(
        pairs, by=["seed", "stimulus_dose", "trial_uid"], order=["distance", "_tie", "donor_uid"], limit=limit, rank="choice", spread="donor_uid", salts=16
    ).filter("choice <= want").drop("_tie")


def _propose(candidates: DataFrame) -> DataFrame:
    """The sequential matching by deferred acceptance, in rounds over all seeds and doses.

    All donors rank additions by the same priority, so the stable matching is
    unique and equals the sequential one.  In each round every free addition
    proposes to its next candidate and every donor keeps its best proposal.
    """
    key = ["seed", "stimulus_dose"]
    lists = materialize(candidates.select(*key, "trial_uid", "donor_uid", "priority", "choice"))
    # holds is 0 for a free addition, else the position of the donor it holds
    state = lists.groupBy(*key, "trial_uid").agg(F.max("choice").alias("last")).selectExpr("*", "0 AS tried", "false AS held")
    while True:
        active = state.selectExpr(*key, "trial_uid", "last", "if(held, tried, tried + 1) AS choice")
        offers = active.filter("choice <= last").join(lists, [*key, "trial_uid", "choice"])
        best = offers.groupBy(*key, "donor_uid").agg(F.min_by("trial_uid", F.struct("priority", "trial_uid")).alias("winner"))
        result = offers.join(best, [*key, "donor_uid"]).selectExpr(*key, "trial_uid", "donor_uid", "choice", "trial_uid = winner AS won")
        state = materialize(
            state.join(result.select(*key, "trial_uid", "choice", "won"), [*key, "trial_uid"], "left").selectExpr(
                *key, "trial_uid", "last", "coalesce(choice, tried) AS tried", "coalesce(won, false) AS held"
            )
        )
        if not state.filter("not held and tried < last").head(1):
            break
    final = state.filter("held").selectExpr(*key, "trial_uid", "tried AS choice")
    return final.join(lists, [*key, "trial_uid", "choice"]).select(*key, "trial_uid", "donor_uid")


def match_donors(
    train: DataFrame, additions: DataFrame, *, context: str = "context", targets: Sequence[str] = TARGETS,
    list_length: int = LIST_LENGTH, ties: str = "pair",
) -> DataFrame:
    """One train row given up per added row: ``(seed, stimulus_dose, trial_uid, donor_uid)``.

    Additions (one row per seed, dose and trial) go in hash order; each takes
    the nearest free donor of its own context, and another context's only when
    its own has none left.  Donors at equal distance go by the hash of the pair,
    or with ``ties="donor"`` by a hash of the donor alone: then no more than an
    addition's turn of the donors at one point are ever looked at, where a pair
    hash has to be taken of all of them.  An addition of priority r never needs
    more than its r nearest donors, so candidate lists are short; only additions
    that run out of candidates get longer lists, until all are placed.
    """
    if len(targets) not in (1, 2):
        raise EvaluationError("donors are matched on one or two targets")
    if ties not in ("pair", "donor"):
        raise EvaluationError("ties go by pair or by donor")
    key = ["seed", "stimulus_dose"]
    block = ["seed", context]
    a = additions.withColumn("dose_seed", F.col("seed") + DONOR_SEED * F.col("stimulus_dose")).withColumn(
        "priority", seeded_hash(F.col("dose_seed"), "addition", F.col("trial_uid"))
    )
    a = hash_rank(a, hash_column="priority", tie="trial_uid", by=[*key, context], rank="turn", digits=2)
    a = materialize(hash_rank(a, hash_column="priority", tie="trial_uid", by=key, rank="overall", count="total", digits=2))
    sizes = train.groupBy("seed").agg(F.count(F.lit(1)).alias("rows"))
    guard_none(
        a.select(*key, "total").distinct().join(sizes, "seed", "left").filter("total >= coalesce(rows, 0)"),
        "more additions than train rows that could be given up",
    )
    donors = train.select("seed", "trial_uid", context, *targets)
    addition = [*key, "trial_uid"]
    # reach: candidates asked for so far; spilt: the own context has no more of them
    pending = a.selectExpr("*", f"{int(list_length)}L AS reach", "false AS spilt")
    lists, reached, longest, spills, points = None, None, list_length, False, {}
    while True:
        for wide in (False, True) if spills else (False,):
            near = block if not wide else ["seed"]
            if ties == "donor" or wide not in points:  # with ties by pair the points don't depend on the reach
                points[wide] = _donor_points(donors if not wide else donors.drop(context), near, targets, longest, ties)
        new = _candidates(pending.withColumn("want", F.least("turn", "reach")), points[False], block, targets, longest, ties)
        if spills:
            # additions whose own context is exhausted continue with the other contexts' donors
            late = pending.filter("spilt").withColumn("want", F.least("overall", "reach")).drop(context)
            wide = _candidates(late, points[True], ["seed"], targets, longest, ties)
            wide = wide.join(new.select(*addition, "donor_uid"), [*addition, "donor_uid"], "left_anti")
            own = new.groupBy(*addition).agg(F.max("choice").alias("_own"))
            wide = wide.join(own, addition, "left").withColumn("choice", F.expr("cast(choice + coalesce(_own, 0) as int)")).drop("_own")
            # positions stay in preference order; gaps are closed for the proposal rounds
            new = new.unionByName(wide).selectExpr(
                "seed", "stimulus_dose", "trial_uid", "donor_uid", "want",
                "row_number() over (partition by seed, stimulus_dose, trial_uid order by choice) AS choice",
            )
        new = new.select(*addition, "donor_uid", "choice").join(a.select(*addition, "priority"), addition)
        lists = materialize(new if lists is None else lists.join(pending.select(*addition), addition, "left_anti").unionByName(new))
        matched = _propose(lists)
        matched = materialize(matched.selectExpr("seed", "cast(stimulus_dose as int) AS stimulus_dose", "trial_uid", "donor_uid"))
        state = pending.select(*addition, "reach", "spilt") if reached is None else reached.join(
            pending.select(*addition), addition, "left_anti").unionByName(pending.select(*addition, "reach", "spilt"))
        reached = materialize(state)
        left = a.join(matched, addition, "left_anti").join(reached, addition)
        pending = materialize(left.selectExpr(*a.columns, "4 * reach AS reach", "spilt or turn <= reach AS spilt"))
        short = pending.agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach"), F.max("spilt").alias("spilt")).first()
        if not short.n:
            return matched
        longest, spills = short.reach, short.spilt


def compile_cells(
    trials: DataFrame, strict: DataFrame, *, p_doses: Sequence[int], s_doses: Sequence[int], subject="subject_uid",
    stimulus="stimulus_uid", context="context", targets: Sequence[str] = TARGETS, validate: bool = True, ties: str = "pair",
) -> DataFrame:
    """Role table of the whole grid: ``(seed, participant_dose, stimulus_dose, trial_uid, split, role)``."""
    return expand_cells(
        cell_marks(
            trials, strict, p_doses=p_doses, s_doses=s_doses, subject=subject, stimulus=stimulus, context=context,
            targets=targets, validate=validate, ties=ties,
        ),
        p_doses=p_doses, s_doses=s_doses,
    )


def cell_marks(
    trials: DataFrame, strict: DataFrame, *, p_doses, s_doses, subject="subject_uid", stimulus="stimulus_uid",
    context="context", targets=TARGETS, validate: bool = True, ties: str = "pair",
) -> DataFrame:
    """One row per (seed, trial) with everything that decides its role in any cell."""
    pmax, smax = max(p_doses), max(s_doses)
    support = materialize(
        fixed_support(trials, strict, pmax=pmax, smax=smax, subject=subject, stimulus=stimulus, context=context, targets=targets, validate=validate)
    )
    key = ["seed", "trial_uid"]
    cal = nested_dose_sample(support.filter("pool = 'participant'"), subject, axis="participant", dose=pmax).selectExpr(
        *key, "dose_rank AS cal_rank"
    )
    exposed = materialize(nested_dose_sample(support.filter("pool = 'stimulus'"), stimulus, axis="stimulus", dose=smax))
    out = support.join(cal, key, "left").join(exposed.selectExpr(*key, "dose_rank AS exp_rank"), key, "left")
    doses = [s for s in s_doses if s > 0]
    if not doses:
        return out.withColumn("donor_doses", F.array().cast("array<int>"))
    additions = exposed.selectExpr("*", f"explode(array({', '.join(str(s) for s in doses)})) AS stimulus_dose").filter(
        "dose_rank <= stimulus_dose"
    ).select("seed", "stimulus_dose", "trial_uid", context, *targets)
    donors = match_donors(support.filter("split = 'train'"), additions, context=context, targets=targets, ties=ties)
    # a row is a donor at most once per dose, so the set has at most len(s_doses) items
    per_row = donors.groupBy("seed", F.col("donor_uid").alias("trial_uid")).agg(F.collect_set("stimulus_dose").alias("donor_doses"))
    return out.join(per_row, key, "left").withColumn("donor_doses", F.coalesce("donor_doses", F.array().cast("array<int>")))


def expand_cells(marks: DataFrame, *, p_doses, s_doses) -> DataFrame:
    p = f"array({', '.join(str(int(x)) for x in sorted(p_doses))})"
    s = f"array({', '.join(str(int(x)) for x in sorted(s_doses))})"
    role = """case when in_test then 'fixed_joint_test'
        when cal_rank <= participant_dose then 'labelled_participant_calibration'
        when split = 'validation' then 'strict_validation'
        when exp_rank <= stimulus_dose then 'repeated_stimulus_exposure'
        when array_contains(donor_doses, stimulus_dose) then 'train_size_matched_donor'
        when split = 'train' then 'population_train' else 'unsupported_or_unused' end"""
    rows = marks.selectExpr("*", f"explode({p}) AS participant_dose").selectExpr("*", f"explode({s}) AS stimulus_dose")
    rows = rows.selectExpr("seed", "participant_dose", "stimulus_dose", "trial_uid", f"{role} AS role")
    return rows.selectExpr(
        "seed", "participant_dose", "stimulus_dose", "trial_uid",
        "case role when 'fixed_joint_test' then 'test' when 'labelled_participant_calibration' then 'calibration' "
        "when 'strict_validation' then 'validation' when 'repeated_stimulus_exposure' then 'train' "
        "when 'population_train' then 'train' else 'excluded' end AS split",
        "role",
    )


CELL = ("seed", "participant_dose", "stimulus_dose")


def support_digests(assignment: DataFrame, keys: Sequence[str] = CELL, *, listed: bool = False) -> DataFrame:
    """Digest of the test support per cell.

    ``support_digest`` is order-free and aggregates at any size.  With
    ``listed`` the caller also asks for ``listed_sha256``, the SHA-256 of the
    sorted identifiers one per line, for which each support is gathered whole.
    """
    test = assignment.filter("split = 'test'")
    digest = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), support_digest().alias("support_digest"))
    if not listed:
        return digest
    lines = test.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("trial_uid")), "\n"), 256).alias("listed_sha256"))
    return digest.join(lines, list(keys), "left")


def axis_isolation(trials: DataFrame, assignment: DataFrame, columns: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """Per cell and column: identities complete, overlap of development and test, verified.

    A column that the trials lack is an axis without identities: incomplete, its overlap unknown, and not verified.
    """
    present = [c for c in columns if c in trials.columns]
    rows = assignment.filter("split <> 'excluded'").join(trials.select("trial_uid", *present), "trial_uid")
    cells = ", ".join(f"struct('{c}' AS axis, {f'cast({c} as string)' if c in present else 'cast(null as string)'} AS identity)" for c in columns)
    long = rows.selectExpr(*keys, "split", f"inline(array({cells}))")
    per = long.groupBy(*keys, "axis", "identity").agg(
        F.expr("bool_or(split <> 'test')").alias("dev"), F.expr("bool_or(split = 'test')").alias("test")
    )
    return per.groupBy(*keys, "axis").agg(
        F.expr("bool_and(coalesce(trim(identity), '') <> '')").alias("complete"), F.expr("count_if(dev and test)").alias("overlap")
    ).selectExpr(*keys, "axis", "complete", "if(complete, overlap, null) AS overlap", "complete and overlap = 0 AS verified")


AXIS_COLUMNS = {"session": "session_uid", "dataset": "dataset_id", "device": "device_id"}
_AXIS_CLAIMS = {"session": "session-independent generalization", "dataset": "cross-dataset generalization", "device": "cross-device generalization"}


def claim_card(
    cells: DataFrame, *, stimulus_label: str = "stimulus", verified: Sequence[str] = (), isolation: DataFrame | None = None,
    axis_columns: dict[str, str] | None = None, requested: Sequence[str] = (), context: str | None = None,
) -> DataFrame:
    """Deterministic wording, required labels and blocked claims of each cell row.

    With ``isolation``, the result of ``axis_isolation``, the axes verified in a
    cell decide which claims that cell may make, and the card also says which
    holdouts were ``requested``, the deployment ``context`` and what the
    verification covers; else ``verified`` names the axes of all cells.
    """
    columns = {**AXIS_COLUMNS, **(axis_columns or {})}
    names = list(cells.columns)
    if isolation is not None:
        held = isolation.filter("verified").groupBy(*CELL).agg(F.array_sort(F.collect_set("axis")).alias("_held"))
        cells = cells.join(held, list(CELL), "left").withColumn("_held", F.coalesce("_held", F.array().cast("array<string>")))
    else:
        cells = cells.withColumn("_held", F.array(*[F.lit(columns[a]) for a in verified]).cast("array<string>"))
    claims = ", ".join(f"if(array_contains(_held, '{columns[a]}'), null, '{text}')" for a, text in _AXIS_CLAIMS.items())
    base = (
        "'latent or true emotion disentanglement', 'causal removal of participant or stimulus identity', "
        "'fully subject-independent prediction when participant calibration is non-zero', "
        f"'unseen-{stimulus_label} prediction when {stimulus_label} exposure is non-zero'"
    )
    holdouts = ", ".join(f"if(array_contains(_held, '{columns[a]}'), '{a}', null)" for a in columns)
    wanted = ", ".join(f"'{a}'" for a in requested)
    boundary = [
        f"filter(array({holdouts}), x -> x is not null) AS verified_holdouts", f"cast(array({wanted}) as array<string>) AS requested_holdouts",
        "cast(null as string) AS deployment_context" if context is None else f"'{context.replace(chr(39), chr(92) + chr(39))}' AS deployment_context",
        "'identities as supplied; aliases and pretraining are not verified' AS verification_boundary",
    ] if isolation is not None else []
    who = "if(participant_dose = 0, 'zero labelled target-participant calibration', concat('a known participant with ', participant_dose, ' labelled calibration trials'))"
    what = f"if(stimulus_dose = 0, 'a {stimulus_label} absent from population training', concat('a {stimulus_label} represented by ', stimulus_dose, ' other-participant ratings'))"
    return cells.selectExpr(
        *names,
        "concat('participant-', lpad(participant_dose, greatest(2, length(participant_dose)), '0'), '_stimulus-', lpad(stimulus_dose, greatest(2, length(stimulus_dose)), '0')) AS cell",
        f"concat('Prediction for ', {who}, ' and ', {what}, '.') AS supported_deployment",
        "participant_dose > 0 AS participant_identity_id_required", "participant_dose AS participant_labels_required",
        "stimulus_dose AS same_stimulus_training_labels_required",
        f"filter(array({base}, {claims}), x -> x is not null) AS blocked_claims", *boundary,
    )


def cell_audit(assignment: DataFrame, base_train: DataFrame | None = None) -> DataFrame:
    """Counts per cell, donors, and whether the train size is that of the base.

    The base is the train rows of ``base_train`` (trial_uid, split and, if
    seeds differ, seed), or else those of the seed's cell without exposure.
    """
    per = assignment.groupBy(*CELL).agg(
        *[F.expr(f"count_if(split = '{s}')").alias(f"{s}_rows") for s in ("train", "validation", "calibration", "test", "excluded")],
        F.expr("count_if(role = 'train_size_matched_donor')").alias("donors"),
        F.expr("count_if(role = 'repeated_stimulus_exposure')").alias("exposures"),
    )
    if base_train is None:
        base = per.filter("participant_dose = 0 and stimulus_dose = 0").select("seed", F.col("train_rows").alias("_base"))
        joined = per.join(base, "seed", "left")
    elif "seed" in base_train.columns:
        joined = per.join(base_train.filter("split = 'train'").groupBy("seed").agg(F.count(F.lit(1)).alias("_base")), "seed", "left")
    else:
        joined = per.crossJoin(base_train.agg(F.expr("count_if(split = 'train')").alias("_base")))
    return joined.selectExpr(*per.columns, "train_rows = _base AS train_size_preserved")


def coverage_report(trials: DataFrame, assignment: DataFrame, *, fold: str = "fold") -> DataFrame:
    """Tested and total subjects, stimuli and trials over folds, and trials tested in several folds."""
    test = assignment.filter("split = 'test'").groupBy("trial_uid").agg(F.count_distinct(fold).alias("_folds"))
    rows = trials.select("trial_uid", "subject_uid", "stimulus_uid").join(test, "trial_uid", "left")
    return rows.agg(
        F.count_distinct("subject_uid").alias("subjects"), F.count_distinct("stimulus_uid").alias("stimuli"), F.count(F.lit(1)).alias("trials"),
        F.expr("count(distinct subject_uid) filter (where _folds is not null)").alias("tested_subjects"),
        F.expr("count(distinct stimulus_uid) filter (where _folds is not null)").alias("tested_stimuli"),
        F.count("_folds").alias("tested_trials"), F.expr("count_if(_folds > 1)").alias("trials_tested_twice"),
    )


def verify_doses(trials: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per cell: test identities whose realised dose is wrong, and forbidden overlaps."""
    rows = assignment.filter("split <> 'excluded'").join(trials.select("trial_uid", "subject_uid", "stimulus_uid"), "trial_uid")
    out = None
    for axis, column, role, dose in (
        ("participant", "subject_uid", "labelled_participant_calibration", "participant_dose"),
        ("stimulus", "stimulus_uid", "repeated_stimulus_exposure", "stimulus_dose"),
    ):
        per = rows.groupBy(*CELL, column).agg(
            F.expr("bool_or(split = 'test')").alias("tested"), F.expr(f"count_if(role = '{role}')").alias("n"),
            F.expr("count_if(split = 'calibration')").alias("cal"), F.expr("count_if(split in ('train', 'validation'))").alias("fit"),
        ).filter("tested")
        part = per.groupBy(*CELL).agg(
            F.count(F.lit(1)).alias(f"test_{axis}s"), F.expr(f"count_if(n <> {dose})").alias(f"wrong_{axis}_doses"),
            F.sum("cal" if axis == "stimulus" else "fit").alias(
                "calibration_rows_on_test_stimuli" if axis == "stimulus" else "fit_rows_of_test_participants"
            ),
        )
        out = part if out is None else out.join(part, list(CELL))
    return out


def grid_completeness(predictions: DataFrame, *, keys: Sequence[str] = ("representation", "seed", "participant_dose", "stimulus_dose")) -> DataFrame:
    """Every (representation, seed, p, s) with its rows and whether its support equals the seed's common one."""
    axes = [predictions.select(k).distinct() for k in keys]
    grid = axes[0]
    for a in axes[1:]:
        grid = grid.crossJoin(a)  # one row per expected cell
    found = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), support_digest().alias("digest"))
    per_seed = found.groupBy("seed").agg(F.min("digest").alias("_lo"), F.max("digest").alias("_hi"))
    return grid.join(found, list(keys), "left").join(per_seed, "seed", "left").selectExpr(
        *keys, "coalesce(rows, 0L) AS rows", "rows is not null AS present", "coalesce(_lo = _hi, false) AS same_support"
    )


def phase_assignment(
    trials: DataFrame, subject_roles: DataFrame, stimulus_roles: DataFrame, *, phase: str, p: int, s: int, pmax: int, smax: int, seed: int,
    targets: Sequence[str] = TARGETS,
) -> DataFrame:
    """Cell assignment of one selector phase; the other phase's identities never take part.

    Only the outcomes of the phase's own test block are blinded before matching.
    """
    if phase not in ("validation", "test"):
        raise EvaluationError("phase names no known step of selection")
    other = "test" if phase == "validation" else "validation"
    table = attach_groups(trials, subject_roles.withColumnRenamed("role", "_ps"), ["subject_uid"], how="inner")
    table = attach_groups(table, stimulus_roles.withColumnRenamed("role", "_ss"), ["stimulus_uid"], how="inner")
    table = table.filter((F.col("_ps") != other) & (F.col("_ss") != other))
    split = "case when _ps <> _ss then 'excluded' " + " ".join(
        f"when _ps = '{r}' then '{x}'" for r, x in (("fit", "train"), ("tuning", "validation"), (phase, "test"))
    ) + " else 'excluded' end"
    table = table.withColumn("_split", F.expr(split))
    blinded = table.withColumns({t: F.when(F.col("_split") == "test", 0.0).otherwise(F.col(t)) for t in targets})
    strict = table.selectExpr("trial_uid", "_split AS split", f"cast({seed} as bigint) AS seed")
    doses = dict(p_doses=sorted({p, pmax}), s_doses=sorted({s, smax}))
    marks = cell_marks(blinded.select(*trials.columns), strict, targets=targets, validate=False, **doses)
    return expand_cells(marks, p_doses=[p], s_doses=[s]).withColumn("phase", F.lit(phase))


def support_matched_overlap(
    trials: DataFrame, reference: DataFrame, *, subject="subject_uid", stimulus="stimulus_uid", validate: bool = True,
) -> DataFrame:
    """Same test rows and counts as ``reference``, but train covers every test identity.

    Greedy cover in two exact phases: rows that cover an uncovered test subject
    and an uncovered test stimulus are matched in hash order (parallel rounds of
    rows that are first at both ends), then each identity still uncovered takes
    its first row.  The rest is filled in hash order.  Keyed by ``seed``.
    """
    rows = trials.select("trial_uid", subject, stimulus).join(reference.select("trial_uid", "split", "seed"), "trial_uid")
    rows = materialize(rows.withColumn("_h", seeded_hash(F.col("seed"), F.col("trial_uid"))))
    test = rows.filter("split = 'test'")
    counts = rows.groupBy("seed").agg(*[F.expr(f"count_if(split = '{x}')").alias(f"_{x}") for x in ("train", "validation", "test")])
    if validate:
        guard_none(counts.filter("_train < 1 or _validation < 1 or _test < 1"), "reference needs nonempty train, validation and test")
    need = {c: test.select("seed", c).distinct() for c in (subject, stimulus)}
    pool = rows.filter("split <> 'test'")
    both = pool
    for c in (subject, stimulus):
        both = both.join(need[c], ["seed", c], "left_semi")
    # only the first row of a pair can ever be chosen
    edges = materialize(both.groupBy("seed", subject, stimulus).agg(F.min(F.struct("_h", "trial_uid")).alias("e")))
    chosen = edges.limit(0).select("seed", subject, stimulus, "e")
    while edges.head(1):
        first = edges
        for c in (subject, stimulus):
            low = edges.groupBy("seed", c).agg(F.min("e").alias(f"_lo_{c}"))
            first = first.join(low, ["seed", c])
        picked = materialize(first.filter(f"e = _lo_{subject} and e = _lo_{stimulus}").select("seed", subject, stimulus, "e"))
        chosen = chosen.unionByName(picked)
        for c in (subject, stimulus):
            edges = edges.join(picked.select("seed", c), ["seed", c], "left_anti")
        edges = materialize(edges)
    cover = chosen.selectExpr("seed", "e.trial_uid AS trial_uid")
    for c in (subject, stimulus):
        open_ids = need[c].join(chosen.select("seed", c), ["seed", c], "left_anti")
        firsts = pool.join(open_ids, ["seed", c], "left_semi").groupBy("seed", c).agg(F.min(F.struct("_h", "trial_uid")).alias("e"))
        if validate:
            guard_none(open_ids.join(firsts, ["seed", c], "left_anti"), f"test identities of {c} cannot be represented outside test")
        cover = cover.unionByName(firsts.selectExpr("seed", "e.trial_uid AS trial_uid"))
    cover = materialize(cover.distinct())
    sizes = cover.groupBy("seed").agg(F.count(F.lit(1)).alias("_cover"))
    if validate:
        guard_none(sizes.join(counts, "seed").filter("_cover > _train"), "too few training rows to cover all test identities")
    rest = pool.select("seed", "trial_uid", "_h").join(cover, ["seed", "trial_uid"], "left_anti")
    ranked = hash_rank(rest, hash_column="_h", tie="trial_uid", by=["seed"], rank="_r")
    ranked = ranked.join(counts, "seed").join(sizes, "seed", "left").selectExpr(
        "seed", "trial_uid",
        "case when _r <= _train - coalesce(_cover, 0) then 'train' when _r <= _train - coalesce(_cover, 0) + _validation then 'validation' end AS split",
    ).filter("split is not null")
    out = cover.selectExpr("seed", "trial_uid", "'train' AS split").unionByName(ranked).unionByName(test.select("seed", "trial_uid", "split"))
    return out.withColumn("protocol", F.lit("support_matched_identity_overlap"))
