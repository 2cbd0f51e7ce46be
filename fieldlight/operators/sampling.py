"""Deterministic sampling, splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_rank, unit_interval
from .aggregates import stratum_targets
from .cohort import unambiguous
from .contracts import candidate_contract, constant, enforce
from .joins import one_block_groups, only_in_one, too_close
from .windows import first_rows, placed, spaced_rows


def split_of(block: Column, seed: str, ratios: dict[str, float]) -> Column:
    """Split of a block by its draw against cumulative ratios."""
    u = unit_interval(F.lit(seed), block)
    out, edge = None, 0.0
    for name, share in list(ratios.items())[:-1]:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return F.lit(list(ratios)[-1]) if out is None else out.otherwise(list(ratios)[-1])


def select_candidates(
    df: DataFrame, total: int | None, floor: int, power: float, seed: str, ratios: dict[str, float], countries: list[str],
    least_metres: float = 200.0, tolerance: float = 0.0,
) -> DataFrame:
    """Stratified sample of each country by hash rank, with inclusion probabilities and a split per spatial block.

    total is one country's; None takes everything. Candidates must keep the contract (unique ids and places, the
    stated countries), and no two selected points may be nearer than least_metres (1 - tolerance).
    """
    enforce(candidate_contract(df, countries))
    if total is None:
        got = full_lattice(df, seed, ratios)
    else:
        t = stratum_targets(df, ["country"], ["stratum"], total, floor, power)
        rank = [hash_rank(F.lit(seed), "candidate_id"), F.col("candidate_id")]
        got = first_rows(df.join(t, ["country", "stratum"]), ["country", "stratum"], rank, F.col("target"))
        got = got.withColumn("spatial_split", split_of(F.col("spatial_block"), seed, ratios)).drop("n", "target")
    enforce(constant(got, ["spatial_block"], "spatial_split", "one_split"))
    near = too_close(got, "candidate_id", "longitude", "latitude", least_metres, tolerance)
    enforce(near.select(F.lit("minimum_distance").alias("rule"), F.concat_ws("|", "a", "b").alias("key"), F.col("metres").cast("string").alias("detail")))
    return got


def full_lattice(df: DataFrame, seed: str, ratios: dict[str, float]) -> DataFrame:
    """Everything, with probability 1."""
    return df.withColumns({"inclusion_probability": F.lit(1.0), "spatial_split": split_of(F.col("spatial_block"), seed, ratios)})


def best_split(df: DataFrame, block: str, label: str, seeds: int, ratios: dict[str, float]) -> DataFrame:
    """(seed, score): the seed whose blocks' split has every class in every split and deviates least from the ratios.

    The deviation is that of the splits' sizes, plus for each split the mean over classes of that of the
    class's share. Works on block-by-class counts times a range of seeds, never on rows. Without a
    class-complete split both are null.
    """
    counts = df.groupBy(block, label).agg(F.count("*").alias("n"))
    classes = counts.groupBy(label).agg(F.sum("n").alias("_t"))
    rows = classes.agg(F.sum("_t").alias("_rows"), F.count("*").alias("_classes"))  # one row
    own = counts.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("split", _seeded(F.col("seed"), F.col(block), ratios))
    want = F.element_at(F.create_map(*[x for k, r in ratios.items() for x in (F.lit(k), F.lit(r / sum(ratios.values())))]), F.col("split"))
    cells = own.groupBy("seed", label, "split").agg(F.sum("n").alias("n")).join(classes, label)
    splits = cells.groupBy("seed", "split").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.avg(F.abs(F.col("n") / F.col("_t") - want)).alias("off"))
    splits = splits.crossJoin(rows).withColumn("off", F.col("off") + F.abs(F.col("n") / F.col("_rows") - want))
    score = splits.groupBy("seed").agg(F.sum("cells").alias("cells"), F.first("_classes").alias("_classes"), F.sum("off").alias("score"))
    ok = score.where(F.col("cells") == F.col("_classes") * len(ratios))
    return ok.agg(F.min(F.struct(F.round("score", 9).alias("score"), "seed")).alias("b")).select("b.seed", "b.score")


def _seeded(seed: Column, block: Column, ratios: dict[str, float]) -> Column:
    u = unit_interval(seed.cast("string"), block.cast("string"))
    out, edge = None, 0.0
    for name, share in list(ratios.items())[:-1]:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return out.otherwise(list(ratios)[-1])


def balanced_folds(df: DataFrame, block: str, label: str, k: int, seeds: int) -> DataFrame:
    """(seed, score): random fold assignment of blocks with the least chi-square-like imbalance."""
    counts = df.groupBy(block, label).agg(F.count("*").alias("n")).withColumn("_t", F.sum("n").over(W.partitionBy(label)))
    own = counts.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    own = own.withColumn("fold", F.pmod(hash_rank(F.col("seed").cast("string"), F.col(block).cast("string")), F.lit(k).cast("decimal(20,0)")).cast("int"))
    cells = own.groupBy("seed", label, "fold").agg(F.sum("n").alias("n"), F.first("_t").alias("_t"))
    want = F.col("_t") / k
    # an empty cell counts want: all cells' sum of (n - want)^2 / want is the sum over full ones of (n^2 / want) less the totals
    s = cells.groupBy("seed").agg(F.sum(F.col("n") * F.col("n") / want - F.col("n")).alias("score"))
    return s.agg(F.min(F.struct(F.round("score", 9).alias("score"), "seed")).alias("b")).select("b.seed", "b.score")


#: Hashed assignments that a balanced one is held against.
HASHED = 8


def _assignments(groups: DataFrame, group: str, label: str, low: int, high: int) -> DataFrame:
    """(k, way, group, fold): for every k the groups dealt in rounds by size, in two ways, and by HASHED hashes.

    A round gives its k largest groups to the folds, forwards and backwards in turn, so that the fold with the largest gets the smallest next.
    Way 0 deals the groups of each label by themselves, each from where the last one ended; way 1 deals all together; from way 2 on hashes.
    """
    own = W.partitionBy(group)
    sized = groups.withColumns({"_all": F.sum("n").over(own), "_r": F.row_number().over(own.orderBy(F.desc("n"), F.col(label).cast("string")))}).where("_r = 1")
    tie = F.sha2(F.col(group).cast("string"), 256)
    # positions by counted ranges of sizes, label by label, then over all; one row a group
    by_label = sized.withColumn("_own", F.row_number().over(W.partitionBy(label).orderBy(F.desc("n"), tie)) - 1)
    counts = by_label.groupBy(label).agg(F.count("*").alias("_c")).withColumn("_ahead", F.coalesce(F.sum("_c").over(W.orderBy(F.col(label).cast("string")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed_ = placed(by_label.join(counts, label).withColumns({"_minus": -F.col("_all"), "_tie": tie}), ["_minus", "_tie"])
    each = placed_.withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(high))))
    round_ = lambda at: F.when((F.floor(at / F.col("k")) % 2) == 0, at % F.col("k")).otherwise(F.col("k") - 1 - at % F.col("k")).cast("int")
    hashed = [F.pmod(hash_rank(F.lit("g" if i == 0 else f"g{i}"), F.col(group).cast("string")), F.col("k").cast("decimal(20,0)")).cast("int") for i in range(HASHED)]
    ways = [round_(F.col("_ahead") + F.col("_own")), round_(F.col("place") - 1), *hashed]
    return each.select("k", group, F.posexplode(F.array(*ways)).alias("way", "fold"))


def imbalance(cells: DataFrame, keys: list[str], label: str, k: str) -> DataFrame:
    """(keys, score, full): sum over labels and folds of |share - 1/k|; full: every fold has every label."""
    shares = cells.withColumn("_t", F.sum("n").over(W.partitionBy(*keys, label)))
    off = F.abs(F.col("n") / F.col("_t") - 1 / F.col(k)) - 1 / F.col(k)  # an empty cell counts 1/k
    out = shares.groupBy(*keys).agg(F.sum(off).alias("_s"), F.count("*").alias("_cells"), F.count_distinct(label).alias("_labels"))
    return out.select(*keys, F.round(F.col("_s") + F.col("_labels"), 9).alias("score"), (F.col("_cells") == F.col(k) * F.col("_labels")).alias("full"))


def balanced_group_folds(df: DataFrame, group: str, label: str, most: int, least: int = 2) -> tuple[DataFrame, int | None, str]:
    """(group and fold, k, status): the largest k up to most with every class in every fold, and for it the assignment with the least imbalance.

    Status is '<k>_fold', or why no k can be tested: 'one_class', 'too_few_groups' or 'not_testable' (then no rows and k is None). Rows are read once,
    for counts by group and label; every k and every way is judged in one grouped pass. Never less balanced than the hashes it is held against.
    """
    groups = df.groupBy(group, label).agg(F.count("*").alias("n")).persist()
    try:
        seen = groups.agg(F.count_distinct(label).alias("labels"), F.count_distinct(group).alias("groups")).head()
        none = groups.select(group, F.lit(None).cast("int").alias("fold")).limit(0)
        if seen.labels < 2:
            return none, None, "one_class"
        high = min(most, seen.groups)
        if high < least:
            return none, None, "too_few_groups"
        ways = _assignments(groups, group, label, least, high)
        cells = ways.join(groups, group).groupBy("k", "way", label, "fold").agg(F.sum("n").alias("n"))
        best = imbalance(cells, ["k", "way"], label, "k").where("full").agg(F.max(F.struct(F.col("k"), (-F.col("score")).alias("s"), (-F.col("way")).alias("w"))).alias("b")).head().b
        if best is None:
            return none, None, "not_testable"
        return ways.where((F.col("k") == best.k) & (F.col("way") == -best.w)).select(group, "fold"), best.k, f"{best.k}_fold"
    finally:
        groups.unpersist()


def group_folds(df: DataFrame, group: str, label: str, most: int, least: int = 2) -> tuple[DataFrame, int | None]:
    """(rows with fold, k); fold is null where no k is testable."""
    folds, k, _ = balanced_group_folds(df, group, label, most, least)
    return df.join(folds, group, "left"), k


def calibrated_folds(df: DataFrame, group: str, label: str, most: int, inner: int = 3) -> tuple[DataFrame, int | None, str]:
    """(group, outer_fold, role, k, status): the outer folds, and inside the training groups of each a calibration part.

    role: test, calibration (fold 0 of up to `inner` balanced folds of the training groups) or fit. An outer fold whose training groups cannot
    be divided has role train for all of them.
    """
    folds, k, status = balanced_group_folds(df, group, label, most)
    if k is None:
        return folds.select(group, F.lit(0).alias("outer_fold"), F.lit("").alias("role")), k, status
    rows, out = df.join(folds, group), None
    for o in range(k):  # k is small, and each is one grouped pass over counts
        inside, parts, _ = balanced_group_folds(rows.where(F.col("fold") != o), group, label, inner)
        train = F.lit("train") if parts is None else F.when(F.col("_in") == 0, "calibration").otherwise("fit")
        own = folds.join(inside.withColumnRenamed("fold", "_in"), group, "left").select(group, F.lit(o).alias("outer_fold"), F.when(F.col("fold") == o, "test").otherwise(train).alias("role"))
        out = own if out is None else out.unionByName(own)
    return out, k, status


def classification_rows(
    a: DataFrame, b: DataFrame, pixel: str, group: str, label: str, block: str, cap: int, ratios: dict[str, float], good: Column, order: list, seeds: int = 64
) -> DataFrame:
    """The pixel dataset of two sources: one good row per pixel with one label, no pixel of both sources, no group over
    several blocks, classes capped by hash and numbered, blocks split by the best seed."""
    x, y = (unambiguous(d, pixel, label, good, order)[0] for d in (a, b))
    x, y = only_in_one(x, y, pixel)
    both = one_block_groups(x.withColumn("source", F.lit("a")).unionByName(y.withColumn("source", F.lit("b"))), group, block)
    got = first_rows(both, [label], [hash_rank(F.lit("cap"), F.col(pixel).cast("string")), F.col(pixel)], cap)
    classes = got.select(label).distinct().withColumn("class_id", F.dense_rank().over(W.orderBy(label)) - 1)  # one row per class
    seed = best_split(got, block, label, seeds, ratios).head().seed
    if seed is None:
        raise ValueError(f"none of {seeds} seeds puts every class into every split")
    return got.join(classes, label).withColumn("split", _seeded(F.lit(seed), F.col(block), ratios))


def balanced_sample(df: DataFrame, label: str, field: str, pixel: str, n: int, m: int) -> DataFrame:
    """n fields per label by hash, m evenly spaced pixels of each."""
    fields = first_rows(df.select(label, field).distinct(), [label], [hash_rank(F.lit("b"), F.col(field).cast("string")), F.col(field)], n)
    return spaced_rows(df.join(fields, [label, field], "left_semi"), [label, field], [F.col(pixel)], m)


def observed_outcome(n_fine: Column, need: int) -> Column:
    return F.when(n_fine >= need, "complete").when(n_fine > 0, "insufficient").otherwise("none")
