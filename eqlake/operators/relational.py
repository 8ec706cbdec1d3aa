"""Relational operators of the evaluation pipeline: splits, samples, joins by key and nearness, ranks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def hash_order(*keys: str, seed: int = 42) -> Column:
    """An order that depends on seed and keys alone: the same for any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


#: Ranges of a hash order in which rows of a stratum are counted before they are ranked.
RANGES = 256


def places(df: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with _rank (from 1, in the hash order of ``key``) and _size within its stratum; a null stratum is one too.

    Rows are counted by stratum and range of the order first, which gives each range the
    number of rows before it; only rows of one range are ranked together. So a stratum that
    holds most rows is ranked by up to RANGES tasks.
    """
    order = hash_order(key, seed=seed)
    rows = df.withColumn("_order", order).withColumn("_range", F.conv(F.substring("_order", 1, 2), 16, 10).cast("int"))
    counts = rows.groupBy(F.col(stratum).alias("_stratum"), "_range").agg(F.count("*").alias("_n"))
    # RANGES rows a stratum
    within = Window.partitionBy("_stratum")
    counts = counts.select(
        "_stratum", F.col("_range").alias("_of"), F.sum("_n").over(within.orderBy("_range")).alias("_upto"), "_n", F.sum("_n").over(within).alias("_size")
    )
    joined = rows.join(counts, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_range") == F.col("_of")))
    own = F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_order", key))
    return joined.withColumn("_rank", own + F.col("_upto") - F.col("_n")).drop("_order", "_range", "_stratum", "_of", "_upto", "_n")


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """``per_stratum`` rows of each stratum, or all of a smaller one."""
    return places(df, stratum, key, seed).where(F.col("_rank") <= per_stratum).drop("_rank", "_size")


def split(df: DataFrame, stratum: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Column ``split``: train, val or test by share within each stratum."""
    place = (F.col("_rank") - 0.5) / F.col("_size")
    named = F.when(place <= train, "train").when(place <= train + val, "val").otherwise("test")
    return places(df, stratum, key, seed).withColumn("split", named).drop("_rank", "_size")


def strata(df: DataFrame) -> Column:
    """The stratum of a row of an augmented set: whether it is augmented, its solution type and edge case, or one default of each."""
    col = lambda c, default: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)) if c in df.columns else F.lit(default)
    return F.concat_ws("_", col("augmented", "false"), col("solution_type", "unknown"), col("edge_case", "none"))


def split_dataset(df: DataFrame, key: str, train: float = 0.8, val: float = 0.0, seed: int = 42) -> DataFrame:
    """``split`` by strata of augmentation, type and edge case.

    Shares that add up to more than 1 are scaled to 0.9; without any share left for
    test all rows are train. A stratum of one row can't be split, and then there are no
    strata at all; a single row is train.
    """
    if train + val > 1:
        train, val = train * 0.9 / (train + val), val * 0.9 / (train + val)
    if train + val >= 1 and not val:
        return df.withColumn("split", F.lit("train"))
    rows = df.withColumn("_strata", strata(df))
    if rows.groupBy("_strata").count().where("count < 2").limit(1).count():
        rows = rows.withColumn("_strata", F.lit("all"))
    return split(rows, "_strata", key, train, val, seed).drop("_strata")


def split_statistics(df: DataFrame) -> DataFrame:
    """``split, solution_type, edge_case, rows, originals, augmented, ratio, level``: by split, by split and type, and by split and edge case of augmented rows.

    Level 3 is a whole split, 1 a type and 2 an edge case, as grouping_id gives them. Blank values are left out of
    the last two; the ratio is the share of augmented rows.
    """
    made = F.coalesce(F.col("augmented").cast("boolean"), F.lit(False))
    rows = df.withColumn("_made", made).withColumn("edge_case", F.when(F.col("_made"), F.nullif(F.trim("edge_case"), F.lit("")))).withColumn("solution_type", F.nullif(F.trim("solution_type"), F.lit("")))
    out = rows.groupingSets([["split"], ["split", "solution_type"], ["split", "edge_case"]], "split", "solution_type", "edge_case").agg(
        F.count("*").alias("rows"), F.count_if(~F.col("_made")).alias("originals"), F.count_if("_made").alias("augmented"), F.grouping_id().alias("level")
    )
    named = ((F.col("level") == 1) & F.col("solution_type").isNotNull()) | ((F.col("level") == 2) & F.col("edge_case").isNotNull())
    return out.where((F.col("level") == 3) | named).withColumn("ratio", F.col("augmented") / F.col("rows"))


def quotas(df: DataFrame, stratum: str, key: str, part: float = 0.1, seed: int = 42) -> DataFrame:
    """Column ``split``: in each stratum the first tenth, one row at least, is validation and the rest train."""
    first = F.greatest(F.lit(1), F.floor(F.col("_size") * part))
    return places(df, stratum, key, seed).withColumn("split", F.when(F.col("_rank") <= first, "val").otherwise("train")).drop("_rank", "_size")


def pilot(df: DataFrame, stratum: str, key: str, twice: str = "exact_symbolic") -> DataFrame:
    """The first row of each stratum by key, and the second of one."""
    w = Window.partitionBy(stratum).orderBy(key)
    # the two least rows of a stratum are found within parts of it first
    part = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64)))
    near = part.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum, "_part").orderBy(key))).where("_rn <= 2").drop("_part", "_rn")
    return near.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") == 1) | ((F.col("_rn") == 2) & (F.col(stratum) == twice))).drop("_rn")


def without_leaks(train: DataFrame, test: DataFrame, value: str = "lambda_val", digits: int = 6) -> DataFrame:
    """Rows of ``train`` whose value, rounded, isn't one of ``test``; a row without a value stays."""
    seen = test.select(F.round(value, digits).alias("_seen")).where("_seen is not null").distinct()
    return train.join(seen, F.round(F.col(value), digits) == F.col("_seen"), "left_anti")


def unseen(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't done yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def nearest(left: DataFrame, right: DataFrame, key: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Every row of ``left`` with the nearest ``y`` of ``right`` by ``x``, closer than ``tolerance``, or null.

    Bands of that width: what is closer is the next row of ``right`` on either side in a row's own band, the last of the band
    below or the first of the band above. So rows are put in order within bands and no pairs are made. Of equally near ones the
    lesser x wins, and of equal x the least y. Repeated rows repeat.
    """
    spot = lambda c: F.floor(c / tolerance)
    there = F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    points = right.where(F.col(key).isNotNull() & there).groupBy(F.col(key).alias("_key"), F.col(x).alias("_x")).agg(F.min(y).alias("_y")).withColumn("_band", spot(F.col("_x")))
    point = F.struct("_x", "_y")
    ends = points.groupBy("_key", "_band").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    moved = lambda by, c: ends.select("_key", (F.col("_band") + by).alias("_band"), F.col(c))
    beside = moved(1, "_last").join(moved(-1, "_first"), ["_key", "_band"], "full")
    placeable = F.col(key).isNotNull() & there
    rows = left.where(placeable).select(F.struct(*left.columns).alias("_row"), F.col(key).alias("_key"), F.col(x).alias("_x"), spot(F.col(x)).alias("_band"), F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType).alias("_p"))
    both = rows.unionByName(points.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_key", "_x", "_band", point.alias("_p")))
    order = Window.partitionBy("_key", "_band").orderBy("_x")
    # rows of one x see its point on either side, whatever their order
    upto, onward = order.rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("_key", "_band").orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_before", F.last("_p", True).over(upto)).withColumn("_after", F.last("_p", True).over(onward)).where(F.col("_row").isNotNull())
    found = placed.join(beside, ["_key", "_band"], "left")
    near = lambda c: F.when(F.abs(F.col(c)["_x"] - F.col("_x")) < tolerance, F.struct(F.abs(F.col(c)["_x"] - F.col("_x")).alias("gap"), F.col(c)["_x"].alias("x"), F.col(c)["_y"].alias("y")))
    best = F.least(*map(near, ("_before", "_after", "_first", "_last")))
    out = found.select("_row.*", best["y"].alias("nearest_y"))
    return out.unionByName(left.where(~placeable).withColumn("nearest_y", F.lit(None).cast(out.schema["nearest_y"].dataType)))


def running(df: DataFrame, key: str, amount: str, name: str, ranges: int = 1024) -> DataFrame:
    """Column ``name``: the sum of ``amount`` over all rows with a lesser numeric ``key``, which must be unique.

    Ranges of the key are summed first; only rows of one range are summed in order.
    """
    bounds = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)]).alias("b")).first()["b"]
    cuts = sorted(set(bounds or ()))  # at most ``ranges`` numbers
    # the cut is found among every 32nd first, then among the 32 from there
    listed = lambda part: F.array(*map(F.lit, part)) if part else F.array().cast("array<double>")
    below = lambda part: F.size(F.filter(part, lambda c: c < F.col(key)))
    rows = df.withColumn("_block", below(listed(cuts[31::32])))
    rows = rows.withColumn("_range", F.col("_block") * 32 + below(F.slice(listed(cuts), F.col("_block") * 32 + 1, F.lit(32)))).drop("_block")
    sums = rows.groupBy(F.col("_range").alias("_of")).agg(F.sum(amount).alias("_sum"))
    ahead = sums.select("_of", F.coalesce(F.sum("_sum").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(ahead), F.col("_range") == F.col("_of")).withColumn(name, own + F.col("_ahead")).drop("_range", "_of", "_ahead")


def best(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_rn = 1").drop("_rn")


def majority(df: DataFrame, group: str, vote: str) -> DataFrame:
    """Each group's most frequent vote, ties to the least; only votes of two and more count."""
    n = df.groupBy(group, vote).agg(F.count("*").alias("votes")).where("votes > 1")
    return best(n, group, F.desc("votes"), F.col(vote))


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Rows and percentage of each value; what is summed for the total is one row a value."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select(*by, "n", F.round(100 * F.col("n") / F.col("_all"), 6).alias("pct"))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
