"""Statistics as relational plans: correlations, ranks, agreement.

Undefined metrics are NaN, absent values null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions import halves
from assayframe.operators import ordered
from assayframe.operators.tables import saved

NAN = float("nan")


def pearson(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; NaN below two rows or without variance."""
    top, low = F.covar_pop(x, y), F.var_pop(x) * F.var_pop(y)
    return F.when((F.count(F.lit(1)) < 2) | (low <= 0), F.lit(NAN)).otherwise(F.coalesce(F.try_divide(top, F.sqrt(low)), F.lit(NAN)))


def mean(x: str | Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(NAN))


def average_ranks(df: DataFrame, col: str, out: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the average rank of ``col`` within ``by``, ties sharing theirs; rows without a value drop out.

    The different values are numbered over ranges (see ``ordered``), so ties
    are one row there and never lie on both sides of an edge.
    """
    by = by or []
    places = ordered.value_places(df.where(F.col(col).isNotNull()), by, col)
    return df.join(places.select(*by, col, _rank().alias(out)), [*by, col])


def _rank() -> Column:
    return F.col("before") + (F.col("n") + 1) / 2.0


def metric_block(df: DataFrame, model: str, human: str, by: list[str] | None = None, extra: dict[str, Column] | None = None, errors: tuple[str, str] | None = None, weight: str | None = None) -> DataFrame:
    """n, pearson, spearman, mae, mse and rmse of two columns, and the means of further columns.

    Errors are those of the columns ``errors``, where they are others.  A row
    counts ``weight`` times.  Rows without both values drop out.

    Rows are counted by their pair of values once; moments and ranks are taken
    from the pairs with their weights, moments about the means.
    """
    by, extra = by or [], extra or {}
    a, b = (F.col(c) for c in errors or (model, human))
    w = F.col(weight) if weight else F.lit(1)
    known = lambda c: F.sum(F.when(c.isNotNull(), w))
    rows = df.where(F.col(model).isNotNull() & F.col(human).isNotNull())
    sums = {"abs": F.abs(a - b), "sq": F.pow(a - b, 2), **{f"x_{k}": c.cast("double") for k, c in extra.items()}}
    pairs = rows.groupBy(*by, F.col(model).alias("_m"), F.col(human).alias("_h")).agg(
        F.sum(w).cast("long").alias("_n"), *[F.sum(c * w).alias(f"_s_{k}") for k, c in sums.items()], *[known(c).alias(f"_c_{k}") for k, c in sums.items()]
    )
    pairs = saved(pairs)
    sides = F.explode(F.array(F.struct(F.lit("m").alias("_side"), F.col("_m").cast("double").alias("_v")), F.struct(F.lit("h").alias("_side"), F.col("_h").cast("double").alias("_v"))))
    places = ordered.value_places(pairs.select(*by, "_n", sides.alias("_x")).select(*by, "_n", "_x.*"), [*by, "_side"], "_v", "_n")
    ranks = lambda side: places.where(F.col("_side") == side).select(*by, F.col("_v").alias(f"_{side}d"), _rank().alias(f"_r{side}"))
    total = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_pairs"), F.sum("_n").alias("n"), *[(F.sum(F.col(c) * F.col("_n")) / F.sum("_n")).alias(f"{c}_mean") for c in ("_m", "_h")], *[(F.min(c) == F.max(c)).alias(f"{c}_flat") for c in ("_m", "_h")])
    both = ordered.shared_out(pairs, total, by, "_pairs") if by else pairs.crossJoin(F.broadcast(total))
    both = both.withColumns({"_md": F.col("_m").cast("double"), "_hd": F.col("_h").cast("double")})
    both = both.join(ranks("m"), [*by, "_md"]).join(ranks("h"), [*by, "_hd"])
    middle = (F.col("n") + 1) / 2.0
    off = {"m": F.col("_m") - F.col("_m_mean"), "h": F.col("_h") - F.col("_h_mean"), "rm": F.col("_rm") - middle, "rh": F.col("_rh") - middle}
    moment = lambda x, y: F.sum(off[x] * off[y] * F.col("_n"))
    out = both.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n"),
        F.first("_m_flat").alias("_m_flat"), F.first("_h_flat").alias("_h_flat"),
        *[moment(x, y).alias(f"_{x}{y}") for x, y in (("m", "m"), ("h", "h"), ("m", "h"), ("rm", "rm"), ("rh", "rh"), ("rm", "rh"))],
        *[(F.sum(f"_s_{k}") / F.sum(f"_c_{k}")).alias(f"_a_{k}") for k in sums],
    )
    flat = (F.col("n") < 2) | F.col("_m_flat") | F.col("_h_flat")
    correlation = lambda xy, xx, yy: F.when(flat, F.lit(NAN)).otherwise(F.coalesce(F.try_divide(F.col(xy), F.sqrt(F.col(xx) * F.col(yy))), F.lit(NAN)))
    average = lambda k: F.coalesce(f"_a_{k}", F.lit(NAN))
    return out.select(
        *by, "n",
        correlation("_mh", "_mm", "_hh").alias("pearson"), correlation("_rmrh", "_rmrm", "_rhrh").alias("spearman"),
        average("abs").alias("mae"), average("sq").alias("mse"), *[F.col(f"_a_x_{k}").alias(k) for k in extra], F.sqrt(average("sq")).alias("rmse"),
    )


def vote_counts(votes: DataFrame) -> DataFrame:
    """row_id, score, n; only rows of two votes or more."""
    size = Window.partitionBy("row_id")
    counts = votes.groupBy("row_id", "score").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("m", F.sum("n").over(size)).where("m >= 2")


def krippendorff(votes: DataFrame, categories: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Krippendorff's alpha of ``votes(row_id, score)``: metric, alpha.

    Coincidences per pair of categories are one aggregation; all that follows
    is arithmetic on the categories' own small table.
    """
    counts = vote_counts(votes)
    a, b = counts.select("row_id", F.col("score").alias("c"), F.col("n").alias("nc"), "m"), counts.select("row_id", F.col("score").alias("k"), F.col("n").alias("nk"))
    pairs = a.join(b, "row_id").groupBy("c", "k").agg(F.sum(F.col("nc") * (F.col("nk") - F.when(F.col("c") == F.col("k"), 1).otherwise(0)) / (F.col("m") - 1)).alias("o"))
    spark = votes.sparkSession
    labels = spark.createDataFrame([(int(c),) for c in categories], "c int")
    grid = labels.crossJoin(labels.withColumnRenamed("c", "k")).join(pairs, ["c", "k"], "left").fillna(0.0, ["o"])
    marg = grid.groupBy("c").agg(F.sum("o").alias("n"))
    total = marg.agg(F.sum("n").alias("total"))
    cum = marg.alias("x").join(marg.alias("y"), F.col("y.c") <= F.col("x.c")).groupBy("x.c").agg(F.sum("y.n").alias("cum"), F.first("x.n").alias("n")).select("c", "cum", "n")
    left = cum.select("c", F.col("n").alias("nc"), F.col("cum").alias("cc"))
    right = cum.select(F.col("c").alias("k"), F.col("n").alias("nk"), F.col("cum").alias("ck"))
    cells = grid.join(left, "c").join(right, "k").crossJoin(total)
    # between c and k: all marginals from one to the other, less half of both ends
    middle = F.abs(F.col("ck") - F.col("cc")) + F.when(F.col("c") <= F.col("k"), F.col("nc")).otherwise(F.col("nk")) - (F.col("nc") + F.col("nk")) / 2
    distances = {"nominal": F.when(F.col("c") == F.col("k"), 0.0).otherwise(1.0), "ordinal": F.when(F.col("c") == F.col("k"), 0.0).otherwise(F.pow(middle, 2)), "interval": F.pow(F.col("c") - F.col("k"), 2).cast("double")}
    # all metrics in one pass over the cells
    sums = [x for name, d in distances.items() for x in (F.sum(F.col("o") * d).alias(f"o_{name}"), F.sum(F.col("nc") * F.col("nk") * d).alias(f"e_{name}"))]
    one = cells.where("total > 1").agg(F.first("total").alias("t"), *sums)
    alpha = lambda name: F.coalesce(1 - F.try_divide(F.col(f"o_{name}") / F.col("t"), F.nullif(F.col(f"e_{name}") / (F.col("t") * (F.col("t") - 1)), F.lit(0.0))), F.lit(NAN))
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), alpha(name).alias("alpha")) for name in distances])).alias("x")).select("x.*")


def annotator_pairs(votes: DataFrame) -> DataFrame:
    """Unordered pairs of annotators in each row: row_id, left, right, l, r."""
    a = votes.select("row_id", F.col("annotator").alias("left"), F.col("score").alias("l"))
    b = votes.select("row_id", F.col("annotator").alias("right"), F.col("score").alias("r"))
    return a.join(b, "row_id").where(F.col("left") < F.col("right"))


def cohen_kappas(votes: DataFrame, scale: int = 2) -> DataFrame:
    """Cohen's kappa per pair of annotators with two shared rows or more:
    weights, left, right, support, kappa (null where undefined)."""
    cells = annotator_pairs(votes).groupBy("left", "right", "l", "r").agg(F.count(F.lit(1)).alias("o"))
    pair = ["left", "right"]
    rows = cells.groupBy(*pair, "l").agg(F.sum("o").alias("nl"))
    cols = cells.groupBy(*pair, F.col("r").alias("r")).agg(F.sum("o").alias("nr"))
    support = cells.groupBy(*pair).agg(F.sum("o").alias("support")).where("support >= 2")
    grid = rows.join(cols, pair).join(cells, [*pair, "l", "r"], "left").join(support, pair)
    apart = F.abs(F.col("l") - F.col("r"))
    weights = {"none": F.when(apart == 0, 0.0).otherwise(1.0), "linear": apart / scale, "quadratic": F.pow(apart / scale, 2)}
    seen = F.coalesce("o", F.lit(0))
    aggs = []
    for k, w in weights.items():
        aggs += [F.sum(w * seen).alias(f"o_{k}"), (F.sum(w * F.col("nl") * F.col("nr")) / F.first("support")).alias(f"e_{k}")]
    wide = grid.groupBy(*pair).agg(F.first("support").alias("support"), *aggs)
    kappa = lambda k: 1 - F.try_divide(F.col(f"o_{k}"), F.nullif(F.col(f"e_{k}"), F.lit(0.0)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("weights"), kappa(k).alias("kappa")) for k in weights]))
    return wide.select(*pair, "support", each.alias("x")).select("x.weights", *pair, "support", "x.kappa")


def kappa_summary(votes: DataFrame) -> DataFrame:
    """Per weights: pairs, mean kappa, support-weighted mean kappa."""
    defined = cohen_kappas(votes).where("kappa IS NOT NULL")
    return defined.groupBy("weights").agg(
        F.count(F.lit(1)).alias("pairs"), mean("kappa").alias("mean_kappa"), (F.sum(F.col("kappa") * F.col("support")) / F.sum("support")).alias("weighted_kappa")
    )


def leave_one_out(votes: DataFrame, reference: str = "leave_one_out") -> DataFrame:
    """Each vote of rows of two or more, with the mean and majority of its reference:
    the row's other votes, or with ``all_annotators`` all of the row's.

    The votes of a row are gathered once (as many as it has annotators); the
    majority's ties go to the score nearest the mean, then the smaller.
    """
    if reference not in ("leave_one_out", "all_annotators"):
        raise ValueError(f"unknown reference: {reference}")
    own = reference == "all_annotators"
    rows = votes.groupBy("row_id").agg(F.collect_list(F.struct("annotator", "score")).alias("v")).where(F.size("v") >= 2)
    rows = rows.withColumn("all", F.transform("v", lambda x: x["score"]))
    rows = rows.withColumn("s", F.aggregate("all", F.lit(0.0), lambda s, x: s + x)).withColumn("n", F.size("all"))
    held = rows.select("row_id", "all", "s", "n", F.explode("v").alias("x")).select("row_id", "all", "s", "n", "x.annotator", "x.score")
    held = held.withColumn("rest_mean", F.col("s") / F.col("n") if own else (F.col("s") - F.col("score")) / (F.col("n") - 1))
    less = F.lit(0) if own else F.lit(1)
    ranked = F.array_sort(
        F.transform(
            F.array_distinct(F.array_sort("all")),
            lambda k: F.struct(
                (F.when(k == F.col("score"), less).otherwise(0) - F.size(F.filter("all", lambda x: x == k))).alias("less"),
                F.abs(k - F.col("rest_mean")).alias("far"),
                k.alias("score"),
            ),
        )
    )
    kept = F.filter(ranked, lambda c: c["less"] < 0)
    return held.select("row_id", "annotator", "score", "rest_mean", F.get(kept, F.lit(0))["score"].alias("rest_majority"))


def rotations(votes: DataFrame, reference: str = "leave_one_out") -> DataFrame:
    """The agreement of single votes with their reference, pooled over votes and averaged by row first:
    rows, votes, pooled_* and row_* of accuracy against majority and rounded mean, mae and rmse (on 0-10)."""
    held = leave_one_out(votes, reference)
    gap = (F.col("score") - F.col("rest_mean")) * 5
    hits = {"majority": F.col("score") == F.col("rest_majority"), "rounded": F.col("score") == F.bround("rest_mean", 0).cast("int")}
    held = held.withColumns({"mae": F.abs(gap), "mse": gap * gap, **{k: c.cast("double") for k, c in hits.items()}})
    kinds = ("majority", "rounded", "mae", "mse")
    per = held.groupBy("row_id").agg(F.count(F.lit(1)).alias("k"), *[F.avg(c).alias(f"r_{c}") for c in kinds], *[F.sum(c).alias(f"s_{c}") for c in kinds])
    out = per.agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("votes"), *[(F.sum(f"s_{c}") / F.sum("k")).alias(f"pooled_{c}") for c in kinds], *[F.avg(f"r_{c}").alias(f"row_{c}") for c in kinds])
    return out.withColumn("pooled_rmse", F.sqrt("pooled_mse")).withColumn("row_rmse", F.sqrt("row_mse")).drop("pooled_mse", "row_mse")


def split_half(votes: DataFrame, iterations: int = 10, seed: int = 13) -> DataFrame:
    """Per iteration: n, pearson and spearman of the halves' means, Spearman-Brown.

    Votes of a row are ordered by md5('seed:iteration:row:annotator'); the
    first floor(n/2) are one half.  A row's votes are gathered once (as many as
    it has annotators) and all iterations drawn from them.
    """
    return _halves(votes, iterations, seed, 1)


LATTICE = 10  # votes; rows of more are split by the order of digests


def split_half_lattice(votes: DataFrame, iterations: int = 1000, seed: int = 13, most: int = LATTICE) -> DataFrame:
    """``split_half`` for many iterations: of a row's halvings one is drawn at once.

    A row of n votes (in the order of their annotators) has C(n, n/2) halvings;
    iteration i takes the one numbered by the eight digits from 8 * (i % 4) of
    md5('seed:i/4:row') modulo their number, in ascending order of bit masks.
    Rows of more than ``most`` votes have too many halvings to list and are
    split as in ``split_half``.
    """
    if not 2 <= most <= 16:
        raise ValueError("most must be from 2 to 16")
    return _halves(votes, iterations, seed, most)


def _halves(votes: DataFrame, iterations: int, seed: int, most: int) -> DataFrame:
    """The reliability of each iteration's halves, which tasks draw and count by their means (see ``halves``).

    The lattice of different pairs of means, with weights, is all that is
    shuffled and ranked.
    """
    if iterations < 1:
        raise ValueError("there must be an iteration")
    parts = int(votes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else few tasks get all the draws, as rows are small
    rows = votes.repartition(parts, "row_id").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("annotator", "score"))).alias("v")).where(F.size("v") >= 2)
    part = lambda c: F.coalesce(F.concat(F.lit(":"), c.cast("string")), F.lit(""))
    keys = F.when(F.size("v") > most, F.transform("v", lambda x: F.concat(part(F.col("row_id")), part(x["annotator"]))))
    rows = rows.select(part(F.col("row_id")).alias("text"), keys.alias("keys"), F.transform("v", lambda x: x["score"].cast("double")).alias("scores"))
    cells = rows.mapInArrow(halves.draws(iterations, seed, most), "iteration int, x double, y double, w long")
    cells = cells.groupBy("iteration", "x", "y").agg(F.sum("w").alias("w"))  # so that means are worked out once
    out = metric_block(cells, "x", "y", ["iteration"], weight="w").select("iteration", "n", "pearson", "spearman")
    return out.withColumn("reliability", 2 * F.col("pearson") / (1 + F.col("pearson")))
