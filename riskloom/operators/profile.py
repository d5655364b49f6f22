"""Profiles of labelled tables, splits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares by each column, all in one pass."""
    kinds = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(kinds).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("column")), 4))


def nulls(df: DataFrame) -> DataFrame:
    """Nulls of each column, one aggregation for all."""
    sums = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = sums.select("__n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns])))
    return long.select("column", "n_null", F.round(F.when(F.col("__n") > 0, F.col("n_null") * 100.0 / F.col("__n")).otherwise(0.0), 4).alias("percent"))


#: Hexadecimal digits of a hash that name a block, so 65536 blocks; points that cut the range of values.
DIGITS, CUTS = 4, 256


def ranked(df: DataFrame, by: str, id_: str, seed: int = 42, rank: str = "__rank", size: str = "__size") -> DataFrame:
    """Adds each row's rank among those of its label in order of a hash of its id, and how many there are.

    Ranks are counted by blocks of the hash: a task sorts one block, never a label, of which there may be two.  Null is a label too.
    """
    rows = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")))).withColumn("__b", F.substring("__h", 1, DIGITS))
    sizes = rows.groupBy(F.col(by).alias("__by"), F.col("__b").alias("__block")).agg(F.count(F.lit(1)).alias("__n"))
    label = Window.partitionBy("__by")  # over blocks, not rows
    before = F.coalesce(F.sum("__n").over(label.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__by", "__block", before.alias("__before"), F.sum("__n").over(label).alias(size))
    joined = rows.join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__block")))
    own = F.row_number().over(Window.partitionBy(by, "__b").orderBy("__h", id_))
    return joined.withColumn(rank, F.col("__before") + own).drop("__h", "__b", "__by", "__block", "__before")


def stratified(df: DataFrame, label: str, id_: str, fractions: list[float], seed: int = 42) -> DataFrame:
    """K2: exact split by label: rows in order of a hash get the part that their rank falls into."""
    part = F.lit(len(fractions) - 1)
    for k in reversed(range(len(fractions) - 1)):
        part = F.when(F.col("__rank") <= F.round(F.col("__size") * sum(fractions[: k + 1])), k).otherwise(part)
    return ranked(df, label, id_, seed).withColumn("part", part.cast("long")).drop("__rank", "__size")


def _blocked(df: DataFrame, value: str) -> DataFrame:
    """Adds ``__block``: how many of CUTS cuts of the range lie below the value.  The cuts are one row of bounded size."""
    cuts = df.agg(F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)]), 10000)).alias("__cuts"))
    return df.join(F.broadcast(cuts)).withColumn("__block", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): exact quantiles with linear interpolation, nulls aside.

    Equal values are counted first, counts are summed by blocks of the range, and only the blocks that hold a wanted rank are put in
    order, so no task holds a group's values, however many.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__by"), F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = _blocked(counts, "__v")
    sums = counts.groupBy("__by", "__block").agg(F.sum("__n").alias("__in"))
    group = Window.partitionBy("__by")  # over blocks
    sums = sums.select("__by", "__block", "__in", F.sum("__in").over(group).alias("__all"), F.coalesce(F.sum("__in").over(group.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = lambda q: q * (F.col("__all") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares.values()])))
    wanted = sums.select("*", F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__in"))).alias("__ranks")).where(F.size("__ranks") > 0)
    wanted = wanted.select(F.col("__by").alias("__g"), F.col("__block").alias("__k"), "__before", "__all", "__ranks")
    held = counts.join(wanted, F.col("__by").eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__k")))
    until = F.col("__before") + F.sum("__n").over(Window.partitionBy("__by", "__block").orderBy("__v"))
    held = held.select("__by", "__v", "__n", "__all", "__ranks", until.alias("__until"))
    at = held.select("__by", "__v", "__all", F.explode(F.filter("__ranks", lambda r: (r < F.col("__until")) & (r >= F.col("__until") - F.col("__n")))).alias("__r"))
    picked = at.groupBy("__by").agg(F.max("__all").alias("__all"), F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__m"))
    low, high = (lambda q: F.try_element_at("__m", F.floor(place(q)))), (lambda q: F.try_element_at("__m", F.ceil(place(q))))
    return picked.select(F.col("__by").alias(by), *[(low(q) + (high(q) - low(q)) * (place(q) - F.floor(place(q)))).alias(k) for k, q in shares.items()])


def class_distribution(df: DataFrame, label: str, value: str) -> DataFrame:
    """Number, mean, least, most and quartiles of a value by label."""
    plain = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 3).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    quartiles = quantiles(df, label, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed(label, "__label")
    return plain.join(quartiles, F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")


def imputed(df: DataFrame, numbers: list[str], names: list[str] = (), train: DataFrame | None = None) -> DataFrame:
    """Missing numbers get the median of the training rows (default: these), missing names ``unknown``."""
    source = (df if train is None else train).withColumn("__one", F.lit(1))
    for c in numbers:
        middle = quantiles(source, "__one", c, {"__median": 0.5}).select("__median")
        df = df.join(F.broadcast(middle), how="left").withColumn(c, F.coalesce(F.col(c), F.col("__median").cast(df.schema[c].dataType))).drop("__median")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in names})


def scaled_to_max(df: DataFrame, value: str, out: str, digits: int = 3) -> DataFrame:
    """A value over the greatest; the greatest is an aggregate of its own, one row, so no window gathers the table."""
    return df.join(F.broadcast(df.agg(F.max(value).alias("__most")))).withColumn(out, F.round(F.col(value) / F.col("__most"), digits)).drop("__most")


def model_ranks(scores: DataFrame, model: str, score: str) -> DataFrame:
    """Models by mean score, ties share the better rank; one row a model."""
    mean = scores.groupBy(F.col(model).alias("model")).agg(F.round(F.avg(score), 6).alias("combined"))
    return mean.withColumn("rank", F.rank().over(Window.orderBy(F.desc("combined"))).cast("long"))


def worst_nulls(df: DataFrame, most: int = 15) -> DataFrame:
    """T5: the columns with most nulls, ties by name; those without any are left out."""
    return nulls(df).where("n_null > 0").orderBy(F.desc("percent"), "column").limit(most)


def metrics(df: DataFrame, label: Column, score: Column, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and the rank-sum AUC.

    Rows are counted by score, scores are dealt to blocks of their range, and only block sums are summed one after the other.
    """
    by = df.select(label.cast("int").alias("y"), score.cast("double").alias("s")).groupBy("s").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    by = _blocked(by, "s")
    below = lambda w: F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = F.col("s") >= threshold
    within = by.withColumn("u", F.col("p") * (below(Window.partitionBy("__block").orderBy("s")) + F.col("q") / 2))
    sums = within.groupBy("__block").agg(*[F.sum(x).alias(x) for x in ("p", "q", "u")], F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("fp"))
    sums = sums.withColumn("u", F.col("u") + F.col("p") * below(Window.orderBy("__block")))  # CUTS rows at most
    c = sums.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.col("p") - F.col("tp")), F.lit(0)).alias("fn"), F.coalesce(F.sum(F.col("q") - F.col("fp")), F.lit(0)).alias("tn"), F.sum("u").alias("u"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", *[F.round(v, 6).alias(k) for k, v in (("accuracy", F.try_divide(tp + tn, tp + fp + fn + tn)), ("precision", F.try_divide(tp, tp + fp)), ("recall", F.try_divide(tp, tp + fn)), ("f1", F.try_divide(2 * tp, 2 * tp + fp + fn)), ("auc", F.try_divide("u", (tp + fn) * (fp + tn))))])


def coverage(df: DataFrame, filled: dict[str, str], true: list[str]) -> DataFrame:
    """Rows, rows where a text is neither null nor empty (by result name), and rows where a flag is true, in one aggregation."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.length(F.col(c)) > 0).alias(k) for k, c in filled.items()], *[F.count_if(F.col(c)).alias(c) for c in true])


def summary(rows: DataFrame, columns: list[str], sets: list[list[str]]) -> DataFrame:
    """A20 as one table: how many rows each combination of each set of columns has, and its share of all; ``level`` tells the sets apart (a bit for each
    column left out, the last column's the lowest), so a null value isn't taken for a column left out.  One pass, combined before the shuffle."""
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    counts = grouped.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("__all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("level", *columns, "n", F.round(F.col("n") / F.col("__all"), 4).alias("share"))
