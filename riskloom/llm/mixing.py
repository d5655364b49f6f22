"""Mixing sources to target weights by pivotal dependent rounding.  DataFrame functions only.

Sources get shares of ``share`` times all words by weight, stopped at ``cap`` times what they have, the excess shared
anew by weight.  A source's rate target / size gives each of its documents floor(rate) copies and a fractional
probability p of one more.  In a cell of about CELL documents these are paired one after the other: mass (words times
probability) moves from one to the other, in a direction drawn so that expectations stay, until one of them is 0 or 1.  The
sum of words stays what it was.  What is left over, one document a cell, goes on to the next level's cells, a reduction tree
that ends in one document a source; only that one is rounded on its own, to the nearer.  So a source's words miss its target
by half of one document at most.  Cells come from hashes, so no source, however large, meets in one task, and draws come from hashes of
ids, so reruns agree.

Defined results: a null text has size 0; documents of size 0 are taken once at most and count 0 words; null is a source of its own,
after all others; rows of equal or null ids are rounded apart, and dealt to different cells; which of several rows that are alike in id, source
and size takes which number of copies doesn't matter, their numbers are the same in each run; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS, SHARE, CAP, CELL, SEED = (5, 2, 1), 1.5, 2, 64, 29
#: Rows that are alike and listed by one task.
RUN = 10000
WORD = r"[^\x20\x09-\x0D]+"
UNIT = "struct<size:bigint,key:bigint,id:bigint,p:double>"
STATE = f"struct<left:{UNIT},done:array<struct<id:bigint,size:bigint,more:int>>>"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size, ...), a row a source."""
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    full = F.col("source_size") * float(cap)
    # sources in the order in which a rising level fills them, one row a source: those before the first that the level leaves room in are full
    order = Window.orderBy(full / F.col("w"), F.col("source").asc_nulls_last())
    before, all_ = (lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))), (lambda c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = sizes.withColumn("w", weight).withColumn("level", (all_(F.col("source_size")) * share - before(full)) / (all_(F.col("w")) - before(F.col("w")))).withColumn("at", F.row_number().over(order))
    level = F.min(F.when(F.col("level") <= full / F.col("w"), F.struct("at", "level"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    return rows.withColumn("level", level).select("source", "source_size", "n", F.least(full, F.col("w") * F.col("level")).alias("target"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _uniform(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(SEED)), 11).cast("double") * F.lit(2.0**-53)


def _done(unit: Column, more: int) -> Column:
    return F.struct(unit["id"].alias("id"), unit["size"].alias("size"), F.lit(more).alias("more"))


def _with(unit: Column, p: Column) -> Column:
    return F.struct(unit["size"].alias("size"), unit["key"].alias("key"), unit["id"].alias("id"), p.alias("p"))


def _step(state: Column, unit: Column) -> Column:
    """One pairing: the unit left so far, a, with the next one, b."""
    out = lambda left, *done: F.struct(left.cast(UNIT).alias("left"), F.concat(state["done"], F.array(*done)).alias("done"))
    a, b = state["left"], unit
    room = F.struct((a["size"] * (1 - a["p"])).alias("a_up"), (a["size"] * a["p"]).alias("a_down"), (b["size"] * (1 - b["p"])).alias("b_up"), (b["size"] * b["p"]).alias("b_down"))
    none = F.lit(None)

    def pair(x: Column) -> Column:
        up, down = F.least(x["a_up"], x["b_down"]), F.least(x["a_down"], x["b_up"])
        a_one = out(_with(b, b["p"] - x["a_up"] / b["size"]), _done(a, 1))
        b_zero = out(_with(a, a["p"] + x["b_down"] / a["size"]), _done(b, 0))
        a_zero = out(_with(b, b["p"] + x["a_down"] / b["size"]), _done(a, 0))
        b_one = out(_with(a, a["p"] - x["b_up"] / a["size"]), _done(b, 1))
        close = lambda s, t: F.abs(s - t) <= F.lit(1e-9) * (s + t)
        rise = F.when(close(x["a_up"], x["b_down"]), out(none, _done(a, 1), _done(b, 0))).when(x["a_up"] < x["b_down"], a_one).otherwise(b_zero)
        fall = F.when(close(x["a_down"], x["b_up"]), out(none, _done(a, 0), _done(b, 1))).when(x["a_down"] < x["b_up"], a_zero).otherwise(b_one)
        return F.when(_uniform(a["key"], b["key"]) * (up + down) < down, rise).otherwise(fall)

    return F.when(a.isNull(), F.struct(unit.alias("left"), state["done"].alias("done"))).otherwise(_let(room, pair))


def _keyed(rows: DataFrame) -> DataFrame:
    """(id, source, size, key): rows alike in all of (id, source, size, text) are counted, and numbered as they are listed again, so
    keys differ within a repeated id and are the same in every run, however the table is cut into files.  (text: null but for null ids.)"""
    alike = [F.col(c) for c in rows.columns]
    counted = store.put(rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")), "counted")
    blocks = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))
    many = counted.where(F.col("n") > 1).select("*", F.explode(blocks).alias("block")).repartition(store.parts(rows.sparkSession), "id", "text", "block")
    listed = many.select("id", "source", "size", "text", F.explode(F.sequence(F.col("block") * RUN, F.least(F.col("n"), (F.col("block") + 1) * RUN) - 1)).alias("nth"))
    one = counted.where(F.col("n") == 1).select("id", "source", "size", "text", F.lit(0).cast("long").alias("nth"))
    return one.unionByName(listed).select("id", "source", "size", F.xxhash64("id", "source", "size", "text", "nth", F.lit(SEED)).alias("key"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), a row for each row of docs; taken = copies * size."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size, F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).alias("text"))
    sized = store.put(_keyed(rows), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    goal = store.put(targets(sizes, weights, share, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    whole, p = F.floor("rate"), F.col("rate") - F.floor("rate")
    joined = sized.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    plain = joined.where((F.col("size") == 0) | (p == 0)).select("source", "id", "size", F.lit(0).alias("more"))
    units = joined.where((F.col("size") > 0) & (p > 0)).select("source", "n", F.struct("size", "key", "id", p.alias("p")).alias("unit"))
    most = goal.agg(F.max("n")).first()[0] or 0
    decided, level = [plain], 1
    while most:
        cells = F.greatest(F.lit(1), F.ceil(F.col("n") / float(CELL**level)))
        grouped = units.groupBy("source", F.pmod(F.xxhash64("unit.key", F.lit(level)), cells).alias("cell"), "n").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        start = F.struct(F.lit(None).cast(UNIT).alias("left"), F.lit(None).cast("array<struct<id:bigint,size:bigint,more:int>>").alias("done"))
        start = F.struct(start["left"].alias("left"), F.coalesce(start["done"], F.array().cast("array<struct<id:bigint,size:bigint,more:int>>")).alias("done"))
        reduced = store.put(grouped.select("source", "n", F.aggregate("units", start.cast(STATE), lambda s, u: _step(s, u).cast(STATE)).alias("state")), f"level{level}")
        decided.append(reduced.select("source", F.inline("state.done")))
        left = reduced.where(F.col("state.left").isNotNull()).select("source", "n", F.col("state.left").alias("unit"))
        if most <= CELL**level:
            last = F.when(F.col("unit.p") >= 0.5, 1).otherwise(0)
            decided.append(left.select("source", F.col("unit.id").alias("id"), F.col("unit.size").alias("size"), last.alias("more")))
            break
        units, level = left, level + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    out = out.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source")))
    copies = (whole + F.col("more")).cast("int")
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(store.table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op9_source_mixing": op9_source_mixing}
ORACLE_SQL: dict[str, str] = {}
