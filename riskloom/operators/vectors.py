"""Nearest vectors of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A catalogue of so many vectors at most goes to every task as one row; a larger one is compared in blocks of as many.
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    """M1: inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """M1: an array over its length; zeros stay."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vector): the sum of each label's vectors, summed by position before anything moves."""
    sums = rows.select(label, F.posexplode(vector)).groupBy(label, "pos").agg(F.sum(F.col("col").cast("double")).alias("x"))
    return sums.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(vector))


def nearest(rows: DataFrame, id_: str, vector: str, catalogue: DataFrame, name: str, other: str, most: int = 3) -> DataFrame:
    """(id, name, similarity, place) of each row's ``most`` likest entries by cosine, ties by name; place from 1.

    The catalogue is counted (a job of its own) and dealt to blocks of at most about BLOCK vectors; each row meets one block at a time, keeps
    ``most`` of it, and the blocks' best are merged.  Rows are told apart by id and vector, and those that agree in both give as many results as they are.
    Rows with a null or zero vector have likeness 0 to all.
    """
    count = catalogue.count()
    blocks = max(1, -(-count // BLOCK))
    known = catalogue.select(F.pmod(F.xxhash64(name), F.lit(blocks)).alias("__b"), F.struct(F.col(name).alias("name"), unit(F.col(other)).alias("v")).alias("__e"))
    held = known.groupBy("__b").agg(F.collect_list("__e").alias("__entries"))
    own = rows.select(id_, F.col(vector).alias("__r")).withColumn("__n", F.lit(1).cast("long"))
    if blocks > 1:
        own = own.groupBy(id_, "__r").agg(F.sum("__n").alias("__n"))
    own = own.select(id_, "__r", "__n", unit(F.col("__r")).alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__b"))
    joined = own.join(F.broadcast(held) if blocks == 1 else held, "__b")
    likest = F.slice(F.array_sort(F.transform("__entries", lambda e: F.struct((-F.coalesce(dot(F.col("__v"), e["v"]), F.lit(0.0))).alias("s"), e["name"].alias("name")))), 1, most)
    some = joined.select(id_, "__r", "__n", likest.alias("__l"))
    if blocks > 1:
        some = some.groupBy(id_, "__r", "__n").agg(F.slice(F.array_sort(F.flatten(F.collect_list("__l"))), 1, most).alias("__l"))
        some = some.select(id_, "__l", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return some.select(id_, F.posexplode("__l").alias("__p", "__x")).select(id_, F.col("__x.name").alias(name), (-F.col("__x.s")).alias("similarity"), (F.col("__p") + 1).cast("long").alias("place"))
