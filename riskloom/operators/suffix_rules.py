"""P1 with a table of public suffixes: which part of a host its owner registered.

A rule is a suffix (``co.uk``), a wildcard (``*.ck``: any label below) or an exception (``!www.ck``: not a suffix after all).  Of the rules that
fit a host an exception wins, else the longest; where none fits, the last label is the suffix.  The registered domain is the
suffix and one label more; a host that is a suffix itself, or an address of numbers, is its own.

``with_registered`` joins every suffix of the distinct hosts with a rule table of any size, by equality.  ``Rules`` holds a table of checked
size in the tasks, for hosts that stand in arrays.

Defined results: hosts are compared in lower case without a dot at their end; a null host stays null, an empty one empty; repeated rules
count once, null and empty rules not; columns named like the results give way.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import urls

#: Rules that tasks hold at most.
MOST = 200_000


def read_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """The rules of a suffix list file: one a line, ``//`` starts a comment; those between the marks of private domains only if asked for."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    marks = lines.where(F.col("line").contains("===BEGIN PRIVATE DOMAINS===") | F.col("line").contains("===END PRIVATE DOMAINS===")).agg(F.min("at").alias("from"), F.max("at").alias("to"))
    rules = lines.crossJoin(F.broadcast(marks)) if not private else lines.withColumns({"from": F.lit(None), "to": F.lit(None)})  # one row
    kept = rules.where(F.col("from").isNull() | ~F.col("at").between(F.col("from"), F.col("to")))
    return kept.select(F.lower(F.regexp_extract("line", r"^\s*([^\s/]\S*)", 1)).alias("rule")).where("rule <> ''").distinct()


def _plain(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"\.$", "")


def _known(rules: DataFrame) -> DataFrame:
    return rules.select(_plain(F.trim("rule")).alias("rule")).where("rule <> ''").distinct()


def _registered(host: Column, labels: Column) -> Column:
    """The last ``labels`` + 1 labels; the host itself if it has no more."""
    parts = F.split(host, r"\.")
    return F.when(urls.is_ip(host) | (F.size(parts) <= labels + 1), host).otherwise(F.array_join(F.slice(parts, F.size(parts) - labels, labels + 1), "."))


def with_registered(rows: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """The rows with ``suffix`` and ``registered`` of their host.

    Hosts are made distinct before they are taken apart, so a host that many rows have is looked up once; the join back is an equality
    join that Spark can split where a host has many rows.
    """
    at = _plain(F.col(f"`{host}`"))
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in ("suffix", "registered")]
    hosts = rows.select(at.alias("__host")).where(F.col("__host").isNotNull()).distinct()
    above = hosts.select("__host", F.posexplode(urls.suffixes(F.col("__host"))).alias("i", "s")).withColumn("n", F.size(F.split("__host", r"\.")) - F.col("i"))
    tail = F.when(F.col("n") > 1, F.regexp_replace("s", r"^[^.]*\.", ""))
    form = lambda rule, first, labels: F.struct(rule.alias("rule"), F.lit(first).alias("first"), labels.alias("labels"))
    forms = F.array(form(F.col("s"), 0, F.col("n")), form(F.concat(F.lit("*."), tail), 0, F.col("n")), form(F.concat(F.lit("!"), F.col("s")), 1, F.col("n") - 1))
    fits = above.select("__host", F.explode(forms).alias("f")).select("__host", "f.*").join(_known(rules), "rule")
    best = fits.groupBy("__host").agg(F.max(F.struct("first", "labels")).alias("b")).select("__host", F.col("b.labels").alias("__n"))
    found = hosts.join(best, "__host", "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    parts = F.split("__host", r"\.")
    suffix = F.when(~urls.is_ip(F.col("__host")), F.array_join(F.slice(parts, F.greatest(F.size(parts) - F.col("__n") + 1, F.lit(1)), F.greatest(F.col("__n"), F.lit(1))), "."))
    found = found.select("__host", suffix.alias("suffix"), _registered(F.col("__host"), F.col("__n")).alias("registered"))
    return rows.select(*columns, at.alias("__host")).join(found, "__host", "left").drop("__host")


class Rules:
    """A rule table that tasks hold; more than MOST rules are refused (join them instead)."""

    def __init__(self, rules: DataFrame):
        held = [r["rule"] for r in _known(rules).limit(MOST + 1).collect()]
        if len(held) > MOST:
            raise ValueError(f"more than {MOST} rules: use with_registered")
        self.rules = frozenset(held)

    def of(self, host: str | None) -> str | None:
        """The registered domain of one host."""
        if host is None:
            return None
        host = host.lower().removesuffix(".")
        parts = host.split(".")
        if len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 for p in parts):
            return host
        labels = 1
        for i in range(len(parts)):
            s = ".".join(parts[i:])
            if "!" + s in self.rules:
                labels = len(parts) - i - 1
                break
            if s in self.rules or i + 1 < len(parts) and "*." + ".".join(parts[i + 1 :]) in self.rules:
                labels = max(labels, len(parts) - i)
        return ".".join(parts[-labels - 1 :])

    def column(self, hosts: Column) -> Column:
        """Of an array of hosts, in Arrow batches; each distinct host of a batch is looked up once."""

        def run(lists: pa.Array) -> pa.Array:
            flat = lists.flatten().dictionary_encode()
            known = pa.array([self.of(h) for h in flat.dictionary.to_pylist()], pa.string())
            off = pa.concat_arrays([lists.value_lengths().fill_null(0)]).to_numpy(zero_copy_only=False).cumsum()
            values = known.take(flat.indices) if len(flat) else pa.array([], pa.string())
            return pa.ListArray.from_arrays(pa.array([0, *off.tolist()], pa.int32()), values)

        return F.arrow_udf(run, "array<string>")(hosts)
