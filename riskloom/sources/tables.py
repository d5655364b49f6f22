"""Files that come in and go out: rank lists, suffix statistics, page folders, embedded images, labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rank_list(spark: SparkSession, path: str, first: int) -> DataFrame:
    """The first rows by rank of a ``rank,domain`` file, domains in lower case; unreadable ranks go."""
    rows = spark.read.schema("rank string, domain string").csv(path).select(F.expr("try_cast(trim(rank) AS int)").alias("rank"), F.lower(F.trim("domain")).alias("domain"))
    return rows.where(F.col("rank").isNotNull() & (F.col("domain") != "")).orderBy("rank").limit(first)


def suffix_scores(rows: DataFrame, suffix: str, score: str) -> DataFrame:
    """Positive, readable scores over the greatest, three decimals; the greatest is one row, so no window gathers the table."""
    read = rows.select(F.regexp_replace(F.lower(F.trim(suffix)), "^[\\ufeff.]+", "").alias("tld"), F.expr(f"try_cast(replace(trim(`{score}`), ',', '') AS double)").alias("s")).where("s > 0")
    return read.join(F.broadcast(read.agg(F.max("s").alias("m")))).select("tld", F.round(F.col("s") / F.col("m"), 3).alias("risk"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole files named ``platform_brand_index.html``, with the parts of the name; null where a name has another form."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.html?$", 1)
    part = lambda k: F.nullif(F.regexp_extract(name, r"^([^_]+)_(.+)_([0-9]+)$", k), F.lit(""))
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(name.alias("name"), part(1).alias("platform"), part(2).alias("brand"), part(3).cast("int").alias("index"), F.col("value").alias("html"))


def embedded_images(rows: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Each image given as base64 in a page: key, index from 0, extension and bytes; unreadable ones have null bytes."""
    uri = r"(?i)data:image/([a-z0-9.+-]+);base64,([A-Za-z0-9+/=\s]+)"
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(uri), F.lit(1)).alias("kind"), F.regexp_extract_all(html, F.lit(uri), F.lit(2)).alias("data"))
    one = rows.select(key, F.posexplode(found).alias("index", "image"))
    kind = F.lower(F.col("image.kind"))
    return one.select(key, F.col("index").cast("long").alias("index"), F.when(kind == "jpeg", "jpg").otherwise(kind).alias("ext"), F.try_to_binary(F.regexp_replace("image.data", r"\s", ""), F.lit("base64")).alias("bytes"))


def flag(value: Column) -> Column:
    """1 or 0 for true, false, 1 and 0 in any case; null for the rest."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "1"), 1).when(v.isin("false", "0"), 0)


def labelled(parts: list[DataFrame], label: str) -> DataFrame:
    """The union by name of all parts (absent columns null), rows of label 0 or 1 only."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.withColumn(label, F.expr(f"try_cast(`{label}` AS double)")).where(F.col(label).isin(0.0, 1.0)).withColumn(label, F.col(label).cast("int"))


def varying(rows: DataFrame) -> list[str]:
    """The columns with two values or more, null counted as one; one pass of minima, maxima and null counts."""
    plain = [c for c, t in rows.dtypes if not t.startswith("map")]
    one = rows.agg(*[F.struct(F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`")).alias("same"), F.count(f"`{c}`").alias("n"), F.count(F.lit(1)).alias("all")).alias(f"c{i}") for i, c in enumerate(plain)]).first()
    return [c for i, c in enumerate(plain) if not (one[i]["same"] and one[i]["n"] in (0, one[i]["all"]))]


def put_ordered(rows: DataFrame, first: list[str], path: str, form: str = "parquet") -> None:
    """Writes the named columns first, then the rest by name."""
    rows.select(*[c for c in first if c in rows.columns], *sorted(c for c in rows.columns if c not in first)).write.format(form).mode("overwrite").options(**({"header": True} if form == "csv" else {})).save(path)


def domain_lines(spark: SparkSession, path: str, top: int = 1000) -> DataFrame:
    """A text file of domains, one a line in order of rank: rank from 1, domain, and whether it is among the first ``top``.

    Blank lines don't count.  Ranks come from the order within and between the file's parts, counted by part, so no task gathers the file.
    """
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("domain"), F.monotonically_increasing_id().alias("at")).where("domain <> ''").withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a part
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("at")))
    return ranked.select("rank", "domain", (F.col("rank") <= top).alias("top"))


def brand_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Brand, domain and embedding from a JSON file that is a list of entries, or an object that holds them as ``entries``; rows without a vector go."""
    entry = "struct<brand:string,domain:string,embedding:array<double>>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    both = text.select(F.coalesce(F.when(F.startswith("t", F.lit("[")), F.from_json("t", f"array<{entry}>")), F.from_json("t", f"struct<entries:array<{entry}>>")["entries"]).alias("e"))
    return both.select(F.inline("e")).where(F.size("embedding") > 0)
