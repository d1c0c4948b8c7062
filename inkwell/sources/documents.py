"""Where documents come from: JSON files, Parquet tables, and validation of what comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import stripped
from ..operators.index import spread

FIELDS = "title string, body string, url string, tags array<string>"
MAX_TITLE, MAX_BODY, MAX_URL, MAX_TAGS = 500, 1_000_000, 2048, 50


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON files that hold an array, or an object with an array ``documents``."""
    schema = f"{FIELDS}, documents array<struct<title: string, body: string, url: string, tags: array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    inner = rows.where("documents IS NOT NULL").select(F.explode("documents").alias("d")).select("d.*")
    return rows.where("documents IS NULL").drop("documents").unionByName(inner)


def indexed(docs: DataFrame) -> DataFrame:
    """Add ``index``, the place of each row in the order they are read, from 0.  Rows are counted by partition, so none are moved."""
    rows = docs.withColumn("index", F.monotonically_increasing_id())
    part, place = F.shiftright("index", 33), F.col("index").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    if len(counts) < 2:
        return rows.withColumn("index", place)
    starts, before = [], 0
    for k in sorted(counts):
        starts += [F.lit(k), F.lit(before)]
        before += counts[k]
    return rows.withColumn("index", F.create_map(*starts)[part] + place)


def numbered(docs: DataFrame, first: int = 1) -> DataFrame:
    """Documents with ``index`` and all columns of a stored one: where missing or null, doc_id is ``first`` and the index, seq the
    doc_id, and created_at now."""
    has = set(docs.columns)

    def given(name: str, other: Column) -> Column:
        return (F.coalesce(F.col(name), other) if name in has else other).alias(name)

    rows = docs.withColumn("doc_id", given("doc_id", F.col("index") + first).cast("long"))
    more = [F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in (("body", "string"), ("url", "string"), ("tags", "array<string>"))]
    return rows.select("index", "doc_id", given("seq", F.col("doc_id")).cast("long").alias("seq"), "title", *more, given("created_at", F.current_timestamp()))


def problem() -> Column:
    """Why a document is refused, or null."""
    return (
        F.when(F.col("title").isNull() | (stripped(F.col("title")) == ""), "title must not be blank")
        .when(F.length("title") > MAX_TITLE, "title is too long")
        .when(F.length("body") > MAX_BODY, "body is too long")
        .when(F.length("url") > MAX_URL, "url is too long")
        .when(F.size("tags") > MAX_TAGS, "too many tags")
    )


def validated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused); refused rows have a column error."""
    checked = docs.withColumn("error", problem())
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def corpus_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``: the first sentence or line is the title, the whole text the body, language and source are tags."""
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))  # before the titles are cut
    return rows.select(
        "doc_id",
        F.col("doc_id").alias("seq"),
        F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"),
        F.col("text").alias("body"),
        F.lit(None).cast("string").alias("url"),
        F.array("lang", "source").alias("tags"),
        F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("created_at"),
    )


def corpus_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``pages``: its title element, and what is left of the page without scripts, styles, comments and tags."""
    rows = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("page_id", "doc_id"))
    body = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>", " ")
    return rows.select(
        "doc_id",
        F.col("doc_id").alias("seq"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        body.alias("body"),
        "url",
        F.array(F.regexp_extract("html", r'<html lang="([^"]*)"', 1)).alias("tags"),
        F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("created_at"),
    )
