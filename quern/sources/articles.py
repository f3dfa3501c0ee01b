"""Article sources: the record's schema, scans of JSON, Parquet and JDBC, and the index row built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as X

ARTICLE = (
    "id string, title string, content string, slug string, board struct<name:string,slug:string>, category string, tags array<string>, "
    "contributors array<struct<name:string,slug:string,role:string>>, created string, updated string, views long, thumbnail string, preview string"
)
SERIES = "id string, name string, articles array<string>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one JSON record a file; fields that a file lacks are null."""
    return spark.read.schema(ARTICLE).json(path, multiLine=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def one_per_id(df: DataFrame, order: str = "row_id") -> DataFrame:
    """The first row of each id; two aggregates of ids and a semi join, so texts are not sorted."""
    first = df.groupBy("id").agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def doc_meta(df: DataFrame) -> DataFrame:
    """The index row of each article: optional fields take their defaults, the date its first ten characters."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    authors = F.transform(
        F.coalesce("contributors", F.array().cast("array<struct<name:string,slug:string,role:string>>")),
        lambda c: F.struct(F.coalesce(c["name"], F.lit("")).alias("name"), F.coalesce(c["role"], F.lit("author")).alias("role")),
    )
    return df.select(
        "row_id",
        "id",
        F.coalesce(blank("slug"), F.col("id")).alias("slug"),
        "title",
        F.col("board.slug").alias("board"),
        F.col("board.name").alias("board_name"),
        "category",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        authors.alias("authors"),
        X.created_date(F.col("created")).alias("created"),
        blank("thumbnail").alias("thumbnail"),
        blank("preview").alias("preview"),
        F.coalesce("views", F.lit(0)).alias("views"),
    )


def series(spark: SparkSession, jdbc: dict | None = None, path: str | None = None) -> DataFrame:
    """Series from a database, else from a JSON file, else none, in that preference."""
    if jdbc:
        rows = spark.read.format("jdbc").options(**jdbc).load()
        return rows.groupBy("id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "article"))), lambda x: x["article"]).alias("articles"))
    if path:
        return spark.read.schema(SERIES).json(path, multiLine=True)
    return spark.createDataFrame([], SERIES)


def relational_export(articles: DataFrame, boards: DataFrame, categories: DataFrame, tags: DataFrame, article_tags: DataFrame, people: DataFrame, contributions: DataFrame) -> DataFrame:
    """Published articles of a relational source as records: dimensions looked up, contributors in their order, references unescaped."""
    by_tag = article_tags.join(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")), "tag_id").groupBy("article_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    by_person = (
        contributions.join(people.select(F.col("id").alias("person_id"), "name", "slug"), "person_id")
        .groupBy("article_id")
        .agg(F.array_sort(F.collect_list(F.struct("sort_order", "name", "slug", "role"))).alias("c"))
        .select("article_id", F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["slug"].alias("slug"), x["role"].alias("role"))).alias("contributors"))
    )
    return (
        articles.where("status = 'published'")
        .join(boards.select(F.col("id").alias("board_id"), F.struct("name", "slug").alias("board")), "board_id", "left")
        .join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")
        .join(by_tag, F.col("id") == by_tag["article_id"], "left")
        .drop("article_id")
        .join(by_person, F.col("id") == by_person["article_id"], "left")
        .drop("article_id")
        .withColumn("title", X.html_unescape("title"))
        .withColumn("content", X.html_unescape("content"))
    )


def term_lists(meta: DataFrame) -> DataFrame:
    """(row_id, t, r): terms of the title, and of tags and authors, for the keyword index."""
    rest = F.flatten(F.transform(F.concat("tags", F.transform("authors", lambda a: a["name"])), X.extract_terms))
    return meta.select("row_id", X.extract_terms(F.col("title")).alias("t"), rest.alias("r"))


def clean_terms(df: DataFrame) -> DataFrame:
    """A stored term dictionary with its terms trimmed and lower-cased; null and empty ones left out."""
    tidy = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.btrim(x))), lambda x: x.isNotNull() & (x != ""))
    return df.select("row_id", "id", tidy("t").alias("t"), tidy("r").alias("r"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
