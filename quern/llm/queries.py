"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chars, knn, lines, markup, neardup, packing, subjects, terms, tokens, topn


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark, d):
    return chars.normalize_fields(_read(spark, d, "articles"), "row_id", ["title", "content", "tags"], found=True)


def p1_text(spark, d):
    return chars.normalize_fields(_read(spark, d, "articles"), "row_id", ["title", "content", "tags"])


def p2_found(spark, d):
    near = knn.nearest(_read(spark, d, "doc_embeddings"), "row_id", "vector", dim=128, k=10, least=0.82)
    return near.select(F.least("row_id", "neighbour").alias("row_a"), F.greatest("row_id", "neighbour").alias("row_b")).distinct()


def p2_nearest(spark, d):
    return knn.nearest(_read(spark, d, "doc_embeddings"), "row_id", "vector", dim=128, k=10)


def p3_found(spark, d):
    return p3_terms(spark, d).where("mark != 'kept'").select("term", "mark")


def p3_terms(spark, d):
    return terms.term_frequencies(_read(spark, d, "doc_terms"), "id", ["t", "r"])


def p4_method(spark, d):
    """The method on multisets: the same groups by the overlap of runs with their numbers."""
    return neardup.article_groups(_read(spark, d, "articles"), weighted=True)


def p4_found(spark, d):
    return neardup.group_pairs(neardup.article_groups(_read(spark, d, "articles")))


def p4_groups(spark, d):
    return neardup.article_groups(_read(spark, d, "articles"))


def p5_method(spark, d):
    """Every candidate of the tree with its marginal: what the model holds for markup and what it turns down."""
    return markup.markup_nodes(_read(spark, d, "articles"), "row_id", "content")


def p5_found(spark, d):
    return markup.markup_kinds(_read(spark, d, "articles"), "row_id", "content")


def p5_text(spark, d):
    return markup.clean_texts(_read(spark, d, "articles"), "row_id", "content")


def p6_found(spark, d):
    return p6_top(spark, d).select("src", "id")


def p6_top(spark, d):
    return topn.top_n(_read(spark, d, "related").where("src IS NULL OR id IS NULL OR src != id"), "src", "id", "score", n=10)


def p7_method(spark, d):
    """The repeated blocks of lines of every board, by the identifiers of their lines."""
    return lines.source_blocks(_read(spark, d, "articles"), "row_id", "id", "board.slug", "content")


def p7_found(spark, d):
    return lines.repeated_lines(_read(spark, d, "articles"), "row_id", "id", "board.slug", "content")


def p7_text(spark, d):
    return lines.without_repeated(_read(spark, d, "articles"), "row_id", "id", "board.slug", "content")


def p8_ids(spark, d):
    return tokens.encode_texts(_read(spark, d, "documents"), "doc_id", "text")


def p9_method(spark, d):
    """The method alone: every item to the lowest-cost sequence of all that have room."""
    return packing.containers(tokens.token_counts(_read(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", capacity=2048, slack=2048)


def p9_containers(spark, d):
    return packing.containers(tokens.token_counts(_read(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", capacity=2048)


def p10_found(spark, d):
    return subjects.subject_shares(_read(spark, d, "documents"), "doc_id", "text", _read(spark, d, "subjects")).select("doc_id", "subject")


def p10_mix(spark, d):
    docs = _read(spark, d, "documents")
    return subjects.composition(subjects.subject_shares(docs, "doc_id", "text", _read(spark, d, "subjects")), docs, "doc_id", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_text, p2_found, p2_nearest, p3_found, p3_terms, p4_method, p4_found, p4_groups, p5_method, p5_found, p5_text, p6_found, p6_top, p7_method, p7_found, p7_text, p8_ids, p9_method, p9_containers, p10_found, p10_mix)
    return {f.__name__: f for f in own}


_TERMS = """WITH e AS (SELECT id, lower(trim(x, ' ')) AS term FROM (SELECT id, unnest(list_concat(coalesce(t, []), coalesce(r, []))) AS x FROM doc_terms) WHERE x IS NOT NULL AND trim(x, ' ') <> ''),
n AS (SELECT count(DISTINCT id) AS n_docs FROM doc_terms),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS df FROM e GROUP BY term)
SELECT term, occurrences, df, n_docs, CASE WHEN df < 2 THEN 'rare' WHEN df > 0.6 * n_docs THEN 'common' ELSE 'kept' END AS mark FROM c, n"""
_TOP = """WITH r AS (SELECT src, id, max(score) AS score FROM related WHERE score IS NOT NULL AND NOT isnan(score) AND src <> id GROUP BY src, id)
SELECT src, id, score, rank FROM (SELECT src, id, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10"""
_PAIRS = """WITH g AS (SELECT row_id, vector::DOUBLE[] AS v FROM doc_embeddings WHERE vector IS NOT NULL AND len(vector) = 128 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
u AS (SELECT row_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[128] AS v FROM g),
p AS (SELECT a.row_id AS x, b.row_id AS y, array_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.row_id <> b.row_id),
t AS (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY round(s, 6) DESC, y) AS k FROM p WHERE s >= 0.82)
SELECT DISTINCT least(x, y) AS row_a, greatest(x, y) AS row_b FROM t WHERE k <= 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _PAIRS,
        "p3_terms": _TERMS,
        "p3_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark <> 'kept'",
        "p6_top": _TOP,
        "p6_found": f"SELECT src, id FROM ({_TOP})",
    }
