"""Keyword search, spelling correction and tag matching for a set of queries.

Query terms meet the distinct vocabulary in equi joins that miss no match: equal
words, words that hold the term by its rarest pair of characters, words that the
term holds, and for edits the pieces of a word of which one must be left whole.
Only those candidates are scored, and what matches meets the postings in an equi
join.  No join compares all with all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.vectors import top_k
from quern.runtime import broadcast_below, materialize

# The score of a literal title hit, and how many results come out.
LITERAL = 1.5
K = 20

SMALL = 500_000  # rows of a table that may be broadcast; it is counted first


def interpretations(queries: DataFrame) -> DataFrame:
    """(query_id, interp, terms): 0 the nouns, 1 the raw words, 2 all words joined; empty ones are left out."""
    q = queries.select("query_id", X.words(F.col("text")).alias("raw"), X.extract_terms(F.col("text")).alias("nouns"), X.joined(F.lower("text")).alias("whole"))
    distrust = (F.size("raw") == 1) & (F.length(F.array_join("nouns", "")) < 0.7 * F.length("whole"))
    every = F.array(
        F.struct(F.lit(0).alias("interp"), F.when(distrust, F.array().cast("array<string>")).otherwise(F.col("nouns")).alias("terms")),
        F.struct(F.lit(1).alias("interp"), F.col("raw").alias("terms")),
        F.struct(F.lit(2).alias("interp"), F.when((F.size("raw") > 1) & (F.length("whole") >= 2), F.array("whole")).otherwise(F.array().cast("array<string>")).alias("terms")),
    )
    return q.select("query_id", F.inline(every)).where(F.size("terms") > 0)


def phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase): the raw words with one space between."""
    return queries.select("query_id", F.array_join(X.words(F.col("text")), " ").alias("phrase"))


def _pairs(c):
    """The distinct pairs of neighbouring characters; a single character by itself."""
    n = F.length(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, ...) of every text (text, ...) that holds a needle (needle): each looks where its rarest pair of characters stands."""
    needles = needles.select("needle").where("needle != ''").distinct()
    pairs = needles.select("needle", F.explode(_pairs(F.col("needle"))).alias("gram"))
    wanted = broadcast_below(pairs.select("gram").distinct(), SMALL)
    grams = F.array_union(_pairs(F.col("text")), F.split("text", ""))  # needles of one character look among the characters
    held = texts.where("text != ''").withColumn("gram", F.explode(grams))
    counts = held.select("gram").join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = pairs.join(broadcast_below(counts, SMALL), "gram", "left").groupBy("needle").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n IS NOT NULL").select("needle", "r.gram")
    return held.join(broadcast_below(materialize(rarest), SMALL), "gram").where(F.expr("contains(text, needle)")).drop("gram")


def literal_hits(queries: DataFrame, meta: DataFrame) -> DataFrame:
    """(query_id, row_id) of titles that contain the phrase of two characters or more."""
    q = phrases(queries).where(F.length("phrase") >= 2).withColumnRenamed("phrase", "needle")
    hit = containing(q, meta.select("row_id", F.lower("title").alias("text"))).select("needle", "row_id")
    return hit.join(broadcast_below(q, SMALL), "needle").select("query_id", "row_id")


def postings(terms: DataFrame) -> DataFrame:
    """(term, row_id, in_title) of a term dictionary (row_id, t, r)."""
    one = lambda c, title: terms.select(F.explode(c).alias("term"), "row_id", F.lit(title).alias("in_title"))
    return one("t", True).union(one("r", False)).distinct()


def _cuts(length, k: int):
    """(start, length) of the i-th of ``k`` even pieces, the longer ones last; both functions of i."""
    base, more = F.floor(length / k), length % k
    return lambda i: i * base + F.greatest(F.lit(0), i - (k - more)), lambda i: base + F.when(i >= k - more, 1).otherwise(0)


def _stored(kind, size, j, k: int):
    """Keys of a word's jamo ``j`` in ``k`` pieces; ``kind`` and ``size`` tell whole words and beginnings apart."""
    start, length = _cuts(F.length(j), k)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.xxhash64(F.lit(kind), size, F.lit(k), F.length(j), i, F.substring(j, (start(i) + 1).cast("int"), length(i).cast("int"))))


def _asked(kind, size, j, k: int, most: int):
    """Keys under which words within ``most`` edits of ``j`` store a piece: one of k > most pieces is whole, at most ``most`` places off."""

    def of_length(d):
        n = F.length(j) + d
        start, length = _cuts(n, k)
        key = lambda i, p: F.when((p >= 0) & (p + length(i) <= F.length(j)), F.xxhash64(F.lit(kind), size, F.lit(k), n, i, F.substring(j, (p + 1).cast("int"), length(i).cast("int"))))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda m: key(i, start(i) + m))))

    every = F.flatten(F.transform(F.sequence(F.lit(-most), F.lit(most)), of_length))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def _beginnings(x):
    """array<struct<m, j>>: the beginnings of a spelled word of three characters or more and at least half of it, with their jamo."""
    n = F.length(x["w"])
    first = F.greatest(F.lit(3), F.ceil(n / 2).cast("int"))
    return F.when(n > first, F.transform(F.sequence(first, n - 1), lambda m: F.struct(m.alias("m"), F.substring(x["j"], F.lit(1), F.get(x["at"], m - 1)).alias("j")))).otherwise(F.array().cast("array<struct<m:int,j:string>>"))


def edited(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, word): all pairs that may be within 1 edit of their jamo, or 2 from four characters on, whole or as beginnings.

    ``terms`` has (term, q), ``words`` (word, v), both spelled.  A word is stored
    under its pieces, two below four characters and three from there on; a term
    asks for its own pieces at the few places where they may stand.
    """
    v, q = F.col("v"), F.col("q")
    zero = F.lit(0)
    by_size = lambda size, few, many: F.when(size >= 4, many).otherwise(few)
    heads = F.flatten(F.transform(_beginnings(v), lambda x: by_size(x["m"], _stored("head", x["m"], x["j"], 2), _stored("head", x["m"], x["j"], 3))))
    stored = words.where((F.length("word") >= 2) & v["h"]).select("word", F.explode(F.concat(by_size(F.length("word"), _stored("whole", zero, v["j"], 2), _stored("whole", zero, v["j"], 3)), heads)).alias("key"))
    n = F.length("term")
    whole = F.concat(_asked("whole", zero, q["j"], 2, 1), F.when(n >= 4, _asked("whole", zero, q["j"], 3, 2)).otherwise(_asked("whole", zero, q["j"], 3, 1)))
    own = F.flatten(F.transform(_beginnings(q), lambda x: by_size(x["m"], _asked("whole", zero, x["j"], 2, 1), _asked("whole", zero, x["j"], 3, 2))))
    as_head = by_size(n, _asked("head", n, q["j"], 2, 1), _asked("head", n, q["j"], 3, 2))
    asked = terms.where((n >= 2) & q["h"]).select("term", F.explode(F.array_distinct(F.concat(whole, own, as_head))).alias("key"))
    return stored.join(asked, "key").select("term", "word")


def term_matches(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, word, score, ...) of each query term and each word of a distinct vocabulary that answers it.

    Columns beside ``word`` come along.  Words are spelled out once.
    """
    q = materialize(terms.select("term").distinct().withColumn("q", X.spelled(F.col("term"))))
    v = materialize(vocabulary.withColumn("v", X.spelled(F.col("word"))))
    longest = v.agg(F.max(F.length("word")).alias("longest"))
    n, word = F.length("term"), F.col("word")
    inner = F.flatten(F.transform(F.sequence(F.greatest(F.lit(2), F.ceil(n * 0.6).cast("int")), F.least(n, F.col("longest"))), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.substring("term", i, m))))
    parts = q.join(F.broadcast(longest), F.lit(True)).where((n >= 2) & (F.least(n, F.col("longest")) >= F.greatest(F.lit(2), F.ceil(n * 0.6)))).select("term", F.explode(F.array_distinct(inner)).alias("word"))  # one row beside each
    pairs = [
        q.select("term", F.col("term").alias("word")),
        parts.join(v.select("word"), "word").select("term", "word"),
        containing(q.where(n >= 2).select(F.col("term").alias("needle")), v.select("word", word.alias("text"))).select(F.col("needle").alias("term"), "word"),
        edited(q, v.select("word", "v")),
    ]
    met = reduce(DataFrame.union, pairs).distinct()
    hit = met.join(broadcast_below(q, 100_000), "term").join(v, "word")
    return hit.withColumn("score", X.spelled_score(F.col("q"), F.col("v"))).where("score > 0").drop("q", "v")


def keyword_search(queries: DataFrame, meta: DataFrame, terms: DataFrame, k: int = K) -> DataFrame:
    """(query_id, row_id, score, rank): the ``k`` best documents of each query.

    A title's match counts double and hides the other terms' matches; a query
    term without a match voids its interpretation; the best interpretation
    counts; a literal title hit lifts the score to 1.5; ties go by row.
    """
    wanted = interpretations(queries).select("query_id", "interp", F.size("terms").alias("n"), F.posexplode("terms").alias("no", "term"))
    post = postings(terms)
    matches = broadcast_below(materialize(term_matches(wanted, post.select(F.col("term").alias("word")).distinct())), SMALL)
    found = post.withColumnRenamed("term", "word").join(matches, "word").groupBy("term", "row_id").agg(F.max(F.when(F.col("in_title"), F.col("score") * 2)).alias("title"), F.max(F.when(~F.col("in_title"), F.col("score"))).alias("rest"))
    best = found.select("term", "row_id", F.coalesce("title", "rest").alias("best"))
    full = best.join(broadcast_below(wanted, SMALL), "term").groupBy("query_id", "interp", "row_id", "n").agg(F.sum("best").alias("total"), F.count("*").alias("hit")).where("hit = n")
    scored = full.select("query_id", "row_id", (F.col("total") / (2 * F.col("n"))).alias("score"))
    literal = literal_hits(queries, meta).withColumn("score", F.lit(LITERAL))
    merged = scored.unionByName(literal).groupBy("query_id", "row_id").agg(F.max("score").alias("score"))
    return top_k(merged, ["query_id"], "score", ["row_id"], k)


def substring_search(queries: DataFrame, meta: DataFrame, k: int = K) -> DataFrame:
    """Keyword search without term lists: 2 for a title that contains the word, 1 for tags and authors that do."""
    wanted = interpretations(queries).select("query_id", "interp", F.size("terms").alias("n"), F.posexplode("terms").alias("no", "term"))
    rest = F.lower(F.concat_ws(" ", F.array_join("tags", " "), F.array_join(F.transform("authors", lambda a: a["name"]), " ")))
    words = materialize(wanted.select(F.col("term").alias("needle")).distinct())
    parts = [containing(words, meta.select("row_id", text.alias("text"), F.lit(best).alias("best"))).select("needle", "row_id", "best") for text, best in ((F.lower("title"), 2.0), (rest, 1.0))]
    best = parts[0].union(parts[1]).groupBy(F.col("needle").alias("term"), "row_id").agg(F.max("best").alias("best"))
    full = best.join(broadcast_below(wanted, SMALL), "term").groupBy("query_id", "interp", "row_id", "n").agg(F.sum("best").alias("total"), F.count("*").alias("hit")).where("hit = n")
    scored = full.select("query_id", "row_id", (F.col("total") / (2 * F.col("n"))).alias("score"))
    merged = scored.unionByName(literal_hits(queries, meta).withColumn("score", F.lit(LITERAL))).groupBy("query_id", "row_id").agg(F.max("score").alias("score"))
    return top_k(merged, ["query_id"], "score", ["row_id"], k)


def vocabulary(terms: DataFrame) -> DataFrame:
    """(word, place): distinct words in the order of the documents, then distinct neighbours in titles joined."""
    single = terms.select("row_id", F.posexplode(F.concat("t", "r")).alias("at", "word")).select("word", F.struct(F.lit(0).alias("k"), "row_id", "at").alias("place"))
    double = terms.select("row_id", F.posexplode(X.bigrams(F.col("t"))).alias("at", "word")).select("word", F.struct(F.lit(1).alias("k"), "row_id", "at").alias("place"))
    return single.union(double).groupBy("word").agg(F.min("place").alias("place"))


def correct(queries: DataFrame, meta: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, corrected): the spelling that the vocabulary suggests, for queries without a literal hit that need one."""
    asked = queries.join(literal_hits(queries, meta).select("query_id").distinct(), "query_id", "left_anti")
    wanted = interpretations(asked).select("query_id", "interp", F.size("terms").alias("n"), F.posexplode("terms").alias("no", "term"))
    hit = term_matches(wanted, vocab)
    order = Window.partitionBy("term").orderBy(F.col("score").desc(), F.abs(F.length("word") - F.length("term")), "place")
    best = hit.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("term", "word", "score")
    swap = (F.col("score") < 1) & (F.col("score") >= 0.65) & (F.col("word") != F.col("term"))
    full = (
        wanted.join(broadcast_below(materialize(best), SMALL), "term")
        .withColumn("swap", swap)
        .groupBy("query_id", "interp", "n")
        .agg(
            F.count("*").alias("hit"),
            F.avg("score").alias("quality"),
            F.max("swap").alias("replaced"),
            F.transform(F.array_sort(F.collect_list(F.struct("no", F.when(F.col("swap"), F.col("word")).otherwise(F.col("term")).alias("w")))), lambda x: x["w"]).alias("terms"),  # a query's words
        )
        .where("hit = n")
        .join(broadcast_below(phrases(asked), SMALL), "query_id")
        .withColumn("gap", F.abs(F.length(F.array_join("terms", "")) - F.length(X.joined(F.col("phrase")))))
    )
    first = Window.partitionBy("query_id").orderBy(F.col("quality").desc(), "gap", "n", "interp")
    one = full.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("corrected", F.array_join("terms", " "))
    merged = (X.joined(F.col("corrected")) == X.joined(F.col("phrase"))) & (F.size("terms") < F.size(X.words(F.col("phrase"))))
    return one.where((F.col("corrected") != F.col("phrase")) & (F.col("replaced") | merged)).select("query_id", "corrected")


def tag_counts(meta: DataFrame) -> DataFrame:
    """(name, count, first_row): how often each tag stands, and the first row that has it."""
    return meta.select("row_id", F.explode("tags").alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("count"), F.min("row_id").alias("first_row"))


def tag_index(meta: DataFrame, rows: int = 4096) -> DataFrame:
    """(name, block, count, ids) for export: a tag's identifiers by blocks of ``rows`` row numbers, as a tag may stand in nearly all rows."""
    return (
        meta.select("row_id", "id", F.explode("tags").alias("name"))
        .where("name IS NOT NULL")
        .groupBy("name", F.floor(F.col("row_id") / rows).alias("block"))
        .agg(F.count("*").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("row_id", "id"))), lambda x: x["id"]).alias("ids"))
    )


def match_tags(queries: DataFrame, counts: DataFrame, k: int = 3, least: float = 0.65) -> DataFrame:
    """(query_id, name, count, score, rank): the tags that best answer any word of each query."""
    wanted = queries.select("query_id", F.explode(X.words(F.col("text"))).alias("term")).distinct()
    names = counts.withColumn("word", F.lower("name"))
    hit = term_matches(wanted, names).where(F.col("score") >= least)
    scored = hit.join(broadcast_below(wanted, SMALL), "term").groupBy("query_id", "name", "count", "first_row").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("count").desc(), "first_row", "name")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first_row")
