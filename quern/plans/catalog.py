"""Every query of the engine by name, with the SQL that states the same result.

All run over whole tables.  Where SQL cannot state a result (fitted models,
folds with a reset, draws from hashes) the query has none; tests compare it with
brute force instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.functions import text as X
from quern.operators import benchmark, distill, encoder, fusion, graph, index, keyword, lexicon, metrics, related
from quern.plans import oracle
from quern.sources import articles as A
from quern.runtime import materialize, scratch
from quern.sources import assets
from quern.streaming import changes

HOST = "read.example"
FIELDS = ["id", "title", "content", "category", "preview"]


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _articles(spark, d):
    return A.one_per_id(_read(spark, d, "articles"))


def _meta(spark, d):
    return A.doc_meta(_articles(spark, d))


def _terms(spark, d):
    kept = _read(spark, d, "articles").groupBy("id").agg(F.min("row_id").alias("row_id"))
    return A.clean_terms(_read(spark, d, "doc_terms")).join(kept.select("row_id"), "row_id", "left_semi")


def _queries(spark, d):
    return benchmark.query_set(_read(spark, d, "articles"))


def _embeddings(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(e):
    return e.where(F.col("id") % 50 == 0)


def literal_title_search(spark, d):
    return keyword.literal_hits(_queries(spark, d), _meta(spark, d))


def keyword_search_substring(spark, d):
    return keyword.substring_search(_queries(spark, d), _meta(spark, d)).select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


def keyword_search_terms(spark, d):
    return keyword.keyword_search(_queries(spark, d), _meta(spark, d), _terms(spark, d)).select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


def search_exact(spark, d):
    return fusion.search(_queries(spark, d), _meta(spark, d), _terms(spark, d), exact_mode=True).select("query_id", "row_id", "score", "source", "tier", "rank")


def query_interpretations(spark, d):
    return keyword.interpretations(_queries(spark, d)).select("query_id", "interp", F.array_join("terms", " ").alias("terms"))


def spelling_correction(spark, d):
    return keyword.correct(_queries(spark, d), _meta(spark, d), keyword.vocabulary(_terms(spark, d)))


def tag_counts(spark, d):
    return keyword.tag_counts(_meta(spark, d))


def tag_index(spark, d):
    return keyword.tag_index(_meta(spark, d)).withColumn("ids", F.array_join("ids", ","))


def tag_match(spark, d):
    return keyword.match_tags(_queries(spark, d), keyword.tag_counts(_meta(spark, d)))


def doc_meta(spark, d):
    m = _meta(spark, d)
    return m.withColumn("tags", F.array_join(F.transform("tags", lambda t: F.coalesce(t, F.lit("-"))), "|")).withColumn("authors", F.array_join(F.transform("authors", lambda a: F.concat_ws("/", a["name"], a["role"])), "|"))


def clean_markdown(spark, d):
    return _read(spark, d, "articles").select("row_id", X.clean_markdown(F.col("content")).alias("text"))


def strip_html_body(spark, d):
    return _read(spark, d, "articles").select("row_id", X.body_text(F.coalesce("content", F.lit(""))).alias("text"))


def clean_titles(spark, d):
    return _read(spark, d, "articles").select("row_id", X.clean_title(F.col("title")).alias("text"))


def title_keywords(spark, d):
    return _read(spark, d, "articles").select("row_id", F.array_join(X.title_keywords(F.col("title")), " ").alias("words"))


def content_segments(spark, d):
    return _read(spark, d, "articles").select("row_id", F.explode(X.segments(X.body_text(F.col("content")))).alias("segment"))


def chunk_documents(spark, d):
    return index.chunks(_read(spark, d, "articles"), "row_id", "content")


def passages(spark, d):
    a = _articles(spark, d)
    return index.passages(a, index.chunks(a, "id", "content"), "id", "title", "passage: ")


def vocab_df_idf(spark, d):
    a = _articles(spark, d).select("id", F.concat_ws(" ", "title", "content").alias("text"))
    return index.document_frequency(a, "id", "text").withColumn("idf", F.round("idf", 6))


def bigram_vocab(spark, d):
    return keyword.vocabulary(_terms(spark, d)).select("word", F.col("place.k").alias("k"), F.col("place.row_id").alias("row_id"), F.col("place.at").alias("at"))


def student_tokens(spark, d):
    return _articles(spark, d).select("row_id", F.posexplode(X.student_tokens(F.col("title"))).alias("at", "x")).select("row_id", "at", F.col("x.t").alias("t"), F.col("x.kind").alias("kind"))


def near_dup_jaccard(spark, d):
    """Titles as training items against the titles of every fiftieth row as evaluation items."""
    items = _read(spark, d, "articles").where("title IS NOT NULL").select(F.col("row_id").alias("id"), X.words(F.col("title")).alias("tokens"))
    return distill.near_duplicates(items, _asked(items), 0.6).withColumn("jaccard", F.round("jaccard", 6))


def quantize_int8(spark, d):
    e = _embeddings(spark, d).withColumn("s", vectors.scale_of(F.col("embedding")))
    return e.select("id", F.round("s", 8).alias("scale"), F.posexplode(vectors.quantize(F.col("embedding"), F.col("s"))).alias("at", "q"))


def dequantize_error(spark, d):
    e = _embeddings(spark, d).withColumn("scale", vectors.scale_of(F.col("embedding")))
    back = vectors.dequantize(vectors.quantize(F.col("embedding"), F.col("scale")), F.col("scale"))
    return e.select("id", F.round(F.array_max(F.zip_with("embedding", back, lambda x, y: F.abs(x - y))), 4).alias("most"))


def cosine_topk(spark, d):
    e = _embeddings(spark, d)
    return graph.block_top_k(_asked(e), e, "id", "embedding", 10, exclude_self=True).withColumn("score", F.round("score", 4))


def knn_edges(spark, d):
    return graph.knn_edges(graph.self_top_k(_embeddings(spark, d), "id", "embedding", 10), 0.3).withColumn("weight", F.round("weight", 3))


def centroid_pool(spark, d):
    return vectors.mean_pool(_embeddings(spark, d), "label", "embedding").select("label", F.posexplode("embedding").alias("at", "x")).withColumn("x", F.round("x", 5))


def _linked(spark, d):
    """Articles as a site shows them: behind the content, links to the ten related ones, by slug or by identifier."""
    r = _read(spark, d, "related").where("src != id AND score IS NOT NULL AND NOT isnan(score)")
    top = vectors.top_k(r.groupBy("src", "id").agg(F.max("score").alias("score"), F.max("slug").alias("to")), ["src"], "score", ["id"], 10)
    url = F.coalesce(F.concat(F.lit(f"https://{HOST}/view/"), "to"), F.concat(F.lit(f"https://{HOST}/view?uid="), "id"))
    links = top.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(url)), "\n").alias("links")).withColumnRenamed("src", "id")  # ten
    return _articles(spark, d).join(links, "id", "left").withColumn("content", F.concat_ws("\n", "content", "links")).drop("links")


def _graph(spark, d):
    return graph.build(_linked(spark, d), HOST)


def graph_build(spark, d):
    """Edges of the whole graph by type: attributes, links, boards' categories as series, and neighbours of the fiftieth articles."""
    a, v = _linked(spark, d), _doc_vectors(spark, d)
    series = a.where("category IS NOT NULL").groupBy(F.col("category").alias("id")).agg(F.min("category").alias("name"), F.collect_set("id").alias("articles"))
    near = graph.block_top_k(v.where("row_id % 50 = 0"), v, "id", "vector", 10, exclude_self=True)
    nodes, edges = graph.build(a, HOST, series, near)
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.round(F.sum("weight"), 1).alias("weight"))


def attribute_edges(spark, d):
    return _graph(spark, d)[1]


def graph_nodes(spark, d):
    return _graph(spark, d)[0]


def link_targets(spark, d):
    return graph.link_targets(_linked(spark, d), HOST).groupBy("resolved").agg(F.count("*").alias("n"))


def edge_merge(spark, d):
    return graph.adjacency(_graph(spark, d)[1])


def degree(spark, d):
    return graph.degrees(_graph(spark, d)[1])


def graph_counts(spark, d):
    return graph.counts(*_graph(spark, d))


def drawing_edges(spark, d):
    return graph.drawing_edges(_graph(spark, d)[1])


def neighbours_by_type(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.neighbours_by_type(edges, nodes).withColumn("neighbours", F.array_join("neighbours", ","))


def find_nodes(spark, d):
    return graph.find_nodes(_graph(spark, d)[0], "환율", ["tag", "article"])


def _beam(spark, d, best=None):
    a = materialize(_articles(spark, d).select("id", "row_id", "title", "slug", "board", "category", "tags", "contributors"))
    links = graph.link_edges(graph.link_targets(_linked(spark, d).select("id", "slug", "content"), HOST, among=a))
    adjacent = materialize(graph.adjacency(graph.attribute_edges(a)[1].unionByName(links)))
    v = materialize(_doc_vectors(spark, d, a).select(F.concat(F.lit("a:"), "id").alias("id"), "row_id", "vector"))
    every = materialize(graph.node_vectors(adjacent, v))
    return graph.beam_search(v.where("row_id % 50 = 0").select("id"), adjacent, every, returned=v, best=best, digits=4)


def beam_bfs(spark, d):
    """From every fiftieth article through its tags, authors, category, board and links; such a node's vector is its articles' mean."""
    return _beam(spark, d)


def related_articles(spark, d):
    return related.related(_beam(spark, d, best=10))


def fuse_rank(spark, d):
    e = _embeddings(spark, d).withColumn("half", F.slice("embedding", 1, 32))
    asked = _asked(e)
    one = lambda v: graph.block_top_k(asked, e, "id", v, 20, exclude_self=True).select(F.col("query").alias("query_id"), F.col("id").alias("row_id"), F.round("score", 4).alias("score"), "rank")
    ask = asked.select(F.col("id").alias("query_id"), F.lit("one two").alias("text"))
    return fusion.fuse(one("half"), fusion.gate(one("embedding")), ask)


def mrr_recall(spark, d):
    e = _embeddings(spark, d)
    return metrics.recall_mrr(_ranks(e)).select("n", *(F.round(c, 4).alias(c) for c in ("r1", "r5", "r10", "r20", "mrr")))


def _ranks(e):
    return graph.label_ranks(_asked(e), e, "id", "embedding", "label")


def bootstrap_ci(spark, d):
    return metrics.bootstrap_interval(_ranks(_embeddings(spark, d)), lambda r: 1 / (r + 1)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def top10_agreement(spark, d):
    e = _embeddings(spark, d).withColumn("scale", vectors.scale_of(F.col("embedding")))
    e = e.withColumn("back", vectors.dequantize(vectors.quantize(F.col("embedding"), F.col("scale")), F.col("scale")))
    one = lambda v: graph.block_top_k(_asked(e), e, "id", v, 10, exclude_self=True).select(F.col("query").alias("query_id"), F.col("id").alias("row_id"), "rank")
    return metrics.agreement(one("embedding"), one("back")).agg(F.round(F.avg("agreement"), 1).alias("agreement"), F.count("*").alias("n"))


def gate_calibration(spark, d):
    e = _embeddings(spark, d)
    top = graph.block_top_k(_asked(e), e, "id", "embedding", 1, exclude_self=True).select("query", F.round("score", 4).alias("top"))
    return metrics.propose_gate(top.where(F.col("query") % 100 == 0), top.where(F.col("query") % 100 != 0))


def gate_sets(spark, d):
    """The gate's calibration over titles, their first tags, and titles read backwards as gibberish, of every fiftieth article."""
    a = _articles(spark, d).where("row_id % 50 = 0").select("row_id", "title", F.nullif(F.array_join(F.slice("tags", 1, 2), " "), F.lit("")).alias("tag"))
    one = lambda k, name, text, fail: a.select((F.col("row_id") * 4 + k).alias("query_id"), "row_id", F.lit(name).alias("set"), text.alias("text"), F.lit(fail).alias("must_fail"))
    asked = one(0, "title", F.col("title"), False).union(one(1, "tags", F.col("tag"), False)).union(one(2, "gibberish", F.reverse("title"), True)).where("text IS NOT NULL")
    asked = materialize(asked)
    hits = materialize(_semantic(spark, d)(asked.select("query_id", "text")).where("score > 0"))
    floors, report = metrics.calibrate(asked, hits, asked.where("NOT must_fail"))
    return report.join(F.broadcast(floors.toDF("exact_floor", "fallback_floor")), F.lit(True))  # one row


def floor_percentiles(spark, d):
    return metrics.floor_percentiles(_read(spark, d, "articles"), "views", [0.05, 0.5, 0.95])


def source_digest(spark, d):
    return changes.source_digest(_articles(spark, d), FIELDS)


def fnv_shard(spark, d):
    words = _terms(spark, d).select(F.explode(F.concat("t", "r")).alias("term")).distinct()
    return lexicon.shards(words.withColumn("hash", X.fnv1a32(F.col("term"))))


def shard_packs(spark, d):
    sized = fnv_shard(spark, d).groupBy("shard").agg(F.sum(F.octet_length("term") + 4).cast("bigint").alias("bytes"))
    return lexicon.packs(sized, 2048)


def lexicon_candidates(spark, d):
    lines = _read(spark, d, "doc_terms").select(F.explode("r").alias("value")).where("value IS NOT NULL")
    return lexicon.title_candidates(lines.distinct())


def hangul_jamo(spark, d):
    return _read(spark, d, "articles").select("row_id", X.to_jamo(F.col("title")).alias("jamo"))


def term_score_hangul(spark, d):
    p = spark.createDataFrame(oracle.PAIRS, "q string, t string")
    return p.select("q", "t", X.term_score(F.col("q"), F.col("t")).alias("score"))


def strip_particles(spark, d):
    w = _read(spark, d, "articles").select(F.explode(X.words(F.col("content"))).alias("word")).distinct()
    return w.select("word", X.strip_particle(F.col("word")).alias("stem"))


def bench_variants(spark, d):
    return benchmark.variants(_articles(spark, d)).where("variant != 'typo'")


def bench_typos(spark, d):
    return benchmark.variants(_articles(spark, d)).where("variant = 'typo'")


def keyword_covered(spark, d):
    q = _articles(spark, d).select(F.col("row_id").alias("query_id"), "row_id", F.concat_ws(" ", F.slice("tags", 1, 2)).alias("text")).where("tags IS NOT NULL")
    return distill.keyword_covered(q, _meta(spark, d))


def query_synthesis(spark, d):
    return distill.synthesize(_articles(spark, d))


def encoder_slots(spark, d):
    return encoder.slots(_queries(spark, d), _vocabulary(spark, d)).select("query_id", "slot", "kind", "term")


def _vocabulary(spark, d):
    """(term, place, idf) of the terms of at least two documents and at most three fifths of them."""
    t = _terms(spark, d).select("id", F.array_distinct(F.concat("t", "r")).alias("x"))
    df = t.select("id", F.explode("x").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = t.count()
    df = df.withColumn("kept", (F.col("df") >= 2) & (F.col("df") <= 0.6 * n) & (F.length("term") >= 2))
    return lexicon.vocabulary_places(df).join(df.select("term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf")), "term")


def _doc_vectors(spark, d, articles=None):
    """(row_id, id, vector) of the articles: the first usable vector of each id, at unit length."""
    usable = (F.size("vector") == 128) & ~F.exists("vector", F.isnan) & F.exists("vector", lambda x: x != 0)
    v = _read(spark, d, "doc_embeddings").where("vector IS NOT NULL").where(usable)
    first = v.join(v.groupBy("id").agg(F.min("row_id").alias("row_id")).select("row_id"), "row_id", "left_semi").select("id", vectors.normalize(F.col("vector")).alias("vector"))
    return first.join((_articles(spark, d) if articles is None else articles).select("id", "row_id"), "id")


def _term_vectors(spark, d, vocabulary):
    """(place, idf, vector): what the documents that hold a term have in common, the mean of their vectors."""
    held = _terms(spark, d).select("row_id", F.explode(F.array_distinct(F.concat("t", "r"))).alias("term")).join(vocabulary.select("term", "place"), "term")
    pooled = vectors.mean_pool(held.join(_doc_vectors(spark, d), "row_id").select("place", "vector"), "place", "vector")
    return vocabulary.select("place", "idf").join(pooled, "place", "left")


def _student(spark, d, vocabulary, most: int = 2_000_000):
    """An encoder whose terms are weighted by idf; its vocabulary is what the driver holds, up to ``most`` terms."""
    rows = _term_vectors(spark, d, vocabulary).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} terms: narrow its document-frequency band")
    v, scale = np.zeros((len(rows), 128)), np.zeros(len(rows))
    for place, idf, x in rows.itertuples(index=False):
        scale[place] = idf
        if x is not None:
            v[place] = x
    return encoder.Student(v, [encoder.Member(scale, np.eye(128), np.zeros(128))])


def _semantic(spark, d):
    """Queries to ranked documents by the encoder, with how many of their slots are whole words."""
    vocabulary = materialize(_vocabulary(spark, d))
    student, docs = _student(spark, d, vocabulary), materialize(_doc_vectors(spark, d))

    def run(queries):
        return encoder.search(encoder.encode(encoder.slots(queries, vocabulary), student), docs.select("row_id", "vector"), k=20)

    return run


def student_search(spark, d):
    return _semantic(spark, d)(_queries(spark, d)).select("query_id", "row_id", F.round("score", 4).alias("score"), "rank", "exact_slots").where("score > 0")


def search_semantic(spark, d):
    """The whole search: keyword and encoder lists, correction, the gate with its two floors, fusion."""
    return fusion.search(_queries(spark, d), _meta(spark, d), _terms(spark, d), _semantic(spark, d)).withColumn("score", F.round("score", 4))


def student_encode(spark, d):
    """The queries by an encoder distilled from the documents' own vectors: titles are its training queries."""
    return distilled(spark, d)[1]


def distilled(spark, d, sample: int = 2000, **how):
    """(untrained, encoded queries of the trained encoder, trained): fitted on at most ``sample`` titles and their documents' vectors."""
    vocabulary = materialize(_vocabulary(spark, d))
    student = _student(spark, d, vocabulary)
    titles = benchmark.sample(_articles(spark, d).join(_doc_vectors(spark, d).select("row_id", "vector"), "row_id").where("title IS NOT NULL"), "row_id", sample)
    own = materialize(titles.select(F.col("row_id").alias("query_id"), F.col("title").alias("text"), "vector"))
    slots = encoder.slots(own.select("query_id", "text"), vocabulary).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "kind"))).alias("s"))
    rows = own.join(slots, "query_id").orderBy("query_id").toPandas()  # at most ``sample``
    pooled = [(np.array([x["place"] for x in s]), np.array([x["kind"] == "fb" for x in s])) for s in rows["s"]]
    docs = np.stack(rows["vector"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, 128))
    if not len(rows):
        return student, encoder.encode(encoder.slots(_queries(spark, d), vocabulary), student), student
    held = np.arange(len(rows)) % 10 == 0
    taught = encoder.Student(student.vectors)
    distill.train(pooled, docs, docs, np.arange(len(rows)), taught, student.members[0].term_scale, held, **({"epochs": 8, "seeds": (0,)} | how))
    return student, encoder.encode(encoder.slots(_queries(spark, d), vocabulary), taught), taught


def random_walks(spark, d):
    e = _embeddings(spark, d)
    edges = graph.adjacency(graph.knn_edges(graph.self_top_k(e, "id", "embedding", 10), 0.2))
    return related.random_walks(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight"))


def word2vec_graph(spark, d):
    return related.node_embeddings(random_walks(spark, d))


def layout(spark, d):
    return related.layout(_embeddings(spark, d).select("id", F.col("embedding").alias("vector")))


def eval_items(spark, d):
    """Each source's candidates as an evaluation item of that source."""
    pairs = _read(spark, d, "related").where("src != id").select(F.col("src").alias("query_id"), "id").distinct()
    return assets.relevant_pairs(pairs, _meta(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def slot_coverage(spark, d):
    return metrics.coverage(_queries(spark, d), encoder.slots(_queries(spark, d), _vocabulary(spark, d))).withColumn("covered", F.round("covered", 4))


def json_scan(spark, d):
    """The articles written as JSON records and scanned again with the record's schema."""
    at = scratch(spark)
    _articles(spark, d).select("id", "title", "content", "slug", "board", "category", "tags", "contributors", "created", "updated", "views", "thumbnail", "preview").write.json(at)
    back = spark.read.schema(A.ARTICLE).json(at)
    return back.select("id", "title", F.md5("content").alias("content"), F.col("board.slug").alias("board"), F.size(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), F.col("contributors")[0]["name"].alias("first"), "views")


def relational_export(spark, d):
    """The articles taken apart into boards, categories, tags and people, and put together again; those without views stay unpublished."""
    a = _articles(spark, d)
    boards = a.where("board.slug IS NOT NULL").groupBy(F.col("board.slug").alias("id")).agg(F.min("board.name").alias("name")).withColumn("slug", F.col("id"))
    categories = a.where("category IS NOT NULL").select(F.col("category").alias("id"), F.col("category").alias("name")).distinct()
    tagged = a.select(F.col("id").alias("article_id"), F.explode(F.array_distinct("tags")).alias("tag_id")).where("tag_id IS NOT NULL")
    who = a.select(F.col("id").alias("article_id"), F.posexplode("contributors").alias("sort_order", "c"))
    person = F.concat_ws("/", F.col("c.slug"), F.col("c.name"))
    people = who.select(person.alias("id"), F.col("c.name").alias("name"), F.col("c.slug").alias("slug")).distinct()
    rows = a.select("id", F.when(F.col("views").isNotNull(), "published").otherwise("draft").alias("status"), F.col("board.slug").alias("board_id"), F.col("category").alias("category_id"), "title", "content")
    out = A.relational_export(rows, boards, categories, tagged.select(F.col("tag_id").alias("id"), F.col("tag_id").alias("name")).distinct(), tagged, people, who.select("article_id", person.alias("person_id"), "sort_order", F.col("c.role").alias("role")))
    return out.select("id", F.col("board.slug").alias("board"), "category", F.array_join("tags", "|").alias("tags"), F.array_join(F.transform("contributors", lambda c: F.coalesce(c["name"], F.lit("-"))), "|").alias("people"))


def vocabulary_order(spark, d):
    return _vocabulary(spark, d).select("term", "place", F.round("idf", 6).alias("idf"))


def vocabulary_digest(spark, d):
    return changes.list_digest(_vocabulary(spark, d), "term", "place")


def lexicon_affinity(spark, d):
    """How near each vocabulary term comes to any article, by the mean of the vectors of the articles that hold it."""
    v = materialize(_vocabulary(spark, d))
    words = _term_vectors(spark, d, v).where("vector IS NOT NULL").join(v.select("term", "place"), "place").select(F.col("term").alias("word"), "vector")
    return lexicon.affinity(words, _doc_vectors(spark, d)).withColumn("affinity", F.round("affinity", 4))


def frequency_candidates(spark, d):
    """Words of the contents with their numbers, as lines of a frequency list."""
    w = _read(spark, d, "articles").select(F.explode(X.words(F.col("title"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return lexicon.frequency_candidates(w.select(F.concat_ws(" ", "word", F.col("n").cast("string")).alias("value")))


def new_words(spark, d):
    return lexicon.new_words(frequency_candidates(spark, d), _vocabulary(spark, d))


def student_rows(spark, d):
    """Rows of the index for the encoder's documents; those that the index lacks have -1."""
    ids = _read(spark, d, "related").select("id").distinct()
    return assets.student_rows(ids.select(F.col("id").alias("place"), "id"), _meta(spark, d))


def split_metrics(spark, d):
    """Retrieval quality of queries of even and odd number apart, as of new and old documents."""
    return metrics.recall_mrr(_ranks(_embeddings(spark, d)).withColumn("fresh", F.col("query_id") % 100 == 0), ["fresh"]).select("fresh", "n", *(F.round(c, 4).alias(c) for c in ("r1", "r5", "r10", "r20", "mrr")))


def bench_sample(spark, d):
    return benchmark.sample(_articles(spark, d), "row_id", 300).select("row_id", "id")


def training_counts(spark, d):
    """Synthesised training queries of each kind, and those that no evaluation query equals or is like."""
    held = _queries(spark, d).select(F.col("query_id").alias("id"), X.tidy(F.col("text")).alias("text"))
    return distill.training_set(_articles(spark, d), [held])[1]


def latest_rows(spark, d):
    w = Window.partitionBy("id").orderBy(F.col("ingested_at").desc(), F.col("row_id").desc())
    return _read(spark, d, "articles").select("id", "row_id", "ingested_at").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", "row_id")


NAMES = """literal_title_search keyword_search_substring keyword_search_terms search_exact query_interpretations spelling_correction tag_counts tag_index tag_match doc_meta
clean_markdown strip_html_body clean_titles title_keywords content_segments chunk_documents passages vocab_df_idf bigram_vocab student_tokens near_dup_jaccard quantize_int8
dequantize_error cosine_topk knn_edges centroid_pool attribute_edges graph_nodes graph_build link_targets edge_merge degree graph_counts drawing_edges neighbours_by_type find_nodes beam_bfs
related_articles fuse_rank mrr_recall bootstrap_ci top10_agreement gate_calibration gate_sets floor_percentiles source_digest fnv_shard shard_packs lexicon_candidates hangul_jamo
term_score_hangul strip_particles bench_variants bench_typos keyword_covered query_synthesis encoder_slots student_search search_semantic student_encode random_walks word2vec_graph layout eval_items slot_coverage json_scan relational_export vocabulary_order vocabulary_digest lexicon_affinity
frequency_candidates new_words student_rows split_metrics bench_sample training_counts latest_rows""".split()


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()


__all__ = ["oracle_sql", "queries"]
