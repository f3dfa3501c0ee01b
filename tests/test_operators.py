"""Operators without SQL against brute force, and the edges of the others."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import benchmark, distill, encoder, fusion, graph, index, keyword, lexicon, metrics, related
from quern.runtime import materialize
from quern.sources import articles as A


def test_chunk_rules():
    assert index.chunk([]) == [""]
    assert index.chunk(["a" * 30]) == ["a" * 30]  # short, but all there is
    assert index.chunk(["a" * 540, "b" * 20]) == ["a" * 540]  # a short rest is dropped
    assert index.chunk(["a" * 300, "b" * 100, "c" * 200]) == ["a" * 300 + " " + "b" * 100, "c" * 200]
    assert [len(x) for x in index.chunk(["a" * 2000])] == [800, 800, 400]


def test_chunks_keep_null_contents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "가\r\n\r\n" + "나" * 900)], "id int, content string")
    got = {(r.id, r.chunk_no): r.chunk for r in index.chunks(df, "id", "content").collect()}
    assert got[1, 0] == "" and got[2, 0] == "" and got[3, 0] == "가" and got[3, 1] == "나" * 800 and got[3, 2] == "나" * 100


def _e(spark, n=60, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")


@pytest.mark.parametrize("block", [7, 1000])
def test_self_top_k_in_blocks(spark, block):
    x, df = _e(spark)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {i: set(np.argsort(-s[i])[:4].tolist()) for i in range(len(x))}
    got = {}
    for r in graph.self_top_k(df, "id", "vector", 4, block=block).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert got == want


def test_queries_in_tiles_and_held_agree(spark):
    x, df = _e(spark)
    asked = df.where("id < 20")
    rows = lambda d: sorted((r.query, r.id, r["rank"]) for r in d.collect())
    assert rows(graph.block_top_k(asked, df, "id", "vector", 3, True)) == rows(graph.block_top_k(asked, df, "id", "vector", 3, True, block=7, most_held=5))
    labelled = df.withColumn("label", (F.col("id") % 7).cast("int"))
    s = np.round(x.astype(np.float64) @ x.T, 5)
    np.fill_diagonal(s, -9)
    want = {i: int((s[i] > max(s[i, j] for j in range(60) if j != i and j % 7 == i % 7)).sum()) for i in range(20)}
    got = {r.query_id: r["rank"] for r in graph.label_ranks(labelled.where("id < 20"), labelled, "id", "vector", "label", block=9).collect()}
    assert sum(got[i] != want[i] for i in want) <= 1  # float32 products may round apart


def test_beam_search_equals_a_loop(spark):
    x, df = _e(spark)
    edges = graph.knn_edges(graph.self_top_k(df, "id", "vector", 3), -1)
    adj = graph.adjacency(edges)
    near = {}
    for r in adj.collect():
        near.setdefault(r.src, set()).add(r.dst)
    beam, want = 5, {}
    for src in (0, 7):
        seen, front = {src}, [src]
        for d in range(4):
            new = {v for u in front for v in near.get(u, ())} - seen
            seen |= new
            for v in new:
                want[src, v] = (d, float(x[src] @ x[v]) * 0.9**d)
            front = sorted(new, key=lambda v: (-round(want[src, v][1], 6), v))[:beam]
    got = {(r.src, r.id): (r.level, r.score) for r in graph.beam_search(df.where("id IN (0, 7)"), adj, df, beam=beam).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
    top = related.related(graph.beam_search(df.where("id IN (0, 7)"), adj, df, beam=beam).select("src", "id", "score"), k=3).collect()
    assert len(top) == 6 and max(r["rank"] for r in top) == 3


def _hub(spark, monkeypatch):
    """80 nodes around one hub and two that nobody reaches, many with the same vector; the rows of each table that is written on the way."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 4))
    x = (x / np.linalg.norm(x, axis=1)[:, None])[rng.integers(0, 12, 83)]
    v = spark.createDataFrame([(f"{i:02}", r.tolist()) for i, r in enumerate(x)], "id string, vector array<double>")
    near = {"80": {f"{i:02}" for i in range(80)}} | {f"{i:02}": {"80", f"{(i * 7 + 1) % 80:02}"} for i in range(80)}
    adj = spark.createDataFrame([(a, b, 1.0) for a, bs in near.items() for b in bs] + [("81", "81", 1.0), ("00", "lost", 1.0)], "src string, dst string, weight double")
    want = {}
    for src in near:
        seen, front = {src}, [src]
        for d in range(4):
            new = {b for a in front for b in near[a]} - seen
            seen |= new
            want |= {(src, b): (d, round(float(x[int(src)] @ x[int(b)]) * 0.9**d, 4)) for b in new}
            front = sorted(new, key=lambda b: (-round(float(x[int(src)] @ x[int(b)]) * 0.9**d, 6), b))[:3]
    rows, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: (w := plain(df), rows.append(w.count()))[0])
    return v, adj, want, rows


def test_best_of_a_beam_search_are_found_without_writing_all_pairs(spark, monkeypatch):
    v, adj, want, rows = _hub(spark, monkeypatch)
    by = {}
    for (src, b), (_, score) in want.items():
        by.setdefault(src, []).append((-score, b))
    want = {(src, n + 1): b for src, bs in by.items() for n, (_, b) in enumerate(sorted(bs)[:5])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        for more in ({}, {"held": 7}):
            hits = graph.beam_search(v.select("id"), adj, v, beam=3, best=5, **more)
            assert {(r.src, r["rank"]): r.id for r in related.related(hits, k=5).collect()} == want
            assert hits.count() < 81 * 80 / 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(rows) < 81 * 80 / 10


def test_all_pairs_of_a_beam_search_come_whole_and_are_not_written_on_the_way(spark, monkeypatch):
    v, adj, want, rows = _hub(spark, monkeypatch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        hits = graph.beam_search(v.select("id"), adj, v, beam=3)
        got = [(r.src, r.id, r.level, round(r.score, 4)) for r in hits.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted((src, b, d, score) for (src, b), (d, score) in want.items())
    few = graph.beam_search(v.select("id"), adj, v, v.where("id < '05'"), beam=3).collect()
    assert sorted((r.src, r.id) for r in few) == sorted(k for k in want if k[1] < "05")
    assert max(rows) < len(got) / 10


def _received(plan) -> int:
    """Bytes that a plan which has run got from Python."""
    own = plan.metrics().get("pythonDataReceived")
    below = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.children().apply(i) for i in range(plan.children().size())]
    return (own.get().value() if own.isDefined() else 0) + sum(map(_received, below))


def test_identifiers_of_all_pairs_of_a_beam_search_do_not_pass_python(spark, monkeypatch):
    v, adj, want, _ = _hub(spark, monkeypatch)
    long = lambda c: F.concat(F.lit("n" * 60), c).alias(c)
    v, adj = v.select(long("id"), "vector"), adj.select(long("src"), long("dst"), "weight")
    for more in ({}, {"held": 7}):
        hits = graph.beam_search(v.select("id"), adj, v, beam=3, **more)
        got = [(r.src[60:], r.id[60:], r.level, round(r.score, 4)) for r in hits.collect()]
        assert sorted(got) == sorted((src, b, d, score) for (src, b), (d, score) in want.items())
        assert len(got) < _received(hits._jdf.queryExecution().executedPlan()) < 60 * len(got)
    hits = graph.beam_search(v.select(F.lit(0).cast("long").alias("id")), adj.where("dst NOT LIKE '%lost'").select(*(F.substring(c, 61, 2).cast("long").alias(c) for c in ("src", "dst"))), v.select(F.substring("id", 61, 2).cast("long").alias("id"), "vector"), beam=3)
    assert dict(hits.dtypes) == {"src": "bigint", "id": "bigint", "score": "double", "level": "int"}
    assert sorted((r.src, r.id) for r in hits.collect()) == sorted((0, int(b)) for src, b in want if src == "00")


def test_registered_beam_search_walks_the_article_graph(spark, data):
    """The query against a loop over the same graph: beam of 128, nodes without a vector of their own at their neighbours' mean."""
    from quern.plans import catalog

    near, vec = {}, {}
    for r in catalog._graph(spark, data)[1].select("src", "dst").distinct().collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    asked = []
    for r in catalog._doc_vectors(spark, data).collect():
        vec["a:" + r.id] = np.array(r.vector)
        if r.row_id % 50 == 0:
            asked.append("a:" + r.id)
    own = set(vec)
    for n in near.keys() - own:
        if around := [vec[m] for m in near[n] if m in own]:
            mean = np.mean(around, axis=0)
            vec[n] = mean / np.linalg.norm(mean)
    want = {}
    for src in asked:
        seen, front = {src}, [src]
        for d in range(4):
            new = {v for u in front for v in near.get(u, ()) if v in vec} - seen
            seen |= new
            score = {v: float(vec[src] @ vec[v]) * 0.9**d for v in new}
            want |= {(src, v): d for v in new if v in own}
            front = sorted(new, key=lambda v: (-round(score[v], 6), v))[:128]
    got = {(r.src, r.id): r.level for r in catalog.beam_bfs(spark, data).collect()}
    assert got == want and len(got) > 50


def test_walks_follow_edges(spark):
    adj = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 3.0)], "src string, dst string, weight double")
    edges = {(r.src, r.dst) for r in adj.collect()}
    rows = related.random_walks(adj, walks=50, length=10).collect()
    assert len(rows) == 100
    for r in rows:
        assert r.path[0] == r.start and all(e in edges for e in zip(r.path, r.path[1:]))
        assert len(r.path) == 10 or r.path[-1] == "c"
    second = [r.path[1] for r in rows if r.start == "b"]
    assert 25 < second.count("c") < 50  # three in four


def test_registered_walks_and_vectors_have_full_size(spark, data):
    from quern.plans import catalog

    walks = catalog.random_walks(spark, data)
    n, starts, short, longest = walks.agg(F.count("*"), F.countDistinct("start"), F.min(F.size("path")), F.max(F.size("path"))).first()
    assert n == 10 * starts and short == longest == 80  # both directions of each edge: no sinks
    assert walks.select("start", "walk").distinct().count() == n


def test_registered_node_vectors_have_128_places(spark, data, monkeypatch):
    from pyspark.ml import feature

    from quern.plans import catalog

    asked, fit = [], feature.Word2Vec.fit
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda w, df: asked.append((w.getVectorSize(), w.getWindowSize(), w.getMaxIter())) or fit(w.setMaxIter(1), df))
    few = spark.createDataFrame([("a", 0, ["a", "b", "a"]), ("b", 0, ["b", "a", "b"])], "start string, walk int, path array<string>")
    monkeypatch.setattr(catalog, "random_walks", lambda s, d: few)
    rows = catalog.word2vec_graph(spark, data).collect()
    assert {r.id for r in rows} == {"a", "b"} and all(len(r.vector) == 128 for r in rows)
    assert asked == [(128, 10, 5)]


def test_link_targets(spark):
    rows = [("1", "s1", "http://h.x/b/s2 http://h.x/p?uid=3 http://h.x/api/files/z http://h.x/b/s1 http://h.x/q/none http://h.x/p?uid=9"), ("2", "s2", None), ("3", None, "")]
    df = spark.createDataFrame(rows, "id string, slug string, content string")
    got = sorted((r.id, r.target, r.resolved) for r in graph.link_targets(df, "h.x").where("resolved").collect())
    assert got == [("1", "2", True), ("1", "3", True)]
    assert graph.link_targets(df, "h.x").where("NOT resolved").count() == 3  # itself by slug, an unknown slug, an unknown id


def test_series_need_two_members(spark):
    articles = spark.createDataFrame([("1",), ("2",)], "id string")
    series = spark.createDataFrame([("s", "S", ["1", "2", "9"]), ("t", "T", ["1", "9"])], "id string, name string, articles array<string>")
    assert {(r.src, r.dst) for r in graph.series_edges(series, articles).collect()} == {("a:1", "series:s"), ("a:2", "series:s")}
    assert A.series(spark).count() == 0


def test_fusion_rules(spark):
    q = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a")], "query_id long, text string")
    kw = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 20, 0.5, 1)], "query_id long, row_id long, score double, rank int")
    sem = spark.createDataFrame([(1, 30, 0.7, 1), (2, 20, 0.9, 1), (2, 21, 0.8, 2), (3, 40, 0.4, 1)], "query_id long, row_id long, score double, rank int")
    got = {}
    for r in fusion.fuse(kw, sem, q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.row_id, r.source, r.tier))
    assert got[1] == [(10, "keyword", "keyword"), (11, "keyword", "keyword"), (30, "semantic", "keyword")]  # strong and no overlap
    assert got[2] == [(20, "semantic", "semantic"), (21, "semantic", "semantic")]
    assert got[3] == [(40, "semantic", "semantic")]
    fixed = spark.createDataFrame([(1, "x")], "query_id long, corrected string")
    assert fusion.fuse(kw, sem, q, fixed).where("query_id = 1").orderBy("rank").first().row_id == 30  # a corrected query trusts the semantic list
    assert fusion.gate(sem, exact=0.75).select("query_id").distinct().count() == 1


def test_empty_tables(spark):
    meta = spark.createDataFrame([], "row_id long, id string, title string, tags array<string>, authors array<struct<name:string,role:string>>")
    terms = spark.createDataFrame([], "row_id long, id string, t array<string>, r array<string>")
    q = spark.createDataFrame([(1, "세금")], "query_id long, text string")
    assert keyword.keyword_search(q, meta, terms).count() == 0
    assert keyword.correct(q, meta, keyword.vocabulary(terms)).count() == 0
    assert keyword.match_tags(q, keyword.tag_counts(meta)).count() == 0
    v = spark.createDataFrame([], "id long, vector array<float>")
    assert graph.self_top_k(v, "id", "vector", 3).count() == 0
    assert graph.block_top_k(v, v, "id", "vector", 3).count() == 0


def test_slots_first_wins_and_fallback(spark):
    vocab = spark.createDataFrame([("세금", 0), ("인상", 1), ("경제", 2)], "term string, place long")
    lex = spark.createDataFrame([("환율", 0)], "term string, place long")
    q = spark.createDataFrame([(1, "세금 세금의 환율 경제학자 나무"), (2, "없다")], "query_id long, text string")
    got = [(r.query_id, r.slot, r.kind, r.term) for r in encoder.slots(q, vocab, lex).orderBy("query_id", "slot").collect()]
    assert got == [(1, 0, "core", "세금"), (1, 1, "ext", "환율"), (1, 2, "fb", "경제")]


def test_encoder_equals_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3, 4)).astype(np.float32)
    m = encoder.Member(np.array([1.0, 2.0, 0.5]), rng.normal(size=(2, 4)), rng.normal(size=2), 0.6, 1.5)
    student = encoder.Student(v, [m, m], lexicon=rng.normal(size=(1, 4)).astype(np.float32))
    slots = spark.createDataFrame([(1, 0, "core", "a", 1), (1, 1, "ext", "b", 0), (1, 2, "fb", "c", 2)], "query_id long, slot int, kind string, term string, place long")
    got = encoder.encode(slots, student).first()
    p = 2.0 * v[1] + 1.5 * student.lexicon[0] + 0.5 * 0.6 * v[2]
    q = m.w @ p + m.b
    assert np.allclose(got.vector, q / np.linalg.norm(q), atol=1e-5) and got.exact_slots == 2


def test_ridge_recovers_a_map(spark):
    rng = np.random.default_rng(2)
    w, b = rng.normal(size=(3, 5)), rng.normal(size=3)
    x = rng.normal(size=(400, 5))
    df = spark.createDataFrame([(p.tolist(), (w @ p + b).tolist()) for p in x], "x array<double>, y array<double>")
    got_w, got_b = distill.ridge(df, share=1e-9)
    assert np.allclose(got_w, w, atol=1e-4) and np.allclose(got_b, b, atol=1e-4)


def test_distillation_gradient_and_training():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q, t, d = unit(rng.normal(size=(4, 6))), unit(rng.normal(size=(4, 6))), unit(rng.normal(size=(9, 6)))
    src = np.array([0, 1, -1, 3])
    _, g = distill.loss_and_gradient(q, t, d, src)
    for i, j in ((0, 0), (2, 3), (3, 5)):
        e = np.zeros_like(q)
        e[i, j] = 1e-6
        num = (distill.loss_and_gradient(q + e, t, d, src)[0] - distill.loss_and_gradient(q - e, t, d, src)[0]) / 2e-6
        assert abs(num - g[i, j]) < 1e-3 * max(1, abs(num))
    assert np.allclose(distill.softplus(distill.inverse_softplus(np.array([0.3, 2.0]))), [0.3, 2.0])
    vec = rng.normal(size=(20, 8)).astype(np.float32)
    true = rng.normal(size=(6, 8))
    pooled = [(rng.choice(20, 3, replace=False), np.zeros(3, bool)) for _ in range(200)]
    teacher = unit(np.stack([true @ vec[p].sum(0) for p, _ in pooled]))
    docs = unit(rng.normal(size=(30, 6)))
    src = (teacher @ docs.T).argmax(1)
    held = np.arange(200) % 10 == 0
    student = distill.train(pooled, teacher, docs, src, encoder.Student(vec), np.ones(20), held, epochs=8, seeds=(0,))
    m = student.members[0]
    got = unit(np.stack([m.w @ (m.term_scale[p, None] * vec[p]).sum(0) + m.b for p, _ in pooled]))
    assert (got[held] * teacher[held]).sum(1).mean() > 0.95


def test_student_round_trip(tmp_path):
    from quern.sources import sinks

    rng = np.random.default_rng(4)
    s = encoder.Student(rng.normal(size=(5, 4)).astype(np.float32), [encoder.Member(np.ones(5), rng.normal(size=(3, 4)), np.zeros(3))])
    sinks.write_student(s, list("abcde"), str(tmp_path))
    back, terms = sinks.read_student(str(tmp_path))
    assert terms == list("abcde") and np.allclose(back.members[0].w, s.members[0].w) and np.abs(back.vectors - s.vectors).max() < 0.02
    meta = json.loads((tmp_path / "meta.json").read_text())
    (tmp_path / "meta.json").write_text(json.dumps(meta | {"dim": 9}))
    with pytest.raises(ValueError):
        sinks.read_student(str(tmp_path))


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 0), (2, 4), (3, None), (4, 30)], "query_id long, rank long")
    r = metrics.recall_mrr(ranks).first()
    assert (r.n, r.r1, r.r5, r.r10, r.r20) == (4, 25, 50, 50, 50) and abs(r.mrr - (1 + 1 / 5 + 1 / 31) / 4) < 1e-12
    ci = metrics.bootstrap_interval(ranks.fillna(99), lambda c: 1 / (c + 1), resamples=400).first()
    assert 0 < ci.low < r.mrr < ci.high <= 1
    p = {x.q: x.value for x in metrics.floor_percentiles(spark.createDataFrame([(i,) for i in [5, 1, 1, 9, None]], "v int"), "v", [0.0, 0.5, 1.0]).collect()}
    assert p == {0.0: 1, 0.5: 1, 1.0: 9}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    mk = lambda n: [(i, rng.sample("abcdefgh", rng.randint(1, 5))) for i in range(n)]
    train, held = mk(30), mk(20)
    want = {(i, j) for i, a in train for j, b in held if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}
    df = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>")
    assert {(r.train_id, r.eval_id) for r in distill.near_duplicates(df(train), df(held)).collect()} == want


def test_lexicon(spark, tmp_path):
    words = spark.createDataFrame([("세금",), ("환율",), ("tax",)], "term string")
    lexicon.write_shards(lexicon.shards(words), str(tmp_path / "lex"))
    assert lexicon.read_shard(spark, str(tmp_path / "lex"), "환율").count() == 1
    assert lexicon.read_shard(spark, str(tmp_path / "lex")).count() == 3
    plan = lexicon.read_shard(spark, str(tmp_path / "lex"), "환율")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    p = [(r.pack, r.start) for r in lexicon.packs(spark.createDataFrame([(0, 6), (1, 5), (2, 4)], "shard int, bytes bigint"), 10).orderBy("shard").collect()]
    assert p == [(0, 0), (1, 0), (1, 5)]
    lines = spark.createDataFrame([("세금 3",), ("세금의 2",), ("tax 9",), ("나무 1",), ("",)], "value string")
    assert {(r.word, r.freq) for r in lexicon.frequency_candidates(lines).collect()} == {("세금", 5)}
    x, _ = _e(spark, 10)
    rows = spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x)], "word string, vector array<float>")
    docs = spark.createDataFrame([(v.tolist(),) for v in x[:3]], "vector array<float>")
    assert {r.word for r in lexicon.affinity(rows, docs, 0.999, block=2).collect()} == {"w0", "w1", "w2"}


def test_embedding_plug_and_pooling(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "id long, chunk_no int, passage string")
    enc = lambda texts: np.array([[1.0, 0.0] if t == "a" else [0.0, 1.0] for t in texts])
    got = {r.id: r.vector for r in index.document_vectors(index.embed(df, ["id", "chunk_no"], "passage", enc), "id").collect()}
    assert np.allclose(got[1], [2**-0.5] * 2) and np.allclose(got[2], [1, 0])


def test_quantisation_is_half_even_and_guards_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([127.0, 0.5],), ([127.0, 1.5],), ([-127.0, 2.5],)], "v array<float>")
    got = [list(r.q) for r in df.select(vectors.quantize(F.col("v"), vectors.scale_of(F.col("v"))).alias("q")).collect()]
    assert got == [[0, 0], [127, 0], [127, 2], [-127, 2]]


def test_relational_export(spark):
    articles = spark.createDataFrame([("1", "A &amp; B", "x&lt;y", "b1", "c1", "published"), ("2", "t", "c", None, None, "draft")], "id string, title string, content string, board_id string, category_id string, status string")
    dims = lambda rows: spark.createDataFrame(rows, "id string, name string, slug string")
    got = A.relational_export(
        articles, dims([("b1", "Board", "b")]), dims([("c1", "Cat", "c")]), dims([("t1", "tag", "t")]), spark.createDataFrame([("1", "t1")], "article_id string, tag_id string"),
        dims([("p1", "P", "p"), ("p2", "Q", "q")]), spark.createDataFrame([("1", "p1", 2, "author"), ("1", "p2", 1, "editor")], "article_id string, person_id string, sort_order int, role string"),
    ).collect()
    assert len(got) == 1 and got[0].title == "A & B" and got[0].content == "x<y" and got[0].board.slug == "b" and [c.name for c in got[0].contributors] == ["Q", "P"] and got[0].tags == ["tag"]


def test_json_articles_and_change_stream(spark, tmp_path):
    from quern.streaming import changes

    src = tmp_path / "in"
    src.mkdir()
    put = lambda i, t: (src / f"{i}-{t}.json").write_text(json.dumps({"id": i, "title": t}))
    put("1", "a")
    put("2", "b")
    df = A.read_json(spark, str(src))
    assert df.count() == 2 and df.where("content IS NULL").count() == 2
    meta = A.doc_meta(df.withColumn("row_id", F.monotonically_increasing_id())).collect()
    assert {r.slug for r in meta} == {"1", "2"} and all(r.created == "1970-01-01" and r.views == 0 and r.tags == [] for r in meta)
    assert changes.changed(df, ["id", "title"], str(tmp_path / "mark")) and not changes.changed(df, ["id", "title"], str(tmp_path / "mark"))
    table, check = str(tmp_path / "table"), str(tmp_path / "check")
    changes.keep_latest(changes.new_articles(spark, str(src)), table, check).awaitTermination()
    put("2", "c")
    changes.keep_latest(changes.new_articles(spark, str(src)), table, check).awaitTermination()
    now = spark.read.parquet(table)
    assert {(r.id, r.title) for r in now.collect()} == {("1", "a"), ("2", "c")}
    assert changes.changed(A.read_json(spark, str(src)), ["id", "title"], str(tmp_path / "mark"))


def test_paged_rest(spark):
    import http.server
    import threading
    import urllib.parse

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            page = int(q["page"][0])
            body = json.dumps({"totalPages": 3, "items": [{"id": page * 10 + k, "filter": q.get("filter", [""])[0]} for k in range(2)]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    from quern.sources.rest import PagedRest

    spark.dataSource.register(PagedRest)
    df = spark.read.format("paged_rest").option("url", f"http://127.0.0.1:{server.server_port}/x").option("filter", "(s='p')").load()
    got = sorted(json.loads(r.item)["id"] for r in df.collect())
    server.shutdown()
    assert got == [10, 11, 20, 21, 30, 31]


def test_sinks(spark, tmp_path):
    from quern.sources import sinks

    m = spark.createDataFrame([("dev", 3, 0.5)], "name string, n int, mrr double")
    assert "| dev | 3 | 0.500 |" in sinks.report(m, str(tmp_path / "r"))
    assert sinks.page("<script>DATA</script>", "DATA", spark.createDataFrame([("</script>",)], "x string")) == '<script>[{"x": "<\\/script>"}]</script>'
    sinks.write_records(spark.createDataFrame([("a/b", "t")], "id string, title string"), str(tmp_path / "rec"))
    assert any(re.search("file=a_b", str(p)) for p in (tmp_path / "rec").iterdir())
    x, df = _e(spark, 5)
    sinks.write_index(spark.range(1), df.withColumnRenamed("id", "row_id"), spark.range(1), spark.range(1), str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix/doc_vectors")).count() == 5
    sinks.write_graph(spark.range(2), spark.range(3), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/edges")).count() == 3


def test_materialize_cuts_lineage(spark):
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "FileScan parquet" in df._jdf.queryExecution().toString() and df.count() == 10


def test_layout_and_axes(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(20, 5)) + 6, rng.normal(size=(20, 5)) - 6])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    _, axes, share = related.principal_axes(df, 2)
    assert share[0] > 0.8 and np.allclose(axes.T @ axes, np.eye(2), atol=1e-8)
    for limit in (1000, 10):
        p = {r.id: (r.x, r.y) for r in related.layout(df, exact_rows=limit, rounds=120).collect()}
        y = np.array([p[i] for i in range(40)])
        assert np.abs(y).max() <= 1.0001
        gap = np.linalg.norm(y[:, None] - y[None], axis=2) + 9 * np.eye(40)
        assert ((gap.argmin(1) < 20) == (np.arange(40) < 20)).mean() >= 0.8  # a point's nearest is of its own cluster


def test_grid_forces_equal_the_sum_over_pairs():
    y = np.random.default_rng(7).normal(size=(700, 2)) * 12
    push, total = related._repulsion(y)
    got, near = related._repulsion_by_grid(y)
    assert abs(near / total - 1) < 1e-2 and np.linalg.norm(got - push) < 0.02 * np.linalg.norm(push)


def test_layout_keeps_neighbourhoods_beyond_the_exact_size(spark):
    rng = np.random.default_rng(8)
    centres = np.eye(12) * 10  # two axes cannot tell 12 clusters apart
    x = np.concatenate([rng.normal(size=(20, 12)) + c for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    p = {r.id: (r.x, r.y) for r in related.layout(df, exact_rows=10, perplexity=8.0, rounds=300).collect()}
    y = np.array([p[i] for i in range(240)])
    gap = np.linalg.norm(y[:, None] - y[None], axis=2) + 9 * np.eye(240)
    assert (gap.argmin(1) // 20 == np.arange(240) // 20).mean() > 0.95


def test_registered_layout_places_every_row(spark, data, monkeypatch):
    from quern.plans import catalog

    real = related.layout
    monkeypatch.setattr(related, "layout", lambda v: real(v, rounds=5))
    got = [r.id for r in catalog.layout(spark, data).collect()]
    assert sorted(got) == sorted(r.id for r in catalog._embeddings(spark, data).collect())


def test_synthesis_draws_40_windows_and_20_segments(spark):
    words = [chr(0xAC00 + 28 * i) + chr(0xB098 + 28 * (i % 90)) for i in range(400)]
    body = ". ".join(" ".join(words[i : i + 5]) for i in range(0, 400, 5))
    df = spark.createDataFrame([(1, "가나 다라", ["태그"], body)], "row_id long, title string, tags array<string>, content string")
    n = {r.kind: r["count"] for r in distill.synthesize(df).groupBy("kind").count().collect()}
    assert 30 <= n["win"] <= 40 and 12 <= n["seg"] <= 20  # equal draws meet


def test_body_text_is_whole(spark):
    from quern.functions import text as X

    df = spark.createDataFrame([("가" * 9000 + "<p>끝",)], "c string")
    whole, part = df.select(X.body_text(F.col("c")), X.body_text(F.col("c"), 8000)).first()
    assert whole == "가" * 9000 + " 끝" and part == "가" * 8000


def test_held_out_links(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(400)], "src string, dst string")
    kept, hidden = related.hold_out(edges)
    assert kept.count() + hidden.count() == 400 and 30 < hidden.count() < 90
    scores = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("a", "z", 0.95)], "src string, id string, score double")
    r = related.link_quality(scores, spark.createDataFrame([("a", "y"), ("a", "q")], "src string, dst string"), spark.createDataFrame([("a", "z")], "src string, dst string")).first()
    assert r.n == 2 and r.mrr == 0.25 and r.recall == 0.5


def test_assets(spark, tmp_path):
    import gzip

    from quern.sources import assets, sinks

    x = np.arange(-6, 6, dtype=np.int8).reshape(4, 3)
    (tmp_path / "v.bin").write_bytes(x.tobytes())
    got = {r.row_no: list(r.vector) for r in assets.read_int8(spark, str(tmp_path / "v.bin"), 3).collect()}
    assert got == {i: v.tolist() for i, v in enumerate(x)}
    scales = spark.createDataFrame([(i, 0.5) for i in range(4)], "row_no long, scale double")
    assert {r.row_no: list(r.vector) for r in assets.read_int8(spark, str(tmp_path / "v.bin"), 3, scales).collect()} == {i: (v / 2).tolist() for i, v in enumerate(x)}
    with pytest.raises(Exception):
        assets.read_int8(spark, str(tmp_path / "v.bin"), 5).count()
    np.savez(tmp_path / "e.npz", ids=np.array(["a", "b"]), vectors=np.ones((2, 3)))
    assert {(r.id, tuple(r.vector)) for r in assets.read_npz(spark, str(tmp_path / "e.npz")).collect()} == {("a", (1, 1, 1)), ("b", (1, 1, 1))}
    (tmp_path / "terms.json").write_text(json.dumps({"docs": [{"t": ["a"], "r": []}, {"t": [], "r": ["b"]}]}))
    assert [(r.row_id, r.t, r.r) for r in assets.read_terms(spark, str(tmp_path / "terms.json")).orderBy("row_id").collect()] == [(0, ["a"], []), (1, [], ["b"])]
    with gzip.open(tmp_path / "w.gz", "wt") as f:
        f.write("나무 3\n")
    assert assets.read_words(spark, str(tmp_path / "w.gz")).first().value == "나무 3"
    (tmp_path / "eval.json").write_text(json.dumps([{"text": "x", "relevant": ["1", "9"]}, {"text": "y", "relevant": ["9"]}]))
    (tmp_path / "probes.json").write_text(json.dumps(["p", "q"]))
    meta = spark.createDataFrame([("1", 7)], "id string, row_id long")
    assert [(r.query_id, r.text, r.rows) for r in assets.relevant_rows(assets.read_eval(spark, str(tmp_path / "eval.json")), meta).collect()] == [(0, "x", [7])]
    assert [r.text for r in assets.read_probes(spark, str(tmp_path / "probes.json")).orderBy("query_id").collect()] == ["p", "q"]
    docs = spark.createDataFrame([(0, "1"), (1, "2")], "place int, id string")
    assert {(r.place, r.row_id) for r in assets.student_rows(docs, meta).collect()} == {(0, 7), (1, -1)}
    nodes = spark.createDataFrame([("a", "article", "A")], "id string, type string, label string")
    edges = spark.createDataFrame([("a", "b", "knn", 0.5)], "src string, dst string, type string, weight double")
    sinks.write_graph(nodes, edges, str(tmp_path / "graph"))
    n, e = assets.read_graph(spark, str(tmp_path / "graph"))
    assert n.first().label == "A" and e.first().weight == 0.5


@pytest.mark.parametrize("least", [1, 2])
def test_containing_equals_a_loop(spark, least):
    rng = random.Random(3)
    texts = ["".join(rng.choices("가나다ab ", k=rng.randint(0, 9))) for _ in range(200)] + ["", "가"]
    needles = {"".join(rng.choices("가나다ab", k=rng.randint(least, 4))) for _ in range(40)} | {"없다"}
    got = {(r.needle, r.i) for r in keyword.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()}
    assert got == {(n, i) for n in needles for i, t in enumerate(texts) if n in t}


def test_term_matches_equal_all_pairs(spark, data):
    """No match is lost by meeting in equi joins: edits at any place, beginnings, parts, particles; golden queries among the terms."""
    from quern.functions import hangul
    from quern.plans import oracle

    words = sorted({w.strip().lower() for r in spark.read.parquet(f"{data}/doc_terms.parquet").select(F.explode(F.concat("t", "r")).alias("w")).where("w IS NOT NULL").collect() for w in [r.w] if w.strip()})
    rng = random.Random(0)
    terms = {t for _, q in oracle.QUERIES for t in [*q.lower().split(), "".join(q.lower().split())] if t} | {"나", "나라", "ab", "a"} | {x for p in oracle.PAIRS for x in p}
    for w in rng.sample(words, 60):
        ls = list(w)
        i = rng.randrange(len(ls))
        if "가" <= ls[i] <= "힣":
            ls[i] = chr(0xAC00 + (ord(ls[i]) - 0xAC00 + 28 * rng.randint(0, 3) + rng.randint(0, 2)) % 11172)
        new = "".join(ls)
        terms |= {new, new[: max(1, len(new) - rng.randint(0, 3))], new + rng.choice(["은", "이나", "합니다", "x"]), new + rng.choice(words), new[:i] + new[i + 1 :]}
    terms.discard("")
    want = {(t, w, hangul.term_score(t, w)) for t in terms for w in words if hangul.term_score(t, w)}
    df = keyword.term_matches(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w, 1) for w in words], "word string, extra int"))
    assert {(r.term, r.word, r.score) for r in df.collect()} == want and len(want) > 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") + plan.count("CartesianProduct") <= 2  # one row with the longest length, in the plan before and after it adapts


def test_golden_queries(spark):
    """The stated cases of correction, literal titles and particles."""
    titles = ["세금 인상안의 그늘", "사유재산과 자유", "혈당 이야기", "물가 환율 그리고 통화"]
    a = spark.createDataFrame([(i, f"d{i}", t, None, None, ("n", "s"), None, ["자유"], None, None, None, None, None, None) for i, t in enumerate(titles)], "row_id long, " + A.ARTICLE.replace("id string", "id string"))
    meta = A.doc_meta(a)
    terms = A.term_lists(meta).join(meta.select("row_id", "id"), "row_id")
    q = spark.createDataFrame([(1, "쎄금"), (2, "사유재솬"), (3, "세 금"), (4, "혈당은 이야기를"), (5, "세금 인상안"), (6, "  "), (7, "환율")], "query_id long, text string")
    fixed = {r.query_id: r.corrected for r in keyword.correct(q, meta, keyword.vocabulary(terms)).collect()}
    assert fixed == {1: "세금", 2: "사유재산", 3: "세금"}
    hits = {(r.query_id, r.row_id): r.score for r in keyword.keyword_search(q, meta, terms).collect()}
    assert hits[5, 0] == 1.5 and hits[7, 3] == 1.5 and hits[1, 0] == 0.7 and not any(k == 6 for k, _ in hits)


def test_query_set(spark):
    rows = [(50 * k, f"d{k}", "긴낱말하나 그리고 다른낱말둘", ["가", None, "나"]) for k in range(6)] + [(300, "x", "한낱말", []), (51, "y", "빠지는 행", None), (350, "z", "하나", None)]
    got = {r.query_id: r.text for r in benchmark.query_set(spark.createDataFrame(rows, "row_id long, id string, title string, tags array<string>")).collect()}
    assert got == {0: "긴낱말하나 그리고 다른낱말둘", 50: "긴낱말하나 다른낱말둘", 100: "긷낱말하나 다른낱말둘".replace("긷", chr(0xAC00 + (ord("긴") - 0xAC00 + 28) % 11172)), 150: "긴낱 말하나 다른낱말둘", 200: "긴낱말하나다른낱말둘", 250: "가", 300: "한낱말", 350: "하나"}


def test_gate_floor_of_fallback_queries(spark):
    sem = spark.createDataFrame([(1, 10, 0.5, 1, 0), (2, 11, 0.5, 1, 2), (3, 12, 0.7, 1, 0), (4, 13, 0.2, 1, 3)], "query_id long, row_id long, score double, rank int, exact_slots long")
    assert {r.query_id for r in fusion.gate(sem).collect()} == {2, 3}
    assert {r.query_id for r in fusion.gate(sem.drop("exact_slots")).collect()} == {1, 2, 3}
    assert {r.query_id for r in fusion.gate(sem.drop("exact_slots"), sem.select("query_id", "exact_slots")).collect()} == {2, 3}


def test_numbered_places(spark):
    from quern.runtime import exists, numbered, sweep

    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    assert sorted((r.x, r.n) for r in numbered(df, ["x"], "n").collect()) == [(i, i) for i in range(1000)]
    assert numbered(df.limit(0), ["x"], "n").count() == 0
    at = materialize(df)
    path = at.inputFiles()[0].rsplit("/", 1)[0]
    assert exists(spark, path) and sweep(spark) > 0 and not exists(spark, path)


def test_keep_latest_by_time(spark, tmp_path):
    from quern.streaming import changes

    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    put = lambda i, t, at, n: (src / f"{n}.json").write_text(json.dumps({"id": i, "title": t, "updated": at}))
    run = lambda: changes.keep_latest(changes.new_articles(spark, str(src)), table, str(tmp_path / "check"), buckets=4).awaitTermination()
    put("a", "new", "2024-02-01", 1), put("a", "older", "2024-01-01", 2), put("b", "first", None, 3), put("c", "same", "2024-01-01", 4)
    run()
    put("a", "late and old", "2023-01-01", 5), put("b", "second", "2020-01-01", 6), put("d", "only", None, 7), put("c", "same again", "2024-01-01", 8)
    run()
    assert {r.id: r.title for r in spark.read.parquet(table).collect()} == {"a": "new", "b": "second", "c": "same again", "d": "only"}


def test_training_with_lexicon_and_hidden_documents(tmp_path, spark):
    """The lexicon's weight is trained, hidden documents are no columns, every row is met once an epoch, members go to checkpoints."""
    from quern.sources import sinks

    rng = np.random.default_rng(0)
    words, lex = rng.normal(size=(30, 8)), rng.normal(size=(5, 8))
    docs = rng.normal(size=(40, 8))
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    pooled = [(np.array([i % 30, i % 5]), np.array([False, False]), np.array([False, True])) for i in range(40)]
    student = encoder.Student(words, lexicon=lex)
    hidden = np.arange(40) % 8 == 0
    distill.train(pooled, docs, docs, np.arange(40), student, np.ones(30), np.arange(40) % 5 == 0, epochs=3, batch=7, seeds=(0, 3), hidden=hidden, on_member=lambda seed, m: sinks.write_checkpoint(spark, seed, m, str(tmp_path / "ck")))
    begun = np.log(41) + 1
    assert len(student.members) == 2 and all(abs(m.ext_weight - begun) > 1e-4 for m in student.members)
    back = sinks.read_checkpoints(spark, str(tmp_path / "ck"))
    assert [s for s, _ in back] == [0, 3] and all(np.allclose(m.w, x.w) and m.ext_weight == x.ext_weight for (_, m), x in zip(back, student.members))
    slots = spark.createDataFrame([(1, 0, "core", "w", 2), (1, 1, "ext", "x", 3)], "query_id long, slot int, kind string, term string, place long")
    assert abs(np.linalg.norm(encoder.encode(slots, student).first().vector) - 1) < 1e-5


def test_distilled_student_beats_the_untrained_one(spark):
    """Held-out titles find their document higher after training."""
    from quern.plans import catalog

    d = "/root/testdata/sf0.01"
    before, _, after = catalog.distilled(spark, d, sample=800, epochs=6)
    vocabulary, docs = materialize(catalog._vocabulary(spark, d)), materialize(catalog._doc_vectors(spark, d))
    asked = catalog._articles(spark, d).where("row_id % 7 = 0").select(F.col("row_id").alias("query_id"), F.col("title").alias("text"))
    slots = materialize(encoder.slots(asked, vocabulary))
    found = []
    for s in (before, after):
        hits = encoder.search(encoder.encode(slots, s), docs.select("row_id", "vector"), k=20)
        found.append(hits.where("query_id = row_id").agg(F.sum(1 / F.col("rank"))).first()[0])
    assert found[1] > 0.9 * found[0] > 0


def test_writers_of_vectors_packs_and_places(spark, tmp_path):
    from quern.sources import assets, sinks

    x, df = _e(spark, 30)
    files = sinks.write_npz(df.repartition(3), str(tmp_path / "npz"))
    assert files.agg(F.sum("rows")).first()[0] == 30
    back = {r.id: r.vector for r in assets.read_npz(spark, str(tmp_path / "npz")).collect()}
    assert len(back) == 30 and np.allclose(back["7"], x[7])
    terms = lexicon.shards(spark.createDataFrame([(f"낱말{i}",) for i in range(300)], "term string"))
    packs = lexicon.packs(terms.groupBy("shard").agg(F.sum(F.octet_length("term")).cast("long").alias("bytes")), 500)
    for _ in range(2):
        sinks.write_packs(terms, packs, str(tmp_path / "packs"))
    assert spark.read.parquet(str(tmp_path / "packs" / "packs")).count() == 300 and spark.read.parquet(str(tmp_path / "packs" / "index")).count() == packs.count()
    sinks.write_layout(spark.createDataFrame([("a", 0.5, 1.0)], "id string, x double, y double"), str(tmp_path / "layout"))
    assert spark.read.json(str(tmp_path / "layout")).first().x == 0.5


def test_analyser_plug(spark):
    from quern.functions import text as X

    df = spark.createDataFrame([("세금은 오른다",), (None,)], "t string")
    try:
        X.plug_analyser(lambda texts: [[w[:2] for w in t.split()] for t in texts])
        assert df.select(X.extract_terms(F.col("t")).alias("x")).first().x == ["세금", "오른"]
    finally:
        X.plug_analyser(None)
    assert df.select(X.extract_terms(F.col("t")).alias("x")).first().x == ["세금", "오른다"]


def test_whole_graph_and_training_set(spark):
    a = spark.createDataFrame([("1", "가", "https://h/x/two", "one", ["t"], "c"), ("2", "나", None, "two", ["t"], "c"), ("3", "다", "https://h/x?uid=1", None, None, None)], "id string, title string, content string, slug string, tags array<string>, category string")
    a = a.selectExpr("cast(id as bigint) as row_id", "*", "cast(null as array<struct<name:string,slug:string,role:string>>) as contributors", "cast(null as struct<name:string,slug:string>) as board")
    series = spark.createDataFrame([("s", "연재", ["1", "3", "9"]), ("z", "하나", ["2"])], "id string, name string, articles array<string>")
    near = spark.createDataFrame([("1", "2", 0.9, 1), ("2", "1", 0.9, 1), ("1", "3", 0.1, 2)], "query string, id string, score double, rank int")
    nodes, edges = graph.build(a, "h", series, near)
    got = {(r.type, r.src, r.dst) for r in edges.collect()}
    assert {x for x in got if x[0] in ("links_to", "in_series", "knn")} == {("links_to", "a:1", "a:2"), ("links_to", "a:3", "a:1"), ("in_series", "a:1", "series:s"), ("in_series", "a:3", "series:s"), ("knn", "a:1", "a:2")}
    assert {r.type for r in nodes.collect()} == {"article", "tag", "category", "series"}
    titled = spark.createDataFrame([(1, "세금 인상 이야기", "물가와 환율 그리고 통화 정책", ["자유"])], "row_id long, title string, content string, tags array<string>")
    held = spark.createDataFrame([(1, "자유"), (2, "세금 인상 이야기")], "id long, text string")
    items, counts = distill.training_set(titled, [held, held.limit(1)], windows=4, pieces=2)
    texts = {r.text for r in items.collect()}
    assert "자유" not in texts and "세금 인상 이야기" not in texts and texts
    assert {r.kind: r.kept for r in counts.collect()}["tag"] == 0


def test_progressive_results_and_stale_answers(spark):
    a = spark.createDataFrame([(1, "세금 인상", []), (2, "환율 이야기", [])], "row_id long, title string, tags array<string>").selectExpr("*", "cast(row_id as string) as id", "array(named_struct('name', 'n', 'role', 'author')) as authors")
    terms = A.term_lists(a)
    q = spark.createDataFrame([(1, "세금")], "query_id long, text string")
    semantic = lambda asked: asked.select("query_id", F.lit(2).cast("long").alias("row_id"), F.lit(0.9).alias("score"), F.lit(1).alias("rank"), F.lit(1).cast("long").alias("exact_slots"))
    got = list(fusion.progressive(q, a, terms, semantic))
    assert [k for k, _ in got] == ["keyword", "fused"] and {r.row_id for r in got[1][1].collect()} == {1, 2}
    tickets = fusion.Tickets()
    run = fusion.progressive(q, a, terms, semantic, tickets)
    assert next(run)[0] == "keyword"
    tickets.take()  # a newer search
    assert next(run, None) is None


def test_poll_reads_no_file(spark, tmp_path):
    from quern.streaming import changes

    (tmp_path / "a.json").write_text("{}")
    sign, new = changes.poll(spark, str(tmp_path), None)
    assert new and changes.poll(spark, str(tmp_path), sign) == (sign, False)
    (tmp_path / "b.json").write_text("{}")
    assert changes.poll(spark, str(tmp_path), sign)[1]


def test_calibration_by_sets(spark):
    asked = spark.createDataFrame([("title", 1, False), ("title", 2, False), ("bad", 3, True), ("bad", 4, True), ("bad", 5, True)], "set string, query_id long, must_fail boolean")
    hits = spark.createDataFrame([(1, 10, 0.25, 1, 2), (2, 11, 0.9, 1, 1), (2, 12, 0.8, 2, 1), (3, 10, 0.5, 1, 0), (4, 10, 0.2, 1, 1)], "query_id long, row_id long, score double, rank int, exact_slots long")
    floors, report = metrics.calibrate(asked, hits, spark.createDataFrame([(1, 10), (2, 12)], "query_id long, row_id long"))
    assert tuple(floors.first()) == (0.245, 0.51)
    assert {tuple(r) for r in report.collect()} == {("title", 2, 0, 2, 0, 2, 0), ("bad", 3, 1, 1, 1, 0, 0)}


def test_int8_files_in_stretches(spark, tmp_path):
    from quern.sources import assets

    x = np.random.default_rng(0).integers(-127, 128, (100, 6)).astype(np.int8)
    (tmp_path / "m").mkdir()
    x[:70].tofile(tmp_path / "m" / "a.bin")
    x[70:].tofile(tmp_path / "m" / "b.bin")
    got = {(r.path[-5:], r.row_no): list(r.vector) for r in assets.read_int8(spark, str(tmp_path / "m"), 6, rows=16).collect()}
    assert got == {("a.bin" if i < 70 else "b.bin", i if i < 70 else i - 70): x[i].tolist() for i in range(100)}
    with pytest.raises(ValueError):
        assets.read_int8(spark, str(tmp_path / "m"), 7)


def test_basis_digest_and_response(spark):
    x, df = _e(spark)
    mean, axes, _ = related.principal_axes(df, 3)
    assert related.basis_digest(mean, axes) == related.basis_digest(mean.copy(), axes.copy()) != related.basis_digest(mean, axes[:, ::-1])
    a = spark.createDataFrame([(1, "세금 인상", ["세금"])], "row_id long, title string, tags array<string>").selectExpr("*", "cast(row_id as string) as id", "array(named_struct('name', 'n', 'role', 'author')) as authors")
    hits, fixed, tags = fusion.respond(spark.createDataFrame([(1, "쎄금")], "query_id long, text string"), a, A.term_lists(a))
    assert hits.first().row_id == 1 and fixed.first().corrected == "세금" and tags.first().name == "세금"
