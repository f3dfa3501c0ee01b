"""The operators on small tables: brute force, and each edge with its defined result."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chars, knn, lines, markup, neardup, packing, queries, subjects, terms, tokens, topn

ARTICLE = "row_id long, id string, title string, content string, tags array<string>, board struct<name:string,slug:string>, text string, field string, kind string, keys int, source string, n int"


def _articles(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", 1, "clash", 1) for r in rows], ARTICLE)


# 1 ----------------------------------------------------------------------------------------------


def test_fields(spark):
    df = _articles(spark, [(1, "a", "ＡＢ", "가​나", ["x", None, " y", "x"], None), (2, "b", None, None, None, None), (3, "c", "", "", [], None), (1, "a", "ＡＢ", "가​나", ["x", None, " y", "x"], None), (None, None, "λόγος", "m²", ["①"], None)])
    found = Counter((r.row_id, r.field) for r in chars.normalize_fields(df, "row_id", ["title", "content", "tags"], found=True).collect())
    assert found == {(1, "title"): 2, (1, "content"): 2, (1, "tags"): 2}
    got = {r.row_id: r for r in chars.normalize_fields(df, "row_id", ["title", "content", "tags"]).collect()}
    assert (got[1].title, got[1].content, got[1].tags) == ("AB", "가나", ["x", None, " y", "x"]) and (got[2].title, got[2].content, got[2].tags) == (None, None, None) and got[3].tags == []
    assert got[None].title == "λόγος"
    assert chars.normalize_fields(df.limit(0), "row_id", ["title"], found=True).count() == 0
    with pytest.raises(TypeError):
        chars.normalize_fields(df, "row_id", ["n"])


# 2 ----------------------------------------------------------------------------------------------


def _pairs(x, rows, k, least):
    s = x @ x.T
    out = set()
    order = np.argsort(rows)
    for i in range(len(x)):
        best = sorted((j for j in order if j != i), key=lambda j: (-round(float(s[i, j]), 5), rows[j]))[:k]
        out |= {(rows[i], rows[j]) for j in best if s[i, j] >= least}
    return out


@pytest.mark.parametrize("list_rows, tile_rows, max_lists", [(1000, 65_536, 100), (40, 65_536, 100), (40, 25, 100), (20, 65_536, 1), (10, 65_536, 2)])
def test_nearest_recall(spark, list_rows, tile_rows, max_lists):
    """One list, several, lists cut in tiles, lists divided again within their task."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.25 * rng.normal(size=(8, 16)) for c in centres])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = rng.permutation(len(x)) * 3
    bad = [(10_000, None), (10_001, [0.0] * 16), (10_002, [1.0] * 15), (10_003, [float("nan")] + [1.0] * 15), (10_004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame([(int(r), v.tolist(), 1, 2.0, "c") for r, v in zip(rows, x)] + [(r, v, 1, 2.0, "c") for r, v in bad], "row_id long, vector array<float>, row int, similarity double, list string")
    for least in (None, 0.8):
        got = {(r.row_id, r.neighbour) for r in knn.nearest(df, "row_id", "vector", 16, k=5, least=least, list_rows=list_rows, tile_rows=tile_rows, max_lists=max_lists).collect()}
        want = _pairs(x, rows.tolist(), 5, least or -2)
        assert len(got & want) / len(want) >= 0.9
        if list_rows > len(x):
            assert got == want


@pytest.mark.parametrize("list_rows", [1089, 101, 27])
def test_nearest_recall_on_the_table(spark, list_rows):
    """The ten nearest of every row whose id 50 divides, whatever the cosine, against all rows: 10, 107 and 400 lists."""
    df = spark.read.parquet("/root/testdata/sf0.1/doc_embeddings.parquet")
    got = defaultdict(set)
    for r in knn.nearest(df, "row_id", "vector", 128, k=10, list_rows=list_rows).where("row_id % 50 = 0").collect():
        got[r.row_id].add(r.neighbour)
    rows = [(r.row_id, r.vector) for r in df.collect() if r.vector and len(r.vector) == 128]
    ids, x = np.array([r for r, _ in rows]), np.array([v for _, v in rows], np.float64)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    ids, x = ids[good], x[good] / norm[good, None]
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        cut = np.sort(s)[-10] - 1e-6  # any of equal rows will do
        hit += sum(s[np.searchsorted(ids, j)] >= cut if ids[np.searchsorted(ids, j)] == j else False for j in got[ids[i]]) if (np.diff(ids) > 0).all() else sum(s[np.flatnonzero(ids == j)[0]] >= cut for j in got[ids[i]])
        total += 10
    assert hit / total >= 0.95, hit / total


def test_nearest_ties_and_copies(spark):
    v, w = [1.0, 0.0], [0.8, 0.6]
    df = spark.createDataFrame([(i, v) for i in range(8)] + [(20, w), (21, w)], "row_id long, vector array<float>")
    got = defaultdict(list)
    for r in knn.nearest(df, "row_id", "vector", 2, k=3).orderBy("row_id", "rank").collect():
        got[r.row_id].append(r.neighbour)
    assert got[0] == [1, 2, 3] and got[5] == [0, 1, 2] and got[20] == [21, 0, 1] and got[21] == [20, 0, 1]
    assert knn.nearest(df.limit(0), "row_id", "vector", 2).count() == 0
    assert knn.nearest(df.limit(1), "row_id", "vector", 2).count() == 0


# 3 ----------------------------------------------------------------------------------------------


def test_term_counts(spark):
    rng = random.Random(0)
    words = ["A ", "a", "b", "", " ", None, "hot", "hot", "HOT "]
    rows = [(f"d{rng.randint(0, 40)}", [rng.choice(words) for _ in range(rng.randint(0, 6))], None if rng.random() < 0.2 else [rng.choice(words)]) for _ in range(300)] + [(None, ["a", "only"], []), ("z", ["once", "once"], None)]
    occ, rec = Counter(), defaultdict(set)
    for d, t, r in rows:
        for w in (t or []) + (r or []):
            w = (w or "").strip().lower()
            if w:
                occ[w] += 1
                rec[w] |= {d} - {None}
    n = len({d for d, _, _ in rows} - {None})
    want = {(w, occ[w], len(rec[w]), n, "rare" if len(rec[w]) < 2 else "common" if len(rec[w]) > 0.6 * n else "kept") for w in occ}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, t array<string>, r array<string>, term string, n int")
    for salts in (1, 8):
        assert {tuple(x) for x in terms.term_frequencies(df, "id", ["t", "r"], salts=salts).collect()} == want
    assert terms.term_frequencies(df.limit(0), "id", ["t", "r"]).count() == 0


def test_term_runs_go_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(f"d{i % 7}", ["a", "a", "b" if i % 2 else "c"]) for i in range(50)], "id string, t array<string>")
        got = {r.term: (r.occurrences, r.df) for r in terms.term_frequencies(df, "id", ["t"], salts=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"a": (100, 7), "b": (25, 7), "c": (25, 7)}


# 4 ----------------------------------------------------------------------------------------------


def _groups(texts, width, least):
    sets = {i: {tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                label[root(b)] = root(a)
    out = defaultdict(set)
    for i in sets:
        out[root(i)].add(i)
    return {frozenset(x) for x in out.values() if len(x) > 1}


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    texts = {}
    for g in range(25):
        base = rng.choices(vocab, k=60)
        for c in range(rng.randint(1, 6)):
            t = base[:]
            for _ in range(rng.randint(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts[f"g{g}c{c}"] = " ".join(t)
    base = rng.choices(vocab, k=40)
    texts |= {f"hot{i}": " ".join(base if i % 2 else [*base[:-1], f"e{i}"]) for i in range(60)}  # one hot group with copies
    texts |= {"short": "a b", "empty": ""}
    df = spark.createDataFrame([(k, i, t, 1, "c") for k, (i, t) in enumerate(texts.items())], "row_id long, id string, text string, n int, key string")
    got = defaultdict(set)
    for r in neardup.groups(df, width=3, least=0.5, bands=60, rows=3).collect():
        got[r.class_id].add(r.id)
    assert {frozenset(x) for x in got.values() if len(x) > 1} == _groups(texts, 3, 0.5)
    assert neardup.groups(df.limit(0), width=3).count() == 0


def test_weighted_groups_see_repeats(spark):
    df = spark.createDataFrame([(1, "a", "x y z " * 40), (2, "b", "x y z " * 40 + "q"), (3, "c", "x y z x")], "row_id long, id string, text string")
    got = {r.id: r.class_id for r in neardup.groups(df, width=3, least=0.5, bands=40, rows=3, weighted=True).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_a_bucket_of_unlike_records_gives_few_pairs(spark):
    """Records that share a band but little else: the rarest elements tell them apart, and no like pair is lost."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join(common + [f"u{k}w{i}" for i in range(60)]) for k in range(3000)]
    like = " ".join(common + [f"v{i}" for i in range(60)])
    texts += [like, like.replace("v0 ", "w0 "), like.replace("v59", "w59")]
    df = spark.createDataFrame([(k, f"r{k}", t) for k, t in enumerate(texts)], "row_id long, id string, text string")
    table = neardup.signatures(df, 3, 4, 1, False)
    sets = table.select("row_id", "n", "elements", "weights")
    pairs = neardup.rare_pairs(df.select("row_id", F.col("row_id").alias("label")), sets, 0.5)
    assert {(r.a, r.b) for r in pairs.collect()} == {(3000, 3001), (3000, 3002), (3001, 3002)}
    got = defaultdict(set)
    for r in neardup.groups(df, width=3, least=0.5, bands=40, rows=1, most_open=8).collect():
        got[r.class_id].add(r.id)
    assert {frozenset(x) for x in got.values() if len(x) > 1} == {frozenset({"r3000", "r3001", "r3002"})}
    assert rng


def test_weighted_groups_equal_brute_force(spark):
    """Overlap of multisets: runs count as often as they stand, weights of thousands too."""
    rng = random.Random(8)
    vocab, texts = [f"w{i}" for i in range(40)], {}
    for g in range(12):
        base = [w for w in rng.sample(vocab, 6) for _ in range(rng.choice([1, 3, 40]))]
        for c in range(rng.randint(1, 4)):
            t = base + rng.choices(vocab, k=rng.randint(0, len(base) // 3))
            texts[f"g{g}c{c}"] = " ".join(t)
    texts |= {"long": "a " * 5000, "long2": "a " * 4000, "short": "a a a a"}
    bags = {k: Counter(zip(*(t.split()[i:] for i in range(2)))) for k, t in texts.items()}
    label = {k: k for k in bags}
    for a in bags:
        for b in bags:
            if a < b and (bags[a] & bags[b]).total() >= 0.6 * (bags[a] | bags[b]).total():
                old, new = label[b], label[a]
                label = {k: new if x == old else x for k, x in label.items()}
    want = defaultdict(set)
    for k, x in label.items():
        want[x].add(k)
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(texts.items())], "row_id long, id string, text string")
    for most_open in (64, 1):
        got = defaultdict(set)
        for r in neardup.groups(df, width=2, least=0.6, bands=80, rows=2, weighted=True, most_open=most_open).collect():
            got[r.class_id].add(r.id)
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_article_groups(spark):
    body = " ".join(f"낱말{i}" for i in range(40))
    rows = [(1, "a", "제목", body, None, ("n", "s")), (2, "b", "제목", "**" + body.replace("낱말3 ", "​낱말3 ") + "**", None, ("n", "s")), (3, "a", "제목", body, None, ("n", "s")), (4, "c", "제목", None, None, None), (5, "d", None, "  ", None, None), (6, "e", None, "다른 글이 여기 있다", [], None)]
    df = _articles(spark, rows)
    assert {(r.id_a, r.id_b) for r in neardup.group_pairs(neardup.article_groups(df)).collect()} == {("a", "b")}
    assert neardup.article_groups(df.limit(0)).count() == 0


# 5 ----------------------------------------------------------------------------------------------


def test_markup_tables(spark):
    df = _articles(spark, [(1, "a", None, "<p>**x**</p>", None, None), (2, "b", None, None, None, None), (3, "c", None, "", None, None), (4, "d", None, "본문 * 5 * 3", None, None), (1, "a", None, "<p>**x**</p>", None, None), (5, "e", None, "# 가\n\n나 " * 20_000, None, None)])
    got = Counter((r.row_id, r.kind) for r in markup.markup_kinds(df, "row_id", "content").collect())
    assert got == {(1, "html"): 2, (1, "markdown"): 2, (5, "markdown"): 1}
    out = {r.row_id: r for r in markup.clean_texts(df, "row_id", "content").collect()}
    assert out[1].clean_text == "x" and out[2].clean_text is None and out[2].blocks is None and out[3].clean_text == "" and out[3].blocks == [] and out[4].clean_text == "본문 * 5 * 3"
    assert markup.clean_texts(df.limit(0), "row_id", "content").count() == 0


# 6 ----------------------------------------------------------------------------------------------


def test_top_n_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hub"] * 12 + [f"g{i}" for i in range(30)]), f"i{rng.randint(0, 300)}", rng.choice([None, float("nan"), -0.5, *[round(rng.random(), 2) for _ in range(12)]])) for _ in range(4000)]
    rows += [(None, "x", 1.0), ("g1", None, 1.0), ("tie", "b", 0.5), ("tie", "a", 0.5), ("tie", "a", 0.5), ("one", "z", 0.1)]
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), -9))
    want = set()
    for g in {k[0] for k in best}:
        for n, (s, i) in enumerate(sorted(((-s, i) for (h, i), s in best.items() if h == g))[:10], 1):
            want.add((g, i, -s, n))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "src string, id string, score double, rank int, band string")
    for shares in ((0.08, 0.2, 0.45), (0.001,), ()):
        assert {tuple(r) for r in topn.top_n(df, "src", "id", "score", 10, shares=shares).collect()} == want
    assert topn.top_n(df.limit(0), "src", "id", "score").count() == 0
    assert topn.top_n(df.where("score IS NULL"), "src", "id", "score").count() == 0


# 7 ----------------------------------------------------------------------------------------------


def test_repeated_lines(spark):
    rng = random.Random(3)
    note, foot = "※ 이 글의 모든 권리는 글방에 있습니다", "조회 {} 댓글 {} 추천"
    rows, want = [], set()
    for i in range(40):
        ls = [f"본문 문장 하나 {rng.random()}" + "".join(rng.choices("가나다라마바사", k=8)) for _ in range(3)]
        if i % 3 == 0:
            ls += ["", rng.choice([note, f"<p>{note}</p>", f"*{note[2:]}*", note.replace("글방", "글​방")]), foot.format(i, i * 7)]
            want |= {(i, 5), (i, 6)}
        if i < 4:
            ls.append("네 문서에만 있는 같은 줄입니다")  # below five documents
        rows.append((i, f"d{i}", None, ("\r\n" if i % 2 else "\n").join(ls), None, ("n", "s" if i < 39 else None)))
        if i == 39 and i % 3 == 0:
            want -= {(39, 5), (39, 6)}
    rows += [(100, "d0", None, rows[0][3], None, ("n", "s")), (101, "x", None, None, None, ("n", "s")), (102, "y", None, note, None, None), (103, "d1", None, "네 문서에만 있는 같은 줄입니다", None, ("n", "s"))]
    want |= {(100, 5), (100, 6)}
    df = _articles(spark, rows)
    assert {(r.row_id, r.line_no) for r in lines.repeated_lines(df, "row_id", "id", "board.slug", "content").collect()} == want
    out = {r.row_id: r for r in lines.without_repeated(df, "row_id", "id", "board.slug", "content").collect()}
    assert out[0].removed == 2 and note not in out[0].text and out[101].text is None and out[102].text == note and out[1].removed == 0 and out[1].text == rows[1][3]
    blocks = lines.source_blocks(df, "row_id", "id", "board.slug", "content").collect()
    assert {(r.length, r.docs) for r in blocks} == {(1, 13), (2, 13)}  # the block of both lines, and the second by itself
    assert lines.repeated_lines(df.limit(0), "row_id", "id", "board.slug", "content").count() == 0


def _blocks(rows, least_docs, least_share):
    """By brute force: (source, block) to documents, for blocks in enough documents that no longer one with as many begins with."""
    docs, held = defaultdict(set), defaultdict(set)
    for doc, source, keys in rows:
        docs[source].add(doc)
        for a in range(len(keys)):
            for b in range(a + 1, len(keys) + 1):
                if 0 in keys[a:b]:
                    break
                held[source, tuple(keys[a:b])].add(doc)
    need = {s: max(least_docs, -(-len(d) * least_share // 1)) for s, d in docs.items()}
    enough = {k: len(d) for k, d in held.items() if len(d) >= need[k[0]]}
    longer = {(s, b[:-1], n) for (s, b), n in enough.items()}
    return {(s, b, n) for (s, b), n in enough.items() if (s, b, n) not in longer}


def test_blocks_equal_brute_force(spark):
    """Blocks of up to nine lines, cut short and repeated within documents, in sources of different sizes."""
    rng = random.Random(9)
    footer, rows = [f"마지막에 오는 같은 줄 번호 {c}" for c in "가나다라마바사아자"], []
    for i in range(160):
        own = [f"글마다 다른 문장 {rng.random()}" + "".join(rng.choices("가나다라마바사", k=8)) for _ in range(2)]
        a, b = sorted(rng.choices(range(10), k=2)) if i % 4 else (0, 9)
        rows.append((i, f"d{i % 150}", None, "\n".join([own[0], *footer[a:b], "", own[1], *(footer[2:4] if i % 3 == 0 else [])]), None, ("n", "s" if i % 5 else "t")))
    df = _articles(spark, rows)
    keys = [(r.id, r.source, r["keys"]) for r in lines.prepared(df, "row_id", "id", "board.slug", "content").collect()]
    got = {(r.source, tuple(r.block), r.docs) for r in lines.source_blocks(df, "row_id", "id", "board.slug", "content").collect()}
    want = _blocks(keys, 5, 0.05)
    assert got == want and max(len(b) for _, b, _ in got) == 9
    cut = {(r.source, tuple(r.block), r.docs) for r in lines.source_blocks(df, "row_id", "id", "board.slug", "content", depth=3).collect()}
    assert {x for x in want if len(x[1]) < 3} <= cut and max(len(b) for _, b, _ in cut) == 3
    covered = lambda d: {(r.row_id, r.line_no) for r in lines.repeated_lines(df, "row_id", "id", "board.slug", "content", depth=d).collect()}
    assert covered(3) == covered(256)


def test_blocks_of_the_table_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/articles.parquet").where("content IS NOT NULL AND board.slug IS NOT NULL")
    keys = [(r.id, r.source, r["keys"]) for r in lines.prepared(df, "row_id", "id", "board.slug", "content").collect()]
    got = {(r.source, tuple(r.block), r.docs) for r in lines.source_blocks(df, "row_id", "id", "board.slug", "content").collect()}
    assert got == _blocks(keys, 5, 0.05) and got


# 8, 9 -------------------------------------------------------------------------------------------


def test_ids_and_containers(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "<|endoftext|>", "같은 글", "같은 글", "글 " * 9000] + ["".join(rng.choices("가나다 abc\n", k=rng.randint(1, 900))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, size int, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df, "doc_id", "text", batch=7).collect()}
    assert got[0] == [] and got[1] == [] and len(got) == len(texts) and got[4] == got[5]
    back = {r.doc_id: r.text for r in tokens.decode_ids(tokens.encode_texts(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    sizes = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    rows = packing.containers(tokens.token_counts(df, "doc_id", "text"), "doc_id", "n_tokens", capacity=512, shard_rows=30).collect()
    total, places = Counter(), defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.n_tokens
        places[r.container].append((r.place, r.offset, r.n_tokens))
        assert r.n_tokens <= 512 and (sizes[r.doc_id] > 512 or r.piece == 0)
    assert total == {i: n for i, n in sizes.items() if n}
    for p in places.values():
        p.sort()
        at = 0
        for n, (place, offset, size) in enumerate(p):
            assert (place, offset) == (n, at)
            at += size
        assert at <= 512
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    assert packing.containers(df.limit(0), "doc_id", "size").count() == 0
    assert packing.containers(spark.createDataFrame([(None, 5), (1, None), (2, 0), (3, 5)], "doc_id long, size int"), "doc_id", "size").count() == 1


# 10 ---------------------------------------------------------------------------------------------


def test_subjects_on_labelled_documents(spark):
    """Agreement with readers' labels, which the fit does not see and of which a few are wrong."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = defaultdict(set)
    for r in queries.p10_found(spark, d).collect():
        got[r.doc_id].add(r.subject)
    label = defaultdict(set)
    for r in spark.read.parquet(f"{d}/doc_labels.parquet").collect():
        label[r.doc_id].add(r.subject.lower())
    tp = sum(len((s - {"none"}) & got[k]) for k, s in label.items())
    assert tp / sum(len(s - {"none"}) for s in label.values()) > 0.93
    assert tp / sum(len(got[k]) for k in label) > 0.93
    blank = {r.doc_id for r in docs.where("text IS NULL OR trim(text) = ''").collect()}
    assert not blank & {k for k, s in got.items() if s}


def test_subject_edges(spark):
    s = spark.createDataFrame([("one", ["나무", "same"]), ("two", ["바다", "same"]), (None, ["x"])], "subject string, cues array<string>")
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "  ", 1), (4, "...", 1)], "doc_id long, text string, terms int")
    assert subjects.subject_shares(df, "doc_id", "text", s).count() == 0
    assert subjects.subject_shares(df.limit(0), "doc_id", "text", s).count() == 0
    assert subjects.subject_shares(df, "doc_id", "text", s.limit(0)).count() == 0
    shares = spark.createDataFrame([(1, "one"), (2, "one"), (2, "two"), (3, "two")], "doc_id long, subject string")
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "doc_id long, source string")
    got = {(r.source, r.subject, r.n_docs, r.doc_share) for r in subjects.composition(shares, docs, "doc_id", "source").collect()}
    assert got == {("a", "one", 2, 1.0), ("a", "two", 1, 0.5), (None, "one", 2, 0.5), (None, "two", 2, 0.5)}


# all --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_has_its_columns(spark, data, name):
    columns = {
        "p1_found": ["row_id", "field"], "p2_found": ["row_a", "row_b"], "p3_found": ["term", "mark"], "p4_found": ["id_a", "id_b"], "p5_found": ["row_id", "kind"], "p6_found": ["src", "id"],
        "p7_found": ["row_id", "line_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "subject"],
    }
    df = queries.queries()[name](spark, data)
    assert df.columns == columns.get(name, df.columns)
    assert df.count() > 0
    if name in columns and name != "p8_ids":
        assert df.distinct().count() == df.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    df, want = queries.queries()[name](spark, data), c.sql(queries.oracle_sql()[name])
    order = [want.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_gram_product_by_rows_own_terms(spark):
    """The runs of rows cover all rows once and stay within the bound; partial matrices add up whatever the tree."""
    rng = np.random.default_rng(0)
    ends = np.concatenate([[0], np.cumsum(rng.integers(0, 50, 300))]).tolist()
    runs = list(subjects.cuts(ends, 30, 600))
    assert [r[0] for r in runs] == [0] + [r[1] for r in runs[:-1]] and runs[-1][1] == 300
    assert all(j - i == 1 or (j - i) * min(30, ends[j] - ends[i]) <= 600 for i, j in runs)
    whole = rng.normal(size=(10_000, 3))

    def part(batches):
        for _ in batches:
            pass
        yield from subjects._parts(whole)

    for n in (1, 3, 40):
        got = subjects.tree_sum(spark.range(0, 100, 1, n).mapInArrow(part, "block int, part binary"))
        assert np.allclose(got.reshape(whole.shape), n * whole)


def test_method_of_lowest_cost(spark):
    """The pure rule: each item in turn goes to the cheapest container that has room."""
    rng = random.Random(5)
    sizes = sorted((rng.randint(1, 60) for _ in range(120)), reverse=True)
    where, _ = packing.pack(np.array(sizes), 100, 1.0, 0.01, slack=100)
    used, cost = Counter(), Counter({b: 0.0 for b in range(packing.least_bins(np.array(sizes), 100))})
    for n, b in zip(sizes, where.tolist()):
        fits = [x for x in cost if used[x] + n <= 100]
        assert not fits or cost[b] == min(cost[x] for x in fits)
        used[b] += n
        cost[b] += n + 0.01 * n * n
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, size int")
    total = packing.loads(packing.containers(df, "doc_id", "size", 100, slack=100), 1.0, 0.01).collect()
    assert sum(r.n_items for r in total) == 120 and max(r.n_tokens for r in total) <= 100
