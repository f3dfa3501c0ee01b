"""The text kernels without Spark: exact cases, round trips, brute force."""

import random

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import chars, lines, markup, neardup, packing, tokens
from quern.llm.knn import CentroidGraph, _best, balanced_centroids


@pytest.mark.parametrize(
    "text, want",
    [
        ("ΑΡΙ", "API"), ("СЕО", "CEO"), ("noνel", "novel"), ("ѕсоре", "scope"), ("свобода", "свобода"), ("λόγος", "λόγος"), ("oﬃce", "office"),
        ("ｆｕｌｌ　１２！", "full 12!"), ("金利", "金利"), ("나\u00a0무\u2007잎", "나 무 잎"), ("저\u2060장\u200b소\ufeff", "저장소"), ("\u1112\u1161\u11ab글", "한글"), ("가\u11a8", "각"),
        ("nai\u0308ve\u0301", "naïvé"), ("처방‧시간⋅값ㆍ", "처방·시간·값·"), ("non‑stop", "non-stop"), ("👨\u200d👩\u200d👧 👩\u200d🔬 ❤\ufe0f 1\ufe0f\u20e3", "👨\u200d👩\u200d👧 👩\u200d🔬 ❤\ufe0f 1\ufe0f\u20e3"),
        ("m² ½ × ① Ⅲ ㈜ ㎡ ㅋㅋ “곁” ‘곁’ 『들녘』", "m² ½ × ① Ⅲ ㈜ ㎡ ㅋㅋ “곁” ‘곁’ 『들녘』"), ("a\r\nb\n", "a\r\nb\n"), ("&nbsp;", "&nbsp;"), ("", ""), ("р\u200bер", "pep"), ("क\u094d\u200dष", "क\u094d\u200dष"),
        ("ｶﾞｷﾞﾊﾟ ｱﾞ ﾞ ｶ\u200bﾞ か\u3099", "ガギパ ア\u3099 ゛ ガ が"), ("⼈⽔⺡⻓", "人水氵长"), ("seոd ꓢale Ꭱoad", "send Sale Road"), ("ꓮꓐꓚ հայ Ꭰ Ⅲ ⅼ", "ꓮꓐꓚ հայ Ꭰ Ⅲ ⅼ"), ("leveⅼ 3∶2 a․b", "level 3:2 a.b"), ("1\u0301 #\u20e3 x\u20e3", "1\u0301 #\u20e3 x\u20e3"),
    ],
)
def test_one_form(text, want):
    assert chars.consistent(text) == want


def test_mapping_is_conflict_checked_and_final():
    t = chars.Transducer()
    assert not any(ch in t.table for to in t.table.values() for ch in to)
    table = {"a": "b", "b": "a"}
    with pytest.raises(chars.Conflict):
        chars._closed(table)


@settings(max_examples=300, deadline=None)
@given(st.text("aрсе가한\u1100\u1161\u11a8\u200b\u00a0　ｆＡ👩\u200d🔬é\u0301 \n·‧", max_size=30))
def test_one_pass_is_final(text):
    once = chars.consistent(text)
    assert chars.consistent(once) == once


def test_null_and_long_texts():
    assert chars.consistent(None) is None
    assert chars.consistent("가\u200b" * 200_000) == "가" * 200_000


@pytest.mark.parametrize(
    "text, kinds, clean",
    [
        ("<p>가 <b>나</b></p>", ["html"], "가 나"), ("가&nbsp;나 &amp; 다", ["html"], "가 나 & 다"), ("<!-- x -->가", ["html"], "가"), ("## 제목", ["markdown"], "제목"), ("제목\n=====", ["markdown"], "제목\n"),
        ("**굵게** 가", ["markdown"], "굵게 가"), ("*한 줄*", ["markdown"], "한 줄"), ("[글](/x/1) 가", ["markdown"], "글 가"), ("> 인용", ["markdown"], "인용"), ("`x` ~~y~~ __z__", ["markdown"], "x y z"),
        ("```\n<b>x</b>\n```", ["markdown"], "\n<b>x</b>\n"), ("| 가 | 1 |\n|---|---|\n| 나 | 2 |", ["markdown"], "가 | 1\n\n나 | 2"), ("== 제목 ==", ["wiki"], "제목"), ("'''가''' ''나''", ["wiki"], "가 나"),
        ("[[가|나]] [[다]]", ["wiki"], "나 다"), ("[https://a.example/1 글]", ["wiki"], "글"), ("{{인용|가}}", ["wiki"], "가"), ("{|\n|-\n| 가 || 1\n|}", ["wiki"], "\n\n가 | 1\n"), ("\\emph{가 \\textbf{나}}", ["latex"], "가 나"),
        ("가~\\cite{r1} 나", ["latex"], "가 나"), ("$x^2 + 1$", ["latex"], "x^2 + 1"), ("\\section{가}\n\\item 나", ["latex"], "가\n- 나"), ("**가** <b>나</b>", ["html", "markdown"], "가 나"),
        *[(x, [], x) for x in ("<주의> 가", "Q&A 시간", "low_rate_case", "값은 $30 안팎", "50% 안팎", "x == y", "[1] 앞", "C:\\자료", "~라고", "#1 순위", "#하루글", "* 가\n* 나", "- 가", "1. 가", "5 * 3 * 2", "a < b 이고 b > c", "x^2", "")],
    ],
)
def test_markup(text, kinds, clean):
    assert markup.kinds(text) == kinds
    assert markup.clean(text) == clean


def test_markup_keeps_lines_and_structure():
    text = "# 가\r\n\r\n* 나\r\n* 다\r\n\r\n> 인용\r\n\r\n```py\r\nx = 1\r\n  y\r\n```\r\n\r\n\\[ a = b \\]\n\n본문 **굵게**\n둘째"
    assert markup.clean(text).count("\n") == text.count("\n")
    assert markup.blocks(text) == [("heading1", "가"), ("list", "* 나"), ("list", "* 다"), ("quote", "인용"), ("code", "x = 1\n  y"), ("formula", "a = b"), ("paragraph", "본문 굵게\n둘째")]
    assert markup.blocks(None) is None and markup.blocks("") == [] and markup.clean(None) is None


def test_markup_on_held_out_pages():
    """Accuracy of the tree model on labelled pages of another seed."""
    right = total = 0
    for text, marked in markup.labelled_pages(200, seed=99):
        for k in markup.KINDS:
            total += 1
            right += (k in markup.kinds(text)) == bool(marked[k])
    assert right / total > 0.98


def test_markup_marginals_are_exact():
    """Sum-product equals the sum over all states of small trees: paragraphs, elements, nested candidates."""
    import itertools

    m = markup.model()
    for text in ("**가** #나 <b>*다*</b>", "<div>\n$x$ <주의>\n\n</div> ~라", "| **가** | ''나'' |\n|---|---|"):
        nodes = markup.parse(text)
        bins = markup._tree(nodes, text)
        shift = 1 + len(bins)
        parents = [0] * shift + [n.parent for n in nodes]
        assert 3 <= len(nodes) <= 8 and all(p < i for i, p in enumerate(parents) if i)
        total, hits = 0.0, np.zeros(len(nodes))
        for y in itertools.product((0, 1), repeat=shift + len(nodes)):
            p = m.doc[y[0]]
            for i in range(1, len(y)):
                if i < shift:
                    p *= m.moves["block"][y[0]][y[i]] * m.blocks[bins[i - 1]][y[i]]
                else:
                    n = nodes[i - shift]
                    p *= m.moves[m._relation(nodes, n, shift)][y[parents[i]]][y[i]] * m.emission(n)[y[i]]
            total += p
            hits += p * np.array(y[shift:])
        assert np.allclose(m.marginals(nodes, bins), hits / total, atol=1e-9)


def test_markup_tree():
    """Elements hold what stands between their tags, cells and emphasis what stands in them; a stray end tag opens nothing."""
    text = "<ul>\n<li>*가*</li>\n</ul>\n\n</p>\n\n**굵은 [글](/x) 끝**"
    nodes = markup.parse(text)
    shift = 1 + len(markup._tree(nodes, text))
    up = {(n.sign, n.name): nodes[n.parent - shift].name or nodes[n.parent - shift].sign if n.parent >= shift else n.parent for n in nodes}
    assert up == {("<", "ul"): 1, ("<", "li"): "ul", ("*", None): "li", ("<", "/li"): "li", ("<", "/ul"): "ul", ("<", "/p"): 2, ("**", None): 3, ("[", None): "**"}


def test_the_model_decides():
    """Candidates that the grammar proposes and the model turns down, by pages written by hand; with other labels it turns round."""
    text = "<주의> #1 순위, 5 * 3 * 2, $30 안팎, low_rate_case, ~라고, \\자료, x == y, Q&A\n\n**굵게** <b>가</b> $x^2$ \\emph{나} [[다]]"
    nodes, p = markup.judged(text)
    down = [n.sign for n, x in zip(nodes, p) if x <= 0.5]
    assert len(down) >= 8 and {n.kind for n, x in zip(nodes, p) if x > 0.5} == set(markup.KINDS)
    assert markup.clean(text) == text.split("\n\n")[0] + "\n\n굵게 가 x^2 나 다"
    pages = markup.labelled_pages
    try:
        markup.labelled_pages = lambda: ((t, {**dict.fromkeys(markup.KINDS, set()), "markdown": {n.a for n in markup.parse(t) if n.kind == "markdown"}}) for t, _ in pages())
        other = markup.TreeModel()
    finally:
        markup.labelled_pages = pages
    bins = markup._tree(nodes, text)
    assert {n.kind for n, x in zip(nodes, other.marginals(nodes, bins)) if x > 0.5} == {"markdown"}


@pytest.mark.parametrize("lines_", [5, 25, 200])
def test_long_formulas(lines_):
    body = "\n".join(f"x_{i} = {i} + y" for i in range(lines_))
    for text in (f"앞\n\\[\n{body}\n\\]\n뒤", f"앞\n$$\n{body}\n$$\n뒤", f"앞 ${body.replace(chr(10), ' ')}$ 뒤", f"\\begin{{equation}}\n{body}\n\\end{{equation}}"):
        assert markup.kinds(text) == ["latex"]
        assert body.replace("\n", " ") in markup.clean(text).replace("\n", " ") and markup.clean(text).count("\n") == text.count("\n")
    assert markup.kinds("\\[ a\n\nb \\]") == []
    assert markup.clean("값 \\frac{a}{b} 와 \\alpha") == "값 \\frac{a}{b} 와 \\alpha" and markup.kinds("\\frac{a}{b}") == ["latex"]
    assert markup.clean("{{lang|en|hello}} {{x}}") == "en hello "


def test_markup_is_linear_on_bad_input():
    import time

    for bad in ("*", "[", "<", "{{", "\\[", "`", "| ", "_a", "<!--", "$", "$$ ", "<b>", "</b>", "<pre>", "\\begin{equation}", "```\n", "\n\n", "''", "**a", "&", "\\emph{", "~"):
        took = []
        for n in (4_000, 32_000):
            text = bad * (n // len(bad))
            began = time.perf_counter()
            markup.clean(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 30 * max(took[0], 0.02), bad


def test_line_keys():
    a, b, c, d, e = lines.line_keys("※ 조회 12 댓글 3 추천\n[조회 4  댓글 56 추천]\n짧은 줄\n\n* 조회 1 댓글 2 추천 *")
    assert a == b == e != 0 and c == d == 0
    assert lines.line_keys("") == [0]
    assert lines.line_keys("Aa bb cc dd\nAA BB CC DD")[0] == lines.line_keys("aa bb cc dd")[0]


def test_bag_minhash_is_unbiased():
    """Agreement of signatures is near the weighted Jaccard similarity."""
    rng = np.random.default_rng(0)
    for weighted in (False, True):
        el = np.arange(120, dtype=np.uint64)
        wa, wb = (rng.integers(0, 4, 120) if weighted else rng.integers(0, 2, 120) for _ in range(2))
        owner = np.concatenate([np.zeros((wa > 0).sum(), int), np.ones((wb > 0).sum(), int)])
        sig = neardup.bag_minhash(owner, np.concatenate([el[wa > 0], el[wb > 0]]), np.concatenate([wa[wa > 0], wb[wb > 0]]), 2, 4096)
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (neardup.bag_minhash(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 1, 8) == neardup.bag_minhash(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 1, 8)).all()


def test_bag_minhash_cost_does_not_follow_the_weights():
    """A weight of a million has twenty levels, and signatures still agree as the weighted similarity says."""
    owner = np.concatenate([np.zeros(40, int), np.ones(40, int)])
    el = np.tile(np.arange(40, dtype=np.uint64), 2)
    weight = np.concatenate([np.full(40, 1_000_000), np.full(40, 700_000)])
    own, _, size, below = neardup.levels(owner, el, weight, 1)
    assert len(own) <= 21 * 80
    assert np.bincount(own, below).tolist() == [40_000_000, 28_000_000] and (below <= size).all()
    sig = neardup.bag_minhash(owner, el, weight, 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.7) < 0.05


def test_intervals_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        suffixes = sorted({(1, *rng.choices([1, 2, 3], k=rng.randint(0, 5))) for _ in range(rng.randint(1, 12))})
        rng.shuffle(suffixes)
        docs, need, held = [rng.randint(1, 4) for _ in suffixes], rng.randint(1, 8), {}
        for x, d in zip(suffixes, docs):
            for k in range(1, len(x) + 1):
                held[x[:k]] = held.get(x[:k], 0) + d
        longer = {(x[:-1], n) for x, n in held.items()}
        got = [(tuple(x), n) for x, n in lines.intervals([list(x) for x in suffixes], docs, need)]
        assert sorted(got) == sorted((x, n) for x, n in held.items() if n >= need and (x, n) not in longer)


def test_shingles():
    own, el, w = neardup.shingles(["a b c d", "a b", "", "a b c d", "x y z x y z"], 3, weighted=True)
    assert [(own == i).sum() for i in range(5)] == [2, 0, 0, 2, 3]
    assert (el[own == 0] == el[own == 3]).all() and w[own == 4].tolist().count(2) == 1


def _tokenizer():
    t = tokenizers.Tokenizer.from_file(f"{tokens.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_tokens_equal_the_library_and_round_trip():
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "'s", "1", "²", "Ⅲ", "é", "한", "글", "!", "_", "...", "\t", "\x85", "\x1c", "　", "👩\u200d🔬", "'ll", "<|endoftext|>", "e\u0301", "\u00a0", "中"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, n))) for n in [12] * 400 + [20_000] * 6] + [" " * 9000, "a" * 9000, " a" * 6000, "\n" * 5000 + "x", "", "한국어 문장 " * 3000]
    texts += ["".join(rng.choices(some, k=rng.randint(200, 3000))) for some in ("ab", "ton the".replace(" ", ""), "가나다", "  \n", "!'", "'s", "12", " a", "é한a") for _ in range(12)]  # no sure boundary for long
    library = _tokenizer().encode_batch(texts, add_special_tokens=False)
    for leaf, near in ((tokens.LEAF, 128), (1, 1), (2, 3), (7, 5), (40, 8)):  # a seam at almost every character
        e = tokens.Encoder(tokens.vocabulary(), leaf=leaf, near=near)
        ids, ends = e.encode([None, *texts])
        assert ends[1] == 0
        for i, (t, want) in enumerate(zip(texts, library), 1):
            got = ids[ends[i] : ends[i + 1]].tolist()
            assert got == want.ids
            assert e.decode(got) == t
        assert e.sizes([None, *texts]).tolist() == np.diff(ends).tolist()


def test_tokens_memory_is_bounded():
    e = tokens.Encoder(tokens.vocabulary(), most=50)
    for i in range(20):
        ids, _ = e.encode([f"w{i}x{j}" for j in range(30)])
        assert len(e) <= 50 and e.decode(ids.tolist()) == "".join(f"w{i}x{j}" for j in range(30))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_is_valid_and_tight(sizes):
    s = -np.sort(-np.array(sizes, np.int64))
    where, offset = packing.pack(s, 64)
    if len(s):
        assert np.bincount(where, weights=s).max() <= 64
        for b in np.unique(where):
            o = np.sort(offset[where == b])
            assert o[0] == 0 and len(set(o.tolist())) == len(o)
    used = len(set(where.tolist()))
    low = packing.least_bins(s, 64)
    assert low <= used <= max(low + 2, int(1.35 * low))


@pytest.mark.parametrize("lists", [1, 2, 10, 100, 600, 3000])
def test_centroid_graph_finds_what_a_scan_finds(lists):
    """The graph is searched at every number of centroids, the same way."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 6000)] + 0.4 * rng.normal(size=(6000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = balanced_centroids(x, lists)
    assert len(c) == lists
    q = x[:300]
    at, cos = CentroidGraph(c).search(q, 4)
    best = (q @ c.T).argmax(1)
    assert (at[:, 0] == best).mean() > 0.9 and (np.diff(cos, axis=1) <= 1e-6).all() and at.shape == (300, min(4, lists))
    assert all(len(set(r)) == len(r) for r in at.tolist())


def test_centroid_graph_memory():
    """A slice of a search needs few tens of megabytes, whatever the number of centroids."""
    import tracemalloc

    rng = np.random.default_rng(0)
    c = rng.normal(size=(16_384, 128)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    graph = CentroidGraph(c, links=rng.integers(0, len(c), (len(c), 24)).astype(np.int32))
    tracemalloc.start()
    graph.search(c[:2048], 8)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_best_breaks_ties_by_row():
    x = np.ones((4, 2), np.float32)
    r, o, _ = _best(np.array([5, 3, 9, 1]), x, np.array([5, 3, 9, 1]), x, 2, None)
    assert sorted(zip(r.tolist(), o.tolist())) == [(1, 3), (1, 5), (3, 1), (3, 5), (5, 1), (5, 3), (9, 1), (9, 3)]
