import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import hangul as H


@pytest.mark.parametrize(
    "query, term, score",
    [("세금", "세금", 1.0), ("세금", "세금인상", 0.9), ("쎄금", "세금", 0.7), ("tax", "tale", 0.0), ("인플레이숀의", "인플레이션", 0.65), ("쎄금인", "세금인상", 0.65), ("나", "나라", 0.0), ("", "", 1.0)],
)
def test_term_score(query, term, score):
    assert H.term_score(query, term) == score


@pytest.mark.parametrize("word, stem", [("세금의", "세금"), ("나는", "나는"), ("학교에서부터", "학교"), ("tax", "tax"), ("", "")])
def test_strip_particle(word, stem):
    assert H.strip_particle(word) == stem


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 3))
def test_within_is_the_edit_distance(a, b, most):
    assert H.within(a, b, most) == (levenshtein(a, b) <= most)


def test_spelled_words_score_alike(spark):
    from pyspark.sql import functions as F

    from quern.functions import text as X

    words = ["세금", "쎄금", "세금인상", "tax", "taxes", "인플레이숀의", "인플레이션", "ai시대", "ai시대에서", "", "나는", "사유재솬", "사유재산", "값😀", "교육과정에서부터", "교욱과정", "a가나다", "가나다라마바", "abc가"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "q string, t string")
    for r in df.select("q", "t", X.spelled_score(X.spelled(F.col("q")), X.spelled(F.col("t"))).alias("s")).collect():
        assert r.s == H.term_score(r.q, r.t), (r.q, r.t)


def test_columns_equal_their_twins(spark):
    from pyspark.sql import functions as F

    from quern.functions import text as X

    words = ["세금", "쎄금", "세금인상", "tax", "인플레이숀의", "인플레이션", "ai시대", "", "나는", "사유재솬", "사유재산", "값😀", "교육과정에서부터"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "q string, t string")
    for r in df.select("q", "t", X.term_score(F.col("q"), F.col("t")).alias("s"), X.to_jamo(F.col("q")).alias("j"), X.strip_particle(F.col("q")).alias("p")).collect():
        assert (r.s, r.j, r.p) == (H.term_score(r.q, r.t), H.to_jamo(r.q), H.strip_particle(r.q)), (r.q, r.t)


def test_fnv_over_code_units(spark):
    from pyspark.sql import functions as F

    from quern.functions import text as X

    def twin(s):
        h, raw = 2166136261, s.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619 & 0xFFFFFFFF
        return h

    words = ["세금", "a", "", "값😀x"]
    got = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.fnv1a32(F.col("w")).alias("h")).collect()}
    assert got == {w: twin(w) for w in words}
    assert got["세금"] == 3381895261


def test_unicode_blanks_and_tokens(spark):
    from pyspark.sql import functions as F

    from quern.functions import text as X

    r = spark.createDataFrame([("  나무 의  세금의　세금 ",)], "x string").select(X.words(F.col("x")).alias("w"), X.student_tokens(F.col("x")).alias("s"), X.tidy(F.col("x")).alias("t")).first()
    assert r.w == ["나무", "의", "세금의", "세금"]
    assert [(x.t, x.kind) for x in r.s] == [("나무", "n"), ("의", "n"), ("세금의", "n"), ("세금", "n"), ("나무의세금의세금", "j")]
    assert r.t == "나무 의 세금의 세금"


def test_typo_changes_one_syllable(spark):
    from pyspark.sql import functions as F

    from quern.functions import text as X

    df = spark.createDataFrame([(w, i) for w in ("세금인상", "tax", "가") for i in range(20)], "w string, i int")
    for r in df.select("w", X.inject_typo(F.col("w"), F.col("i")).alias("t")).collect():
        if r.w == "tax":
            assert r.t == "tax"
        else:
            assert len(r.t) == len(r.w) and sum(a != b for a, b in zip(r.t, r.w)) == 1
            assert levenshtein(H.to_jamo(r.t), H.to_jamo(r.w)) == 1
