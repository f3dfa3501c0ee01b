"""Text functions as Column builders; all stay on the JVM but ``html_unescape``.

Blank means Unicode white space here, hence ``(?U)`` in the patterns.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import hangul

BLANK = r"(?U)\s+"
HANGUL = "[가-힣]"

# The patterns of the text forms and what takes their place, in their order.
MD_IMAGE, MD_LINK, TAG = r"!\[[^\]]*\]\([^)]*\)", r"\[([^\]]*)\]\([^)]*\)", "<[^>]+>"
MD_LINE, MD_MARK = r"(?Um)^[>#*\-\s|]+", "[*_`~]{1,3}"
PARAGRAPH = r"(?:\r?\n){2,}"
BLOCK_END, REFERENCE = r"(?i)</(p|div|li|h\d)>|<br\s*/?>", "(?i)&[a-z#0-9]+;"
SQUARE, ROUND, TITLE_QUOTES = r"\[[^\]]*\]", r"\([^)]*\)", "[<>『』\"“”]"
TITLE_SIGNS = "\\[[^\\]]*\\]|\\([^)]*\\)|[·:|,ㅣ?!'\"“”‘’]"
SENTENCE_SIGNS = "[.!?\\n,;:·…\"“”'‘’()\\[\\]]"
BODY_CHARACTERS, SEGMENT_LENGTHS = 8000, (8, 40)
EPOCH = "1970-01-01"
FNV_START, FNV_PRIME = 2166136261, 16777619


def tidy(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, BLANK, " "))


def joined(c: Column) -> Column:
    """Without any blank."""
    return F.regexp_replace(c, BLANK, "")


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def clean_markdown(c: Column) -> Column:
    """Images out, links to their text, tags out, line decorations and emphasis marks out, blanks tidied, in this order."""
    return tidy(_chain(c, (MD_IMAGE, " "), (MD_LINK, "$1"), (TAG, " "), (MD_LINE, ""), (MD_MARK, "")))


def paragraphs(c: Column) -> Column:
    """Cleaned paragraphs, split at two or more line ends; empty ones left out."""
    return F.filter(F.transform(F.split(c, PARAGRAPH), clean_markdown), lambda p: p != "")


def body_text(c: Column, most: int | None = None) -> Column:
    """Plain body: block ends become line ends, other tags and references spaces; all of it, or the first ``most`` characters."""
    text = _chain(c, (MD_IMAGE, " "), (MD_LINK, "$1"), (BLOCK_END, "\n"), (TAG, " "), (REFERENCE, " "))
    return text if most is None else F.substring(text, 1, most)


def clean_title(c: Column, quotes: bool = True) -> Column:
    """Without bracketed parts and, unless told otherwise, quote signs."""
    return tidy(_chain(c, (SQUARE, " "), (ROUND, " "), *([(TITLE_QUOTES, " ")] if quotes else [])))


def has_hangul(c: Column) -> Column:
    return c.rlike(HANGUL)


def strip_particle(c: Column) -> Column:
    """At most one particle off the end, the longest, if two characters stay; only words with Hangul have any.

    Endings are looked up by length, which is far cheaper than one pattern of all.
    """
    n, out = F.length(c), c
    for size in sorted({len(p) for p in hangul.PARTICLES}):
        known = [p for p in hangul.PARTICLES if len(p) == size]
        out = F.when((n >= size + 2) & F.right(c, F.lit(size)).isin(known), F.left(c, n - size)).otherwise(out)
    return F.when(has_hangul(c), out).otherwise(c)


def words(c: Column) -> Column:
    """Lower-cased pieces between blanks, none empty."""
    return F.filter(F.split(F.lower(c), BLANK), lambda w: w != "")


_ANALYSER: list = [None]


def plug_analyser(analyse=None) -> None:
    """Takes ``analyse``, a function from a list of texts to the list of each one's terms, in place of the words without particles; None goes back.

    It runs on whole batches in the workers; every operator that extracts terms
    uses it.  Texts for which it gives None fall back to their words.
    """
    _ANALYSER[0] = analyse and F.pandas_udf(lambda s: pd.Series(analyse(s.fillna("").tolist()), index=s.index), "array<string>")


def extract_terms(c: Column) -> Column:
    """The terms of a text: the plugged analyser's, else the words without their particles."""
    plain = F.transform(words(c), strip_particle)
    return plain if _ANALYSER[0] is None else F.coalesce(_ANALYSER[0](c), plain)


def student_tokens(c: Column) -> Column:
    """array<struct<t, kind>>: words (n), words of two letters or more as they are and stripped (e), the whole (j); first kind wins."""
    w = words(c)
    as_kind = lambda kind: lambda t: F.struct(t.alias("t"), F.lit(kind).alias("kind"))
    own = F.flatten(F.transform(F.filter(w, lambda t: F.length(t) >= 2), lambda t: F.array(t, strip_particle(t))))
    every = F.concat(F.transform(w, as_kind("n")), F.transform(own, as_kind("e")), F.transform(F.filter(F.array(joined(F.lower(c))), lambda t: t != ""), as_kind("j")))
    return F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["t"]), x["t"]) == i + 1)


def bigrams(c: Column) -> Column:
    """Each two neighbours of an array joined without a space; none if it has fewer than two."""
    n = F.size(c)
    return F.when(n >= 2, F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))


def _jamo_parts(c: Column) -> Column:
    """The jamo of each character."""

    def one(ch: Column) -> Column:
        at = F.ascii(ch) - 0xAC00
        pick = lambda of, i: F.substring(F.lit(of), i.cast("int") + 1, F.lit(1))
        parts = F.concat(pick(hangul.INITIALS, F.floor(at / 588)), pick(hangul.VOWELS, F.floor(at % 588 / 28)), F.btrim(pick(hangul.FINALS, at % 28)))
        return F.when((F.length(ch) == 1) & at.between(0, 11171), parts).otherwise(ch)

    return F.transform(F.split(c, ""), one)


def to_jamo(c: Column) -> Column:
    """Syllables as compatibility jamo; all else as it is."""
    return F.array_join(_jamo_parts(c), "")


def spelled(c: Column) -> Column:
    """struct<w, j, at, h>: a word, its jamo, where each of its first n characters end in them, and whether it has Hangul.

    Made once for each word, so that pairs of words need no more than cuts.
    """
    n = F.transform(_jamo_parts(c), F.length)
    ends = F.transform(n, lambda x, i: F.aggregate(F.slice(n, F.lit(1), i + 1), F.lit(0), lambda s, y: s + y))
    return F.struct(c.alias("w"), to_jamo(c).alias("j"), ends.alias("at"), has_hangul(c).alias("h"))


def fuzzy_equal(a: Column, b: Column, ja: Column, jb: Column) -> Column:
    """Within 1 jamo, or 2 if both have four characters or more; ``ja`` and ``jb`` are their jamo."""
    short = F.least(F.length(a), F.length(b))
    budget = F.when(short >= 4, 2).otherwise(1)
    near = F.when(F.abs(F.length(ja) - F.length(jb)) <= budget, F.levenshtein(ja, jb, 2).between(0, budget)).otherwise(False)
    return (short >= 2) & has_hangul(a) & has_hangul(b) & near


def term_score(q: Column, t: Column, jq: Column | None = None, jt: Column | None = None) -> Column:
    """1, .9, .7, .65 or 0: how well a document's term ``t`` answers the query's ``q``; not symmetric."""
    jq, jt = to_jamo(q) if jq is None else jq, to_jamo(t) if jt is None else jt
    nq, nt = F.length(q), F.length(t)
    short, long = F.least(nq, nt), F.greatest(nq, nt)
    head_q, head_t = F.substring(q, F.lit(1), nt), F.substring(t, F.lit(1), nq)
    return (
        F.when(q == t, 1.0)
        .when((short >= 2) & (F.contains(t, q) | (F.contains(q, t) & (nt >= nq * 0.6))), 0.9)
        .when(fuzzy_equal(q, t, jq, jt), 0.7)
        .when((short >= 3) & (short / long >= 0.5) & (nq != nt) & fuzzy_equal(head_q, head_t, to_jamo(head_q), to_jamo(head_t)), 0.65)
        .otherwise(0.0)
    )


def spelled_score(q: Column, t: Column) -> Column:
    """``term_score`` of two ``spelled`` words."""
    w, v, nq, nt = q["w"], t["w"], F.length(q["w"]), F.length(t["w"])
    short, long = F.least(nq, nt), F.greatest(nq, nt)
    near = lambda a, b, n: F.when(F.abs(F.length(a) - F.length(b)) <= 2, F.levenshtein(a, b, 2).between(0, F.when(n >= 4, 2).otherwise(1))).otherwise(False)
    head = lambda x, n: F.substring(x["j"], F.lit(1), F.get(x["at"], n - 1))
    both = q["h"] & t["h"]
    cut = F.when(nq > nt, near(head(q, nt), t["j"], short) & has_hangul(F.substring(w, F.lit(1), nt))).otherwise(near(q["j"], head(t, nq), short) & has_hangul(F.substring(v, F.lit(1), nq)))
    return (
        F.when(w == v, 1.0)
        .when((short >= 2) & (F.contains(v, w) | (F.contains(w, v) & (nt >= nq * 0.6))), 0.9)
        .when(~both | (short < 2), 0.0)
        .when(near(q["j"], t["j"], short), 0.7)
        .when((short >= 3) & (short * 2 >= long) & (nq != nt) & cut, 0.65)
        .otherwise(0.0)
    )


def fnv1a32(c: Column) -> Column:
    """FNV-1a over UTF-16 code units, as a non-negative long."""
    units = F.transform(F.split(F.hex(F.encode(c, "UTF-16BE")), "(?<=\\G.{4})"), lambda h: F.conv(h, 16, 10).cast("long"))
    units = F.filter(units, lambda u: u.isNotNull())
    return F.aggregate(units, F.lit(FNV_START), lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(F.lit(4294967295)))


def created_date(c: Column) -> Column:
    """The first ten characters; the epoch for null or empty."""
    return F.substring(F.coalesce(F.when(c != "", c), F.lit(EPOCH)), 1, 10)


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def title_keywords(c: Column, n: int = 2) -> Column:
    """The ``n`` longest words with Hangul of two characters or more, earlier ones first among equals."""
    w = F.filter(F.split(F.regexp_replace(c, TITLE_SIGNS, " "), BLANK), lambda t: (F.length(t) >= 2) & has_hangul(t))
    placed = F.array_sort(F.transform(w, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.transform(F.slice(placed, 1, n), lambda x: x["t"])


def segments(c: Column) -> Column:
    """Pieces between sentence signs of 8 to 40 characters with two Hangul in a row; repeats once."""
    parts = F.transform(F.split(c, SENTENCE_SIGNS), tidy)
    return F.array_distinct(F.filter(parts, lambda s: F.length(s).between(*SEGMENT_LENGTHS) & s.rlike("[가-힣]{2}")))


def draw(n: Column, *of) -> Column:
    """A number from 0 to n - 1 by the MD5 of ``of``, texts or numbers, with a bar between: any engine draws the same."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in of))), 1, 12), 16, 10).cast("long"), n)


def uniform(*of) -> Column:
    """A number from 0 to 1, without 1, drawn the same way."""
    return draw(F.lit(1 << 40), *of) / float(1 << 40)


def from_code(n: Column) -> Column:
    """The character of a code below 65,536."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def inject_typo(c: Column, seed: Column) -> Column:
    """One syllable with another vowel or another initial, drawn by ``seed``; words without Hangul stay."""
    chars = F.split(c, "")
    at = F.filter(F.sequence(F.lit(1), F.size(chars)), lambda i: has_hangul(F.element_at(chars, i)))
    i = F.element_at(at, (draw(F.size(at).cast("long"), seed, 1) + 1).cast("int"))
    code = F.ascii(F.element_at(chars, i)) - 0xAC00
    lead, vowel, tail = F.floor(code / 588), F.floor(code % 588 / 28), code % 28
    other = lambda old, n, salt: (old + 1 + draw(F.lit(n - 1), seed, salt)) % n
    first = draw(F.lit(2), seed, 2) == 0
    new = from_code(F.when(first, lead).otherwise(other(lead, 19, 4)) * 588 + F.when(first, other(vowel, 21, 3)).otherwise(vowel) * 28 + tail + 0xAC00)
    return F.when(F.size(at) > 0, F.concat(F.substring(c, F.lit(1), i - 1), new, F.substring(c, i + 1, F.length(c)))).otherwise(c)


def links(c: Column, host: str) -> Column:
    """Addresses on ``host`` in a text, those of the file interface left out."""
    found = F.regexp_extract_all(c, F.lit(f"https?://{re.escape(host)}(/[^\\s)\"'<>\\]]*)"), F.lit(0))
    return F.filter(found, lambda x: ~F.contains(x, F.lit("/api/files")))


def register(spark: SparkSession) -> None:
    """The exported helpers as SQL functions."""
    for name, f, kind in (
        ("strip_particle", hangul.strip_particle, "string"),
        ("to_jamo", hangul.to_jamo, "string"),
        ("has_hangul", hangul.has_hangul, "boolean"),
    ):
        spark.udf.register(name, F.pandas_udf(lambda s, f=f: s.map(f, na_action="ignore"), kind))
    spark.udf.register("term_score", F.pandas_udf(_scores, "double"))


def _scores(q: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else hangul.term_score(a, b) for a, b in zip(q, t, strict=True)])
