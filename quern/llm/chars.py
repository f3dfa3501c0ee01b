"""Problem 1: text that looks the same, brought to one form of characters.

Method: a longest-match transducer over grapheme clusters.  ``Transducer`` is
compiled once per Python worker: a table of transitions between states by class
of character, whose accepting states are the kinds of clusters (emoji sequences,
joined letters, words, jamo, kana with voice marks, marked characters), and a
mapping built by rule (widths, ligatures, radicals, singleton decompositions,
blanks, signs, invisible characters, look-alike letters).  Compilation checks the
mapping for conflicts: one source has one target, no target contains a source, so
one pass is final and idempotent.  The pass takes the longest cluster at each
place and writes its target; clusters of a word are remembered within a bound.

Defined results: null stays null; empty text stays empty; an array keeps its
length, order, repeats and null elements; text without stand-ins is returned
unchanged, byte for byte.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters without a rule in the Unicode tables.
DOTS = "·‧⋅・ㆍ･"  # stand in for the middle dot
HYPHENS = "‐‑−﹣"  # stand in for the hyphen
SPACES = "               ⠀　ㅤﾠ"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
# Letters of another script and the Latin letter of the same look.
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝѵӏАВЕКМНОРСТХІЅЈУԌԜԚҮЗ", "aeopcyxisjhdqwvlABEKMHOPCTXISJYGWQY3", strict=True))
GREEK = dict(zip("οϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧν", "ocjABEZHIKMNOPTYXv", strict=True))
ARMENIAN = dict(zip("օհոսցզՍՏՕԼ", "ohnugqUSOL", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎫᎬᎳᎷᎻᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTJEWMHGZWVSLCPKB", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
NUMERALS = dict(zip("ⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ", "ivxlcdmIVXLCDM", strict=True))
# Look-alikes only beside Latin letters: alone they are words of their script, or numerals.
LOOSE = dict(zip("αιρυκγ", "aipuky", strict=True)) | ARMENIAN | CHEROKEE | LISU | NUMERALS
# Forms of radicals without a rule, and the ideograph of the same look; signs and the plain sign of the same look.
RADICALS = dict(zip("⺎⺏⺐⺒⺓⺕⺘⺙⺠⺡⺢⺣⺤⺨⺩⺪⺬⺭⺯⺰⺲⺶⺹⺺⺾⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻏⻐⻑⻒⻓⻔⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻲", "兀尣尢巳幺彐扌攵民氵氺灬爫犭王疋示礻糹纟罒羊耂肀艹虎衤覀西见角讠贝车辶阝钅長镸长门青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙亀", strict=True))
SIGNS = dict(zip("∶꞉․∕⧸∣∗‚", "::.//|*,", strict=True))
CYRILLIC.pop("З")

VOICE = "\uff9e\uff9f"  # half-width marks of voiced kana
_EMOJI = "\u203c\u2049\u2122\u2139\u2190-\u21ff\u2300-\u23ff\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff"
_MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃜⃡-゙゚⃯︠-︯"


class Conflict(ValueError):
    """The mapping has two targets for a source or feeds its own output."""


def _rules() -> dict[str, str]:
    """Single characters and their targets, from rules over Unicode's tables."""
    out: dict[str, str] = {}

    def put(a: str, b: str) -> None:
        if out.setdefault(a, b) != b:
            raise Conflict(f"{a!r} has targets {out[a]!r} and {b!r}")

    for c in range(0xFF01, 0xFF5F):
        put(chr(c), chr(c - 0xFEE0))
    for c in range(0xFFE0, 0xFFE7):
        put(chr(c), {"￣": "¯"}.get(chr(c)) or ud.normalize("NFKC", chr(c)))
    for c in (*range(0xFF61, 0xFF65), *range(0xFF66, 0xFF9E)):
        put(chr(c), ud.normalize("NFKC", chr(c)))
    for a, b in zip(VOICE, "\u309b\u309c", strict=True):
        put(a, b)  # by itself; behind a kana it composes
    for c in (*range(0x2F00, 0x2FD6), 0x2E9F, 0x2EF3):
        put(chr(c), ud.normalize("NFKC", chr(c)))
    for a, b in (*RADICALS.items(), *SIGNS.items()):
        put(a, b)
    for c in range(0xFFA1, 0xFFDD):
        if (name := ud.name(chr(c), "")).startswith("HALFWIDTH HANGUL LETTER"):
            put(chr(c), ud.lookup(name.removeprefix("HALFWIDTH ")))
    for c in range(0xFB00, 0xFB07):
        put(chr(c), ud.normalize("NFKC", chr(c)))
    for c in (*range(0x80, 0x3000), *range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)):
        to = ud.normalize("NFC", chr(c))
        if len(to) == 1 and to != chr(c) and chr(c) not in DOTS + HYPHENS + SPACES:
            put(chr(c), to)
    for chars, to in ((DOTS, "·"), (HYPHENS, "-"), (SPACES, " "), (INVISIBLE, "")):
        for ch in chars:
            put(ch, to)
    return out


def _closed(table: dict[str, str]) -> dict[str, str]:
    """Targets that are sources themselves are followed; loops are conflicts."""
    out = {}
    for a, b in table.items():
        for _ in range(4):
            nxt = "".join(table.get(ch, ch) for ch in b)
            if nxt == b:
                break
            b = nxt
        else:
            raise Conflict(f"{a!r} never settles")
        out[a] = b
    return out


def _cls(chars) -> str:
    """A character class in ranges: single astral characters would be tried one by one."""
    at = sorted(map(ord, chars))
    runs = [[c, c] for c in at[:1]]
    for c in at[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in runs)


#: The transitions: from a state, by class of character, to a state.  Classes: E emoji, T skin tone, K keycap base, C keycap, V variation
#: selector, Z joiner, W non-joiner, I other invisible, L letter, M mark, S syllable, J jamo, X letters that joiners join, A kana, D voice mark, O mapped, B other.
_MOVES = """start E emoji, T emoji, K key, L word, S syl, J jamo, X join, A kana, O one, V one, Z one, I one, W one, D one, M copy, C copy, B base
emoji V emoji, T emoji, Z emoji-
emoji- E emoji, T emoji
key V key~, C cap, Z base-, I base-, W base-, M marked
key~ C cap, V base-, Z base-, I base-, W base-, M marked
word L word, M word, V word-, Z word-, I word-, W word-
word- L word, M word, V word-, Z word-, I word-, W word-
syl J jamo, M marked, V syl-, Z syl-, I syl-, W syl-
syl- J jamo, M marked, V syl-, Z syl-, I syl-, W syl-
jamo J jamo, V jamo-, Z jamo-, I jamo-, W jamo-
jamo- J jamo, V jamo-, Z jamo-, I jamo-, W jamo-
join Z join-, W join-, M marked, V base-, I base-
join- Z join-, W join-, X joined
joined Z join-, W join-
kana D voiced, M marked, V kana-, Z kana-, I kana-, W kana-
kana- D voiced, M marked, V kana-, Z kana-, I kana-, W kana-
base M marked, D marked, V base-, Z base-, I base-, W base-
base- M marked, D marked, V base-, Z base-, I base-, W base-
marked M marked, V marked-, Z marked-, I marked-, W marked-
marked- M marked, V marked-, Z marked-, I marked-, W marked-"""
#: What becomes of a cluster, by accepting state; states with a sign at the end do not accept.
_ACTS = {"emoji": "copy", "cap": "copy", "copy": "copy", "key": "copy", "syl": "copy", "join": "copy", "joined": "copy", "base": "copy", "kana": "map", "one": "map", "word": "word", "jamo": "compose", "voiced": "voice", "marked": "compose"}


class Classes(dict):
    """Character to its class; each is worked out once."""

    def __init__(self, sets: list[tuple[str, re.Pattern]]) -> None:
        self._sets = sets

    def __missing__(self, ch: str) -> str:
        k = self[ch] = next((k for k, r in self._sets if r.match(ch)), "B")
        return k


class Transducer:
    """The compiled mapping; ``apply`` is one left-to-right longest-match pass."""

    def __init__(self) -> None:
        self.table = t = _closed(_rules())
        self.likes = CYRILLIC | GREEK
        every = self.likes | LOOSE
        letter = "A-Za-zÀ-ɏͰ-ϿЀ-ԯＡ-Ｚａ-ｚﬀ-ﬆ" + _cls(LOOSE)
        voiced = [chr(c) for c in range(0x3041, 0x30FF) if len(ud.normalize("NFC", chr(c) + "\u3099")) == 1 or len(ud.normalize("NFC", chr(c) + "\u309a")) == 1]
        half = [chr(c) for c in range(0xFF66, 0xFF9E)]
        sets = [("T", "\U0001f3fb-\U0001f3ff"), ("K", "#*0-9"), ("C", "⃣"), ("V", "️"), ("Z", "\u200d"), ("W", "\u200c"), ("D", VOICE), ("M", _MARKS), ("I", _cls(INVISIBLE)), ("E", _EMOJI), ("L", letter), ("S", "가-힣"), ("J", "ᄀ-ᅞᅡ-ᇿ"), ("X", "؀-ۿऀ-෿က-႟"), ("A", _cls(voiced + half)), ("O", _cls(t))]
        self._class = Classes([(k, re.compile(f"[{x}]")) for k, x in sets])
        self._moves = {}
        for line in _MOVES.split("\n"):
            state, _, rest = line.partition(" ")
            self._moves[state] = dict(x.split() for x in rest.split(", "))
        self._hit = re.compile(f"[{_cls(t)}{_cls(every)}ᄀ-ᇿ{_MARKS}ꥠ-ꥼힰ-ퟻ]")
        self._token = re.compile("[^ \\n\\r\\t]*" + self._hit.pattern + "[^ \\n\\r\\t]*")
        self._each = str.maketrans(t)
        self._word = str.maketrans(t | every)
        self._voice = str.maketrans(t | dict(zip(VOICE, "\u3099\u309a", strict=True)))
        self._like = re.compile(f"[{_cls(every)}]")
        self._plain = re.compile("[A-Za-z]")
        self._other = re.compile(f"[Ͱ-ϿЀ-ԯ{_cls(LOOSE)}]")
        self._memo = lru_cache(1 << 16)(self._cluster)
        for a, b in t.items():
            if any(ch in t for ch in b):
                raise Conflict(f"the target of {a!r} is mapped again")
        for a, b in every.items():
            if any(ch in t or ch in every for ch in b) or a in t:
                raise Conflict(f"the look-alike {a!r} is mapped twice")
        if missing := {to for moves in self._moves.values() for to in moves.values() if to[-1] not in "-~"} - _ACTS.keys():
            raise Conflict(f"states without an outcome: {missing}")

    def _cluster(self, token: str) -> str:
        """The target of a stretch without blanks: at each place the longest cluster that the table accepts."""
        out, i, n = [], 0, len(token)
        kinds, moves = self._class, self._moves
        while i < n:
            state, j, end, act = "start", i, i + 1, "copy"
            while j < n and (state := moves[state].get(kinds[token[j]]) if state in moves else None):
                j += 1
                if state in _ACTS:
                    end, act = j, _ACTS[state]
            out.append(self._target(act, token[i:end]))
            i = end
        return "".join(out)

    def _target(self, act: str, s: str) -> str:
        if act == "copy":
            return s
        if act == "map":
            return self.table.get(s, s)
        if act != "word":
            return ud.normalize("NFC", s.translate(self._voice if act == "voice" else self._each))
        flat = ud.normalize("NFC", s.translate(self._each))
        if self._like.search(flat):
            foreign = self._other.findall(flat)
            known = self.likes | LOOSE if self._plain.search(flat) else self.likes
            if all(ch in known for ch in foreign):
                flat = ud.normalize("NFC", flat.translate(self._word))
        return flat

    def apply(self, text: str) -> str:
        if text.isascii() or not self._hit.search(text):
            return text
        memo = self._memo
        return self._token.sub(lambda m: memo(m.group()), text)


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def consistent(text: str | None) -> str | None:
    """``text`` in the one form; null stays null."""
    return None if text is None else transducer().apply(text)


def normalize_fields(df: DataFrame, key: str, fields: list[str], found: bool = False) -> DataFrame:
    """The fields of every row in one consistent form.

    ``fields`` are string or array<string> columns.  With ``found`` the result is
    one row (key, field) for each field whose stored text changes; otherwise it
    is the key and the fields.  Other columns of ``df``, whatever their names,
    take no part.  An empty table gives an empty result.
    """
    src = df.select(F.col(key), *(F.col(f) for f in fields))
    kinds = dict(src.dtypes)
    if bad := [f for f in fields if kinds[f] not in ("string", "array<string>")]:
        raise TypeError(f"neither text nor an array of texts: {bad}")
    schema = f"`{key}` {kinds[key]}, " + ("field string" if found else ", ".join(f"`{f}` {kinds[f]}" for f in fields))

    def run(batches):
        apply = transducer().apply
        for b in batches:
            keys = b.column(0)
            cols = [b.column(i + 1) for i in range(len(fields))]
            if found:
                at, names = [], []
                for f, col in zip(fields, cols, strict=True):
                    if kinds[f] == "string":
                        hit = [i for i, x in enumerate(col.to_pylist()) if x and apply(x) != x]
                    else:
                        flat, owner = col.flatten().to_pylist(), col.value_parent_indices().to_pylist()
                        hit = sorted({owner[i] for i, x in enumerate(flat) if x and apply(x) != x})
                    at += hit
                    names += [f] * len(hit)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(names, pa.string())], names=[key, "field"])
            else:
                out = [keys]
                for f, col in zip(fields, cols, strict=True):
                    one = [None if x is None else apply(x) for x in col.to_pylist()] if kinds[f] == "string" else [None if x is None else [None if y is None else apply(y) for y in x] for x in col.to_pylist()]
                    out.append(pa.array(one, pa.string() if kinds[f] == "string" else pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(out, names=[key, *fields])

    return src.mapInArrow(run, schema)
