"""Hangul text kernel: plain-Python twins of the column builders in ``text``.

Particles are tried longest first; at most one is stripped, and only if the word
has a Hangul syllable and keeps at least two characters.
"""

from __future__ import annotations

import re

# The particles that are stripped from the end of a word.
PARTICLES = "에서부터 으로부터 이라도 에게서 으로서 으로써 까지 부터 처럼 보다 에게 한테 께서 이나 이란 라는 든지 마다 조차 밖에 이랑 하고 은 는 이 가 을 를 과 와 도 만 의 에 로 랑 라 뿐".split()
# Compatibility jamo by place in the syllable.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"

#: Longest first, as a lazy prefix must meet the longest particle.
PARTICLE_PATTERN = "^(.{2,}?)(" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + ")$"
_PARTICLE = re.compile(PARTICLE_PATTERN, re.S)
_HANGUL = re.compile("[가-힣]")


def has_hangul(text: str) -> bool:
    return bool(_HANGUL.search(text))


def strip_particle(word: str) -> str:
    if not has_hangul(word):
        return word
    m = _PARTICLE.match(word)
    return m[1] if m else word


def to_jamo(text: str) -> str:
    out = []
    for ch in text:
        at = ord(ch) - 0xAC00
        if 0 <= at < 11172:
            lead, rest = divmod(at, 588)
            out.append(INITIALS[lead] + VOWELS[rest // 28] + FINALS[rest % 28].strip())
        else:
            out.append(ch)
    return "".join(out)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``most``; only a diagonal band is filled."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        if min(new.values()) > most:
            return False
        row = new
    return row.get(len(b), far) <= most


def fuzzy_equal(a: str, b: str) -> bool:
    short = min(len(a), len(b))
    return short >= 2 and has_hangul(a) and has_hangul(b) and within(to_jamo(a), to_jamo(b), 2 if short >= 4 else 1)


def term_score(query: str, term: str) -> float:
    """How well a document's term answers a query's: 1, .9, .7, .65 or 0; not symmetric."""
    if query == term:
        return 1.0
    q, t = len(query), len(term)
    if min(q, t) >= 2 and (query in term or term in query and t >= 0.6 * q):
        return 0.9
    if fuzzy_equal(query, term):
        return 0.7
    if min(q, t) >= 3 and min(q, t) >= 0.5 * max(q, t) and q != t and fuzzy_equal(query[:t], term[:q]):
        return 0.65
    return 0.0
