"""The SQL of each query, for DuckDB over the same tables."""

from __future__ import annotations

from quern.functions import hangul

QUERIES = [
    (1, "세금 인상"), (2, "쎄금"), (3, "물가와 환율"), (4, "봉건제·통화"), (5, "독립 출판"), (6, "혈당"), (7, "통 화"), (8, "논술의 재산권은"), (9, "API 시험"),
    (10, "환겅"), (11, "다시읽기"), (12, "글방칼럼 기업가"), (13, "climate"), (14, "사유재솬"), (15, "  "), (16, "형이상하"), (17, "왜 혈당은 교육과정을"),
]
PAIRS = [("세금", "세금"), ("세금", "세금인상"), ("쎄금", "세금"), ("tax", "tale"), ("인플레이숀의", "인플레이션"), ("쎄금인", "세금인상"), ("사유재솬", "사유재산"), ("세금의", "세금"), ("나", "나"), ("나", "나라"), ("자유", "사유재산"), ("환겅", "환경"), ("교육과정", "교육"), ("교욱과정", "교육과정표")]

#: White space as the JVM and Python see it, for RE2.
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WS_IN = _WS[1:-1]
_JAMO_CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$%&()*+,-./:;<=>?@[\\]^_`"  # one byte for each jamo: levenshtein counts bytes


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") AS v({names})"


def words(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), {_q(_WS + '+')}), lambda w: w <> '')"


def strip(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[가-힣]') THEN regexp_replace({c}, {_q('(?s)' + hangul.PARTICLE_PATTERN)}, '\\1') ELSE {c} END"


def tidy(c: str) -> str:
    return f"trim(regexp_replace({c}, {_q(_WS + '+')}, ' ', 'g'), ' ')"


def joined(c: str) -> str:
    return f"regexp_replace({c}, {_q(_WS + '+')}, '', 'g')"


def chain(c: str, *steps: tuple[str, str]) -> str:
    for a, b in steps:
        c = f"regexp_replace({c}, {_q(a)}, {_q(b)}, 'g')"
    return c


def jamo(c: str, codes: bool = False) -> str:
    every = dict.fromkeys(hangul.INITIALS + hangul.VOWELS + hangul.FINALS.strip())
    to = dict(zip(every, _JAMO_CODES, strict=False)) if codes else {x: x for x in every}
    lists = ["[" + ", ".join(_q(to.get(x, "")) for x in s) + "]" for s in (hangul.INITIALS, hangul.VOWELS, hangul.FINALS)]
    at = "(unicode(ch) - 44032)"
    wide = "WHEN unicode(ch) > 127 THEN chr((1 + unicode(ch) % 31)::INT) " if codes else ""
    one = f"CASE WHEN unicode(ch) BETWEEN 44032 AND 55203 THEN {lists[0]}[{at} // 588 + 1] || {lists[1]}[{at} % 588 // 28 + 1] || {lists[2]}[{at} % 28 + 1] {wide}ELSE ch END"
    return f"array_to_string(list_transform(string_split({c}, ''), lambda ch: {one}), '')"


def _near(a: str, b: str) -> str:
    short = f"least(length({a}), length({b}))"
    return f"({short} >= 2 AND regexp_matches({a}, '[가-힣]') AND regexp_matches({b}, '[가-힣]') AND levenshtein({jamo(a, True)}, {jamo(b, True)}) <= CASE WHEN {short} >= 4 THEN 2 ELSE 1 END)"


def score(q: str, t: str) -> str:
    nq, nt = f"length({q})", f"length({t})"
    short, long = f"least({nq}, {nt})", f"greatest({nq}, {nt})"
    hq, ht = f"left({q}, {nt})", f"left({t}, {nq})"
    return f"""CASE WHEN {q} = {t} THEN 1.0 WHEN {short} >= 2 AND (contains({t}, {q}) OR (contains({q}, {t}) AND {nt} >= {nq} * 0.6)) THEN 0.9
 WHEN {_near(q, t)} THEN 0.7 WHEN {short} >= 3 AND {short} / {long} >= 0.5 AND {nq} <> {nt} AND {_near(hq, ht)} THEN 0.65 ELSE 0.0 END"""


_A = "a AS (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1)"
_TERM = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: lower(trim(x, ' '))), lambda x: x IS NOT NULL AND x <> '')"
_T = f"t AS (SELECT row_id, {_TERM('t')} AS t, {_TERM('r')} AS r FROM doc_terms WHERE row_id IN (SELECT row_id FROM a))"
_KEYS = f"regexp_replace(title, {_q(chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']|' + chr(92) + '([^)]*' + chr(92) + ')|[·:|,ㅣ?!' + chr(39) + chr(34) + '“”‘’]')}, ' ', 'g')"
_KEYS = f"list_filter(string_split_regex({_KEYS}, {_q(_WS + '+')}), lambda w: length(w) >= 2 AND regexp_matches(w, '[가-힣]'))"
_TOP2 = "list_transform(list_sort(list_transform(k, lambda w, i: {'n': -length(w), 'i': i, 'w': w}))[1:2], lambda x: x.w)"
_HALF = "greatest(length(k[1]) // 2, 1)"
_QUERIES = f"""qs AS (SELECT row_id AS query_id, coalesce(CASE WHEN v = 5 THEN nullif(array_to_string(tags[1:2], ' '), '') WHEN v > 0 AND len(k) = 2 THEN CASE v WHEN 1 THEN k[1] || ' ' || k[2]
 WHEN 2 THEN CASE WHEN unicode(k[1]) BETWEEN 44032 AND 55203 THEN chr(44032 + (unicode(k[1]) - 44032 + 28) % 11172) || substr(k[1], 2) ELSE k[1] END || ' ' || k[2]
 WHEN 3 THEN left(k[1], {_HALF}) || ' ' || substr(k[1], {_HALF} + 1) || ' ' || k[2] ELSE k[1] || k[2] END END, title, '') AS text
 FROM (SELECT row_id, title, tags, row_id // 50 % 6 AS v, {_TOP2} AS k FROM (SELECT row_id, title, tags, {_KEYS} AS k FROM articles WHERE row_id % 50 = 0)))"""
_QS = f"{_QUERIES}, q AS (SELECT query_id, text, {words('text')} AS raw, list_transform({words('text')}, lambda w: {strip('w')}) AS nouns, {joined('lower(text)')} AS whole FROM qs)"
_I = """i AS (SELECT query_id, 0 AS interp, nouns AS terms FROM q WHERE len(nouns) > 0 AND NOT (len(raw) = 1 AND length(array_to_string(nouns, '')) < 0.7 * length(whole))
 UNION ALL SELECT query_id, 1, raw FROM q WHERE len(raw) > 0 UNION ALL SELECT query_id, 2, [whole] FROM q WHERE len(raw) > 1 AND length(whole) >= 2)"""
_W = "w AS (SELECT query_id, interp, len(terms) AS n, unnest(terms) AS term, generate_subscripts(terms, 1) AS no FROM i)"
_P = "p AS (SELECT query_id, array_to_string(raw, ' ') AS phrase, raw, whole FROM q)"
_LIT = "lit AS (SELECT query_id, row_id FROM a JOIN p ON length(phrase) >= 2 AND contains(lower(title), phrase))"
_SEARCH = f"""SELECT query_id, row_id, round(score, 6) AS score, rank FROM (SELECT query_id, row_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, row_id) AS rank
 FROM (SELECT query_id, row_id, sum(best) / (2 * n) AS score FROM hit GROUP BY query_id, interp, row_id, n HAVING count(*) = n UNION ALL SELECT query_id, row_id, 1.5 FROM lit) GROUP BY query_id, row_id) WHERE rank <= 20"""
_POST = "post AS (SELECT unnest(t) AS word, row_id, true AS in_title FROM t UNION SELECT unnest(r), row_id, false FROM t)"
_M = f"m AS (SELECT term, word, score FROM (SELECT term, word, {score('term', 'word')} AS score FROM (SELECT DISTINCT term FROM w), (SELECT DISTINCT word FROM post)) WHERE score > 0)"
_HIT = """best AS (SELECT term, row_id, coalesce(max(CASE WHEN in_title THEN score * 2 END), max(CASE WHEN NOT in_title THEN score END)) AS best FROM post JOIN m USING (word) GROUP BY term, row_id),
hit AS (SELECT query_id, interp, row_id, n, best FROM best JOIN w USING (term))"""
_REST = "lower(concat_ws(' ', array_to_string(coalesce(tags, []), ' '), array_to_string(list_transform(coalesce(contributors, []), lambda c: coalesce(c.name, '')), ' ')))"
_VOC = """voc AS (SELECT word, min(place) AS place FROM (
 SELECT unnest(list_concat(t, r)) AS word, {'k': 0, 'row_id': row_id, 'at': generate_subscripts(list_concat(t, r), 1) - 1} AS place FROM t
 UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda k: t[k] || t[k + 1])), {'k': 1, 'row_id': row_id, 'at': generate_subscripts(range(1, len(t)), 1) - 1} FROM t WHERE len(t) > 1) GROUP BY word)"""
_MD = ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"))
_BODY = chain("content", *_MD, (r"(?i)</(p|div|li|h\d)>|<br[\t-\r ]*/?>", "\n"), ("<[^>]+>", " "), ("(?i)&[a-z#0-9]+;", " "))
_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS v, label FROM embeddings)"
_SIM = "s AS (SELECT a.id AS query, b.id AS id, a.label AS la, b.label AS lb, array_inner_product(a.v, b.v) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0)"
_WHO = "coalesce(nullif(c.slug, ''), c.name)"
_EDGES = f"""raw AS (SELECT 'a:' || id AS src, 'author:' || {_WHO} AS dst, 'authored_by' AS type, c.name AS label, 'author' AS kind, 0.5 AS weight FROM (SELECT id, unnest(contributors) AS c FROM a) WHERE {_WHO} IS NOT NULL
 UNION ALL SELECT 'a:' || id, 'tag:' || x, 'tagged', x, 'tag', 0.5 FROM (SELECT id, unnest(list_distinct(tags)) AS x FROM a) WHERE x IS NOT NULL
 UNION ALL SELECT 'a:' || id, 'category:' || category, 'in_category', category, 'category', 0.3 FROM a WHERE category IS NOT NULL
 UNION ALL SELECT 'a:' || id, 'board:' || board.slug, 'in_board', board.name, 'board', 0.05 FROM a WHERE board.slug IS NOT NULL),
url AS (SELECT DISTINCT id, u FROM (SELECT id, unnest(regexp_extract_all(content, 'https?://read\\.example(/[^{chr(92)}s)"''<>\\]]*)')) AS u FROM a) WHERE NOT contains(u, '/api/files')),
tgt AS (SELECT url.id, CASE WHEN uid <> '' THEN k.id WHEN s.id <> url.id THEN s.id END AS target, uid <> '' AS by_uid, url.slug FROM
 (SELECT id, u, regexp_extract(u, '[?&]uid=([\\w-]+)', 1) AS uid, list_last(string_split(trim(regexp_extract(u, '^https?://[^/]+(/[^?#]*)', 1), '/'), '/')) AS slug FROM (SELECT id, unnest([u]) AS u FROM url)) url
 LEFT JOIN (SELECT DISTINCT id FROM a) k ON k.id = url.uid LEFT JOIN (SELECT slug, min(id) AS id FROM a WHERE slug IS NOT NULL GROUP BY slug) s ON s.slug = url.slug WHERE url.slug <> '' OR uid <> ''),
edges AS (SELECT src, dst, type, weight::DOUBLE AS weight FROM raw UNION ALL SELECT DISTINCT 'a:' || id, 'a:' || target, 'links_to', 1.0 FROM tgt WHERE target IS NOT NULL AND target <> id),
nodes AS (SELECT dst AS id, min(kind) AS type, min(trim(label, ' ')) AS label FROM raw GROUP BY dst UNION ALL SELECT 'a:' || id, 'article', title FROM a)"""
_LINKS = """rel AS (SELECT src AS id, coalesce('https://read.example/view/' || slug, 'https://read.example/view?uid=' || id) AS url FROM (SELECT src, id, slug, row_number() OVER (PARTITION BY src ORDER BY score DESC, id) AS n FROM
 (SELECT src, id, max(slug) AS slug, max(score) AS score FROM related WHERE src <> id AND score IS NOT NULL AND NOT isnan(score) GROUP BY src, id)) WHERE n <= 10),
a AS (SELECT a0.* REPLACE (concat_ws(chr(10), content, links) AS content) FROM a0 LEFT JOIN (SELECT id, string_agg(url, chr(10) ORDER BY url) AS links FROM rel GROUP BY id) USING (id))"""
_A0 = _A.replace("a AS", "a0 AS", 1)
_G = f"WITH {_A0}, {_LINKS}, {_EDGES} "
def _half_and_whole() -> str:
    ranked = lambda v, n: f"{n} AS (SELECT query AS query_id, id AS row_id, round(score, 4) AS score, rank FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 5) DESC, id) AS rank FROM (SELECT a.id AS query, b.id AS id, {v} AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0)) WHERE rank <= 20)"
    return f"{ranked('list_dot_product(a.v[1:32], b.v[1:32])', 'kw')}, {ranked('array_inner_product(a.v, b.v)', 'sem0')}, sem AS (SELECT * FROM sem0 QUALIFY max(score) OVER (PARTITION BY query_id) >= 0.3)"


def _fused(ask: str, corrected: str = "false") -> str:
    """CTEs and the result of the fusion of kw and sem; ``ask`` has (query_id, tokens)."""
    return f"""ask AS ({ask}),
led AS (SELECT query_id, CASE WHEN best >= CASE WHEN tokens <= 3 THEN 0.65 ELSE 0.9 END AND NOT {corrected} AND coalesce(shared, 0) / least(10, n) < 0.3 THEN 'keyword' ELSE 'semantic' END AS led FROM ask LEFT JOIN (SELECT query_id, max(score) AS best, count(*) AS n FROM kw GROUP BY 1) USING (query_id)
 LEFT JOIN (SELECT query_id, count(*) AS shared FROM sem WHERE rank <= 10 AND (query_id, row_id) IN (SELECT (query_id, row_id) FROM kw) GROUP BY 1) USING (query_id)),
u AS (SELECT query_id, row_id, score, source, led, rank, (source <> led)::INT AS second FROM (SELECT query_id, row_id, score, rank, 'keyword' AS source FROM kw UNION ALL SELECT query_id, row_id, score, rank, 'semantic' FROM sem) JOIN led USING (query_id)),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, row_id ORDER BY second) = 1)
SELECT query_id, row_id, round(score, 4) AS score, source, CASE WHEN query_id IN (SELECT query_id FROM sem) THEN led ELSE 'keyword' END AS tier, rank FROM (SELECT query_id, row_id, score, source, led, row_number() OVER (PARTITION BY query_id ORDER BY second, rank) AS rank FROM o) WHERE rank <= 20"""


def _toks(c: str) -> str:
    """The student's tokens of a text, repeats left in."""
    w = words(c)
    return f"list_concat(list_transform({w}, lambda w: {{'t': w, 'kind': 'n'}}), flatten(list_transform(list_filter({w}, lambda w: length(w) >= 2), lambda w: [{{'t': w, 'kind': 'e'}}, {{'t': {strip('w')}, 'kind': 'e'}}])), CASE WHEN {joined(c)} <> '' THEN [{{'t': {joined(f'lower({c})')}, 'kind': 'j'}}] ELSE [] END)"


def _once(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda z: z.t), x.t) = i)"


_KNOWN = """vt AS (SELECT row_id, unnest(list_distinct(list_concat(t, r))) AS term FROM t), vn AS (SELECT count(*) AS n FROM t),
known AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM vt GROUP BY term), vn WHERE df >= 2 AND df <= 0.6 * n AND length(term) >= 2)"""
_DOCS = """dv AS (SELECT id, vector::DOUBLE[] AS v FROM doc_embeddings WHERE vector IS NOT NULL AND len(vector) = 128 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) AND list_max(list_transform(vector, lambda x: abs(x))) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_embeddings.row_id) = 1),
du AS (SELECT row_id, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM dv JOIN (SELECT id, row_id FROM a) USING (id))"""


def _slots(table: str) -> str:
    """CTEs up to slots (query_id, slot, kind, term, place) of the texts (query_id, text) of a table."""
    cut = "flatten(list_transform(range(2, length(t)), lambda m: list_transform(range(1, length(t) - m + 2), lambda s: {'m': m, 's': s})))"
    return f"""ts AS (SELECT query_id, {_toks('text')} AS s FROM {table}), tk AS (SELECT query_id, unnest({_once('s')}) AS x, generate_subscripts({_once('s')}, 1) - 1 AS no FROM ts),
opened AS (SELECT query_id, no, x.t AS t FROM tk WHERE x.kind = 'n' AND length(x.t) >= 3 AND x.t NOT IN (SELECT term FROM known)),
cut AS (SELECT query_id, no, p.m AS m, p.s AS s, substr(t, p.s, p.m) AS term FROM (SELECT query_id, no, t, unnest({cut}) AS p FROM opened) WHERE p.m / length(t) >= 0.5),
met AS (SELECT query_id, no, 'core' AS kind, term, place FROM tk JOIN known ON term = x.t UNION ALL SELECT query_id, no, 'fb', term, place FROM (SELECT * FROM cut JOIN known USING (term) QUALIFY row_number() OVER (PARTITION BY query_id, no ORDER BY m DESC, s) = 1)),
slots AS (SELECT query_id, slot, kind, term, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY no) - 1 AS slot FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY query_id, place ORDER BY no) = 1)) WHERE slot < 16)"""


#: From slots to ranked documents: terms' vectors, the queries' unit vectors, the twenty best documents of each.
def _half_and_whole() -> str:
    ranked = lambda v, n: f"{n} AS (SELECT query AS query_id, id AS row_id, round(score, 4) AS score, rank FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 5) DESC, id) AS rank FROM (SELECT a.id AS query, b.id AS id, {v} AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0)) WHERE rank <= 20)"
    return f"{ranked('list_dot_product(a.v[1:32], b.v[1:32])', 'kw')}, {ranked('array_inner_product(a.v, b.v)', 'sem0')}, sem AS (SELECT * FROM sem0 QUALIFY max(score) OVER (PARTITION BY query_id) >= 0.3)"


def _fused(ask: str, corrected: str = "false") -> str:
    """CTEs and the result of the fusion of kw and sem; ``ask`` has (query_id, tokens)."""
    return f"""ask AS ({ask}),
led AS (SELECT query_id, CASE WHEN best >= CASE WHEN tokens <= 3 THEN 0.65 ELSE 0.9 END AND NOT {corrected} AND coalesce(shared, 0) / least(10, n) < 0.3 THEN 'keyword' ELSE 'semantic' END AS led FROM ask LEFT JOIN (SELECT query_id, max(score) AS best, count(*) AS n FROM kw GROUP BY 1) USING (query_id)
 LEFT JOIN (SELECT query_id, count(*) AS shared FROM sem WHERE rank <= 10 AND (query_id, row_id) IN (SELECT (query_id, row_id) FROM kw) GROUP BY 1) USING (query_id)),
u AS (SELECT query_id, row_id, score, source, led, rank, (source <> led)::INT AS second FROM (SELECT query_id, row_id, score, rank, 'keyword' AS source FROM kw UNION ALL SELECT query_id, row_id, score, rank, 'semantic' FROM sem) JOIN led USING (query_id)),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, row_id ORDER BY second) = 1)
SELECT query_id, row_id, round(score, 4) AS score, source, CASE WHEN query_id IN (SELECT query_id FROM sem) THEN led ELSE 'keyword' END AS tier, rank FROM (SELECT query_id, row_id, score, source, led, row_number() OVER (PARTITION BY query_id ORDER BY second, rank) AS rank FROM o) WHERE rank <= 20"""


def _toks(c: str) -> str:
    """The student's tokens of a text, repeats left in."""
    w = words(c)
    return f"list_concat(list_transform({w}, lambda w: {{'t': w, 'kind': 'n'}}), flatten(list_transform(list_filter({w}, lambda w: length(w) >= 2), lambda w: [{{'t': w, 'kind': 'e'}}, {{'t': {strip('w')}, 'kind': 'e'}}])), CASE WHEN {joined(c)} <> '' THEN [{{'t': {joined(f'lower({c})')}, 'kind': 'j'}}] ELSE [] END)"


def _once(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda z: z.t), x.t) = i)"


_KNOWN = """vt AS (SELECT row_id, unnest(list_distinct(list_concat(t, r))) AS term FROM t), vn AS (SELECT count(*) AS n FROM t),
known AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM vt GROUP BY term), vn WHERE df >= 2 AND df <= 0.6 * n AND length(term) >= 2)"""
_DOCS = """dv AS (SELECT id, vector::DOUBLE[] AS v FROM doc_embeddings WHERE vector IS NOT NULL AND len(vector) = 128 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) AND list_max(list_transform(vector, lambda x: abs(x))) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_embeddings.row_id) = 1),
du AS (SELECT row_id, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM dv JOIN (SELECT id, row_id FROM a) USING (id))"""


def _slots(table: str) -> str:
    """CTEs up to slots (query_id, slot, kind, term, place) of the texts (query_id, text) of a table."""
    cut = "flatten(list_transform(range(2, length(t)), lambda m: list_transform(range(1, length(t) - m + 2), lambda s: {'m': m, 's': s})))"
    return f"""ts AS (SELECT query_id, {_toks('text')} AS s FROM {table}), tk AS (SELECT query_id, unnest({_once('s')}) AS x, generate_subscripts({_once('s')}, 1) - 1 AS no FROM ts),
opened AS (SELECT query_id, no, x.t AS t FROM tk WHERE x.kind = 'n' AND length(x.t) >= 3 AND x.t NOT IN (SELECT term FROM known)),
cut AS (SELECT query_id, no, p.m AS m, p.s AS s, substr(t, p.s, p.m) AS term FROM (SELECT query_id, no, t, unnest({cut}) AS p FROM opened) WHERE p.m / length(t) >= 0.5),
met AS (SELECT query_id, no, 'core' AS kind, term, place FROM tk JOIN known ON term = x.t UNION ALL SELECT query_id, no, 'fb', term, place FROM (SELECT * FROM cut JOIN known USING (term) QUALIFY row_number() OVER (PARTITION BY query_id, no ORDER BY m DESC, s) = 1)),
slots AS (SELECT query_id, slot, kind, term, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY no) - 1 AS slot FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY query_id, place ORDER BY no) = 1)) WHERE slot < 16)"""


#: From slots to ranked documents: terms' vectors, the queries' unit vectors, the twenty best documents of each.
_STUDENT = """tm AS (SELECT term, pos, avg(x) AS x FROM (SELECT term, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM vt JOIN du USING (row_id) WHERE term IN (SELECT term FROM slots)) GROUP BY 1, 2),
tv AS (SELECT term, list(x ORDER BY pos) AS v FROM tm GROUP BY term), tu AS (SELECT term, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM tv),
qx AS (SELECT query_id, pos, sum(w * x) AS x FROM (SELECT query_id, idf * CASE WHEN kind = 'fb' THEN exp(-0.5) ELSE 1 END AS w, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM slots JOIN known USING (term) JOIN tu USING (term)) GROUP BY 1, 2),
ql AS (SELECT query_id, list(x ORDER BY pos) AS v FROM qx GROUP BY query_id), qu AS (SELECT query_id, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE) AS v FROM ql),
exact AS (SELECT query_id, count(*) FILTER (kind <> 'fb') AS exact_slots FROM slots GROUP BY query_id),
sem0 AS (SELECT query_id, row_id, score, rank, exact_slots FROM (SELECT query_id, row_id, list_dot_product(v, u) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(v, u), 5) DESC, row_id) AS rank FROM qu, du) JOIN exact USING (query_id) WHERE rank <= 20)"""


def _chunks(paras: str) -> str:
    """The greedy fold over paragraphs, with {done, buf} as its state."""
    flush = "(length(acc.buf) + length(p.buf) > 550 AND acc.buf <> '')"
    buf = f"(CASE WHEN {flush} THEN p.buf ELSE trim(acc.buf || ' ' || p.buf, ' ') END)"
    cuts = f"(CASE WHEN length({buf}) > 800 THEN ceil(length({buf}) / 800.0)::INT - 1 ELSE 0 END)"
    done = f"list_concat(CASE WHEN {flush} THEN list_concat(acc.done, [acc.buf]) ELSE acc.done END, list_transform(range(0, {cuts}), lambda i: substr({buf}, i * 800 + 1, 800)))"
    state = f"list_reduce(list_transform({paras}, lambda p: {{'done': []::VARCHAR[], 'buf': p}}), lambda acc, p: {{'done': {done}, 'buf': substr({buf}, {cuts} * 800 + 1)}}, {{'done': []::VARCHAR[], 'buf': ''}})"
    return f"(SELECT CASE WHEN length(x.buf) >= 50 OR len(x.done) = 0 THEN list_concat(x.done, [x.buf]) ELSE x.done END FROM (SELECT {state} AS x))"


def _beam() -> str:
    """Four levels of the beam search over the article graph, one after another."""
    out = [
        _G.removeprefix("WITH ").rstrip(),
        _DOCS.replace("SELECT id, row_id FROM a)", "SELECT id, row_id FROM a0)"),
        "adj AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges))",
        "own AS (SELECT 'a:' || id AS id, row_id, u FROM du)",
        "nm AS (SELECT id, pos, avg(x) AS x FROM (SELECT src AS id, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM adj JOIN own ON own.id = adj.dst WHERE src NOT IN (SELECT id FROM own)) GROUP BY 1, 2)",
        "nl AS (SELECT id, list(x ORDER BY pos) AS v FROM nm GROUP BY id)",
        "nv AS (SELECT id, u AS v FROM own UNION ALL SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) FROM nl)",
        "f AS (SELECT id AS src, id FROM own WHERE row_id % 50 = 0)",
    ]
    front, seen = "f", "SELECT src, id FROM f"
    for d in range(4):
        out.append(f"n{d} AS (SELECT DISTINCT x.src, adj.dst AS id FROM {front} x JOIN adj ON adj.src = x.id WHERE (x.src, adj.dst) NOT IN (SELECT (z.src, z.id) FROM ({seen}) z))")
        out.append(f"s{d} AS (SELECT n.src, n.id, list_dot_product(y.v, z.v) * {0.9**d!r} AS score, {d} AS level FROM n{d} n JOIN nv y ON y.id = n.src JOIN nv z ON z.id = n.id)")
        out.append(f"f{d} AS (SELECT src, id FROM s{d} QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(score, 6) DESC, id) <= 128)")
        front, seen = f"f{d}", seen + f" UNION ALL SELECT src, id FROM n{d}"
    return "WITH " + ", ".join(out) + " SELECT src, id, round(score, 4) + 0.0::DOUBLE AS score, level FROM (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(4)) + ") WHERE id IN (SELECT id FROM own)"


def _graph_build() -> str:
    return f"""{_G.rstrip()}, {_DOCS.replace("SELECT id, row_id FROM a)", "SELECT id, row_id FROM a0)")}, near AS (SELECT x, y, round(max(s), 4) AS w FROM (SELECT least(p, o) AS x, greatest(p, o) AS y, s FROM (SELECT a.id AS p, b.id AS o, list_dot_product(a.u, b.u) AS s, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.u, b.u), 5) DESC, b.id) AS k FROM du a JOIN du b ON a.id <> b.id WHERE a.row_id % 50 = 0) WHERE k <= 10 AND s >= 0.3) GROUP BY 1, 2),
every AS (SELECT src, type, weight FROM edges UNION ALL SELECT 'a:' || x, 'knn', round(w, 3) FROM near UNION ALL SELECT 'a:' || id, 'in_series', 1.0 FROM a0 WHERE category IN (SELECT category FROM a0 GROUP BY category HAVING count(*) >= 2))
SELECT type, count(*) AS n, count(DISTINCT src) AS sources, round(sum(weight), 1) AS weight FROM every GROUP BY type"""


def _draw(n: str, *of: str) -> str:
    """A number from 0 to n - 1 by the MD5 of values with a bar between."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'({x})::VARCHAR' for x in of)})), 1, 12))::BIGINT % ({n}))"


def _typo(c: str, seed: str) -> str:
    """One syllable of a word with another vowel or initial."""
    spots = f"list_filter(range(1, length({c}) + 1), lambda i: regexp_matches(substr({c}, i, 1), '[가-힣]'))"
    return f"""(SELECT CASE WHEN len(p) = 0 THEN c ELSE left(c, i - 1) || chr((CASE WHEN f THEN 44032 + lead * 588 + (vowel + 1 + {_draw('20', 's', '3')}) % 21 * 28 + tail ELSE 44032 + (lead + 1 + {_draw('18', 's', '4')}) % 19 * 588 + vowel * 28 + tail END)::INT) || substr(c, i + 1) END
 FROM (SELECT *, (unicode(substr(c, i, 1)) - 44032) // 588 AS lead, (unicode(substr(c, i, 1)) - 44032) % 588 // 28 AS vowel, (unicode(substr(c, i, 1)) - 44032) % 28 AS tail FROM
 (SELECT *, CASE WHEN len(p) > 0 THEN p[{_draw('len(p)', 's', '1')} + 1] END::INT AS i, {_draw('2', 's', '2')} = 0 AS f FROM (SELECT {c} AS c, {spots} AS p, {seed} AS s))))"""


def sql() -> dict[str, str]:
    base = f"WITH {_A}, {_T}, {_QS}, {_I}, {_W}, {_P}, {_LIT}"
    terms = f"{base}, {_POST}, {_M}, {_HIT} {_SEARCH}"
    swap = "score < 1 AND score >= 0.65 AND word <> term"
    top2 = f"(SELECT row_id, id, {_TOP2} AS k FROM (SELECT row_id, id, {_KEYS} AS k FROM %s))"
    toks = _toks("title")
    out = {
        "literal_title_search": f"{base} SELECT * FROM lit",
        "keyword_search_substring": f"{base}, d AS (SELECT row_id, lower(title) AS title, {_REST} AS rest FROM a), hit AS (SELECT query_id, interp, row_id, n, CASE WHEN contains(title, term) THEN 2.0 ELSE 1.0 END AS best FROM d JOIN w ON contains(title, term) OR contains(rest, term)) {_SEARCH}",
        "keyword_search_terms": terms,
        "search_exact": f"SELECT query_id, row_id, score, 'keyword' AS source, 'keyword' AS tier, rank FROM ({terms}) WHERE score >= 1.5",
        "query_interpretations": f"WITH {_QS}, {_I} SELECT query_id, interp, array_to_string(terms, ' ') AS terms FROM i",
        "spelling_correction": f"""{base}, {_VOC}, asked AS (SELECT * FROM w WHERE query_id NOT IN (SELECT query_id FROM lit)),
hit AS (SELECT term, word, place, {score('term', 'word')} AS score FROM (SELECT DISTINCT term FROM asked), voc),
best AS (SELECT term, word, score FROM hit WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, abs(length(word) - length(term)), place) = 1),
full_ AS (SELECT query_id, interp, n, avg(score) AS quality, bool_or({swap}) AS replaced, list(CASE WHEN {swap} THEN word ELSE term END ORDER BY no) AS terms FROM asked JOIN best USING (term) GROUP BY query_id, interp, n HAVING count(*) = n),
one AS (SELECT f.*, phrase, whole, raw, array_to_string(terms, ' ') AS corrected FROM full_ f JOIN p USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, abs(length(array_to_string(terms, '')) - length(whole)), n, interp) = 1)
SELECT query_id, corrected FROM one WHERE corrected <> phrase AND (replaced OR (array_to_string(terms, '') = whole AND len(terms) < len(raw)))""",
        "tag_counts": f"WITH {_A} SELECT name, count(*) AS count, min(row_id) AS first_row FROM (SELECT row_id, unnest(tags) AS name FROM a) WHERE name IS NOT NULL GROUP BY name",
        "tag_index": f"WITH {_A} SELECT name, row_id // 4096 AS block, count(*) AS count, string_agg(id, ',' ORDER BY row_id, id) AS ids FROM (SELECT row_id, id, unnest(tags) AS name FROM a) WHERE name IS NOT NULL GROUP BY name, row_id // 4096",
        "tag_match": f"""WITH {_A}, {_QS}, g AS (SELECT name, count(*) AS count, min(row_id) AS first_row FROM (SELECT row_id, unnest(tags) AS name FROM a) WHERE name IS NOT NULL GROUP BY name),
w AS (SELECT DISTINCT query_id, unnest(raw) AS term FROM q), m AS (SELECT query_id, name, count, first_row, max({score('term', 'lower(name)')}) AS score FROM w, g GROUP BY ALL)
SELECT query_id, name, count, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, count DESC, first_row, name) AS rank FROM m WHERE score >= 0.65) WHERE rank <= 3""",
        "doc_meta": f"""WITH {_A} SELECT row_id, id, coalesce(nullif(slug, ''), id) AS slug, title, board.slug AS board, board.name AS board_name, category, array_to_string(list_transform(coalesce(tags, []), lambda t: coalesce(t, '-')), '|') AS tags,
array_to_string(list_transform(coalesce(contributors, []), lambda c: coalesce(c.name, '') || '/' || coalesce(c.role, 'author')), '|') AS authors, left(coalesce(nullif(created, ''), '1970-01-01'), 10) AS created, nullif(thumbnail, '') AS thumbnail, nullif(preview, '') AS preview, coalesce(views, 0) AS views FROM a""",
        "clean_markdown": f"SELECT row_id, {tidy(chain('content', *_MD, ('<[^>]+>', ' '), (f'(?m)^[>#*{chr(92)}-|{_WS_IN}]+', ''), ('[*_`~]{1,3}', '')))} AS text FROM articles",
        "strip_html_body": f"SELECT row_id, {_BODY} AS text FROM (SELECT row_id, coalesce(content, '') AS content FROM articles)",
        "clean_titles": f"SELECT row_id, {tidy(chain('title', (r'\[[^\]]*\]', ' '), (r'\([^)]*\)', ' '), ('[<>『』\"“”]', ' ')))} AS text FROM articles",
        "title_keywords": f"SELECT row_id, array_to_string(k, ' ') AS words FROM {top2 % 'articles'}",
        "vocab_df_idf": f"""WITH {_A}, x AS (SELECT id, unnest(list_distinct(list_transform({words("concat_ws(' ', title, content)")}, lambda w: {strip('w')}))) AS term FROM a), n AS (SELECT count(*) AS n FROM a),
c AS (SELECT term, count(*) AS df FROM x WHERE length(term) >= 2 GROUP BY term) SELECT term, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf, df >= 2 AND df <= 0.6 * n AS kept FROM c, n""",
        "bigram_vocab": f"WITH {_A}, {_T}, {_VOC} SELECT word, place.k AS k, place.row_id AS row_id, place.at AS \"at\" FROM voc",
        "student_tokens": f"WITH {_A}, x AS (SELECT row_id, {toks} AS s FROM a), y AS (SELECT row_id, unnest({_once('s')}) AS x, generate_subscripts({_once('s')}, 1) - 1 AS \"at\" FROM x) SELECT row_id, \"at\", x.t AS t, x.kind AS kind FROM y",
        "near_dup_jaccard": f"""WITH l AS (SELECT row_id AS id, list_distinct({words('title')}) AS x FROM articles WHERE title IS NOT NULL),
c AS (SELECT a.id AS train_id, b.id AS eval_id, count(*) AS c FROM (SELECT id, unnest(x) AS t FROM l) a JOIN (SELECT id, unnest(x) AS t FROM l WHERE id % 50 = 0) b USING (t) GROUP BY ALL)
SELECT train_id, eval_id, round(c / (len(l.x) + len(r.x) - c), 6) AS jaccard FROM c JOIN l ON l.id = train_id JOIN l r ON r.id = eval_id WHERE c / (len(l.x) + len(r.x) - c) >= 0.6""",
        "quantize_int8": "WITH s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS m FROM embeddings), k AS (SELECT id, v, CASE WHEN m > 0 THEN m ELSE 1.0 END AS scale FROM s) SELECT id, round(scale, 8) AS scale, generate_subscripts(v, 1) - 1 AS \"at\", unnest(list_transform(v, lambda x: greatest(-127, least(127, round_even(x / scale, 0)))))::TINYINT AS q FROM k",
        "dequantize_error": "WITH s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS scale FROM embeddings) SELECT id, round(list_max(list_transform(v, lambda x: abs(x - round_even(x / scale, 0) * scale))), 4)::FLOAT AS most FROM s",
        "cosine_topk": f"WITH {_E}, {_SIM} SELECT query, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 5) DESC, id) AS rank FROM s) WHERE rank <= 10",
        "knn_edges": f"WITH {_E}, s AS (SELECT a.id AS a, b.id AS b, array_inner_product(a.v, b.v) AS score FROM e a JOIN e b ON a.id <> b.id), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 5) DESC, b) <= 10) SELECT least(a, b) AS src, greatest(a, b) AS dst, round(round(max(score), 4), 3) AS weight FROM t WHERE score >= 0.3 GROUP BY 1, 2",
        "centroid_pool": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS \"at\" FROM embeddings), m AS (SELECT label, \"at\", avg(x) AS x FROM x GROUP BY 1, 2) SELECT label, \"at\", round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) + 0.0::DOUBLE AS x FROM m",
        "attribute_edges": _G + "SELECT * FROM edges",
        "graph_nodes": _G + "SELECT * FROM nodes",
        "graph_build": _graph_build(),
        "link_targets": _G + "SELECT target IS NOT NULL AS resolved, count(*) AS n FROM tgt GROUP BY 1",
        "edge_merge": _G + "SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY 1, 2",
        "degree": _G + "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1",
        "graph_counts": _G + "SELECT 'node' AS what, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'isolated', type, count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) GROUP BY type",
        "drawing_edges": _G + "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, type, max(weight) AS weight FROM edges GROUP BY 1, 2, 3",
        "neighbours_by_type": _G + "SELECT id, type, count(*) AS n, array_to_string(list(other ORDER BY other)[1:40], ',') AS neighbours FROM (SELECT src AS id, dst AS other, type FROM edges UNION SELECT dst, src, type FROM edges) GROUP BY id, type",
        "find_nodes": _G + "SELECT * FROM nodes WHERE contains(lower(label), '환율') AND type IN ('tag', 'article')",
        "fuse_rank": f"WITH {_E}, {_half_and_whole()}, " + _fused("SELECT DISTINCT id AS query_id, 2 AS tokens FROM e WHERE id % 50 = 0"),
        "mrr_recall": f"WITH {_E}, {_SIM}, m AS (SELECT query, max(round(score, 5)) AS mark FROM s WHERE la = lb GROUP BY query), r AS (SELECT query, count(*) FILTER (round(score, 5) > mark) AS rank FROM s JOIN m USING (query) GROUP BY query) SELECT count(*) AS n, {', '.join(f'round(100 * avg((rank < {k})::INT), 4) AS r{k}' for k in (1, 5, 10, 20))}, round(avg(1 / (rank + 1)), 4) AS mrr FROM r",
        "gate_calibration": f"WITH {_E}, {_SIM}, t AS (SELECT query, round(max(score), 4) AS top FROM s GROUP BY query) SELECT round(least(0.3, min(top) FILTER (query % 100 <> 0) - 0.005), 3) AS exact, round(max(top) FILTER (query % 100 = 0) + 0.01, 3) AS fallback_only FROM t",
        "floor_percentiles": "WITH r AS (SELECT views AS value, row_number() OVER (ORDER BY views) - 1 AS place, count(*) OVER () AS n FROM articles WHERE views IS NOT NULL) SELECT q, value FROM r JOIN (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) AS v(q) ON place = floor(q * (n - 1))",
        "source_digest": f"WITH {_A}, r AS (SELECT sha256(concat_ws(chr(31), {', '.join(f'coalesce({c}, chr(0))' for c in ('id', 'title', 'content', 'category', 'preview'))})) AS d FROM a) SELECT count(*) AS n, sha256(concat_ws('|', count(*), {', '.join(f"sum(('0x' || substr(d, {1 + 15 * k}, 15))::BIGINT)" for k in range(4))})) AS digest FROM r",
        "fnv_shard": f"WITH {_A}, {_T}, x AS (SELECT DISTINCT unnest(list_concat(t, r)) AS term FROM t), h AS (SELECT term, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(term, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295) AS hash FROM x) SELECT term, hash, (hash % 256)::INT AS shard FROM h",
        "hangul_jamo": f"SELECT row_id, {jamo('title')} AS jamo FROM articles",
        "term_score_hangul": f"SELECT q, t, {score('q', 't')}::DOUBLE AS score FROM {_values(PAIRS, 'q, t')}",
        "strip_particles": f"WITH w AS (SELECT DISTINCT unnest({words('content')}) AS word FROM articles) SELECT word, {strip('word')} AS stem FROM w",
        "bench_variants": f"WITH {_A}, t AS (SELECT * FROM {top2 % 'a'} WHERE len(k) = 2) SELECT id AS article, 'clean' AS variant, k[1] || ' ' || k[2] AS text FROM t UNION ALL SELECT id, 'split', left(k[1], greatest(length(k[1]) // 2, 1)) || ' ' || substr(k[1], greatest(length(k[1]) // 2, 1) + 1) || ' ' || k[2] FROM t UNION ALL SELECT id, 'merged', k[1] || k[2] FROM t",
        "latest_rows": "SELECT id, row_id FROM articles QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, row_id DESC) = 1",
        "lexicon_candidates": f"WITH w AS (SELECT DISTINCT unnest(r) AS word FROM doc_terms) SELECT word, CASE WHEN {strip('word')} = word THEN 'single' ELSE 'compound' END AS kind FROM w WHERE regexp_matches(word, '^[가-힣]{{2,6}}$') AND ({strip('word')} = word OR length(word) <= 4)",
    }
    paras = f"list_filter(list_transform(string_split_regex(content, '(\\r?\\n){{2,}}'), lambda c: {tidy(chain('c', *_MD, ('<[^>]+>', ' '), (f'(?m)^[>#*{chr(92)}-|{_WS_IN}]+', ''), ('[*_`~]{1,3}', '')))}), lambda c: c <> '')"
    chunked = lambda key, table: f"(SELECT {key} AS k, title, {_chunks('ps')} AS ch FROM (SELECT {key}, title, CASE WHEN content IS NULL THEN [] ELSE {paras} END AS ps FROM {table}))"
    parts = f"list_distinct(list_filter(list_transform(string_split_regex({_BODY}, {_q('[.!?' + chr(92) + 'n,;:·…' + chr(34) + '“”' + chr(39) + '‘’()' + chr(92) + '[' + chr(92) + ']]')}), lambda c: {tidy('c')}), lambda c: length(c) BETWEEN 8 AND 40 AND regexp_matches(c, '[가-힣]{{2}}')))"
    back = "list_transform(v, lambda x: (round_even(x / m, 0) * m)::FLOAT::DOUBLE)"
    ten = lambda n, v: f"{n} AS (SELECT q, id FROM (SELECT a.id AS q, b.id AS id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.{v}, b.{v}), 5) DESC, b.id) AS r FROM k a JOIN k b ON a.id <> b.id WHERE a.id % 50 = 0) WHERE r <= 10)"
    base_slots = f"WITH {_A}, {_T}, {_QS}, {_KNOWN}, {_slots('qs')}"
    fixed = out["spelling_correction"].removeprefix("WITH ").rsplit("\nSELECT query_id, corrected", 1)
    semantic = f"""WITH {fixed[0]}, fixed AS (SELECT query_id, corrected{fixed[1]}), again AS (SELECT query_id, coalesce(corrected, text) AS text FROM qs LEFT JOIN fixed USING (query_id)),
{_POST}, m2 AS (SELECT term, word, score FROM (SELECT term, word, {score('term', 'word')} AS score FROM (SELECT DISTINCT term FROM w), (SELECT DISTINCT word FROM post)) WHERE score > 0), {_HIT.replace("JOIN m USING", "JOIN m2 USING").replace("hit AS", "hit2 AS").replace("best AS", "best2 AS").replace("FROM best JOIN", "FROM best2 JOIN")},
kw AS ({_SEARCH.replace("FROM hit GROUP", "FROM hit2 GROUP")}), {_KNOWN}, {_DOCS}, {_slots('again')}, {_STUDENT},
sem AS (SELECT query_id, row_id, score, rank FROM sem0 QUALIFY max(score) OVER (PARTITION BY query_id) >= CASE WHEN exact_slots > 0 THEN 0.3 ELSE 0.635 END), """ + _fused("SELECT query_id, len(raw) AS tokens, query_id IN (SELECT query_id FROM fixed) AS was_corrected FROM q", "was_corrected")
    seed = "id || '7'"
    typo_rows = f"SELECT id AS article, 'typo' AS variant, {_typo('k[1]', seed)} || ' ' || k[2] AS text FROM (SELECT * FROM {top2 % 'a'} WHERE len(k) = 2)"
    out |= {
        "encoder_slots": f"{base_slots} SELECT query_id, slot, kind, term FROM slots",
        "slot_coverage": f"{base_slots} SELECT count(*) AS n, round(100 * avg((query_id IN (SELECT query_id FROM slots))::INT), 4) AS covered FROM qs",
        "student_search": f"{base_slots}, {_DOCS}, {_STUDENT} SELECT query_id, row_id, round(score, 4) AS score, rank, exact_slots FROM sem0 WHERE score > 0",
        "search_semantic": semantic,
        "bench_typos": f"WITH {_A} {typo_rows}",
        "bootstrap_ci": f"""WITH {_E}, {_SIM}, m AS (SELECT query, max(round(score, 5)) AS mark FROM s WHERE la = lb GROUP BY query), r AS (SELECT query, 1 / (count(*) FILTER (round(score, 5) > mark) + 1) AS v FROM s JOIN m USING (query) GROUP BY query),
p AS (SELECT list_transform(range(1, 9), lambda k: list_sum(list_transform(range(0, k), lambda j: exp(-1) / factorial(j::INT)))) AS steps), d AS (SELECT b, v, (SELECT len(list_filter(steps, lambda x: {_draw(str(1 << 40), 'query', 'b', '0')} / {float(1 << 40)!r} >= x)) FROM p) AS w FROM r, range(2000) AS t(b)),
x AS (SELECT b, sum(v * w) / nullif(sum(w), 0) AS m FROM d GROUP BY b) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM x""",
        "shard_packs": """WITH RECURSIVE """ + f"""z AS (SELECT shard, sum(strlen(term) + 4)::BIGINT AS bytes, row_number() OVER (ORDER BY shard) AS n FROM ({out['fnv_shard']}) GROUP BY shard),
f AS (SELECT n, shard, bytes, 0::BIGINT AS pack, 0::BIGINT AS start, bytes AS used FROM z WHERE n = 1 UNION ALL
 SELECT z.n, z.shard, z.bytes, f.pack + (f.used > 0 AND f.used + z.bytes > 2048)::INT, CASE WHEN f.used > 0 AND f.used + z.bytes > 2048 THEN 0 ELSE f.used END, CASE WHEN f.used > 0 AND f.used + z.bytes > 2048 THEN 0 ELSE f.used END + z.bytes FROM f JOIN z ON z.n = f.n + 1)
SELECT shard, bytes, pack, start FROM f""",
        "query_synthesis": f"""WITH {_A}, b AS (SELECT row_id, {_BODY} AS body, concat_ws(' ', title, {tidy(_BODY)}) AS flat FROM a),
nn AS (SELECT row_id, list_filter(list_transform({words('flat')}, lambda w: {strip('w')}), lambda w: length(w) >= 2) AS w FROM b), wn AS (SELECT row_id, w, unnest(range(0, 40)) AS k FROM nn WHERE len(w) > 3), wl AS (SELECT *, {_draw('4', 'row_id', 'k', '1', '77')} + 2 AS len FROM wn),
win AS (SELECT array_to_string(w[pos + 1:pos + len], ' ') AS text, row_id AS src, 'win' AS kind, k FROM (SELECT *, {_draw('greatest(len(w) - len, 1)', 'row_id', 'k', '2', '77')} AS pos FROM wl)),
sn AS (SELECT row_id, s, unnest(range(0, 20)) AS k FROM (SELECT row_id, list_filter(s0, lambda x, i: list_position(s0, x) = i) AS s FROM (SELECT row_id, {parts.removeprefix("list_distinct(")[:-1]} AS s0 FROM (SELECT row_id, content FROM a WHERE content IS NOT NULL))) WHERE len(s) > 0),
seg AS (SELECT s[{_draw('greatest(len(s), 1)', 'row_id', 'k', '3', '77')} + 1] AS text, row_id, 'seg', k FROM sn),
tit AS (SELECT {tidy(chain('p', (chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']', ' '), (chr(92) + '([^)]*' + chr(92) + ')', ' '), ('[<>『』"“”]', ' ')))} AS text, row_id, 'title', k FROM (SELECT row_id, unnest(string_split(title, '·')) AS p, generate_subscripts(string_split(title, '·'), 1) - 1 AS k FROM a)),
tag AS (SELECT x AS text, -1, 'tag', k FROM (SELECT unnest(tags) AS x, generate_subscripts(tags, 1) - 1 AS k FROM a)),
every AS (SELECT {tidy('text')} AS text, src, kind, k FROM (SELECT * FROM win UNION ALL SELECT * FROM seg UNION ALL SELECT * FROM tit UNION ALL SELECT * FROM tag)),
good AS (SELECT *, list_position(['win', 'seg', 'title', 'tag'], kind) AS o FROM every WHERE length(text) BETWEEN 2 AND 60 AND regexp_matches(text, '[가-힣]'))
SELECT text, src, kind FROM good QUALIFY row_number() OVER (PARTITION BY text ORDER BY o, src, k) = 1""",
    }
    out["gate_sets"] = f"""WITH {_A}, {_T}, asked AS (SELECT row_id * 4 + k AS query_id, row_id, s AS set, text, k = 2 AS must_fail FROM (SELECT row_id, 0 AS k, 'title' AS s, title AS text FROM a WHERE row_id % 50 = 0 UNION ALL SELECT row_id, 1, 'tags', nullif(array_to_string(tags[1:2], ' '), '') FROM a WHERE row_id % 50 = 0 UNION ALL SELECT row_id, 2, 'gibberish', reverse(title) FROM a WHERE row_id % 50 = 0) WHERE text IS NOT NULL),
{_KNOWN}, {_slots('asked')}, {_DOCS}, {_STUDENT}, hits AS (SELECT * FROM sem0 WHERE score > 0),
r AS (SELECT k.set, k.must_fail, h.top, coalesce(h.exact_slots, 0) > 0 AS whole, p.rank FROM asked k LEFT JOIN (SELECT query_id, max(score) AS top, max(exact_slots) AS exact_slots FROM hits GROUP BY 1) h USING (query_id) LEFT JOIN (SELECT query_id, min(rank) AS rank FROM hits JOIN asked USING (query_id, row_id) WHERE NOT must_fail GROUP BY 1) p USING (query_id)),
f AS (SELECT round(least(0.3, min(top - 0.005) FILTER (rank <= 10 AND whole AND NOT must_fail)), 3) AS exact_floor, coalesce(round(max(top) FILTER (NOT whole AND must_fail) + 0.01, 3), 0.635) AS fallback_floor FROM r),
g AS (SELECT r.*, f.*, coalesce(top >= CASE WHEN whole THEN exact_floor ELSE fallback_floor END, false) AS passed FROM r, f)
SELECT set, count(*) AS n, count(*) FILTER (top IS NULL) AS no_slot, count(*) FILTER (top IS NOT NULL AND whole) AS exact, count(*) FILTER (top IS NOT NULL AND NOT whole) AS fallback_only, count(*) FILTER (passed) AS passed, count(*) FILTER (rank <= 10 AND NOT passed) AS lost, any_value(exact_floor) AS exact_floor, any_value(fallback_floor) AS fallback_floor FROM g GROUP BY set"""
    freq = f"(SELECT stem AS word, sum(n)::BIGINT AS freq FROM (SELECT {strip('word')} AS stem, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest({words('title')}) AS word FROM articles) GROUP BY word)) WHERE regexp_matches(stem, '^[가-힣]{{2,}}$') GROUP BY stem HAVING sum(n) >= 2)"
    known = f"WITH {_A}, {_T}, {_KNOWN}"
    dup = f"""same AS (SELECT m.text AS t, h.text AS h, count(*) AS c FROM (SELECT text, unnest(list_distinct({words('text')})) AS w FROM made) m JOIN (SELECT text, unnest(list_distinct({words('text')})) AS w FROM held) h USING (w) GROUP BY 1, 2),
leak AS (SELECT DISTINCT t FROM same WHERE c / (len(list_distinct({words('t')})) + len(list_distinct({words('h')})) - c) >= 0.6 UNION SELECT text FROM held)"""
    out |= {
        "json_scan": f"WITH {_A} SELECT id, title, md5(content) AS content, board.slug AS board, len(coalesce(tags, []))::INT AS tags, contributors[1].name AS first, views FROM a",
        "relational_export": f"WITH {_A} SELECT id, board.slug AS board, category, CASE WHEN len(list_filter(tags, lambda x: x IS NOT NULL)) > 0 THEN array_to_string(list_sort(list_distinct(list_filter(tags, lambda x: x IS NOT NULL))), '|') END AS tags, CASE WHEN len(contributors) > 0 THEN array_to_string(list_transform(contributors, lambda c: coalesce(c.name, '-')), '|') END AS people FROM a WHERE views IS NOT NULL",
        "vocabulary_order": f"{known} SELECT term, place, round(idf, 6) AS idf FROM known",
        "vocabulary_digest": f"{known} SELECT sha1(string_agg(term, chr(10) ORDER BY place)) AS digest FROM known",
        "lexicon_affinity": f"""{known}, {_DOCS}, tm AS (SELECT term, pos, avg(x) AS x FROM (SELECT term, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM vt JOIN du USING (row_id) JOIN known USING (term)) GROUP BY 1, 2), tv AS (SELECT term, list(x ORDER BY pos) AS v FROM tm GROUP BY term)
SELECT term AS word, round(max(list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), u)), 4) AS affinity FROM tv, du GROUP BY term HAVING max(list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), u)) >= 0.37""",
        "frequency_candidates": f"SELECT * FROM {freq}",
        "new_words": f"{known} SELECT word FROM {freq} WHERE word NOT IN (SELECT term FROM known)",
        "student_rows": f"WITH {_A} SELECT r.id AS place, coalesce(a.row_id, -1) AS row_id FROM (SELECT DISTINCT id FROM related) r LEFT JOIN a ON a.id = r.id",
        "split_metrics": out["mrr_recall"].replace("SELECT count(*) AS n, round(100", "SELECT query % 100 = 0 AS fresh, count(*) AS n, round(100") + " GROUP BY 1",
        "bench_sample": f"WITH {_A} SELECT row_id, id FROM a ORDER BY {_draw(str(1 << 48), 'row_id', '7')}, row_id LIMIT 300",
        "training_counts": f"WITH made AS ({out['query_synthesis']}), {_QUERIES}, held AS (SELECT DISTINCT {tidy('text')} AS text FROM qs), {dup} SELECT kind, count(*) AS n, count(*) FILTER (text NOT IN (SELECT t FROM leak)) AS kept FROM made GROUP BY kind",
    }
    return out | {
        "chunk_documents": f"SELECT k AS row_id, generate_subscripts(ch, 1) - 1 AS chunk_no, unnest(ch) AS chunk FROM {chunked('row_id', 'articles')}",
        "passages": f"WITH {_A} SELECT k AS id, generate_subscripts(ch, 1) - 1 AS chunk_no, 'passage: ' || title || chr(10) || unnest(ch) AS passage FROM {chunked('id', 'a')}",
        "content_segments": f"SELECT row_id, unnest(s) AS segment FROM (SELECT row_id, {parts} AS s FROM articles WHERE content IS NOT NULL)",
        "keyword_covered": f"""WITH {_A}, q AS (SELECT row_id, title, coalesce(array_to_string(tags[1:2], ' '), '') AS text FROM a WHERE tags IS NOT NULL),
w AS (SELECT row_id, list_transform({words('text')}, lambda w: {strip('w')}) AS nouns, {joined('lower(text)')} AS whole, list_transform({words('title')}, lambda w: {strip('w')}) AS tt, {joined('lower(title)')} AS tj FROM q)
SELECT row_id AS query_id, row_id, (length(whole) >= 2 AND contains(tj, whole)) OR (len(nouns) > 0 AND len(list_filter(nouns, lambda x: list_contains(tt, x) OR contains(tj, x))) / len(nouns) >= 0.6) AS covered FROM w""",
        "top10_agreement": f"WITH k0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS m FROM embeddings), k AS (SELECT id, v, {back} AS w FROM k0), {ten('x', 'v')}, {ten('y', 'w')}, g AS (SELECT q, count(*) FILTER ((q, id) IN (SELECT (q, id) FROM y)) / 10 AS s FROM x GROUP BY q) SELECT round(avg(s), 1) AS agreement, count(*) AS n FROM g",
        "beam_bfs": _beam(),
        "eval_items": f"WITH {_A} SELECT src AS query_id, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM (SELECT DISTINCT src, id FROM related WHERE src <> id) JOIN (SELECT id, row_id FROM a) USING (id) GROUP BY src",
        "related_articles": f"SELECT src, id, score, rank FROM (SELECT src, id, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, id) AS rank FROM ({_beam()})) WHERE rank <= 10",
    }
