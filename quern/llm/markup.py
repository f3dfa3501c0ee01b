"""Problem 5: markup residue out of texts, their structure kept.

Method: a tree-structured graphical model over a DOM.  A text is parsed into a
tree: the document, its paragraphs, and in them every sign that may be markup as a
node, under the element, cell, heading or emphasis that holds it.  The grammar
only proposes, and generously: ``#1``, ``<note>``, ``5 * 3`` and ``$30`` are
candidates like ``# head``, ``<p>``, ``*x*`` and ``$x^2$``.  A node has a hidden
state (markup or ordinary text) and shows features: its sign, whether it is
closed, known by name, followed by a blank, what a formula holds; a paragraph
shows how much of it is candidates and links.  Emissions and parent-child
potentials are trained from labelled pages (``labelled_pages``, written by rule
with the marked spans known); one sum-product pass up the tree and one down give
each node's marginal.  Nodes above one half are markup: they are rendered as clean
text, all else stays.

Defined results: null stays null, empty stays empty; line breaks inside a text
are kept one for one (a removed fence leaves an empty line), so a line number
means the same before and after; code is copied verbatim; very long texts and
unclosed constructs are read in linear time (no piece crosses a blank line but
code, comments and formulas).
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

# Element names of HTML, environments and argument roles of LaTeX.
HTML_TAGS = """a abbr acronym address area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col
colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head
header hr html i iframe img input ins kbd label legend li link main map mark meta meter nav noframes noscript object ol optgroup option output p param
picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea
tfoot th thead time title tr track tt u ul var video wbr""".split()
LATEX_MATH = "equation|align|gather|multline|eqnarray|displaymath|math"
LATEX_DROPPED = {"cite", "citep", "citet", "footnote", "footnotemark", "footnotetext", "includegraphics", "label", "ref", "eqref", "pageref", "index", "usepackage", "documentclass", "bibliography", "bibliographystyle", "vspace", "hspace", "centering", "maketitle", "tableofcontents", "newpage", "clearpage", "noindent"}
LATEX_FORMULAS = set("""frac dfrac tfrac cfrac binom sqrt sum prod int oint lim sin cos tan log ln exp max min inf sup cdot times div pm mp leq geq le ge neq ne approx equiv sim propto infty partial nabla forall exists in notin
subset subseteq cup cap to rightarrow leftarrow Rightarrow alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega""".split())
LATEX_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
WIKI_FILES = ("파일:", "그림:", "file:", "image:", "분류:", "category:")

_TAGS = "|".join(sorted(HTML_TAGS, key=len, reverse=True))
_GROUP = r"\{(?:[^{}\n]|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*\}"
#: What opens a stretch that is copied or dropped as a whole; its end is looked up by ``_Ends``, in linear time and at any distance.
_OPEN = re.compile(
    r"^[ \t]*(?P<fence>```+|~~~+)(?P<info>[^\n`~]*)\n"
    r"|(?P<pre><pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?)"
    r"|<(?P<wcode>syntaxhighlight|nowiki)\b[^<>]*>"
    r"|\\begin\{(?P<verb>verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\])?"
    r"|<(?P<drop>script|style)\b[^<>]*>"
    r"|(?P<comment><!--)"
    rf"|\\begin\{{(?P<menv>{LATEX_MATH})\*?\}}"
    r"|(?P<display>\\\[)"
    r"|(?P<dollars>\$\$)(?=[^$]+\$\$)",
    re.M | re.I,
)
_GRAMMAR = (
    r"(?P<lead>^[ \t]{1,3})?(?=[<&*_~`\[{|\\#=$>'!+-])(?:"
    r"(?(lead)|^)(?P<md_head>#{1,6}[ \t]+(?=\S))|(?(lead)|^)(?P<ps_hash>#(?=[^\s#]))"
    r"|(?(lead)|^)(?P<wiki_head>(?P<eq>={2,6})[ \t]*(?P<headtext>[^=\n]+?)[ \t]*(?P=eq)[ \t]*(?=\r?$))"
    r"|(?(lead)|^)(?P<md_setext>={3,}[ \t]*(?=\r?$))|(?(lead)|^)(?P<md_rule>(?:-{3,}|\*{3,}|_{3,})[ \t]*(?=\r?$))"
    r"|(?(lead)|^)(?P<md_delim>\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*(?=\r?$))|(?(lead)|^)(?P<md_delim1>\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*(?=\r?$))"
    r"|(?(lead)|^)(?P<wiki_open>\{\|[^\n]*)|(?(lead)|^)(?P<wiki_row>\|[-+}][^\n|]*(?=\r?$))"
    r"|(?(lead)|^)(?P<wiki_cells>[|!][^|\n]*(?:\|\||!!)[^\n]*)"
    r"|(?(lead)|^)(?P<md_row>\|(?:[^|\n]*\|)+[ \t]*(?=\r?$))"
    r"|(?(lead)|^)(?P<md_quote>>(?:[ \t]*>)*[ \t]?)|(?(lead)|^)(?P<ps_list>[*+](?=[ \t]))"
    r"|(?(lead)|^)(?P<md_fence>(?:```|~~~)[\w-]*[ \t]*(?=\r?$))"
    rf"|(?P<html_tag></?(?:{_TAGS})(?:[\s/][^<>]*)?>|<!doctype[^<>]*>)|(?P<ps_angle><(?!https?:|mailto:)[^<>\n]*>)"
    r"|(?P<html_ref>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)|(?P<ps_amp>&(?=\w))"
    r"|(?P<wiki_tpl>\{\{(?P<tpl>[^{}\n]*)\}\})"
    r"|(?P<wiki_link>\[\[(?P<wlink>[^\[\]\n]*)\]\])|(?P<wiki_ext>@wiki_ext@)"
    r"|(?P<md_image>@md_image@)|(?P<md_link>\[(?P<anchor>[^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:[ \t]+[^()\n]*)?\))"
    r"|(?P<md_auto><(?:https?|mailto):[^<>\s]+>)|(?P<md_foot>\[\^[^\]\s]+\])|(?P<ps_brk>\[\d+\])"
    r"|(?P<wiki_bold>'''(?P<wb>[^'\n](?:[^\n]*?[^'\n])?)''')|(?P<wiki_ital>''(?P<wi>[^'\n](?:[^\n]*?[^'\n])?)'')"
    r"|(?P<md_bold>@md_bold@)|(?P<md_ital>(?<![\w*])\*(?=[^\s*])(?P<i1>[^*\n]*?[^\s*]|[^\s*])\*(?!\*))"
    r"|(?P<ps_star>\*)"
    r"|(?P<md_under2>@md_under2@)|(?P<md_under>(?<![\w_])_(?=[^\s_])(?P<i2>[^_\n]*?[^\s_]|[^\s_])_(?!\w))|(?P<ps_under>_)"
    r"|(?P<md_strike>@md_strike@)|(?P<md_code>(?<!`)(?P<tick>`++)(?P<tt>[^`\n]++)(?P=tick)(?!`))"
    r"|(?P<tex_math>\$(?=[^\s$])(?P<fm>[^$\n]++)(?<![\s\\])\$(?!\d))|(?P<ps_money>\$)"
    rf"|(?P<tex_env>\\(?:begin|end)\{{[A-Za-z*]+\}}(?:\[[^\]\n]*\])?(?:\{{[^{{}}\n]*\}})?)"
    rf"|(?P<tex_paren>@tex_paren@)"
    rf"|(?P<tex_cmd>~?\\(?P<cmd>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?(?P<args>(?:{_GROUP})*))|(?P<tex_break>\\\\(?=[ \t]*\r?$))|(?P<ps_back>\\(?=\w))|(?P<ps_tilde>~(?=\w))|(?P<ps_eq>==+))"
)

#: Pairs whose end may be far: how they open, how they end, and how far behind the opening at least; looked up in linear time.
_PAIRS = {
    "wiki_ext": (r"\[(?:https?|ftp)://[^\s\]]+(?=[ \t\]])", r"\]", 0),
    "md_image": (r"!\[", r"\]", 0),
    "md_bold": (r"\*\*(?=[^\s*])", r"(?<=[^\s*])\*\*", 1),
    "md_under2": (r"(?<!\w)__(?=[^\s_])", r"(?<=[^\s_])__(?!_)", 1),
    "md_strike": (r"~~(?=\S)", r"(?<=\S)~~", 1),
    "tex_paren": (r"\\\(", r"\\\)", 0),
}
_LINE, _REST = (re.compile(re.sub("@(\\w+)@", lambda m: _PAIRS[m[1]][0] if every else "(?!)", _GRAMMAR), re.M | re.I) for every in (True, False))
_TARGET = re.compile(r"\([^()\s]*(?:[ \t]+[^()\n]*)?\)")
_ANY = re.compile(r"[<&*_~`\[{|\\#=$>]|''|^-{3}", re.M)
_LIST = re.compile(r"[ \t]*(?:[-*+·•][ \t]+|\d{1,3}[.)][ \t]+)")
_FORMULA = re.compile(r"[\\^_={}<>]|[-+*/]")
_NAMED = frozenset(html5)


#: The kind of markup and the sign of each candidate of ``_LINE``; the decision which of them are markup is the model's.
_SIGNS = {
    "md_head": "markdown #", "ps_hash": "markdown #", "wiki_head": "wiki =", "ps_eq": "wiki =", "md_setext": "markdown ===", "md_rule": "markdown ---", "md_delim": "markdown |-", "md_delim1": "markdown |-", "wiki_open": "wiki {|", "wiki_row": "wiki |-",
    "wiki_cells": "wiki ||", "md_row": "markdown |", "md_quote": "markdown >", "ps_list": "markdown *", "md_fence": "markdown ```", "html_tag": "html <", "ps_angle": "html <", "html_ref": "html &", "ps_amp": "html &", "wiki_tpl": "wiki {{", "wiki_link": "wiki [[",
    "wiki_ext": "wiki [", "ps_brk": "wiki [", "md_image": "markdown ![", "md_link": "markdown [", "md_auto": "markdown <", "md_foot": "markdown [^", "wiki_bold": "wiki '''", "wiki_ital": "wiki ''", "md_bold": "markdown **", "md_ital": "markdown *", "ps_star": "markdown *",
    "md_under2": "markdown __", "md_under": "markdown _", "ps_under": "markdown _", "md_strike": "markdown ~~", "md_code": "markdown `", "tex_math": "latex $", "ps_money": "latex $", "tex_env": "latex \\begin", "tex_paren": "latex \\(", "tex_cmd": "latex \\",
    "tex_break": "latex \\\\", "ps_back": "latex \\", "ps_tilde": "latex ~",
}
_SPLIT = {t: tuple(x.split()) for t, x in _SIGNS.items()}
_BARE = {"ps_hash", "md_head", "ps_eq", "ps_list", "ps_star", "ps_under", "ps_money", "ps_tilde", "ps_back", "ps_amp"}  # nothing closes them
_UNKNOWN = {"ps_angle", "ps_amp", "ps_back", "ps_brk"}  # no name of the kind's vocabulary
LINKS = {"[", "[[", "![", "<a"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}


class Node:
    """A candidate: its span, how it reads when it is markup, and what it shows to the model.

    ``parts`` are texts and spans of its own text (whose candidates are its
    children); ``inside`` is the node whose span holds it, ``parent`` its parent
    in the tree.
    """

    __slots__ = ("a", "b", "features", "inside", "kind", "line", "name", "parent", "parts", "role", "sign")

    def __init__(self, a: int, b: int, kind: str, sign: str, line: int, inside: int = -1) -> None:
        self.a, self.b, self.kind, self.sign, self.line, self.inside = a, b, kind, sign, line, inside
        self.parts: list = []
        self.role = self.name = None
        self.parent = 0
        self.features = (True, True, False, None)


def _breaks(s: str) -> str:
    return "\n" * s.count("\n")


class _Ends:
    """Where stretches end: each kind of end is found once in a text and then looked up."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.known: dict[str, tuple[list[int], list[int]]] = {}

    def after(self, pattern: str, at: int) -> tuple[int, int] | None:
        if pattern not in self.known:
            spans = [m.span() for m in re.finditer(pattern, self.text, re.M | re.I)]
            self.known[pattern] = [a for a, _ in spans], [b for _, b in spans]
        starts, ends = self.known[pattern]
        k = bisect_left(starts, at)
        return (starts[k], ends[k]) if k < len(starts) else None


def _stretches(text: str):
    """(match of _OPEN, start of the end, end) of every closed stretch, left to right."""
    ends, at = _Ends(text), 0
    while m := _OPEN.search(text, at):
        g = m.group
        if g("fence"):
            stop = ends.after(rf"^[ \t]*{g('fence')}[ \t]*(?=\r?$)", m.end())
        elif g("pre"):
            stop = ends.after(r"(?:</code>\s*)?</pre\s*>", m.end())
        elif g("wcode") or g("drop"):
            stop = ends.after(rf"</{(g('wcode') or g('drop')).lower()}\s*>", m.end())
        elif g("verb") or g("menv"):
            stop = ends.after(rf"\\end\{{{(g('verb') or g('menv')).lower()}\*?\}}", m.end())
        elif g("comment"):
            stop = ends.after("-->", m.end())
        elif g("display"):
            stop = ends.after(r"\\\]", m.end())
            blank = ends.after(r"\n\s*\n", m.start())
            if stop and blank and blank[0] < stop[0]:
                stop = None
        else:
            stop = ends.after(r"\$\$", m.end())
        if stop:
            yield m, *stop
            at = stop[1]
        else:
            at = m.start() + 1


def _pair_end(s: str, m: re.Match, ends: _Ends) -> tuple[int, int] | None:
    """(end of what a pair holds, its own end), on the line where it opens."""
    _, close, gap = _PAIRS[m.lastgroup]
    stop, line = ends.after(close, m.end() + gap), ends.after("\n", m.end())
    if stop is None or line and line[0] < stop[0]:
        return None
    if m.lastgroup == "wiki_ext":
        return None if s[stop[1] : stop[1] + 1] == "(" else stop
    if m.lastgroup == "md_image":
        target = _TARGET.match(s, stop[1])
        return (stop[0], target.end()) if target else None
    return stop


def _scan(s: str, base: int, line: int, inside: int, out: list[Node]) -> None:
    """Adds the candidates of a stretch ``s`` at ``base``, each before those that it holds."""
    at = pos = 0
    ends = _Ends(s)
    while m := _LINE.search(s, pos):
        t = m.lastgroup
        a, b = m.span()
        if t in _PAIRS:
            stop = _pair_end(s, m, ends)
            if stop is None:
                m = _REST.match(s, a)
                if m is None:
                    pos = a + 1
                    continue
                t, b = m.lastgroup, m.end()
            else:
                x, y, b = m.end(), *stop
        # lastgroup names the last group that closed: the outer one, as it closes after what it holds
        g, pos = m.group, b
        line += s.count("\n", at, a)
        at = a
        n = Node(base + a, base + b, *_SPLIT[t], line, inside)
        me = len(out)
        out.append(n)

        def hold(x: int, y: int, n=n, me=me, line=line) -> tuple[int, int]:
            if x >= 0 and _ANY.search(s, x, y):
                _scan(s[x:y], base + x, line, me, out)
            return base + x, base + y

        closed, known, blank, more = t not in _BARE, t not in _UNKNOWN, False, None
        if t in ("md_head", "ps_hash"):
            blank = t == "md_head"
            n.role = f"heading{g().count('#')}"
        elif t == "wiki_head":
            n.role, n.parts = f"heading{len(g('eq'))}", [hold(*m.span("headtext"))]
        elif t == "md_setext":
            n.role = "underline"
        elif t in ("md_delim", "md_delim1", "wiki_open", "wiki_row"):
            n.role = "rule"
        elif t in ("wiki_cells", "md_row"):
            n.role = "table"
            whole = g().strip()
            x = a + g().index(whole)
            y = x + len(whole)
            if t == "wiki_cells":
                x, sep = x + 1, re.compile(r"\|\||!!")
            else:
                x, y, sep = x + len(whole) - len(whole.lstrip("|")), y - len(whole) + len(whole.rstrip("|")), re.compile(r"\|")
            edges = [x, *(e for c in sep.finditer(s, x, y) for e in c.span()), y]
            for k in range(0, len(edges), 2):
                cell = s[edges[k] : edges[k + 1]]
                lead = len(cell) - len(cell.lstrip())
                n.parts += ([" | "] if k else []) + [hold(edges[k] + lead, edges[k] + lead + len(cell.strip()))]
        elif t == "md_quote":
            n.role = "quote"
        elif t == "ps_list":
            blank = True
        elif t == "html_tag":
            n.name = re.match(r"</?!?(\w+)", g())[1].lower()
            if g()[1] == "/":
                n.name = "/" + n.name
            n.role = {"li": "list", "blockquote": "quote", "tr": "table", "td": "table"}.get(n.name) or (f"heading{n.name[1]}" if re.fullmatch(r"h[1-6]", n.name) else None)
            n.parts = [_breaks(g()) or (" " if n.name.lstrip("/") in ("br", "td", "th", "img", "hr") else "")]
        elif t == "html_ref":
            known = g()[1] == "#" or g()[1:] in _NAMED
            n.parts = [unescape(g()).replace("\xa0", " ")]
        elif t == "wiki_tpl":
            name, bar, rest = g("tpl").partition("|")
            if name.strip().lower() in ("인용", "인용문", "quote", "blockquote"):
                n.role = "quote"
            x = m.start("tpl") + len(name) + len(bar)
            for k, part in enumerate(rest.split("|") if bar else []):  # parameters without a name are text
                if "=" not in part:
                    n.parts += ([" "] if n.parts else []) + [hold(x, x + len(part))]
                x += len(part) + 1
        elif t == "wiki_link":
            x, y = m.span("wlink")
            n.parts = [] if g("wlink").lower().startswith(WIKI_FILES) else [hold(x + g("wlink").rfind("|") + 1, y)]
        elif t == "wiki_ext":
            lead = len(s[x:y]) - len(s[x:y].lstrip(" \t"))
            n.parts = [hold(x + lead, y)] if lead and x + lead < y else []
        elif t == "md_link":
            n.parts = [hold(*m.span("anchor"))]
        elif t == "md_auto":
            n.parts = [(base + a + 1, base + b - 1)]
        elif t in ("md_bold", "md_under2", "md_strike"):
            n.parts = [hold(x, y)]
        elif t in ("md_ital", "md_under", "wiki_bold", "wiki_ital"):
            n.parts = [hold(*m.span({"md_ital": "i1", "md_under": "i2", "wiki_bold": "wb", "wiki_ital": "wi"}[t]))]
        elif t == "md_code":
            x, y = m.span("tt")
            n.role, n.parts = "code", [(base + x, base + y)]
        elif t == "tex_math":
            x, y = m.span("fm")
            n.role, n.parts = "formula", [(base + x, base + y)]
            more = bool(_FORMULA.search(s, x, y)), y - x <= 2, bool(re.match(r"\d[\d.,]*\s", g("fm")))
        elif t == "tex_paren":
            n.role, n.parts = "formula", [s[x:y].strip()]
        elif t == "tex_cmd":
            cmd = g("cmd").lower()
            if g("cmd") in LATEX_FORMULAS:
                n.role, n.parts = "formula", [(base + a, base + b)]
            elif cmd not in LATEX_DROPPED:
                n.role = f"heading{LATEX_HEADS[cmd]}" if cmd in LATEX_HEADS else "list" if cmd == "item" else None
                groups = [x.span() for x in re.compile(_GROUP).finditer(s, *m.span("args"))]
                n.parts = [hold(groups[-1][0] + 1, groups[-1][1] - 1)] if groups else ["-"] if cmd == "item" else []
        n.features = closed, known, blank, more


def _tree(nodes: list[Node], text: str) -> list[tuple[int, int]]:
    """Sets every node's parent: the node that holds it, else the open element around it, else its paragraph.

    Places in the tree: 0 the document, then the paragraphs that have a
    candidate, then the nodes.  Returns each paragraph's bins: how much of it is
    candidates, and how many of those are links.
    """
    gaps = [m.start() for m in re.finditer(r"\n[ \t\r]*(?=\n)", text)]
    own, blocks = [], {}
    for n in nodes:
        k = bisect_left(gaps, n.a)
        own.append(blocks.setdefault(k, len(blocks)))
    shift = 1 + len(blocks)
    held, links, seen = [0] * len(blocks), [0] * len(blocks), [0] * len(blocks)
    open_: list[tuple[str, int]] = []
    names: Counter = Counter()
    for i, n in enumerate(nodes):
        p = own[i]
        seen[p] += 1
        links[p] += n.sign in LINKS or n.name == "a"
        if n.inside >= 0:
            n.parent = shift + n.inside
            continue
        held[p] += n.b - n.a
        n.parent = shift + open_[-1][1] if open_ else 1 + p
        if n.name and n.name[0] == "/":
            if names[n.name[1:]]:
                while True:
                    name, _ = open_.pop()
                    names[name] -= 1
                    if name == n.name[1:]:
                        break
        elif n.name and n.name not in VOID and text[n.b - 2] != "/":
            open_.append((n.name, i))
            names[n.name] += 1
    bins = []
    edges = [0, *gaps, len(text)]
    for k, p in blocks.items():
        size = max(1, edges[k + 1] - edges[k])
        share = held[p] / size
        bins.append((0 if share < 0.05 else 1 if share < 0.2 else 2 if share < 0.5 else 3, 0 if not links[p] else 1 if 2 * links[p] < seen[p] else 2))
    return bins


def parse(text: str) -> list[Node]:
    """All candidates of a text, each before those that it holds; what stands in code or formulas belongs to that block."""
    if not _ANY.search(text):
        return []
    out: list[Node] = []
    at = line = 0
    for m, stop, end in _stretches(text) if re.search(r"```|~~~|<pre|<!--|\\begin|\\\[|\$\$|<s|<nowiki", text, re.I) else ():
        if m.start() > at:
            _scan(text[at : m.start()], at, line, -1, out)
        line += text.count("\n", at, m.start())
        g, body = m.group, (m.end(), stop)
        inner = text[slice(*body)]
        if g("fence"):
            n = Node(m.start(), end, "markdown", "```", line)
            n.role, n.parts = "code", ["\n" + inner.rstrip("\n") + ("\n" if inner else "")]
        elif g("pre"):
            n = Node(m.start(), end, "html", "<pre", line)
            n.role, n.parts = "code", [_breaks(g("pre")) + inner + _breaks(text[stop:end])]
        elif g("wcode"):
            n = Node(m.start(), end, "wiki", "<code", line)
            n.role, n.parts = "code", [inner]
        elif g("verb"):
            n = Node(m.start(), end, "latex", "\\begin", line)
            n.role, n.parts = "code", [inner]
        elif g("drop") or g("comment"):
            n = Node(m.start(), end, "html", "<!--", line)
            n.parts = [_breaks(text[m.start() : end])]
        else:
            n = Node(m.start(), end, "latex", "\\[", line)
            n.role, n.parts = "formula", [inner]
        n.parts.append("\n" * max(0, text.count("\n", m.start(), end) - n.parts[0].count("\n")))
        out.append(n)
        line += text.count("\n", m.start(), end)
        at = end
    if at < len(text):
        _scan(text[at:], at, line, -1, out)
    return out


# --- labelled pages ---------------------------------------------------------------------------

_WORDS = "river stone lantern harbour window 바다 나무 편지 골목 햇빛 구름 기차 시장 노래 겨울".split()
#: How each kind is written: ① and ② are words, a piece of markup stands between ‹ and ›.
_WRITTEN = {
    "html": ["‹<p>›① ②‹</p>›", "① ‹<b>›②‹</b>› ①", "①‹<br/>›", "①‹<br>›②", "①‹&nbsp;›②", "①‹&amp;›② ‹&#39;›①", "‹<h2>›①‹</h2>›", '‹<a href="/x/1">›①‹</a>› ②', "‹<!-- ① -->›", "‹<ul>›\n‹<li>›①‹</li>›\n‹<li>›② ‹<i>›①‹</i>›‹</li>›\n‹</ul>›", "‹<pre><code>\n①\n</code></pre>›", '‹<img src="1.png"/>›', '‹<div class="a">›\n①\n‹</div>›', "‹<table>›‹<tr>›‹<td>›①‹</td>›‹</tr>›‹</table>›", "‹<script>①</script>›", "①‹</p>›", "‹<blockquote>›①‹</blockquote>›", "‹<!doctype html>›"],
    "markdown": ["‹# ›① ②", "‹## ›①", "‹**①**› ②", "② ‹*①*› ②", "‹**① ‹*②*› ①**›", "‹[①](/x/1)› ②", "‹![①](/x/1.png)›", "‹> ›① ②", "‹`①`› ②", "‹~~①~~› ②", "‹__①__› ②", "‹```\n①\n```›", "‹```py\nx = 1\n```›", "①\n‹=====›", "‹| ① | 1 |›\n‹|---|---|›\n‹| ‹**②**› | 2 |›", "‹*① ② ①*›", "‹_①_› ②", "‹---›", "‹<https://x.example/1>› ①", "①‹[^1]›", "‹```›", "* ‹**①**› ②"],
    "wiki": ["‹== ① ==›", "‹=== ① ===›", "‹'''①'''› ②", "‹''①''› ②", "‹[[①]]› ②", "‹[[①|②]]› ①", "‹[https://x.example/1 ①]› ②", "‹{{①|②}}›", "‹{|›\n‹|-›\n‹| ① || ‹'''②'''››\n‹|}›", '‹{| class="x"›\n‹! ① !! ②›\n‹|}›', "‹[[파일:1.png|①]]›", "‹<nowiki>①</nowiki>›", "‹'''‹[[①]]›'''›"],
    "latex": ["‹\\section{①}›", "‹\\emph{①}› ②", "‹\\textbf{① ‹\\emph{②}›}›", "①‹~\\cite{a}› ②", "①‹\\footnote{②}›", "‹$x^2 + 1$› ①", "‹$x$› ①", "‹$a_1 = 3$› ①", "‹$2 \\pi$› ①", "‹\\[ a = b \\]›", "‹$$ a = b $$›", "‹\\begin{itemize}›\n‹\\item› ①\n‹\\end{itemize}›", "① ‹\\\\›", "‹\\begin{equation}\nx\n\\end{equation}›", "‹\\(x\\)›", "‹\\begin{verbatim}\n①\n\\end{verbatim}›", "‹\\frac{a}{b}› ①"],
}
_PROSE = ["① ②", "① ② ①.", "* ① ②", "+ ①", "- ①", "1. ①", "5 * 3 * 2 ①", "<①> ②", "Q&A ①", "low_①_case", "$30 ①", "50% ①", "#1 ①", "#①", "[1] ①", "if x == y ①", "\\자료 ①", "~라고 ①", "3~5 ①", "x_2 ①", "<① ②>이라는 ①", "①_②", "AT&T ①", "a < b 이고 b > c", "R&D; ①", "$30 ① ②$ ①", "$① ② ①$ ②", "C:\\자료\\그림 ①", "* ①\n* ②\n* ①", "== ①"]


def labelled_pages(n: int = 800, seed: int = 7):
    """Pages by rule: (text, the spans of each kind's markup). A quarter has none, a quarter one leftover."""
    rng = random.Random(seed)
    for k in range(n):
        out, marked, size = [], defaultdict(set), 0
        styles = [] if k % 4 == 0 else rng.sample(KINDS, 1 if k % 4 < 3 else 2)
        spots = set(rng.sample(range(12), 1 if k % 4 == 1 else 6)) if styles else set()
        for i in range(12):
            style = rng.choice(styles) if i in spots else None
            new = rng.choice(_WRITTEN[style] if style else _PROSE).replace("①", rng.choice(_WORDS)).replace("②", rng.choice(_WORDS))
            for ch in new + rng.choice(["\n", "\n\n"]):
                if ch == "‹":
                    marked[style].add(size)
                elif ch != "›":
                    out.append(ch)
                    size += 1
        yield "".join(out), marked


def _like(x: float) -> float:
    return min(max(x, 1e-12), 1.0)


class TreeModel:
    """Emissions of nodes and paragraphs, and P(child | parent) for document > paragraph > node > node."""

    def __init__(self, weight: float = 2.0) -> None:
        whole, single = (Counter(), Counter()), (Counter(), Counter())
        blocks, moves, docs = (Counter(), Counter()), Counter(), Counter()
        for text, marked in labelled_pages():
            nodes = parse(text)
            bins = _tree(nodes, text)
            states = [int(any(marked.values()))] + [0] * len(bins)
            for n in nodes:
                y = int(n.a in marked[n.kind])
                states.append(y)
                whole[y][n.kind, n.sign, n.features] += 1
                for k, x in enumerate(n.features):
                    single[y][n.kind, n.sign, k, x] += 1
                single[y][n.kind, n.sign] += 1
            shift = 1 + len(bins)
            for i in range(len(nodes) - 1, -1, -1):
                p = nodes[i].parent
                while p >= shift:
                    p = nodes[p - shift].parent
                states[p] |= states[shift + i]
            docs[states[0]] += 1
            for k, x in enumerate(bins):
                blocks[states[1 + k]][x] += 1
                moves["block", states[0], states[1 + k]] += 1
            for i, n in enumerate(nodes):
                moves[self._relation(nodes, n, shift), states[n.parent], states[shift + i]] += 1
        self.total = [sum(c.values()) for c in whole]
        self.whole, self.single, self.weight = whole, single, weight
        rows = lambda key: tuple(tuple((moves[key, a, b] + 0.5) / (moves[key, a, 0] + moves[key, a, 1] + 1) for b in (0, 1)) for a in (0, 1))
        self.moves = {k: rows(k) for k in ("block", "top", "same", "other")}
        n = [sum(c.values()) for c in blocks]
        self.blocks = {(i, j): tuple((blocks[y][i, j] + 0.5) / (n[y] + 6) for y in (0, 1)) for i in range(4) for j in range(3)}
        self.doc = tuple((docs[d] + 0.5) / (docs[0] + docs[1] + 1) for d in (0, 1))
        self.emit: dict = {}

    @staticmethod
    def _relation(nodes: list[Node], n: Node, shift: int) -> str:
        return "top" if n.parent < shift else "same" if nodes[n.parent - shift].kind == n.kind else "other"

    def emission(self, n: Node) -> tuple[float, float]:
        """P(what a node shows | its state): how often it was seen as a whole, backed by its features one by one."""
        key = n.kind, n.sign, n.features
        if key not in self.emit:
            out = []
            for y in (0, 1):
                seen = self.single[y][n.kind, n.sign]
                alone = (seen + 0.05) / (self.total[y] + 1)
                for k, x in enumerate(n.features):
                    alone *= (self.single[y][n.kind, n.sign, k, x] + 0.05) / (seen + 0.1)
                out.append((self.whole[y][key] + self.weight * alone) / (self.total[y] + self.weight))
            self.emit[key] = tuple(out)
        return self.emit[key]

    def marginals(self, nodes: list[Node], bins: list[tuple[int, int]]) -> list[float]:
        """P(markup) of each node by sum-product: from the leaves to the document, and back."""
        shift = 1 + len(bins)
        up = [self.doc, *(self.blocks[x] for x in bins), *map(self.emission, nodes)]
        parents = [0] * shift + [n.parent for n in nodes]
        tables = [None] + [self.moves["block"]] * len(bins) + [self.moves[self._relation(nodes, n, shift)] for n in nodes]
        sent: list = [None] * len(up)
        for i in range(len(up) - 1, 0, -1):
            t, (x0, x1) = tables[i], up[i]
            m0, m1 = t[0][0] * x0 + t[0][1] * x1, t[1][0] * x0 + t[1][1] * x1
            sent[i] = m0, m1 = _like(m0 / (m0 + m1)), _like(m1 / (m0 + m1))
            p0, p1 = up[parents[i]]
            p0, p1 = p0 * m0, p1 * m1
            up[parents[i]] = _like(p0 / (p0 + p1)), _like(p1 / (p0 + p1))
        belief = [up[0]]
        for i in range(1, len(up)):
            t, (m0, m1), (b0, b1), (x0, x1) = tables[i], sent[i], belief[parents[i]], up[i]
            c0, c1 = b0 / m0, b1 / m1
            y0, y1 = (c0 * t[0][0] + c1 * t[1][0]) * x0, (c0 * t[0][1] + c1 * t[1][1]) * x1
            belief.append((_like(y0 / (y0 + y1)), _like(y1 / (y0 + y1))))
        return [b[1] for b in belief[shift:]]


@lru_cache(1)
def model() -> TreeModel:
    return TreeModel()


def judged(text: str) -> tuple[list[Node], list[float]]:
    """The candidates of a text and the marginal of each."""
    nodes = parse(text)
    return (nodes, model().marginals(nodes, _tree(nodes, text))) if nodes else ([], [])


def kinds(text: str | None) -> list[str]:
    """The kinds of markup that a text holds."""
    if not text:
        return []
    return sorted({n.kind for n, x in zip(*judged(text), strict=True) if x > 0.5})


def clean(text: str | None, found: tuple[list[Node], list[float]] | None = None) -> str | None:
    """``text`` without its markup, with as many lines as before."""
    if not text:
        return text
    nodes, p = judged(text) if found is None else found
    if not any(x > 0.5 for x in p):
        return text
    held: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(nodes):
        held[n.inside].append(i)

    def render(a: int, b: int, own: list[int], out: list[str]) -> None:
        for i in own:
            n = nodes[i]
            if n.a < a or n.b > b:
                continue
            out.append(text[a : n.a])
            if p[i] <= 0.5:
                if held[i]:
                    render(n.a, n.b, held[i], out)
                else:
                    out.append(text[n.a : n.b])
            else:
                for part in n.parts:
                    if isinstance(part, str):
                        out.append(part)
                    else:
                        render(*part, held[i], out)
            a = n.b
        out.append(text[a:b])

    out: list[str] = []
    render(0, len(text), held[-1], out)
    return "".join(out)


def blocks(text: str | None) -> list[tuple[str, str]] | None:
    """(role, clean text) of every block in order: paragraph, headingN, list, quote, table, code or formula."""
    if text is None:
        return None
    found = judged(text)
    roles: dict[int, str] = {}
    for n, x in zip(*found, strict=True):
        if x > 0.5 and n.role and n.sign not in ("`", "$", "\\(", "\\") or x > 0.5 and n.sign == "\\" and n.role and n.role != "formula":  # those stand within a line
            last = n.line + text.count("\n", n.a, n.b)
            if n.role == "underline":
                roles[n.line - 1] = "heading1"
            else:
                for ln in range(n.line, last + 1):
                    roles.setdefault(ln, n.role)
    out: list[tuple[str, str]] = []
    gap = True
    for i, ln in enumerate(clean(text, found).split("\n")):
        role = roles.get(i, "paragraph")
        ln = ln.rstrip() if role == "code" else ln.strip()
        if role == "paragraph" and _LIST.match(ln):
            role = "list"
        if not ln or role == "rule":
            gap = role != "rule"
            continue
        if role in ("paragraph", "code", "table", "formula") and out and out[-1][0] == role and (not gap or role == "code"):
            out[-1] = (role, out[-1][1] + "\n" + ln)
        else:
            out.append((role, ln))
        gap = False
    return out


def markup_kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, kind) for each kind of markup that a text holds; null and empty texts hold none."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            at, names = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                for k in kinds(x):
                    at.append(i)
                    names.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string())], names=[key, "kind"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, kind string")


def clean_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, clean_text, blocks) of every row; null texts give null, empty ones an empty text and no block."""
    kind = dict(df.dtypes)[key]
    block = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            all_ = [blocks(x) for x in b.column(1).to_pylist()]
            flat = [None if x is None else "\n\n".join(t for _, t in x) for x in all_]
            rows = [None if x is None else [{"role": r, "text": t} for r, t in x] for x in all_]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flat, pa.string()), pa.array(rows, block)], names=[key, "clean_text", "blocks"])

    return df.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, clean_text string, blocks array<struct<role:string,text:string>>")


def markup_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, inside, kind, sign, markup): every candidate of every text, the candidate that holds it (-1 for none), and its marginal."""
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                for k, (n, p) in enumerate(zip(*judged(x), strict=True)) if x else ():
                    at.append(i)
                    rows.append((k, n.inside, n.kind, n.sign, round(p, 6)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64()), strict=True))], names=[key, "node", "inside", "kind", "sign", "markup"])

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, node int, inside int, kind string, sign string, markup double")
