"""Clean text from HTML, Markdown, wiki and LaTeX markup (problem 1).

What comes out is Org text: headings with stars, list items with hyphens, code
between begin_src and end_src, formulas between \\( \\) or \\[ \\], inline code
between equal signs, links as [[target][name]]. Org's own syntax, and all that
stands inside =verbatim= or ~code~, is set aside first and put back untouched.

HTML goes through the standard library's streaming parser, event by event;
only tags of HTML (and of wiki pages) count, anything else in angle brackets
is text. Lists keep their nesting and numbers. Of a text with tags the ratio
of text to tags of each line is smoothed by a Gaussian and clustered in two;
the regions of the low cluster are left out where their lines hold next to no
text or only links (empty shells and navigation), and kept where they are part
of a structure.

LaTeX environments are paired in one pass: code ones become source blocks,
those of formulas stay as they are, lists are numbered and nested. Commands
and templates inside each other are converted from the inside out.

A null text stays null, an empty one empty; a text without markup is returned
as it is. Repeated rows give repeated results. Texts are read whole.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags of HTML and of wiki pages.
TAGS = frozenset(
    "a abbr address article aside audio b base big blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em "
    "embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map "
    "mark meta nav noscript object ol optgroup option p param pre progress q s samp script section select small source span strike strong style sub summary "
    "sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr gallery includeonly math noinclude nowiki poem ref references".split()
)
#: Names of the category namespace of wikis in the eight languages.
NAMESPACES = "category|kategorie|catégorie|categoría|categorie|categoria|kategori|категория"
#: LaTeX commands that stand without an argument.
BARE = (
    "alpha|beta|gamma|delta|epsilon|varepsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|varphi|chi|psi|omega|Gamma|Delta|Theta|"
    "Lambda|Xi|Pi|Sigma|Phi|Psi|Omega|item|ldots|dots|cdots|cdot|times|leq|geq|neq|approx|equiv|infty|sum|prod|int|partial|nabla|forall|exists|in|subset|cup|"
    "cap|to|rightarrow|leftarrow|Rightarrow|pm|quad|qquad|newline|newpage|par|noindent|hline|centering|maketitle|tableofcontents|LaTeX|TeX|bigskip|medskip|"
    "smallskip|small|large|bfseries|itshape|left|right"
)

_BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "table", "tr", "ul", "ol", "dl", "dt", "dd", "li", "br", "hr", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "title", "figure", "figcaption", "caption", "form", "tbody", "thead", "details", "summary"}

#: Items of lists nested deeper than this are shown at this depth.
_DEEPEST = 20
_CODE = {"code", "tt", "kbd", "samp"}

# Org's own: verbatim and code, links without a bar, stamps, addresses, plain URLs, blocks and keyword lines
_ORG = re.compile(
    r"^#\+begin_(?P<kind>\w+)[^\n]*\n(?:(?!^#\+begin_).)*?^#\+end_(?P=kind)[ \t]*$|^#\+[^\n]*$"
    r"|(?:(?<=[\s\-('\"{])|^)(?P<mark>[=~])(?!(?P=mark))(?=\S)(?:[^\n]*?\S)??(?P=mark)(?=$|[\s\-.,;:!?'\")}\]\\])"
    rf"|\[\[(?!(?:{NAMESPACES})[ \t]*:)[^\[\]|\n]+\](?:\[[^\[\]|\n]*\])?\]"
    r"|[<\[]\d{4}-\d\d-\d\d[^<>\[\]\n]*[>\]]|<[^<>\s@]+@[^<>\s@]+>|(?:(?<=\s)|(?<=<)|^)https?://[^\s<>\]]+",
    re.M | re.S | re.I,
)
# every construct holds one of these, so a text without them has none
_HINT = re.compile(r"[<&\\`$*_~\[{|=#]|''|^>", re.M)

_MATH = r"\\(?:leq|geq|cdot|frac|sqrt|sum)|[\\^_={}+]"
#: The constructs of each syntax other than HTML.
_CODE_ENV = "verbatim|Verbatim|lstlisting|minted|alltt"
_FORMULA_ENV = "equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign|split"
CONSTRUCTS: dict[str, re.Pattern] = {
    "latex code": re.compile(rf"\\begin\{{(?:{_CODE_ENV})\*?\}}"),
    "latex formula": re.compile(rf"\\begin\{{(?:{_FORMULA_ENV})\*?\}}"),
    "latex list": re.compile(r"(?<![ \t])[ \t]*(?:\\(?P<end>begin|end)\{(?P<kind>itemize|enumerate|description)\}(?:\[[^\[\]\n]*\])?|\\item(?![a-zA-Z])[ \t]*(?:\[(?P<a>[^\[\]\n]*)\])?[ \t]*)"),
    "markdown fence": re.compile(r"^[ \t]*(?P<f>```+|~~~+)[ \t]*(?P<lang>[\w+-]*)[ \t]*\n(?P<code>.*?)(?:^[ \t]*(?P=f)[ \t]*$|\Z)", re.M | re.S),
    "latex environment": re.compile(r"\\(?:begin|end)[ \t]*\{[^{}\n]*\}"),
    "latex display": re.compile(r"\$\$(?P<a>[^$]+)\$\$|\\\[(?P<b>(?:(?!\\\[).)+?)\\\]", re.S),
    "latex inline": re.compile(rf"\\\((?P<a>(?:(?!\\\().)+?)\\\)|(?<![\w$\\])\$(?P<b>[a-zA-Z]|(?![\s\d])(?=[^$\n]*(?:{_MATH}))[^$\n]+?(?<!\s))\$(?![\d$])"),
    "latex heading": re.compile(r"\\(?P<level>part|chapter|section|subsection|subsubsection|paragraph|title)\*?[ \t]*\{(?P<a>[^{}\n]*)\}"),
    "latex command": re.compile(rf"(?<![\w\\:])\\(?P<name>[a-zA-Z]+)\*?(?:[ \t]*\[[^\[\]\n]*\])?(?:\{{(?P<a>[^{{}}\n]*)\}})+|(?<![\w\\:])\\(?P<bare>{BARE})(?![a-zA-Z\\])"),
    "latex escape": re.compile(r"(?<![\\\w:])\\(?P<a>[%&$#_{}])|(?<=\d)\\,\\?(?P<b>%?)"),
    "latex quotes": re.compile(r"``(?P<a>[^`'\n]+)''"),
    "markdown heading": re.compile(r"^(?P<h>#{1,6})[ \t]+(?P<a>\S[^\n]*)$", re.M),
    "markdown underlined": re.compile(r"^(?=[^\n=|]*+\n={3,}[ \t]*$)(?=[^\w\n=|]*\w)(?P<a>[^\n=|]++)\n={3,}[ \t]*$", re.M),
    "markdown table": re.compile(r"^[ \t]*+(?:\|[ \t]*+)?:?-{2,}+:?[ \t]*+(?:\|[ \t]*+:?-{2,}+:?[ \t]*+)+(?:\|[ \t]*+)?$", re.M),
    "markdown rule": re.compile(r"^[ \t]*(?:\*[ \t]*){3,}$|^[ \t]*_{3,}[ \t]*$", re.M),
    "markdown quote": re.compile(r"^>[ \t]?(?P<a>[^\n]*)$", re.M),
    "markdown definition": re.compile(r"^[ ]{0,3}\[(?P<n>[^\[\]\n]+)\]:[ \t]+(?P<a>\S+)[^\n]*$", re.M),
    "markdown link": re.compile(r"(?<!\w)(?P<i>!?)\[(?P<a>[^\[\]\n]*)\]\((?P<b>[^()\s]+)(?:[ \t]+\"[^\"\n]*\")?\)"),
    "markdown reference": re.compile(r"(?<![\w\]])\[(?P<a>[^\[\]\n]+)\]\[(?P<b>[^\[\]\n]*)\]|\[\^(?P<n>[^\[\]\n]+)\]"),
    "markdown code": re.compile(r"(?<!`)`(?P<a>[^`\n]+)`(?!`)"),
    "markdown strong": re.compile(r"(?<![\w*])\*\*(?=[^\s*])(?P<a>[^*\n]+?)(?<=\S)\*\*(?![\w*])"),
    "markdown underline": re.compile(r"(?<!\w)__(?=[^\s_])(?P<a>(?:[^\n_]|_(?!_))+)(?<=[^\s_])__(?!\w)"),
    "markdown strike": re.compile(r"(?<![~\w])~~(?=[^\s~])(?P<a>[^~\n]+?)(?<=\S)~~(?![~\w])"),
    "wiki heading": re.compile(r"^(?P<h>={2,6})(?!=)(?P<a>[^\n]*[^\n=])(?P=h)[ \t]*$", re.M),
    "wiki emphasis": re.compile(r"(?<!')'''(?=[^\s'])(?P<a>[^'\n]+?)'''(?!')|(?<![`'\w])''(?=[^\s',.;:)])(?P<b>[^`'\n]+?)''(?!')"),
    "wiki category": re.compile(rf"\[\[[ \t]*(?:{NAMESPACES})[ \t]*:[^\[\]\n]*\]\]", re.I),
    "wiki link": re.compile(r"\[\[(?P<b>[^\[\]|\n]*)\|(?P<a>[^\[\]\n]*)\]\]"),
    "wiki external": re.compile(r"(?<!\[)\[(?P<b>https?://[^\s\]]+)[ \t]+(?P<a>[^\[\]\n]+)\]"),
    "wiki template": re.compile(r"\{\{(?P<a>[^{}\n]+)\}\}"),
    "wiki table": re.compile(r"^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[ \t]*(?:\w+=[^\n]*)?$", re.M),
    "wiki switch": re.compile(r"^#REDIRECT\b|(?<!\w)__[A-Z]{3,}__(?!\w)", re.M),
}
#: What is converted before HTML is read, for nothing inside is markup.
_FIRST = ("markdown fence", "latex code", "latex formula")
#: What may stand inside another one of its kind.
_NESTED = ("latex command", "wiki template")
_ENVIRONMENT = re.compile(r"\\(?P<end>begin|end)\{(?P<name>[^{}\n]*)\}")
_WIKI_ROW = re.compile(r"^[!|][ \t]*(?P<a>[^\n]*)$", re.M)


class _Mask:
    """Pieces set aside, each under one private character pair."""

    def __init__(self):
        self.kept: list[str] = []

    def hide(self, piece: str) -> str:
        self.kept.append(piece)
        return f"\ue0f0{len(self.kept) - 1}\ue0f1"

    def show(self, text: str) -> str:
        while "\ue0f0" in text:
            shown = re.sub("\ue0f0(\\d+)\ue0f1", lambda m: self.kept[int(m.group(1))] if int(m.group(1)) < len(self.kept) else m.group(0).strip("\ue0f0\ue0f1"), text)
            if shown == text:
                break
            text = shown
        return text


class _Events(HTMLParser):
    """Text, and counts per source line, from the parser's events."""

    def __init__(self, mask: _Mask):
        super().__init__(convert_charrefs=False)
        self.mask, self.out, self.found = mask, [], []
        self.tags: dict[int, int] = {}
        self.chars: dict[int, int] = {}
        self.links: dict[int, list[int]] = {}  # line -> links, and characters inside them
        self.structure: set[int] = set()
        self.silent, self.pre, self.code, self.href = 0, 0, 0, []
        self.lists: list[int | None] = []  # open lists: the number of the last item, None without numbers

    def _say(self, text: str) -> None:
        if not self.silent:
            line = self.getpos()[0]
            for k, part in enumerate(text.split("\n")):
                self.chars[line + k] = self.chars.get(line + k, 0) + len(part.strip())
                if self.href:
                    self.links.setdefault(line + k, [0, 0])[1] += len(part.strip())
            self.out.append(text)

    def _tag(self, tag: str, kind: str) -> bool:
        if tag not in TAGS:
            return False
        line = self.getpos()[0]
        self.found.append(f"html {kind}")
        self.tags[line] = self.tags.get(line, 0) + 1
        if tag in ("li", "td", "th", "tr", "table", "pre", "code", "img") or re.fullmatch("h[1-6]", tag):
            self.structure.add(line)
        return True

    def handle_starttag(self, tag, attrs):
        if not self._tag(tag, "tag"):
            return self._say(self.get_starttag_text())
        at = dict(attrs)
        if tag in _BLOCK and self.out and not "".join(self.out[-3:]).endswith("\n") and tag not in ("tr", "table", "ul", "ol"):
            self.out.append("\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("*" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            self.out.append("  " * min(_DEEPEST, len(self.lists) - 1) + self._bullet())
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("#+begin_src\n")
        elif tag in _CODE and not self.pre:
            self.code += 1
            self.out.append(self.mask.hide("="))
        elif tag in ("script", "style"):
            self.silent += 1
        elif tag == "a":
            self.links.setdefault(self.getpos()[0], [0, 0])[0] += 1
            self.href.append(at.get("href") or "")
            if self.href[-1]:
                self.out.append(self.mask.hide(f"[[{self.href[-1]}]["))
        elif tag == "img" and (at.get("alt") or at.get("src")):
            self.out.append(self.mask.hide(f"[[file:{at.get('src') or ''}][{at.get('alt') or at.get('src')}]]"))
        elif tag == "ref":
            self.out.append(" (")

    def _bullet(self) -> str:
        if not self.lists or self.lists[-1] is None:
            return "- "
        self.lists[-1] += 1
        return f"{self.lists[-1]}. "

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in {"script", "style", "pre", "a", "ref"} | _CODE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self._tag(tag, "tag"):
            return self._say(f"</{tag}>")
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n#+end_src\n")
        elif tag in _CODE and self.code and not self.pre:
            self.code -= 1
            self.out.append(self.mask.hide("="))
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
        elif tag == "a" and self.href:
            self.out.append(self.mask.hide("]]") if self.href.pop() else "")
        elif tag == "ref":
            self.out.append(")")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr":
            self.out.append("|\n")
        elif tag in _BLOCK and tag not in ("table", "ul", "ol"):
            self.out.append("\n")

    def handle_data(self, data):
        self._say(self.mask.hide(data) if (self.pre or self.code) and data.strip() else data)

    def handle_comment(self, data):
        self.found.append("html comment")
        line = self.getpos()[0]
        self.tags[line] = self.tags.get(line, 0) + 1

    def handle_decl(self, decl):
        self.found.append("html declaration")

    def handle_pi(self, data):
        self._say(f"<?{data}>")

    def unknown_decl(self, data):
        self._say(f"<![{data}]>")

    def handle_entityref(self, name):
        self.found.append("html entity")
        self._say(self.mask.hide(html5[f"{name};"].replace("\xa0", " ")))

    def handle_charref(self, name):
        self.found.append("html entity")
        self._say(self.mask.hide(html.unescape(f"&#{name};").replace("\xa0", " ")))

    def read(self, text: str) -> str:
        self.feed(text)
        self.close()
        return "".join(self.out)


def _density(events: _Events, n: int, sigma: float = 1.0) -> set[int]:
    """Lines (from 1) of the low cluster of the smoothed text-to-tag ratio that are left out: nearly empty, or links only."""
    tags, chars = events.tags, events.chars
    ratio = np.array([chars.get(i, 0) / max(1, tags.get(i, 0)) for i in range(1, n + 1)], float)
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    pad = np.pad(ratio, 3, mode="edge")
    smooth = np.convolve(pad, kernel / kernel.sum(), mode="valid")
    low, high = smooth.min(), smooth.max()
    for _ in range(10):  # two clusters on a line
        below = smooth < (low + high) / 2
        if not below.any() or below.all():
            return set()
        low, high = smooth[below].mean(), smooth[~below].mean()
    bar = (low + high) / 2

    def empty(i: int) -> bool:
        many, inside = events.links.get(i, (0, 0))
        return chars.get(i, 0) / tags[i] < 3 or (many > 2 and inside > 0.8 * chars.get(i, 0))

    return {i for i in range(1, n + 1) if smooth[i - 1] < bar and tags.get(i, 0) and i not in events.structure and empty(i)}


_ANGLE = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--(?:(?!<!--).)*?--|!\w[^<>]*)>", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")


def _html(text: str, mask: _Mask) -> tuple[str, list[str]]:
    """Text without HTML, and the constructs met. Angle brackets and ampersands that start none are set aside first."""
    if "<" not in text and "&" not in text:
        return text, []

    def angle(m: re.Match) -> str:
        name = re.match(r"</?([a-zA-Z][a-zA-Z0-9]*)[\s/>]", m.group())
        return m.group() if m.group().startswith("<!") or (name and name.group(1).lower() in TAGS) else mask.hide(m.group())

    text = _ANGLE.sub(angle, text)
    spans = [m.span() for m in _ANGLE.finditer(text)]
    refs = [m.span() for m in _ENTITY.finditer(text) if m.group()[1] == "#" or m.group()[1:] in html5]
    if not spans and not refs:
        return text, []
    keep = sorted(spans + refs)
    out, at = [], 0
    for a, b in keep:
        if a < at:
            continue
        out.append(re.sub("[<&]", lambda m: mask.hide(m.group()), text[at:a]))
        out.append(text[a:b])
        at = b
    out.append(re.sub("[<&]", lambda m: mask.hide(m.group()), text[at:]))
    text = "".join(out)
    events = _Events(mask)
    clean = events.read(text)
    if events.tags:
        if drop := _density(events, text.count("\n") + 1):
            lines = text.split("\n")
            events = _Events(mask)
            clean = events.read("\n".join(x for i, x in enumerate(lines, 1) if i not in drop))
            events.found.append("html tag")
    return clean, events.found


def _environments(text: str, mask: _Mask, found: list[str]) -> str:
    """Text with its code and formula environments set aside; each begin is paired with the next end of its name."""
    ends: dict[str, list[tuple[int, int]]] = {}
    begins = []
    for m in _ENVIRONMENT.finditer(text):
        name = m.group("name")
        if m.group("end") == "end":
            ends.setdefault(name, []).append(m.span())
        else:
            kind = next((k for k in ("latex code", "latex formula") if CONSTRUCTS[k].match(m.group())), None)
            if kind:
                begins.append((m.start(), m.end(), name, kind))
    out, at = [], 0
    for start, end, name, kind in begins:
        mine = ends.get(name, [])
        k = bisect_left(mine, (end, 0))
        if start < at or k == len(mine):
            continue
        found.append(kind)
        out.append(text[at:start])
        body = text[end : mine[k][0]]
        if kind == "latex code":
            options = re.match(r"(?:\[[^\[\]\n]*\])?(?:\{(?P<lang>[^{}\n]*)\})?[ \t]*\n?", body)
            code = body[options.end() :].rstrip()
            out.append(mask.hide(f"#+begin_src {options.group('lang') or ''}".rstrip() + f"\n{code}\n#+end_src"))
        else:
            out.append(mask.hide(text[start : mine[k][1]]))
        at = mine[k][1]
    return "".join([*out, text[at:]])


class _Lists:
    """Items of LaTeX lists, nested and numbered as the environments around them say."""

    def __init__(self):
        self.open: list[int | None] = []

    def __call__(self, m: re.Match) -> str:
        if m.group("end") == "begin":
            self.open.append(0 if m.group("kind") == "enumerate" else None)
            return ""
        if m.group("end"):
            if self.open:
                self.open.pop()
            return ""
        indent = "  " * max(0, min(_DEEPEST, len(self.open) - 1))
        name = f"{m.group('a')} :: " if m.group("a") else ""
        if self.open and self.open[-1] is not None:
            self.open[-1] += 1
            return f"{indent}{self.open[-1]}. {name}"
        return f"{indent}- {name}"


def _org(name: str, m: re.Match, mask: _Mask) -> str:
    """What stands for one construct in the clean text."""
    g = m.groupdict()
    a = (g.get("a") or g.get("b") or "").strip()
    match name:
        case "markdown fence":
            return mask.hide(f"#+begin_src {g['lang']}".rstrip() + f"\n{g['code'].rstrip()}\n#+end_src")
        case "latex environment" | "markdown table" | "wiki table" | "wiki switch" | "wiki category" | "markdown rule":
            return ""
        case "latex display":
            return mask.hide(f"\\[ {a} \\]")
        case "latex inline":
            return mask.hide(f"\\({a}\\)")
        case "latex heading":
            depth = {"title": 1, "part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}[g["level"]]
            return "*" * depth + f" {a}"
        case "latex command":
            if g["bare"]:
                return "…" if g["bare"] in ("ldots", "dots") else mask.hide(m.group())
            if g["name"] in ("cite", "ref", "label", "citep", "citet", "eqref", "pageref"):
                return f" [{a}]" if g["name"] != "label" else ""
            if g["name"] in ("textbf", "bf"):
                return f"*{a}*"
            if g["name"] in ("emph", "textit"):
                return f"/{a}/"
            if g["name"] in ("texttt", "verb"):
                return mask.hide(f"={a}=")
            if g["name"] in ("footnote",):
                return f" ({a})"
            if g["name"] in ("frac", "sqrt", "mathbf", "mathrm"):
                return mask.hide(m.group())
            return "…" if g["name"] in ("ldots", "dots") else a
        case "latex escape":
            return g["a"] or g["b"] or ""
        case "latex quotes":
            return f"“{a}”"
        case "markdown heading" | "wiki heading":
            return "*" * max(1, len(g["h"]) - (name == "wiki heading")) + f" {a.rstrip('#').rstrip() or a if name == 'markdown heading' else a}"
        case "markdown underlined":
            return f"* {a}"
        case "markdown quote":
            return mask.hide("#+begin_quote\n" + a + "\n#+end_quote")
        case "markdown definition":
            return f"[{g['n']}] " + mask.hide(g["a"])
        case "markdown link":
            return mask.hide(f"[[{'file:' if g['i'] else ''}{g['b']}][{g['a'] or g['b']}]]")
        case "markdown reference":
            return f"{g['a']} [{g['b'] or g['a']}]" if g["a"] else f"[fn:{g['n']}]"
        case "markdown code":
            return mask.hide(f"={a}=")
        case "markdown strong" | "wiki emphasis":
            return f"/{a}/" if g.get("b") and not g.get("a") else f"*{a}*"
        case "markdown underline":
            return f"*{a}*" if not a.isupper() or len(a) < 3 else ""
        case "markdown strike":
            return f"+{a}+"
        case "wiki link" | "wiki external":
            return mask.hide(f"[[{g['b']}][{g['a']}]]")
        case "wiki template":
            return " ".join(x.strip() for x in g["a"].split("|")[1:]) or a
    return a


def convert(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, constructs met)."""
    if not text:
        return text, []
    work = re.sub("[\ue0f0\ue0f1]", "", text)
    if not _HINT.search(work):
        return text, []
    mask = _Mask()
    work = _ORG.sub(lambda m: mask.hide(m.group()), work)
    found: list[str] = []

    def note(name: str, pattern: re.Pattern, s: str) -> str:
        def one(m: re.Match) -> str:
            found.append(name)
            return _org(name, m, mask)

        return pattern.sub(one, s)

    work = note("markdown fence", CONSTRUCTS["markdown fence"], work)
    work = _environments(work, mask, found)
    work, tags = _html(work, mask)
    found += tags
    for name, pattern in CONSTRUCTS.items():
        if name in _FIRST:
            continue
        if name == "latex list":
            lists, n = pattern.subn(_Lists(), work)
            found += [name] * n
            work = lists
            continue
        work, before = note(name, pattern, work), work
        while name in _NESTED and work != before:  # from the inside out
            work, before = note(name, pattern, work), work
    if not found:
        return text, []
    if "wiki table" in found:
        work = _WIKI_ROW.sub(lambda m: "| " + re.sub(r"[ \t]*(?:!!|\|\|)[ \t]*", " | ", m.group("a")).strip(" |") + " |", work)
    if "latex environment" in found or "latex command" in found:
        work = re.sub(r"(?<=\S)~(?=\S)", " ", work)
    work = re.sub(r"(?<![ \t])[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", mask.show(work))).strip()
    return work, found


SCHEMA = "field_name string, clean string, constructs array<string>"


def clean(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys..., field_name, clean, constructs) of each of the fields of each row; constructs are the distinct kinds met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, field in enumerate(fields):
                rows = [convert(t) for t in batch.column(len(keys) + k).to_pylist()]
                cols = [pa.array([field] * len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([sorted(set(r[1])) for r in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *cols], names=[*keys, "field_name", "clean", "constructs"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, *fields).mapInArrow(run, f"{kinds}, {SCHEMA}")


def found(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys..., field_name) of the fields that hold markup."""
    return clean(df, keys, fields).filter(F.size("constructs") > 0).select(*keys, "field_name").distinct()
