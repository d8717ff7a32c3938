"""Problem 5, one text: find the constructs of HTML, Markdown, wiki and LaTeX, and write them as clean text.

Clean text has headings as "# ...", list items as "- ..." or "1. ...", code
between ``` lines, table rows as "a | b", and formulas between dollar signs.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

KINDS = ("html", "markdown", "wiki", "latex")

# Names of HTML elements, of LaTeX commands and environments.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup "
    "option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup "
    "svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xmp".split()
)
COMMANDS = frozenset(
    "documentclass usepackage title author date maketitle part chapter section subsection subsubsection paragraph subparagraph tableofcontents appendix "
    "textbf textit texttt textrm textsf textsc textsl emph underline footnote footnotemark footnotetext cite citep citet nocite ref eqref pageref label "
    "caption includegraphics centering item input include bibliography bibliographystyle bibitem url href hline toprule midrule bottomrule multicolumn "
    "newcommand renewcommand newenvironment hspace vspace noindent bigskip medskip smallskip newpage clearpage ldots dots LaTeX TeX frac sqrt sum int prod lim "
    "alpha beta gamma delta epsilon theta lambda mu pi rho sigma phi omega mathbb mathbf mathcal mathrm operatorname left right cdot times leq geq neq "
    "infty partial nabla large Large small footnotesize today par quad qquad verb".split()
)
MATH = "equation|align|gather|multline|displaymath|math|eqnarray|alignat|flalign"
VERBATIM = "verbatim|lstlisting|minted|Verbatim|alltt"

_NAME = "[A-Za-z][A-Za-z0-9]*"
_ATTRS = r"(?:\s[^<>]*)?"

#: Stretches whose inside counts for no other kind, earliest first.
_OPAQUE = re.compile(
    r"(?P<comment><!--.*?-->)"
    rf"|(?P<raw><(?P<rawname>script|style|textarea|xmp){_ATTRS}>.*?</(?P=rawname)\s*>)"
    rf"|(?P<pre><pre{_ATTRS}>.*?</pre\s*>)"
    rf"|(?P<code><(?P<codename>code|kbd|samp|tt){_ATTRS}>.*?</(?P=codename)\s*>)"
    r"|(?P<wcode><(?P<wname>nowiki|syntaxhighlight|math)(?:\s[^<>]*)?>.*?</(?P=wname)>)"
    r"|(?:(?<=\n)|\A)(?P<fence>[ ]{0,3}(?P<ticks>`{3,}|~{3,})(?P<info>[^\n`]*)(?:\n(?P<body>.*?))?(?:\n[ ]{0,3}(?P=ticks)[`~]*[ \t]*(?=\n|\Z)|\Z))"
    rf"|(?P<verb>\\begin\{{(?P<vname>{VERBATIM})\}}(?P<vbody>.*?)\\end\{{(?P=vname)\}})"
    rf"|(?P<env>\\begin\{{(?P<ename>(?:{MATH})\*?)\}}(?P<ebody>.*?)\\end\{{(?P=ename)\}})"
    r"|(?P<display>\$\$(?P<dbody>[^$]+?)\$\$|\\\[(?P<bbody>.*?)\\\])"
    r"|(?P<inline>(?<![\\$\w])\$(?P<ibody>[^\s$](?:[^$\n]*?[^\s$\\])?)\$(?![\d$])|\\\((?P<pbody>.*?)\\\))"
    r"|(?P<tick>(?<!`)(?P<n>`+)(?!`)(?P<tbody>[^`\n]+(?:\n(?!\s*\n)[^`\n]+)*)(?P=n)(?!`))",
    re.S | re.I,
)
_KIND_OF = {"comment": "html", "raw": "html", "pre": "html", "code": "html", "wcode": "wiki", "fence": "markdown", "verb": "latex", "env": "latex", "display": "latex", "inline": "latex", "tick": "markdown"}

_HTML = re.compile(rf"</?(?P<tag>{_NAME}){_ATTRS}/?>|&(?P<ent>#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{_NAME});|<!DOCTYPE[^>]*>", re.I)
_WIKI = re.compile(
    r"\[\[[^\[\]\n|]+(?:\|[^\[\]\n]*)*\]\]"
    r"|\{\{\s*[#\w][^{}|]*\|[^{}]*\}\}|\{\{[A-Z][\w ]*\}\}"
    r"|'''(?=[^\s'])[^\n]+?'''|(?<!')''(?=[^\s'])[^'\n]+?''(?!')"
    r"|^(?P<eq>={1,6})[ \t]*[^=\s][^=\n]*?[ \t]*(?P=eq)[ \t]*$"
    r"|^\{\|.*?^\|\}|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|^#REDIRECT\s|</?(?:ref|references|nowiki|gallery|includeonly|noinclude)(?:\s[^<>]*)?/?>"
    r"|\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*)?\](?!\()",
    re.M | re.S,
)
_LATEX = re.compile(
    r"(?<![\\\w:/])\\(?P<cmd>[A-Za-z]{2,})\*?(?:\[[^\]\n]*\])?(?P<arg>\{)?|(?<!\\)\\(?P<acc>['`^\"~=.cvuHr])\{[A-Za-z]\}"
)
_MARKDOWN = re.compile(
    r"^[ ]{0,3}(?P<head>#{1,6})[ \t]+(?P<title>\S[^\n]*)$"
    r"|^(?P<set>[ ]{0,3}[^\s|>#<=*+-][^\n]*)\n[ ]{0,3}(?P<bar>=+|-{2,})[ \t]*$"
    r"|(?<!\!)\[(?P<text>[^\[\]\n]+)\]\((?P<url><[^<>\n]*>|[^\s()]+)(?:[ \t]+\"[^\"\n]*\")?\)|!\[(?P<alt>[^\[\]\n]*)\]\([^\s()]+(?:[ \t]+\"[^\"\n]*\")?\)"
    r"|\[[^\[\]\n]+\]\[[^\[\]\n]*\](?=(?s:.*)^[ ]{0,3}\[[^\]\n]+\]:)|^[ ]{0,3}\[(?P<ref>[^\]\n]+)\]:[ \t]*\S+[^\n]*$"
    r"|<(?:https?|ftp|mailto):[^\s<>]+>|<[\w.+-]+@[\w-]+(?:\.[\w-]+)+>"
    r"|(?P<b>\*\*|__)(?<![\w\\].)(?=[^\s*_])(?P<bold>[^\n]*?[^\s*_\\])(?P=b)(?!\w|\.\w)"
    r"|~~(?=[^\s~])(?P<del>[^~\n]*?[^\s~])~~"
    r"|(?<![\w*\\])\*(?=[^\s*./])(?P<em>[^*\n]*?[^\s*\\])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])(?P<em2>[^_\n]*?[^\s_\\])_(?![\w_])"
    r"|^(?P<quote>[ ]{0,3}>[ \t]?(?=[^\s=]))"
    r"|^(?P<hrow>[^\n]*\|[^\n]*)\n[ ]{0,3}(?P<delim>\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?)[ \t]*$",
    re.M,
)
_ANY = re.compile(r"[<&\[{'=\\$`*_#~>|]|-{3}|__")


class Piece:
    """An opaque stretch: its kind, and how it looks in clean text."""

    __slots__ = ("kind", "clean", "name", "source")

    def __init__(self, kind: str, clean: str, name: str, source: str):
        self.kind, self.clean, self.name, self.source = kind, clean, name, source


def _tags_out(s: str) -> str:
    return html.unescape(re.sub(rf"</?{_NAME}{_ATTRS}/?>", "", s))


def _fenced(body: str) -> str:
    return "\n```\n" + body.strip("\n") + "\n```\n"


def _opaque(m: re.Match) -> Piece:
    name = m.lastgroup or ""
    g = m.group
    for key in _KIND_OF:
        if g(key) is not None:
            name = key
            break
    whole = g()
    if name == "comment":
        clean = ""
    elif name == "raw":
        clean = _tags_out(whole) if g("rawname").lower() in ("textarea", "xmp") else ""
    elif name == "pre":
        clean = _fenced(_tags_out(whole))
    elif name == "code":
        clean = _tags_out(whole)
    elif name == "wcode":
        inner = re.sub(r"\A<[^<>]*>|</[^<>]*>\Z", "", whole)
        clean = {"math": f"${inner}$", "nowiki": inner}.get(g("wname").lower(), _fenced(inner))
    elif name == "fence":
        clean = _fenced(g("body") or "")
    elif name == "verb":
        clean = _fenced(re.sub(r"\A\s*(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?[ \t]*\n", "", g("vbody")))
    elif name == "env":
        body = re.sub(r"\\label\{[^}]*\}", "", g("ebody")).strip()
        clean = f"\n$$ {body} $$\n"
    elif name == "display":
        clean = f"$$ {(g('dbody') or g('bbody')).strip()} $$"
    elif name == "inline":
        clean = f"${(g('ibody') or g('pbody')).strip()}$"
    else:
        clean = g("tbody").strip()
    return Piece(_KIND_OF[name], clean, name, whole)


def _money(m: re.Match) -> bool:
    """A dollar pair that is two prices: digits and words, nothing mathematical."""
    body = m.group("ibody")
    return body is not None and body[0].isdigit() and not re.search(r"[\\^_={}+]", body)


def lift(text: str) -> tuple[str, list[Piece], dict[int, int]]:
    """The text with each opaque stretch put aside, these stretches, and what to translate back.

    U+E000 and U+E001 mark where a stretch was. Where the text itself has them, two characters that it lacks stand in for its own.
    """
    pieces: list[Piece] = []
    back: dict[int, int] = {}
    if "\ue000" in text or "\ue001" in text:
        own = set(text)
        free = (c for c in range(0x10FFFF, 0xE001, -1) if chr(c) not in own)
        back = {next(free): 0xE000, next(free): 0xE001}
        text = text.translate({b: a for a, b in back.items()})

    def put(m: re.Match) -> str:
        if m.group("inline") is not None and _money(m):
            return m.group()
        pieces.append(_opaque(m))
        return f"\ue000{len(pieces) - 1}\ue001"

    return _OPAQUE.sub(put, text), pieces, back


def _html_found(m: re.Match) -> bool:
    tag, ent = m.group("tag"), m.group("ent")
    if tag:
        return tag.lower() in ELEMENTS
    if ent:
        if ent[0] != "#":
            return ent + ";" in html5
        n = int(ent[2:], 16) if ent[1] in "xX" else int(ent[1:])
        return 0 < n < 0x110000 and not 0xD800 <= n < 0xE000
    return True


def _latex_found(m: re.Match) -> bool:
    cmd = m.group("cmd")
    return bool(m.group("acc")) or cmd in COMMANDS or cmd in ("begin", "end") and bool(m.group("arg"))


def _table(m: re.Match) -> bool:
    """A delimiter row counts under a header row of as many cells."""
    cells = lambda s: s.strip().strip("|").count("|") + 1
    return cells(m.group("hrow")) == cells(m.group("delim")) and "-" in m.group("delim")


def _markdown_found(m: re.Match) -> bool:
    if m.group("hrow") is not None:
        return _table(m)
    if m.group("set") is not None:
        return len(m.group("bar")) >= 3
    if m.group("ref") is not None:
        return True
    return True


_FINDERS = (("html", _HTML, _html_found), ("wiki", _WIKI, lambda m: True), ("latex", _LATEX, _latex_found), ("markdown", _MARKDOWN, _markdown_found))


class Page:
    """A text taken apart: ``rest`` without the opaque stretches ``pieces``, and (start, end, kind, token) of every other construct in it, in order.

    A token stands for the construct's template part: a tag with its name, a
    command, a mark.
    """

    __slots__ = ("text", "rest", "pieces", "found", "back", "kinds")

    def __init__(self, text: str):
        self.text, self.rest, self.pieces, self.found, self.back = text, text, [], [], {}
        if _ANY.search(text):
            self.rest, self.pieces, self.back = lift(text)
            self.found = _constructs(self.rest)
        there = {p.kind for p in self.pieces} | {k for _, _, k, _ in self.found}
        self.kinds = [k for k in KINDS if k in there]

    def places(self) -> list[tuple[int, Piece]]:
        return [(m.start(), self.pieces[int(m.group(1))]) for m in _PLACE.finditer(self.rest)]

    def source(self, part: str) -> str:
        """A part of ``rest`` as it stands in the text."""
        return _PLACE.sub(lambda m: self.pieces[int(m.group(1))].source, part).translate(self.back)

    def render(self, rest: str) -> str:
        """``rest``, or what is kept of it, as clean text."""
        if not self.kinds:
            return rest
        marks = {k for _, _, k, _ in self.found}
        for kind, convert in (("html", _clean_html), ("wiki", _clean_wiki), ("latex", _clean_latex), ("markdown", _clean_markdown)):
            if kind in marks:
                rest = convert(rest)
        for _ in range(3):  # a stretch may lie in another
            # the conversion may have made such a mark from character references
            rest = _PLACE.sub(lambda m: self.pieces[int(m.group(1))].clean if int(m.group(1)) < len(self.pieces) else m.group(), rest)
        rest = re.sub(r"[ \t]+$", "", rest, flags=re.M)
        return re.sub(r"\n{3,}", "\n\n", rest).strip("\n").translate(self.back)


_PLACE = re.compile("\ue000(\\d+)\ue001")


def _constructs(rest: str) -> list[tuple[int, int, str, str]]:
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, real in _FINDERS:
        for m in pattern.finditer(rest):
            if real(m):
                s = m.group()
                if kind == "html":
                    tok = re.sub(r"\s.*", "", s.lower(), flags=re.S).rstrip("/>") + ">" if m.group("tag") else s
                elif kind == "latex":
                    tok = "\\" + (m.group("cmd") or m.group("acc"))
                elif kind == "wiki":
                    tok = re.match(r"\{\{[^|{}]*|[^\w\s]+", s).group()
                else:
                    tok = re.match(r"\s*[^\w\s]*", s).group().strip() or "|"
                found.append((m.start(), m.end(), kind, tok))
    if any(kind == "wiki" for _, _, kind, _ in found):  # there, "# x" is a numbered item
        found = [x for x in found if x[2:] != ("markdown", "#")]
    found.sort()
    return found


def kinds(text: str) -> list[str]:
    """The kinds of markup in a text, in the order of KINDS."""
    return Page(text).kinds


# --- conversion -----------------------------------------------------------------------------------------------------


def _clean_html(t: str) -> str:
    def tag(m: re.Match) -> str:
        if not _html_found(m):
            return m.group()
        if m.group("ent"):
            return html.unescape(m.group())
        name, closing = (m.group("tag") or "").lower(), m.group().startswith("</")
        if re.fullmatch("h[1-6]", name):
            return "\n" if closing else "\n" + "#" * int(name[1]) + " "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return " | " if closing else ""
        if name == "tr" and closing:
            return ""
        if name in ("tr", "ul", "ol", "thead", "tbody", "tfoot") and not closing:
            return "\n" if name == "tr" else ""
        if name in ("dt", "dd", "tr", "br", "hr", "p", "div", "section", "article", "ul", "ol", "dl", "table", "blockquote", "details", "summary", "header", "footer", "nav", "main", "aside", "figure", "figcaption", "thead", "tbody", "tfoot", "caption", "form", "fieldset"):
            return "\n"
        if name == "img":
            alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", m.group(), re.I)
            return next((x for x in alt.groups() if x is not None), "") if alt else ""
        return ""

    t = re.sub(r"(</(?:tr|li|p|h[1-6]|div)\s*>)\s*\n?|\n(?=<(?:ul|ol|p|table|h[1-6])[\s>])", r"\1", t, flags=re.I)
    return re.sub(r"[ \t]*\|[ \t]*(?=\n|\Z)", "", _HTML.sub(tag, t))


def _clean_wiki(t: str) -> str:
    def table(m: re.Match) -> str:
        rows = []
        for row in re.split(r"^\|-.*$", m.group()[2:-2].partition("\n")[2], flags=re.M):
            cells = [c for line in re.findall(r"^[|!](?![}+])(.*)$", row, re.M) for c in re.split(r"\|\||!!", line)]
            if cells:
                rows.append(" | ".join(re.sub(r"\A[^|\[]*\|(?!\|)", "", c).strip() for c in cells))
        return "\n".join(rows)

    t = re.sub(r"^\{\|.*?^\|\}", table, t, flags=re.M | re.S)
    t = re.sub(r"^([*#]+)[ \t]+", lambda m: "  " * (len(m.group(1)) - 1) + ("- " if m.group(1)[-1] == "*" else "1. "), t, flags=re.M)
    t = re.sub(r"^(={1,6})[ \t]*([^=\s][^=\n]*?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), t, flags=re.M)
    t = re.sub(r"\[\[(?:[Cc]ategory|[Ff]ile|[Ii]mage):([^\[\]\n|]+)(?:\|[^\[\]\n]*)?\]\]", "", t)
    t = re.sub(r"\[\[[^\[\]\n|]+\|([^\[\]\n]*)\]\]|\[\[([^\[\]\n|]+)\]\]", lambda m: (m.group(1) if m.group(1) is not None else m.group(2)).split("|")[-1], t)

    def template(m: re.Match) -> str:
        named = [p.partition("=") for p in m.group(1).split("|")[1:]]
        return "; ".join(f"{a.strip()}: {b.strip()}" if e else a.strip() for a, e, b in named)

    t = re.sub(r"\{\{(\s*[#\w][^{}|]*\|[^{}]*|[A-Z][\w ]*)\}\}", template, t)
    t = re.sub(r"'''((?=[^\s'])[^\n]+?)'''", r"\1", t)
    t = re.sub(r"(?<!')''((?=[^\s'])[^'\n]+?)''(?!')", r"\1", t)
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]*)\](?!\()", r"\1", t)
    t = re.sub(r"<ref[^<>]*/>|<ref(?:\s[^<>]*)?>.*?</ref>|</?(?:references|gallery|includeonly|noinclude)[^<>]*>|__[A-Z]+__", "", t, flags=re.S)
    return t


_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


def _clean_latex(t: str) -> str:
    t = re.sub(r"\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * _HEADS[m.group(1)] + " " + m.group(2) + "\n", t)

    def tabular(m: re.Match) -> str:
        body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b", "", m.group(2))
        return "\n" + "\n".join(" | ".join(c.strip() for c in r.split("&")) for r in re.split(r"\\\\", body) if r.strip()) + "\n"

    t = re.sub(r"\\begin\{(tabular[*x]?)\}(?:\{[^{}]*\})*(.*?)\\end\{\1\}", tabular, t, flags=re.S)
    t = re.sub(r"(\\begin\{enumerate\}.*?\\end\{enumerate\})", lambda m: m.group().replace("\\item", "\n1."), t, flags=re.S)
    t = re.sub(r"\s*\\item\b(?:\[([^\]]*)\])?[ \t]*", lambda m: "\n- " + (f"{m.group(1)} " if m.group(1) else ""), t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"[ \t]*(?<![\w:/])\\(?:label|cite[pt]?|nocite|ref|eqref|pageref|usepackage|documentclass|bibliography|bibliographystyle|includegraphics|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", t)
    for _ in range(3):
        t = re.sub(r"(?<![\w:/\\])\\([A-Za-z]{2,})\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", lambda m: m.group(2) if m.group(1) in COMMANDS else m.group(), t)
    known = {"ldots": "...", "dots": "...", "LaTeX": "LaTeX", "TeX": "TeX"}
    return re.sub(r"(?<![\w:/\\])\\([A-Za-z]{2,})\b[ \t]?", lambda m: known.get(m.group(1), "") if m.group(1) in COMMANDS else m.group(), t)


def _clean_markdown(t: str) -> str:
    def one(m: re.Match) -> str:
        g = m.group
        if not _markdown_found(m):
            return g()
        if g("head"):
            return g("head") + " " + re.sub(r"[ \t]+#+[ \t]*$", "", g("title"))
        if g("set") is not None:
            return ("# " if g("bar")[0] == "=" else "## ") + g("set").strip()
        if g("hrow") is not None:
            return g("hrow")
        if g("quote") is not None or g("ref") is not None:
            return ""
        for name in ("text", "alt", "bold", "del", "em", "em2"):
            if g(name) is not None:
                return g(name)
        return g().strip("<>")

    for _ in range(2):  # emphasis may hold emphasis
        t = _MARKDOWN.sub(one, t)
    return re.sub(r"^[ \t]*\|(.*?)\|?[ \t]*$", lambda m: " | ".join(c.strip() for c in m.group(1).split("|")), t, flags=re.M)


def clean(text: str) -> tuple[list[str], str]:
    """(kinds, clean text); a text without markup stays as it is."""
    page = Page(text)
    return (page.kinds, page.render(page.rest)) if page.kinds else ([], text)
