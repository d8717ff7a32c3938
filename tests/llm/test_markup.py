import random

import pytest

from vsearch.llm import markup as M
from vsearch.llm import template as T

FOUND = [
    ("plain text, nothing else", []),
    ("", []),
    (" \n ", []),
    ("<p>One</p>", ["html"]),
    ("<DIV CLASS=x>a</DIV>", ["html"]),
    ("a<br/>b", ["html"]),
    ("a &amp; b", ["html"]),
    ("a &#8212; b &#x41;", ["html"]),
    ("<!-- note -->", ["html"]),
    ("array<float> and map<string, x> and <none> and <name>", []),
    ("R&D; Q&A; AT&T &nbsp &foo;", []),
    ("a < b and c > d, x<y>z", []),
    ("## Head", ["markdown"]),
    ("Title\n=====", ["markdown"]),
    ("a **bold** b", ["markdown"]),
    ("an _emphasis_ here", ["markdown"]),
    ("~~gone~~", ["markdown"]),
    ("[text](http://x.y) ![alt](a.png)", ["markdown"]),
    ("use `code` here", ["markdown"]),
    ("```\n<p>not html</p> $x$ [[no]]\n```", ["markdown"]),
    ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
    ("> quoted", ["markdown"]),
    ("- item\n* item\n1. item", []),
    ("snake_case_name, __init__.py, 5 * 4 * 3, *.log, a* b", []),
    ("one ` tick", []),
    ("C# and F#, #1234", []),
    ("[1] and [2] and a[i]", []),
    ("[[Page]] and [[Page|text]]", ["wiki"]),
    ("[[1, 2], [3, 4]]", []),
    ("{{Box|a=1}}", ["wiki"]),
    ("{a: 1} {{name}}", []),
    ("'''bold''' and ''it''", ["wiki"]),
    ("it's and 'quoted' and don''t", []),
    ("== Head ==", ["wiki"]),
    ("a == b == c", []),
    ("{| class=x\n| a\n|}", ["wiki"]),
    ("== H ==\n# one\n# two", ["wiki"]),
    ("\\section{A} \\emph{b}", ["latex"]),
    ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]),
    ("here $x^2 + y$ holds", ["latex"]),
    ("$$ a < b $$", ["latex"]),
    ("\\[ x \\]", ["latex"]),
    ("costs $5 per a and $7 per b, $20", []),
    ("C:\\new\\section\\item and \\d+\\w* and \\w{3}", []),
    ("\\begin{verbatim}\n<b>x</b> **y**\n\\end{verbatim}", ["latex"]),
    ("<pre>**no** $x$</pre>", ["html"]),
    ("**b** and <b>c</b> and [[D]] and \\emph{e}", ["html", "markdown", "wiki", "latex"]),
]


@pytest.mark.parametrize("text,want", FOUND)
def test_kinds(text, want):
    assert M.kinds(text) == want
    kinds, clean = M.clean(text)
    assert kinds == want
    if not want:
        assert clean == text


@pytest.mark.parametrize(
    "text,want",
    [
        ("<h2>A</h2>\n<p>One.</p>\n<ul><li>x</li><li>y &amp; z</li></ul>", "## A\n\nOne.\n\n- x\n- y & z"),
        ("<table><tr><th>n</th><th>r</th></tr><tr><td>a</td><td>1</td></tr></table>", "n | r\na | 1"),
        ("x<pre><code>a &lt; b\n  c</code></pre>", "x\n```\na < b\n  c\n```"),
        ("<style>p {}</style><script>x()</script><!-- c -->text", "text"),
        ("<img alt='A cat' src=x> and <a href=y>link</a>", "A cat and link"),
        ("# H\n\n**b** _e_ ~~d~~ [l](u) ![i](v) `c`\n\n> q\n\n- one\n1. two", "# H\n\nb e d l i c\n\nq\n\n- one\n1. two"),
        ("```py\nx = 1  # **k**\n```", "```\nx = 1  # **k**\n```"),
        ("| a | b |\n|:--|--:|\n| 1 | 2 |", "a | b\n1 | 2"),
        ("Title\n=====\ntext", "# Title\ntext"),
        ("== H ==\n* a\n** b\n[[P|t]] [[Q]] '''b''' {{Box|n=1|x}}[[Category:C]]", "## H\n- a\n  - b\nt Q b n: 1; x"),
        ('{| class="g"\n! a !! b\n|-\n| 1 || 2\n|}', "a | b\n1 | 2"),
        ("\\section{T} \\emph{x}\\label{l}\n\\begin{enumerate}\n\\item a\n\\end{enumerate}\n$y^2$ \\cite{z}", "# T\n x\n\n1. a\n\n$y^2$"),
        ("\\begin{equation}\\label{e}\na + b\n\\end{equation}", "$$ a + b $$"),
        ("\\begin{tabular}{ll}\na & b \\\\\n1 & 2\n\\end{tabular}", "a | b\n1 | 2"),
    ],
)
def test_clean(text, want):
    assert M.clean(text)[1].replace("\n\n1.", "\n1.").replace(" \n", "\n") == want.replace("\n\n1.", "\n1.").replace(" \n", "\n")


def test_a_long_formula_is_one():
    formula = "$" + "a_1 + b*c*d + \\emph{x} " * 40 + "z$"
    assert len(formula) > 900
    assert M.clean(f"See {formula} here.") == (["latex"], f"See {formula} here.")
    price = "costs $5 " + "word " * 200 + "and 6$"
    assert M.clean(price) == ([], price)


def test_long_and_odd_texts():
    for text in ("<" * 20_000, "`" * 5_000, "$" * 5_001, "[[" * 5_000, "**" * 5_000, "\\begin{" * 3_000, "{|" * 3_000, "_a" * 5_000, "\ue0005\ue001 <b>x</b>", "&" * 9_999):
        M.clean(text)


def pages():
    out = []
    for i in range(12):
        out.append((i, f"<div>Home News About</div>\n<h1>Title number {i}</h1>\n<p>Body {i} " + "word " * i + "</p>\n<div>Copyright Example Press</div>", "host"))
    return out


def test_template_of_a_host(spark):
    rows = pages() + [(50, "no markup at all", "host"), (51, "**alone** here", "other"), (52, None, "host"), (53, "", "host"), (54, "a < b", None), (0, pages()[0][1], "host"), (None, "<p>x</p>", "host")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "seq long, text string, coll_name string, kinds string, host int")
    got = {r["id"]: r for r in T.clean_texts(df).collect()}
    assert set(got) == {*range(12), 50, 51, 53, 54}
    assert got[3]["kinds"] == ["html"] and got[3]["template_tokens"] > 4
    assert "Home News" not in got[3]["text"] and "Copyright" not in got[3]["text"]
    assert "# Title number 3" in got[3]["text"] and "Body 3 word word word" in got[3]["text"]
    assert any("Title number 3" in s for s in got[3]["slots"])
    assert (got[50]["kinds"], got[50]["text"]) == ([], "no markup at all") and got[53]["text"] == "" and got[54]["text"] == "a < b"
    assert (got[51]["kinds"], got[51]["text"], got[51]["template_tokens"]) == (["markdown"], "alone here", 0)
    kinds = {r["id"]: r["kinds"] for r in T.markup_kinds(df).collect()}
    assert kinds == {i: r["kinds"] for i, r in got.items() if r["kinds"]}


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def article(seed):
    return "\n".join(f"<p>{words(seed * 100 + k, 12)}</p>" for k in range(6))


HEAD, FOOT = "<div>Home News About Contact</div>", "<div>Copyright Example Press</div>"


@pytest.mark.parametrize("edit", [None, "line", "word"])
def test_copies_keep_their_text(spark, edit):
    """40 pages of one host, a few of them the same page under other ids, whole or with small edits."""
    rows = [(i, f"{HEAD}\n{article(i)}\n{FOOT}", "host") for i in range(36)]
    copy = article(99)
    for i in range(100, 104):
        lines = copy.split("\n")
        if edit == "line":
            lines[i - 100] = f"<p>{words(i, 9)}</p>"
        elif edit == "word":
            lines = [line.replace("</p>", f" {words(i * 7 + k, 1)}</p>") if k < 3 else line for k, line in enumerate(lines)]
        rows.append((i, f"{HEAD}\n" + "\n".join(lines) + f"\n{FOOT}", "host"))
    got = {r["id"]: r for r in T.clean_texts(spark.createDataFrame(rows, "seq long, text string, coll_name string")).collect()}
    for i, text, _ in rows:
        want = text.replace(HEAD, "").replace(FOOT, "").replace("<p>", "").replace("</p>", "").split()
        assert got[i]["text"].split() == want, i
        assert got[i]["template_tokens"] >= 2


def test_a_host_of_copies_only(spark):
    rows = [(i, f"{HEAD}\n{article(5)}\n{FOOT}", "host") for i in range(50)]
    for r in T.clean_texts(spark.createDataFrame(rows, "seq long, text string, coll_name string")).collect():
        assert "Home News" in r["text"] and words(500, 12) in r["text"] and r["template_tokens"] == 0


def test_a_page_is_never_all_template(spark):
    rows = [(i, f"{HEAD}\n{article(i)}\n{FOOT}", "host") for i in range(30)] + [(50, f"{HEAD}\n{FOOT}", "host"), (51, f"{HEAD}\nx\n{FOOT}", "host")]
    got = {r["id"]: r["text"] for r in T.clean_texts(spark.createDataFrame(rows, "seq long, text string, coll_name string")).collect()}
    assert "Home" not in got[3] and "Home" in got[50] and "Home" in got[51] and "x" in got[51]


def test_private_characters_of_the_text_stay():
    text = "\ue0000\ue001 \ue000 `code` **b** \U0010ffff"
    assert M.clean(text) == (["markdown"], "\ue0000\ue001 \ue000 code b \U0010ffff")
    assert M.clean("&#xE000;7&#xE001; `x`")[0] == ["html", "markdown"]


def test_classes_are_ordered_and_nested(spark):
    assert T.nested([(0, 100, 1), (10, 20, 2), (15, 120, 3), (30, 40, 4)]) == {3, 4}
    assert T.nested([(0, 100, 1), (10, 20, 2), (20, 30, 3)]) == {1, 2, 3}
    swapped = [(i, "<b>x</b>\n" + ("AAA line\nBBB line" if i % 2 else "BBB line\nAAA line") + f"\nown {i}", "h") for i in range(10)]
    df = spark.createDataFrame(swapped, "seq long, text string, coll_name string")
    assert all("AAA line" in r["text"] for r in T.clean_texts(df).collect())


def test_empty(spark):
    assert T.clean_texts(spark.createDataFrame([], "seq long, text string, coll_name string")).count() == 0
