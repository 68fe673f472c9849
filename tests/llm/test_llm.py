"""Training-text operators against brute force, exact round trips and planted cases."""

import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseek.llm import language, leakage, markup, nearest, neardup, quality, repetition, split, tokens

LONG = "word and more text " * 40_000
ODD = [None, "", " \n\t ", "x", "\u0000\ufeff\u200b", "a" * 5000, "😀 e\u0301 ﷺ ½ Ⅷ"]


def frame(spark, rows, ddl):
    """A table with extra columns whose names clash with inner ones."""
    df = spark.createDataFrame(rows, ddl) if rows else spark.createDataFrame([], ddl)
    return df.withColumns({c: F.lit(1) for c in ("a", "b", "id", "sid", "shard", "piece", "words", "count") if c not in df.columns})


# p1


CASES = {
    "html tag": ["a <b>bold</b> word", "x<br/>y", '<IMG SRC="a.png" ALT="t">', "<ul><li>a</li></ul>", "text<ref>n</ref>"],
    "html entity": ["a &amp; b", "it&#8217;s", "x&#x2014;y", "&lt;i&gt;"],
    "html comment": ["a <!-- hidden\nnote --> b"],
    "markdown": ["## Head", "a **bold** b", "a __under__ b", "~~gone~~", "a `code` b", "[t](http://x.y)", "![a](i.png)", "[t][4]", "[4]: https://x.y/z", "Head\n=====", "|---|:--|", "```py\nx\n```", "~~~\nx\n~~~", "> quoted"],
    "wiki": ["== Head ==", "===a===", "a '''bold''' b", "''it'' x", "[[Page|name]]", "[[Kategorie:X]]", "{{T|a=1}}", "{| class=\"x\"\n|-\n! a !! b\n|}", "[https://x.y name of it]", "#REDIRECT [[Page]]"],
    "latex": ["\\section{Head}", "\\emph{x}", "a $x^2 + y = 3$ b", "$\\beta$", "\\(a_1\\)", "\\[ \\sum_{k=1}^n k \\]", "$$\\frac{a}{b}$$", "``quoted''", "5\\,\\% x", "A \\& B", "\\begin{itemize}\n\\item a\n\\end{itemize}", "see~\\cite{k1}"],
}
NONE = [
    "met <2024-02-03 Sat> and [2024-02-03 Sat 10:00]", "[[id:abc]] and [[file:x.org][name]]", "*bold* /it/ +gone+ _u_", "- [X] item\n+ [ ] other\n1. one", "| a | b |\n|---+---|\n| 1 | 2 |",
    "=<b>x</b>= and ~**y**~ and =\\section{}=", "see https://x.y/a_b__c?d=e&f=g", "<me@x.example> <you@deskexample>", "costs $20 or $71 to $80", "a <= b >= c, x < 7", "salt & pepper", "C:\\temp\\new", "/usr/lib", "#tag x", "x^2 + y^2",
    "if (a < 4 && b > 2) {\n  x = y[0] * 3\n}  // end", "def f_g(x):\n  return x[i] + 1", "2 ** 8", "suve[0] -> {suve}", "(setq x (list 1 y))", "=Nota juntos=", "‘q’ «q» d'q", "CLOCK: [2023-01-01 Sun 10:00]--[2023-01-01 Sun 11:00] =>  1:00",
]


def test_markup_constructs():
    for kind, texts in CASES.items():
        for t in texts:
            assert any(k.startswith(kind.split()[0]) for k in markup.convert(t)[1]), t
    for t in NONE:
        assert markup.convert(t) == (t, []), t


#: A sample of each construct, of each of its forms.
FORMS = {
    "latex code": ["\\begin{verbatim}\nx\n\\end{verbatim}", "\\begin{lstlisting}[a=b]\nx\n\\end{lstlisting}"],
    "latex formula": ["\\begin{align*}\nx\n\\end{align*}", "\\begin{equation}x\\end{equation}"],
    "latex list": ["\\begin{itemize}\n\\item x\n\\end{itemize}", "\\item[a] x"],
    "markdown fence": ["```\nx\n```", " ~~~ py\nx\n ~~~"],
    "latex environment": ["\\begin{x}", "\\end {x}"],
    "latex display": ["$$x$$", "\\[ x \\]"],
    "latex inline": ["\\(x\\)", "$x$", "$a+b$"],
    "latex heading": ["\\section*{x}"],
    "latex command": ["\\emph{x}", "\\alpha"],
    "latex escape": ["5 \\% x", "5\\,kg"],
    "latex quotes": ["``x''"],
    "markdown heading": ["# x"],
    "markdown underlined": ["x\n==="],
    "markdown table": ["| Name | Value |\n| --- | --- |", "a | b\n--- | ---", "a|b\n:--|--:", " |---|---|", "|---|:--|", "a | b\n -- | --"],
    "markdown rule": ["* * *", "***", " *\t* *", "___", "  ____"],
    "markdown quote": ["> x", "x\n>y"],
    "markdown definition": ["  [x]: y"],
    "markdown link": ["[x](y)", "![x](y)"],
    "markdown reference": ["[x][y]", "[x][]", "[^x]"],
    "markdown code": ["`x`"],
    "markdown strong": ["**x**"],
    "markdown underline": ["__x__"],
    "markdown strike": ["~~x~~"],
    "wiki heading": ["== x =="],
    "wiki emphasis": ["'''x'''", "''x''"],
    "wiki category": ["[[Category : x]]"],
    "wiki link": ["[[x|y]]"],
    "wiki external": ["[https://x y]"],
    "wiki template": ["{{x}}"],
    "wiki table": ["{| x", "|}", "|-", "|- x=y"],
    "wiki switch": ["#REDIRECT x", "__TOC__"],
}


def test_markup_no_construct_unread(monkeypatch):
    assert set(FORMS) == set(markup.CONSTRUCTS)
    for name, texts in FORMS.items():
        for t in texts:
            assert markup.CONSTRUCTS[name].search(t) and markup.convert(t)[1], (name, t)
    rng = random.Random(11)
    pieces = list("<>&\\`$*_~[](){}|=#'^:!-+ \n\ta1") + ["--", "| ", " |", "&lt;", "https://x ", "\ue0f0"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(20_000)]
    got = [markup.convert(t) for t in texts]
    monkeypatch.setattr(markup, "_HINT", re.compile(""))
    assert got == [markup.convert(t) for t in texts]


def test_markup_conversion():
    clean = lambda t: markup.convert(t)[0]
    assert clean("## Head\ntext") == "** Head\ntext" and clean("\\section{Head}") == "* Head" and clean("<h3>Head</h3>") == "*** Head"
    assert clean("<ul><li>a</li><li>b</li></ul>") == "- a\n- b" and clean("```py\nx = **1**\n```") == "#+begin_src py\nx = **1**\n#+end_src"
    assert clean("see $x^2$ ok") == "see \\(x^2\\) ok" and clean("a &lt;b&gt; c") == "a <b> c" and clean("[t](u)") == "[[u][t]]"
    assert clean("keep =<b>= and <b>this</b>") == "keep =<b>= and this"
    assert clean("<style>.x{a:b}</style>text <unknown> stays") == "text <unknown> stays"
    for t in (None, ""):
        assert markup.convert(t) == (t, [])
    assert markup.convert("<" * 2000 + "&" * 2000)[1] == [] and markup.convert("*" * 3000 + "[" * 3000)
    assert markup.convert(("<b>x</b> " + "y " * 50) * 300)[1]


def test_markup_structure():
    clean = lambda t: markup.convert(t)[0]
    code = "x = **b**\n  $y$ \\alpha"
    for env in ("verbatim", "lstlisting"):
        assert clean(f"a\n\\begin{{{env}}}\n{code}\n\\end{{{env}}}\nb") == f"a\n#+begin_src\n{code}\n#+end_src\nb"
    assert clean("\\begin{minted}{python}\nx = 1\n\\end{minted}") == "#+begin_src python\nx = 1\n#+end_src"
    for env in ("align", "equation", "gather*"):
        formula = f"\\begin{{{env}}}\n\\frac{{a}}{{b}} &= **c** \\\\\n\\end{{{env}}}"
        assert clean(f"so\n{formula}\nit is") == f"so\n{formula}\nit is"
    assert clean("\\begin{enumerate}\n\\item one\n\\item two\n\\begin{itemize}\n\\item in it\n\\end{itemize}\n\\item three\n\\end{enumerate}").replace("\n\n", "\n") == "1. one\n2. two\n  - in it\n3. three"
    assert clean("<ol><li>one</li><li>two<ul><li>in</li></ul></li><li>three</li></ol>").replace("\n\n", "\n") == "1. one\n2. two\n  - in\n3. three"
    assert clean("a \\textbf{b \\emph{c} d} e") == "a *b /c/ d* e" and "{" not in clean("x {{T|a|{{U|b}}}} y") and "}" not in clean("x {{T|a|{{U|b}}}} y")
    assert clean("\\begin{align}\nnever closed **b**") == "never closed *b*"
    page = "<html><body>\n" + '<div><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">Shop</a> <a href="/d">Help</a></div>\n' + "<p>" + "This is the text of the page, and it is long. " * 5 + "</p>\n" * 1 + "<p>" + "More of the text stands here in a line. " * 5 + '<a href="/e">link</a></p>\n</body></html>'
    assert "Home" not in clean(page) and clean(page).count("text") == 10 and "[[/e][link]]" in clean(page)
    assert clean("see <code>a **b** [x](y)</code> and <a href='u'>the *name*</a>") == "see =a **b** [x](y)= and [[u][the *name*]]"


def test_markup_is_linear():
    import time

    for unit in ("\\begin{align}", "\\begin{verbatim} x\n", "\\item ", "<ul><li>", "{{a|", "$$", "\\textbf{", "```\n", "<pre>", "[[", "**a "):
        start = time.process_time()
        markup.convert(unit * 6000)
        assert time.process_time() - start < 4, unit


def test_markup_table(spark):
    df = frame(spark, [("k1", "T &amp; t", None), ("k1", "T &amp; t", None), ("k2", None, "a **b** c"), ("k3", "plain", "")], "target_key string, title string, body string")
    got = sorted(map(tuple, markup.found(df, ["target_key"], ["title", "body"]).collect()))
    assert got == [("k1", "title"), ("k2", "body")]
    assert markup.found(df.limit(0), ["target_key"], ["title", "body"]).count() == 0
    assert markup.clean(df, ["target_key"], ["title", "body"]).count() == 8


# p2


def jaccard(x, y, n=3):
    sets = [set(zip(*(re.findall(r"[^\W_]+", t.lower())[k:] for k in range(n)))) for t in (x, y)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if all(sets) else 0


def edited(rng, text, vocabulary):
    w = text.split()
    for _ in range(rng.randint(0, max(1, len(w) // 6))):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [w[i], rng.choice(vocabulary)], [rng.choice(vocabulary)]])
    return " ".join(w or ["x"])


@pytest.mark.parametrize("n,num,den", [(3, 1, 2), (5, 4, 5)])
def test_near_duplicates(spark, n, num, den):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = " ".join(rng.choices(vocabulary, k=rng.choice([3, 4, 8, 30, 60])))
        for j in range(rng.choice([1, 1, 3])):
            rows.append((rng.choice(["targets", "chunks"]), f"k{i}.{j}", edited(rng, base, vocabulary)))
    rows += [("targets", f"copy{i}", "the very same text in many copies of it") for i in range(12)]
    rows += [("targets", f"odd{i}", t) for i, t in enumerate(ODD)] + [("targets", "odd1", ""), ("chunks", "huge", LONG), ("chunks", "huge2", LONG + "tail")]
    rows += rows[:5]
    df = frame(spark, rows, "tab string, rec_key string, text string").repartition(3)
    want = {(a[0], *sorted((a[1], b[1]))) for a, b in itertools.combinations(sorted({r for r in rows if r[2] and "huge" not in r[1]}), 2) if a[0] == b[0] and a[1] != b[1] and jaccard(a[2], b[2], n) >= num / den}
    want.add(("chunks", "huge", "huge2"))
    got = set(map(tuple, neardup.record_pairs(df, n, num, den).collect()))
    assert got == want
    groups = {r["rec_key"]: r["group_id"] for r in neardup.groups(df, n, num, den).collect()}
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for t, a, b in want:
        parent[root((t, a))] = root((t, b))
    for t, a, b in want:
        assert groups[a] == groups[b]
    assert len(set(groups[k] for t, k in parent)) == len({root(x) for x in parent})
    assert neardup.record_pairs(df.limit(0), n, num, den).count() == 0


def test_near_duplicates_with_boilerplate(spark):
    """One paragraph in all records, and hot n-grams cut into tiles."""
    rng = random.Random(12)
    paragraph = " ".join(f"same{i}" for i in range(25))
    rows = []
    for i in range(90):
        own = " ".join(rng.choices([f"w{j}" for j in range(500)], k=rng.choice([4, 20, 40, 60])))
        rows.append(("targets", f"k{i:03d}", f"{own} {paragraph}"))
    df = frame(spark, rows, "tab string, rec_key string, text string").repartition(4)
    want = {("targets", a[1], b[1]) for a, b in itertools.combinations(rows, 2) if jaccard(a[2], b[2]) >= 0.5}
    for tile in (2, 7, neardup.TILE):
        assert set(map(tuple, neardup.record_pairs(df, tile=tile).collect())) == want and want
    hot = neardup.frequent(neardup.stage(df.select("tab", "rec_key", "text"), 3), "gram")
    assert hot[1].max() == 90


def test_sketch_is_bounded(monkeypatch):
    monkeypatch.setattr(neardup, "COUNTERS", 50)
    rng, sketch = np.random.default_rng(1), neardup._Sketch()
    for _ in range(40):
        sketch.add(np.concatenate((rng.integers(1000, 10**6, 100).astype(np.uint64), np.full(20, 7, np.uint64))))
    assert len(sketch.hashes) <= 50 and sketch.total == 4800
    grams, counts = sketch.frequent()
    assert 800 - 4800 // 50 <= counts[grams == 7][0] <= 800


def test_suffix_filter_and_packing():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64) << np.uint64(30)) for _ in range(2))
        marks = neardup._marks(np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)]), 2)
        assert int(np.bitwise_count(marks[0] ^ marks[1]).sum()) <= len(np.setxor1d(x, y))
        packed = neardup._pack(np.concatenate((x, y)), np.array([len(x), len(y)]))
        assert (neardup._unpack(packed[0].as_py()) == x).all() and (neardup._unpack(packed[1].as_py()) == y).all()


def test_near_duplicate_classes(spark):
    rows = [("targets", f"c{i:02d}", "one two three four five six seven") for i in range(5)] + [("targets", "d", "one two three four five six eight"), ("targets", "e", "nothing in common with it at all")]
    got = {r["rec_key"]: (r["copies"], r["links"]) for r in neardup.classes(frame(spark, rows, "tab string, rec_key string, text string")).collect()}
    assert got["c00"] == (5, 1) and got["d"] == (1, 1) and got["e"] == (1, 0)


# p3, p4

WORDS = {"en": "the of and to in a is that it was for on are with as", "de": "der die und das ist nicht ein mit von auf für den im sich dem", "ru": "и в не на что с по это как но к из у за от"}


def prose(rng, lang, n):
    nouns = {"en": "garden table letter window river", "de": "garten tisch brief fenster fluss", "ru": "сад стол письмо окно река"}[lang].split()
    return " ".join(rng.choice(WORDS[lang].split() if rng.random() < 0.55 else nouns) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(0)
    rows = []
    for i in range(240):
        lang = ("en", "de", "ru")[i % 3]
        body = "\n".join(prose(rng, lang, rng.randint(9, 16)) for _ in range(4))
        if i % 8 == 0:
            body = "\n".join(f"- {rng.choice(['garden', 'tisch'])} {i}" for _ in range(5))
        elif i % 8 == 1:
            body = "\n".join(f"{rng.randint(1, 99)};{rng.random():.3f};{rng.randint(1, 9)}" for _ in range(5))
        elif i % 8 == 2:
            body = "\n".join("".join(rng.choices("bcdfghjklm", k=9)) + " " + "".join(rng.choices("npqrst", k=7)) for _ in range(5))
        rows.append((f"k{i}", body, lang))
    df = spark.createDataFrame(rows, "target_key string, body string, label string")
    common = quality.Common(sorted((c, w) for c, ws in WORDS.items() for w in ws.split()))
    model = quality.train(df, "body", "target_key", common)
    return df, common, model, language.train(df, "body", "label", "target_key", common)


def test_quality(spark, trained):
    _, common, model, _ = trained
    rng = random.Random(9)
    rows = [("prose", prose(rng, "en", 14) + "\n" + prose(rng, "de", 14)), ("list", "\n".join(f"- garden letter {i}" for i in range(9))), ("table", "\n".join(f"{i};{i * 7.5};{i * 3}" for i in range(9))), ("junk", "\n".join("xkcdq wrtzp bnmlk qwrtz" for _ in range(5))), ("short", "x y z"), ("tagged", f"<p class='x'>{prose(rng, 'en', 14)}</p>")]
    rows += [(f"odd{i}", t) for i, t in enumerate(ODD)] + [("long", "the garden is in a letter. " * 20_000), ("prose", rows[0][1])]
    stats = quality.measure(frame(spark, rows, "key string, text string"), ["key"], "text", model, common)
    bad = {r["key"] for r in quality.not_prose(stats, ["key"]).collect()}
    assert bad == {"list", "table", "junk", "odd5"}
    s = {r["key"]: r for r in stats.collect()}
    assert s["prose"]["prose_share"] > 0.9 and s["list"]["list_share"] > 0.9 and s["odd0"]["words"] == 0 and s["prose"]["punctuated_lines"] == 1
    assert s["odd1"]["mean_word_length"] == 0 and s["long"]["words"] == 120_000
    assert quality.measure(frame(spark, [], "key string, text string"), ["key"], "text", model, common).count() == 0


def test_lines_of_any_length():
    for n in (10, 60, 2000):
        assert quality.units(f"{'ab ' * n}end. {'cd ' * n}end.") == [f"{'ab ' * n}end.", f"{'cd ' * n}end."]
    assert quality.units("1. first one. second\n- a. b") == ["1. first one.", "second", "- a.", "b"] and quality.units("") == []
    common = quality.Common([("de", "der"), ("en", "the")])
    assert quality.describe("the der " * 70_000 + "the", common.packed())[4] == 70_001
    assert len(language._grams("y" * 300 + "z" * 300)) > len(language._grams("y" * 300)) > 0
    assert quality.plain("a &" + "b" * 90 + "; c") == "a   c"


def test_draw_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"k{i % 40}", f"t{i}") for i in range(400)], "key string, text string")
    got = [quality.draw(df.repartition(n), "key", 5) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) <= 10 and len(quality.draw(df, "key", 500)) == 400


def test_long_tags_and_formulas(trained):
    image = '<img alt="x" src="data:image/png;base64,' + "iVBORw0KGgo/AAAA+" * 3000 + '">'
    assert quality.plain(f"a {image} b") == "a   b" and quality.plain("a <b " + "x" * 9000) == "a <b " + "x" * 9000
    _, common, model, _ = trained
    clean = prose(random.Random(5), "en", 30)
    label = lambda t: model.label([quality.describe(u, common.packed())[0] for u in quality.units(quality.plain(t))])
    assert set(label(clean + "\n" + image)) == {quality.PROSE}
    formula = "x_1 + " * 100 + "x_2"
    assert markup.convert(f"let ${formula}$ be") == (f"let \\({formula}\\) be", ["latex inline"])
    assert markup.convert("costs $20 or " + "more " * 100 + "$71 to $80")[1] == []


def test_language(spark, trained):
    _, common, model, langs = trained
    rng = random.Random(4)
    mixed = prose(rng, "en", 15) + " " + prose(rng, "de", 14)
    rows = [("ok", None, prose(rng, "de", 20), "de_AT"), ("wrong", None, prose(rng, "ru", 20), "English"), ("mixed", None, mixed, "EN"), ("title", prose(rng, "de", 12), None, None), ("list", None, "\n".join("- der garten" for _ in range(9)), "en"), ("named", None, prose(rng, "de", 20), "German")]
    rows += [(f"odd{i}", t, t, None) for i, t in enumerate(ODD)] + [("wrong", *rows[1][1:])]
    df = frame(spark, rows, "target_key string, title string, body string, label string")
    got = language.stretches(df, ["target_key", "label"], ["title", "body"], langs, model, common)
    assert set(map(tuple, language.mislabelled(got, ["target_key"], "label", ["en", "de", "ru"]).collect())) == {("wrong", "ru"), ("mixed", "de"), ("title", "de")}
    docs = {r["target_key"]: r for r in language.documents(got.distinct(), ["target_key"]).collect()}
    assert docs["ok"]["lang"] == "de" and 0.5 < docs["ok"]["confidence"] <= 1
    empty = frame(spark, [], "target_key string, title string, body string, label string")
    assert language.stretches(empty, ["target_key"], ["title", "body"], langs, model, common).count() == 0


def test_language_accuracy(trained):
    _, common, model, langs = trained
    rng = random.Random(77)
    judge = language.Judge(langs, model, common)
    right = 0
    for i in range(90):
        lang = ("en", "de", "ru")[i % 3]
        got = judge.stretches([prose(rng, lang, 12)])
        right += bool(got) and got[0][3] == lang
    assert right >= 86
    code = language.codewords(9)
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 8
    assert language.named("pt_BR", ["pt"]) == "pt" and language.named("Portuguese", ["pt"]) == "pt" and language.named(" pt", ["pt"]) is None and language.named("", ["pt"]) is None


# p5


def planted(rng, n, d):
    x = rng.normal(size=(n, d))
    for i in range(0, n - 4, 7):
        x[i + 1] = x[i] + rng.normal(size=d) * 0.25
        x[i + 2] = x[i] * 3
    return x.astype(np.float32)


def brute(digests, x, k=5, least=0.82):
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(x)):
        best = {}
        for j, s in enumerate(x @ x[i]):
            if digests[j] != digests[i] and s >= least:
                best[digests[j]] = max(s, best.get(digests[j], -1))
        for d in sorted(best, key=lambda d: -round(best[d], 9))[:k]:
            out.add(tuple(sorted((digests[i], d))))
    return out


def vector_rows(x, model="m", dim=None):
    return [(model, f"d{i:05d}", dim or x.shape[1], [float(v) for v in r]) for i, r in enumerate(x)]


VECTOR = "model_id string, text_digest string, dim int, vector array<float>"


def test_nearest_found(spark):
    rng = np.random.default_rng(3)
    x = planted(rng, 900, 48)
    nan = float("nan")
    dirty = [("m", "n1", 48, None), ("m", "n2", 48, [1.0]), ("m", "n3", 2, [nan, 1.0]), ("m", "n4", 2, [0.0, 0.0]), (None, "n5", 2, [1.0, 1.0]), ("m", None, 2, [1.0, 1.0]), ("o", "o1", 2, [1.0, 1.0]), ("o", "o2", 2, [2.0, 2.1]), ("o", "o3", None, [1.0]), ("o", "o4", 1, [None])]
    df = frame(spark, vector_rows(x) + vector_rows(x)[:9] + dirty, VECTOR).repartition(5)
    want = brute([f"d{i:05d}" for i in range(900)], x) | {("o1", "o2")}
    exact = {tuple(sorted((r["digest_a"], r["digest_b"]))) for r in nearest.similar(df, cell=120, cell_factor=1.0, tree_factor=1.0).collect()}
    assert exact == want
    fast = {tuple(sorted((r["digest_a"], r["digest_b"]))) for r in nearest.similar(df, cell=120).collect()}
    assert fast <= want and len(fast) >= 0.9 * len(want)
    assert set(map(tuple, nearest.found(df).select("digest_a", "digest_b").collect())) <= want
    assert nearest.found(df.limit(0)).count() == 0


def test_nearest_hot_cluster(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((np.tile(rng.normal(size=(1, 16)), (400, 1)), rng.normal(size=(400, 16)))).astype(np.float32)
    got = nearest.similar(frame(spark, vector_rows(x), VECTOR), cell=100).collect()
    per = {}
    for r in got:
        per.setdefault(r["digest_a"], []).append(r["place"])
    assert all(len(per[f"d{i:05d}"]) == 5 for i in range(400)) and max(map(len, per.values())) <= 5


def test_nearest_of_close_vectors(spark):
    """Vectors with a mean similarity of 0.85: cells stay small, planted neighbours are found."""
    rng = np.random.default_rng(15)
    base = rng.normal(size=(1500, 32))
    x = np.repeat(base, 3, axis=0) + rng.normal(size=(4500, 32)) * 0.12
    x = x / np.linalg.norm(x, axis=1, keepdims=True) + 2.4 * np.eye(32)[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert 0.8 < s.mean() < 0.9
    points, parts, spread = nearest._cells(u.astype(np.float32), 40, 4500, 100)
    assert len(points) == 40 and parts.max() == 1 and spread < 0.5 and np.bincount(np.argmax(u @ points.T, axis=1)).max() < 900
    got = {tuple(sorted((r["digest_a"], r["digest_b"]))) for r in nearest.similar(frame(spark, vector_rows(x.astype(np.float32)), VECTOR), k=2, cell=100).collect()}
    np.fill_diagonal(s, -1)
    want = {tuple(sorted((f"d{i:05d}", f"d{j:05d}"))) for i, r in enumerate(s) for j in np.argsort(-r)[:2]}
    assert len(got & want) >= 0.9 * len(want)


def test_cells_divide_where_vectors_crowd(monkeypatch):
    monkeypatch.setattr(nearest, "MAX_MEMBERS", 200)
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(1, 16)) * 5 + rng.normal(size=(900, 16)), np.tile(rng.normal(size=(1, 16)), (500, 1)), rng.normal(size=(200, 16))))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    points, parts, _ = nearest._cells(x, 3, len(x), 100)
    size = np.bincount(np.argmax(x @ points.T, axis=1), minlength=len(points))
    assert (size[parts == 1] <= 200).all() and (parts > 1).sum() == 1 and size[parts > 1][0] >= 500
    # a sample of a far larger collection: no cell of different vectors is cut by hash
    few, parts, _ = nearest._cells(x[:900], 3, 10**9, 100)
    assert parts.max() == 1 and len(few) > 100


def test_nearest_with_large_k_and_repeated_digests(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1, 8)) + rng.normal(size=(700, 8)) * 0.2
    names = [f"d{i % 40:02d}" for i in range(700)]
    rows = [("m", n, 8, [float(v) for v in r]) for n, r in zip(names, x)]
    got = nearest.similar(frame(spark, rows, VECTOR), k=39, least=0.5).groupBy("digest_a").count().collect()
    assert {r["digest_a"] for r in got} == set(names) and {r["count"] for r in got} == {39}


def test_nearest_exact_queries(spark):
    rng = np.random.default_rng(8)
    x = planted(rng, 300, 12)
    df = frame(spark, vector_rows(x) + vector_rows(x)[:3], VECTOR).repartition(4)
    q = df.filter("text_digest like '%00'")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {}
    for r in nearest.nearest(df, q, block=2).orderBy("place").collect():
        got.setdefault(int(r["digest"][1:]), []).append(r["cosine"])
    for i, sims in got.items():
        s = np.sort(np.delete(u @ u[i], i))[::-1][:5]
        assert np.allclose(sims, s, atol=1e-6)
    assert set(got) == {0, 100, 200} and nearest.nearest(df, q.limit(0)).count() == 0
    # of equal neighbours the smaller digests, wherever they are
    same = [("m", f"e{i:02d}", 2, [1.0, 0.0]) for i in np.random.default_rng(1).permutation(30)] + [("m", "far", 2, [0.0, 1.0])]
    ties = nearest.nearest(frame(spark, same, VECTOR).repartition(3), spark.createDataFrame([("m", "x", 2, [1.0, 0.1])], VECTOR)).orderBy("place").collect()
    assert [r["neighbour"] for r in ties] == [f"e{i:02d}" for i in range(5)]


def test_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = nearest.VPTree(x, 16)
    hits = set()
    seen = 0
    for who, rows in tree.leaves(x[:50], np.full(50, 0.3), 1.0):
        seen += len(who) * len(rows)
        a, b = np.nonzero(nearest.chord(x[who] @ x[rows].T) <= 0.3)
        hits |= set(zip(who[a].tolist(), rows[b].tolist()))
    assert hits == set(zip(*(v.tolist() for v in np.nonzero(nearest.chord(x[:50] @ x.T) <= 0.3)))) and seen < 50 * 500


# p7


@pytest.mark.parametrize("text", ["para one.\n\npara two is longer. It has sentences! Yes?\n" * 60, "x" * 5000, "word " * 900, "* H\n" + "a b c. " * 400 + "\n** S\n" + "d e f. " * 300, "```\n" + "code line\n" * 300 + "```\n" + "after. " * 200, "\n" * 3000 + "end" + "\n" * 10 + "ü" * 1600])
def test_split(text):
    for limit, overlap in ((1500, 300), (100, 20), (50, 0)):
        got = split.pieces(text, limit, overlap)
        assert "".join(p[again:] for again, p in got) == text.strip()
        assert all(len(p) <= limit and again <= overlap for again, p in got) and got[0][0] == 0
        for (_, before), (again, p) in itertools.pairwise(got):
            assert before.endswith(p[:again])
    if " " in text:
        assert all(p[-1].isspace() or p[-1] in "`.!?" for _, p in split.pieces(text)[:-1])


def test_split_follows_structure():
    heads = {"org": "* H{i}\n", "markdown": "# H{i}\n", "wiki": "== H{i} ==\n", "html": "<h2>H{i}</h2>\n", "latex": "\\section{{H{i}}}\n"}
    for form in heads.values():
        text = "".join(form.format(i=i) + "some words in a line.\n" * 3 for i in range(9))
        got = [p[again:] for again, p in split.pieces(text, 200, 0)]
        assert len(got) > 3 and all(p.startswith(form[:2]) for p in got), form
    nested = "".join(f"- item {i}\n" + "".join(f"  - sub {i}.{j} with words\n" for j in range(4)) for i in range(12))
    assert all(p.startswith("- item") for _, p in split.pieces(nested, 250, 0))
    assert all(p.lstrip().startswith("- ") for _, p in split.pieces(nested, 60, 0))
    code = "```\n" + "x = 1\n\n* no heading\n" * 5 + "```\n"
    for block in (code, code.replace("```\nx", "#+begin_src\nx").replace("```", "#+end_src"), "\\begin{align}\n" + "a = b\n\n" * 12 + "\\end{align}\n", "<pre>\n" + "a\n\n" * 30 + "</pre>\n"):
        got = [p for _, p in split.pieces("before it.\n\n" * 10 + block + "\nafter it.\n" * 10, 160, 0)]
        assert sum(block.strip() in p for p in got) == 1, block
    assert split.whole_blocks("```\nnever closed\n#+begin_a\n\\begin{x}") == []


def test_split_is_linear():
    import time

    def took(text):
        start = time.process_time()
        got = split.pieces(text)
        assert "".join(p[again:] for again, p in got) == text.strip()
        return time.process_time() - start

    for unit in ("```\nx\n```\n\n", "```x\n", "#+begin_a\n", "\\begin{a}\n", "- a\n  - b\n", "* a\n** b\n", "== a\n"):
        small, large = took(unit * 2000), took(unit * 16000)
        assert large < 24 * max(small, 0.01), unit
    took("".join(" " * i + "- x\n" for i in range(1500)))


def test_split_table(spark):
    rows = [("t", f"o{i}", x) for i, x in enumerate(ODD)] + [("t", "long", LONG), ("t", "long", LONG), ("t", "pad", " " * 2000 + "x"), ("t", "edge", "y" * 1500), ("t", "over", "y" * 1501)]
    df = frame(spark, rows, "tab string, rec_key string, text string")
    assert {r["rec_key"] for r in split.oversized(df, "text", ["tab", "rec_key"]).collect()} == {"long", "over", "o5"}
    got = split.split(df.distinct(), "text", ["tab", "rec_key"])
    assert sorted(r["ord"] for r in got.filter("rec_key = 'o5'").collect()) == list(range(5)) and got.filter("rec_key in ('o0', 'o1', 'o2')").count() == 0
    assert split.oversized(df.limit(0), "text", ["tab", "rec_key"]).count() == 0
    with pytest.raises(ValueError):
        split.split(df, "text", ["tab"], 10, 10)


# p8


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_token_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = [x for x in ODD if x is not None] + ["it's  we'll\n\n\tTabs  ", "<|endoftext|>", "x\x1cy\u0085z", "日本語 テスト 一二三", LONG, "ab" * 30_000]
    texts += ["".join(rng.choice("abc éßж漢😀 \n'09²Ⅷ_-") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    df = frame(spark, [(i, x) for i, x in enumerate(texts)] + [(-1, None), (0, texts[0])], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and got[-1] == []
    assert tokens.encode(df.limit(0)).count() == 0


def test_pair_tree():
    rng = random.Random(2)
    for n in (1, 2, 7, 33):
        values = [rng.randrange(9) for _ in range(n)]
        tree = tokens.PairTree(list(values))
        for _ in range(50):
            i, v = rng.randrange(n), rng.randrange(9)
            values[i] = v
            tree.set(i, v)
            assert tree.first() == (values.index(min(values)), min(values))


# p9


def test_leakage(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 40])))) for i in range(30)]
    items[3] = (3, " ".join(rng.choices(vocabulary, k=40)))
    items += [(100, items[3][1]), (101, None), (102, ""), (None, "x " * 20)]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.choice([0, 11, 60]))
        if i % 3 == 0:
            it = (items[rng.randrange(30)][1] or "").split()
            a = rng.randrange(max(1, len(it) - 12))
            at = rng.randrange(len(w) + 1)
            w[at:at] = it[a : a + rng.choice([11, 12, 20])]
        docs.append((i, ", ".join(w).upper()))
    docs += [(900 + i, t) for i, t in enumerate(ODD)] + [(0, docs[0][1]), (950, LONG + items[3][1])]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 11)}
    of_items = [(i, grams(t)) for i, t in items if i is not None]
    want = {(d, i) for d, t in docs for g in [grams(t)] for i, h in of_items if g & h}
    df, it = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    assert set(map(tuple, leakage.found(df, it).collect())) == want and len(want) > 5
    small = leakage.matches(df, it, shard_words=50, block_chars=300).select("doc_id", "item_id")
    assert set(map(tuple, small.distinct().collect())) == want
    assert {r["doc_id"] for r in leakage.clean(df, it).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    m = leakage.matches(df, it).filter("doc_id = 950 and item_id = 3").first()
    assert m["match_words"] == len(items[3][1].split()) and m["doc_word"] == 160_000
    # several small blocks, one item larger than a block, and a passage that says itself again and again
    huge = [(7, " ".join(f"u{i}" for i in range(3000)))] + [(20 + i, " ".join(f"v{i}x{j}" for j in range(15))) for i in range(20)] + [(50, "round and round " * 30)]
    texts = [(1, " ".join(f"u{i}" for i in range(100, 2900))), (2, "x " + huge[5][1] + " y"), (3, "go round and round " * 400), (4, "round and round " * 12)]
    got = leakage.matches(frame(spark, texts, "doc_id long, text string"), frame(spark, huge, "item_id long, text string"), block_chars=200)
    assert {tuple(r) for r in got.collect()} == {(1, 7, 2800, 0, 100), (2, 24, 15, 1, 0), (4, 50, 36, 0, 0)}
    assert leakage.found(df.limit(0), it).count() == 0 and leakage.found(df, it.limit(0)).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(0, 9, rng.integers(1, 7))
        shard = leakage.SuffixShard(rng.integers(0, rng.integers(1, 6), int(lengths.sum())).astype(np.uint64), lengths)
        text = shard.text.tolist()
        suffixes = [text[p : text.index(0, p)] for p in shard.order]
        assert suffixes == sorted(suffixes) and sorted(shard.order) == list(range(len(text)))


# p10


def test_repetition(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = rng.choices([f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(80)], k=rng.choice([10, 49, 60, 200]))
        if i % 2:
            base = base[: rng.choice([20, 45])] * rng.choice([2, 4])
        text = "".join(w + rng.choice([" ", "\n", ". ", " 12 "]) for w in base)
        rows.append((i, text))
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, LONG), (1, rows[1][1])]

    def share(t):
        w = re.findall(r"[^\W\d_]+", (t or "").lower())
        s = list(zip(*(w[k:] for k in range(5))))
        return (1 - len(set(s)) / len(s) if s else 0.0), len(w)

    df = frame(spark, rows, "doc_id long, text string")
    want = {i for i, t in rows if share(t)[1] >= 50 and share(t)[0] >= 0.3}
    assert {r["doc_id"] for r in repetition.found(df).collect()} == want and 200 in want
    for r in repetition.measure(df).collect():
        assert r["repeated_share"] == pytest.approx(share(dict(rows)[r["doc_id"]])[0])
    lines = repetition.measure(frame(spark, [(1, "Heim\nsay this line of eight words here now.\nsay this line of eight words here now.\n")], "doc_id long, text string")).first()
    assert lines["open_lines"] == 1 and lines["repeated_lines"] == 1 and lines["n_lines"] == 3 and lines["punctuation_lines"] == 0
    assert repetition.found(df.limit(0)).count() == 0


def verdicts(text, rules=repetition.RULES):
    lines = text.split("\n")
    none = np.zeros(len(lines), int)
    return repetition.judge(lines, none, none, 0.5, rules)


def test_repetition_line_rules():
    assert verdicts("Heim\nSuche\nÜber uns\nA whole sentence stands here.") == ["punctuation"] * 3 + [None]
    assert verdicts("A heading\nA whole sentence stands here.\nOther heading\nMore of it.") == [None] * 4
    assert verdicts("- one\n- two\n- three\n* Head\n* Two\n* Three\n1. a\n2. b\n3. c") == [None] * 9
    assert verdicts("Главная | Поиск | Вход | Помощь")[0] == "navigation" and verdicts("| a | b | c | d |")[0] is None and verdicts("a > b and c < d holds.")[0] is None
    assert verdicts("© 2020 Jemand. Alle Rechte.")[0] == "boilerplate" and verdicts("https://x.example/a me@x.example")[0] == "boilerplate" and verdicts("see https://x.example/a")[0] is None
    assert verdicts("Page 1 of it here now.\nPage 22 of it here now.\nPage 3 of it here now.") == ["boilerplate"] * 3
    assert verdicts("Heim\nSuche\nWeg", ("navigation",)) == [None] * 3 and verdicts("") == [None] and verdicts(" \n\t") == [None, None]


def test_repetition_cleaning(spark):
    once = [f"{a} {b} {c} stands here." for a, b, c in zip("red blue green brown".split(), "house garden river tree".split(), "old new wide tall".split())]
    said = "the same eight words are said over again."
    bars = ["one | two | three | four", "five | six | seven | eight", "nine | ten | eleven | twelve"]
    text = "\n".join(["Home", "Back", "Next page", *once, "", said, said, "A heading"])
    menu = "\n".join([*bars, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau."] + [f"{x} | {x}b | {x}c | {x}d" for x in map(chr, range(97, 110))])
    rows = [(1, text), (2, menu), (3, None), (4, ""), (5, "Home\nNext\nBack"), (6, LONG)]
    got = {r["doc_id"]: r for r in repetition.measure(frame(spark, rows, "doc_id long, text string"), cleaned=True).collect()}
    assert got[1]["cleaned"] == "\n".join([*once, "", said, "A heading"]) and not got[1]["rejected"]
    assert got[1]["lost_share"] == pytest.approx((17 + len(said)) / sum(len(x) for x in text.split("\n")))
    assert got[2]["rejected"] and not got[2]["repetitive"] and got[2]["cleaned"].startswith("alpha beta") and "|" not in got[2]["cleaned"]
    assert got[3]["cleaned"] is None and got[4]["cleaned"] == "" and got[5]["cleaned"] == "" and not got[5]["rejected"]
    assert got[6]["rejected"] and got[6]["repetitive"]
    # a document is rejected by what the line rules remove
    without = {r["doc_id"]: r for r in repetition.measure(frame(spark, rows, "doc_id long, text string"), rules=("punctuation", "repetition"), cleaned=True).collect()}
    assert not without[2]["rejected"] and without[2]["cleaned"] == menu and without[6]["rejected"]
    assert not any(r["rejected"] for r in repetition.measure(frame(spark, rows, "doc_id long, text string"), rules=("punctuation",)).collect())
    with pytest.raises(ValueError):
        repetition.measure(frame(spark, rows, "doc_id long, text string"), rules=("other",))
    assert {r["doc_id"] for r in repetition.found(frame(spark, rows, "doc_id long, text string")).collect()} == {6}
