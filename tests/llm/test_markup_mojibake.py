import itertools
import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import markup, mincut, mojibake


# ---- minimum cut


def cost(labels, as_boilerplate, as_content, edges):
    return sum(b if not x else c for x, b, c in zip(labels, as_boilerplate, as_content, strict=True)) + sum(w for i, j, w in edges if labels[i] != labels[j])


weights = st.integers(0, 6).map(float)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(weights, weights), min_size=1, max_size=8), st.data())
def test_cut_is_minimal(terminals, data):
    n = len(terminals)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), weights), max_size=12))
    b, c = [t[0] for t in terminals], [t[1] for t in terminals]
    got = cost(mincut.label(b, c, edges), b, c, edges)
    assert got == min(cost(x, b, c, edges) for x in itertools.product([True, False], repeat=n))


def test_cut_of_nothing():
    assert mincut.label([], [], []) == []


# ---- markup

CASES = [
    ("<!DOCTYPE html><html><head><title>x</title><style>p { }</style></head><body><h2>Top</h2><p>One <b>two</b> &amp; <a href='u'>three</a><ul><li>a<li>b</ul><pre>if a &lt; b:\n  <b>c</b></pre></body></html>",
     "x.md", "html", ["heading", "list", "code", "link", "emphasis"], "## Top\n\nOne two & three\n\n- a\n- b\n\n```\nif a < b:\n  c\n```"),
    ("# Top\n\nSome *words* and `code *x*` [t](http://a \"b\").\n\n- one\n  - two\n\n```py\n# no heading\n* no list\n```\n\nEnd $x^2$.", "a.html", "markdown", ["heading", "list", "code", "formula", "link", "emphasis"],
     "# Top\n\nSome words and code *x* t.\n\n- one\n  - two\n\n```\n# no heading\n* no list\n```\n\nEnd $x^2$."),
    ("Title\n=====\n\nText [a][r] here.<br/>\n\n- - -\n\n[r]: http://x\n", None, "markdown", ["heading", "link"], "# Title\n\nText a here."),
    ("== Top ==\n\n'''Bold''' [[Page|page]] {{hint|x}} text.<ref>note</ref>\n\n* a\n** b\n#c\n\n<source>\n== no ==\n</source>\n\n:<math>a+b</math>\n\n[[Category:X]]", "a.txt", "wiki",
     ["heading", "list", "code", "formula", "link", "emphasis"], "## Top\n\nBold page  text.\n\n- a\n  - b\n- c\n\n```\n== no ==\n```\n\n$a+b$"),
    ("\\documentclass{article}\n\\begin{document}\n\\section*{Top}\\label{s}\n\n% \\emph{draft}\n{\\bf Bold} \\href{u}{text} \\& $a$~\\cite{k}.\n\n\\begin{itemize}\n  \\item one\n  \\item two\n\\end{itemize}\n\n\\begin{verbatim}\n\\emph{no}\n\\end{verbatim}\n\\[ x \\]\n\\end{document}",
     None, "latex", ["heading", "list", "code", "formula", "link", "emphasis"], None),
]


@pytest.mark.parametrize("text,name,syntax,elements,clean", CASES)
def test_notations(text, name, syntax, elements, clean):
    got = markup.convert(text, name)
    assert got[:2] == (syntax, elements)
    if clean is not None:
        assert got[2] == clean


PLAIN = [
    None, "", "   ", "Here a < b and c > d for all.", "It costs $40 to $54 per token.", "Use x = 3 * y * 2 as the adapter.", "The type List<Term> is generic.", "Press <name> and wait [3], 50 % of the time.",
    "Open index_worker_v2 or #7.", "The {summary} part.", "See C# and F# notes; 2 == 2 is true & fine.", "Files lie under D:\\profiles\\snippets now.",
]


@pytest.mark.parametrize("text", PLAIN)
@pytest.mark.parametrize("name", [None, "a.html", "b.MD", "c.tex", "d.wiki", "."])
def test_plain_stays_plain(text, name):
    assert markup.convert(text, name) == (None, [], text)


@pytest.mark.parametrize("text", ["<p>a<pre>b", "```\ncode", "# a\n\n```x\n" + "y\n" * 3000, "\\begin{lstlisting}\nx", "\\section{a}\\[ x", "<source>\nx", "<h1>a", "== a ==\n<pre>", "$$\na", "<p>x</p>" * 2000, "> " * 500 + "*a*"])
def test_unclosed_and_long(text):
    markup.convert(text, "a.md")


@settings(max_examples=150, deadline=None)
@given(st.text("<>/ph1b*#`=[]()'\\{}$&; \n-ab", max_size=80), st.sampled_from(["html", "markdown", "wiki", "latex"]))
def test_scanners_take_anything(text, syntax):
    found = markup.blocks(text, syntax)
    assert len(markup.labels(found)) == len(found)


def test_clean_frame(spark):
    df = spark.createDataFrame([(1, CASES[0][0], "x"), (2, None, None), (3, "plain", "p.md")], "doc_id bigint, content string, file_name string").withColumn("syntax", F.lit(1)).withColumn("text", F.lit("clash"))
    got = {r.doc_id: (r.syntax, r.elements) for r in markup.clean_text(df).collect()}
    assert got == {1: ("html", CASES[0][3]), 2: (None, []), 3: (None, [])}
    assert markup.clean_text(df.limit(0)).count() == 0


# ---- wrong encodings

WORDS = {
    "de": "größe über schlüssel wörter für die prüfung ländlich auf käufer".split(), "ru": "поиск индекса строка запрос словарь текст узел это или что".split(),
    "fr": "requête numérique préfixe détaillé déjà créé où élève".split(), "en": "the vector index of a long archive — “quoted” café".split(),
}


def clean_texts(n=300):
    rnd = random.Random(7)
    return [" ".join(rnd.choice(WORDS[list(WORDS)[i % 4]]) for _ in range(25)) for i in range(n)]


GARBLE = [("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp850"), ("utf-8", "cp437"), ("utf-8", "mac-roman")]


def test_found_and_restored(spark):
    texts = clean_texts()
    rows, truth = list(enumerate(texts)), {}
    for k, (right, wrong) in enumerate(GARBLE):
        for j in range(2):
            i, source = len(rows), texts[4 * (10 * k + j) + (0 if k % 2 else 2)]
            rows.append((i, "the archive " + source.encode(right).decode(wrong)))
            truth[i] = "the archive " + source
    twice = texts[0].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    by_bytes = texts[1].encode("cp1251").decode("latin-1")
    rows += [(1000, twice), (1001, by_bytes), (1002, "a lost ch\ufffdr"), (1003, None), (1004, ""), (1005, "plain ascii"), (1006, "Âge et Ãngela: 3 × 4 ½."), (1007, "CONFIGURAÇÃO — SÃO"), (1008, "日本 索引 検索"), (1009, "\xa0")]
    truth |= {1000: texts[0], 1001: texts[1]}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("garbled", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.garbled, r.text) for r in mojibake.repair(df).collect()}
    assert {i for i, (g, _) in got.items() if g} == set(truth) | {1002}
    restored = sum(got[i][1] == t for i, t in truth.items())
    assert restored >= len(truth) - 1
    assert got[1003] == (False, None) and got[1004] == (False, "")
    assert all(got[i][1] == t for i, t in enumerate(texts))
    assert mojibake.repair(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [3, 10])
@pytest.mark.parametrize("copies", [True, False])
@pytest.mark.parametrize("wrong", ["latin-1", "cp1251", "cp437"])
def test_frequent_garbling_is_found(spark, share, copies, wrong):
    texts = clean_texts()
    n = len(texts) // (share - 1)
    sources = [texts[2]] * n if copies else [texts[4 * (i // 2) + 2 * (i % 2)] for i in range(n)]
    rows = list(enumerate(texts + [f"{i if not copies else ''} {t}".encode().decode(wrong) for i, t in enumerate(sources)]))
    got = {r.doc_id: (r.garbled, r.text) for r in mojibake.repair(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i for i, (g, _) in got.items() if g} == set(range(len(texts), len(rows)))
    wanted = [f"{i if not copies else ''} {t}" for i, t in enumerate(sources)]
    assert sum(got[len(texts) + i][1] == t for i, t in enumerate(wanted)) >= 0.9 * n


def test_runs_are_maximal_scoring():
    import numpy as np

    info = np.array([5.0, 5, -4, -3, 5, 5, 5, -9, 1, -9, 5])
    runs = mojibake.improbable_runs(info, expected=0.0, least=2.0, drop=6.0)
    assert runs == [(2, 4), (7, 10)]
    assert mojibake.improbable_runs(np.array([]), 0.0) == []


# ---- restored texts, measured on texts that no margin was set on


def misread(text, right, wrong):
    out = []
    for b in text.encode(right):
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_share_of_texts_restored_exactly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    repairer = mojibake.Repairer(mojibake.model_of(docs, "text"))
    texts = [r.text for r in docs.select("text").distinct().orderBy("text").collect() if r.text and not r.text.isascii()]
    rnd = random.Random(11)
    clean = [t for t in rnd.sample(texts, 1500) if not repairer.examine(t)[0]]
    least = {("utf-8", "cp1252"): (0.99, 0.97), ("utf-8", "cp1251"): (0.99, 0.97), ("koi8-r", "cp1251"): (0.97, 0.85), ("cp1251", "cp1252"): (0.97, 0.8), ("cp1252", "mac-roman"): (0.9, 0.6)}
    for (right, wrong), (found_least, exact_least) in least.items():
        found = exact = n = 0
        for text in clean:
            words = text.split(" ")
            start = rnd.randrange(len(words))
            end = start + rnd.randint(3, 25)
            part = " ".join(words[start:end])
            try:
                garbled = misread(part, right, wrong)
            except UnicodeEncodeError:
                continue
            if garbled == part or n == 60:
                continue
            n += 1
            marked, made = repairer.examine(" ".join([*words[:start], garbled, *words[end:]]))
            found += marked
            exact += made.translate(mojibake._FOLD) == text.translate(mojibake._FOLD)
        assert n == 60 and found >= found_least * n and exact >= exact_least * n, (right, wrong, n, found, exact)


def test_lost_words_are_found(spark):
    rows = [(1, "?????? ?? ????????? ???? word."), (2, "What??? Yes! Really??"), (3, "why ?? because"), (4, "in a ?????????. text"), (5, "\xa0"), (6, "caf�"), (7, None)]
    got = {r.doc_id: (r.garbled, r.text) for r in mojibake.repair(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i for i, (g, _) in got.items() if g} == {1, 4, 6} and all(got[i][1] == t for i, t in rows)


def test_a_short_run_follows_the_long_one(spark):
    plain = ["и в не для поиска словарь и индекс в базе", "не и в для документов и слов", "la maison est près de la rivière"] * 40
    texts = [(i, f"{t} {i}") for i, t in enumerate(plain)] + [(900, misread("для поиска и словарь в базе", "cp1251", "cp1252"))]
    got = {r.doc_id: r.text for r in mojibake.repair(spark.createDataFrame(texts, "doc_id bigint, text string")).where("garbled").collect()}
    assert got == {900: "для поиска и словарь в базе"}


# ---- markup: hostile texts, the fit and the cut


@pytest.mark.parametrize("text", ["# a\n\n$x$ b \ufdd19\ufdd2 c\n", "# a\n\n`x` b \ufdd39\ufdd4 c\n", "\\section{a}\n\n\\emph{b} \\(x\\) \ufdd10\ufdd2 \ufdd5 c", "<p>\\(x\\) \ufdd10\ufdd2 \ufdd3\ufdd4\ufdd5 <b>c</b></p>", "== a ==\n\n[[b]] \ufdd10\ufdd2\ufdd5"])
def test_characters_of_the_scanners_are_kept(text):
    syntax, _, made = markup.convert(text)
    kept = [c for c in text if c in markup.HELD]
    assert syntax and [c for c in made if c in markup.HELD] == kept


LONG = {
    "references": "a <ref>", "parentheses": "\\( a ", "stars": "**a ", "underscores": "_a ", "elements": "<div>", "comments": "<!--", "declarations": "<!a", "quotes": ">", "lines": "\n",
    "cite": "\\cite[", "sections": "\\section{", "links": '[a](b "', "brackets": "[", "braces": "{{", "dollars": "$$ a ", "apostrophes": "''a '''b ", "items": "<ul><li>a", "attributes": "href ",
}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_of_unclosed_marks(name):
    text = {"attributes": "<a ", "lines": "# a"}.get(name, "") + LONG[name] * (1_000_000 // len(LONG[name]))
    began = time.process_time()
    for syntax in ("html", "markdown", "wiki", "latex"):
        found = markup.blocks(text, syntax)
        assert len(markup.labels(found)) == len(found)
    markup.notation(text)
    assert time.process_time() - began < 45


def test_the_cut_changes_labels_and_is_right(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/docs.parquet")
    model = markup.fit(docs)
    right = wrong = 0
    for r in docs.select("content", "file_name").collect():
        if syntax := markup.notation(r.content, r.file_name, model):
            found = markup.blocks(r.content, syntax)
            for b, kept, own in zip(found, markup.labels(found, model), markup.own_costs(found, model) if found else [], strict=True):
                if kept != (own >= 0):
                    # the titles of pages: text by itself, but in the head
                    right += kept == (not b.frame and b.kind not in markup._FRAME)
                    wrong += kept != (not b.frame and b.kind not in markup._FRAME)
    assert right >= 20 and wrong == 0


def test_navigation_is_no_content():
    links = "".join(f"<li><a href='/{i}'>p{i}</a></li>" for i in range(6))
    page = f"<html><body><div><h1>Title</h1><p>A long paragraph of text that says something. It goes on for a while.</p></div><nav><ul>{links}</ul></nav></body></html>"
    _, elements, made = markup.convert(page)
    assert elements == ["heading"] and "long paragraph" in made and "p3" not in made
    # links of an article stay, and so does an article in the frame
    _, elements, made = markup.convert(page.replace("nav>", "div>"))
    assert "list" in elements and "p3" in made
    _, _, made = markup.convert(page.replace("<div><h1>", "<aside><h1>").replace("</p></div>", "</p></aside>"))
    assert "long paragraph" in made


def test_fit_on_nothing(spark):
    model = markup.fit(spark.createDataFrame([(1, None, None), (2, "", "a.md")], "doc_id bigint, content string, file_name string"))
    assert (model.notation == markup.prior_weights()).all()
    assert markup.hint_of(None) is None and markup.hint_of("x") is None and markup.hint_of("x.MD ") == "markdown"


def test_maximum_flow_of_long_chains():
    rnd = random.Random(3)
    n = 20_000
    own = [rnd.uniform(-1, 1) for _ in range(n)]
    edges = [(i, i + 1, 1.0) for i in range(n - 1)]
    got = mincut.label([max(0, w) for w in own], [max(0, -w) for w in own], edges)
    # along a chain the cheapest labelling can be found step by step
    keep, drop, back = 0.0, 0.0, []
    for i, w in enumerate(own):
        a, b = (keep, drop + 1.0) if i else (0.0, 0.0)
        c, d = (drop, keep + 1.0) if i else (0.0, 0.0)
        back.append((a <= b, c <= d))
        keep, drop = min(a, b) + max(0, -w), min(c, d) + max(0, w)
    assert cost(got, [max(0, w) for w in own], [max(0, -w) for w in own], edges) == pytest.approx(min(keep, drop))
