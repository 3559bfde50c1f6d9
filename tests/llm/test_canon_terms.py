import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import bursttrie, canon, distinct
from brindle.llm.terms import TermSplitter

NO_SURROGATES = st.characters(exclude_categories=("Cs",), exclude_characters="\x00")


def slow_terms(text):
    out = "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) in ("Mn", "Nd", "Pc") or c == "-" else " " for c in (text or "").lower())
    return [p for p in out.split(" ") if any(unicodedata.category(c)[0] == "L" for c in p)]


@settings(max_examples=300, deadline=None)
@given(st.text(NO_SURROGATES, max_size=60))
def test_terms_any_text(text):
    assert TermSplitter().split(text) == slow_terms(text)


def test_terms():
    assert TermSplitter().split("Ab-c d_1 22 -- ² 𝐀b x\u0301 نمایه‌سازی") == ["ab-c", "d_1", "𝐀b", "x\u0301", "نمایه", "سازی"]
    assert TermSplitter().split(None) == TermSplitter().split("") == []


# ---- canonical text


@pytest.mark.parametrize(
    "written,form",
    [
        ("Ｆｕｌｌ", "full"), ("cafe\u0301", "café"), ("a\u200bb\u00adc", "abc"), ("a\u00a0\u2003b", "a b"), ("ﬁne", "fine"), ("Straße", "strasse"),
        ("раре", "pape"), ("a\r\nb\u2028c", "a\nb\nc"), ("ي ك", "ی ک"), ("\u200b", ""), ("", ""), (None, None), ("Ё", "ё"), ("co‑op − x", "co-op - x"),
    ],
)
def test_forms(written, form):
    expected = canon.canonical_text(form) if form else form
    assert canon.canonical_text(written) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(NO_SURROGATES, max_size=40), st.booleans())
def test_form_is_stable(text, fold):
    once = canon.canonical_text(text, fold)
    assert canon.canonical_text(once, fold) == once


def test_phrases():
    finder = canon.PhraseFinder([(1, "Common Copy"), (2, "café index"), (3, "نمایه‌سازی پویا"), (4, "\u200b"), (5, "Common Copy")])
    assert sorted(finder.hidden("a Cоmmon Copy")) == [1, 5]
    assert finder.hidden("a Common Copy, plain") == []
    assert sorted(finder.hidden("Common Copy and Common\u00a0Copy")) == [1, 5]
    assert finder.hidden("common cоpy") == [] and finder.hidden("Copy Cоmmon") == []
    assert finder.hidden("xCоmmon Copy") == [] and finder.hidden("Cоmmon Copyx") == [] and sorted(finder.hidden("(Cоmmon Copy)")) == [1, 5]
    assert finder.hidden("cafe\u0301 index") == [2] and finder.hidden("cafe index") == [] and finder.hidden("ｃafé index") == [2]
    assert finder.hidden("نمایه‌سازي پویا") == [3]
    assert finder.hidden(None) == finder.hidden("") == []
    assert canon.PhraseFinder([]).hidden("x") == []


def test_phrases_frame(spark):
    df = spark.createDataFrame([(1, "Cоmmon Copy", 7), (2, None, 7), (None, "Cоmmon Copy", 7), (4, "Cоmmon Copy " * 3000, 7)], "id bigint, text string, record_id int")
    phrases = spark.createDataFrame([(1, "Common Copy"), (2, None)], "ref_id bigint, phrase string")
    for block in (1, 100):
        assert sorted((r[0] or 0, r[1]) for r in canon.hidden_phrases(df, "id", "text", phrases, block=block).collect()) == [(0, 1), (1, 1), (4, 1)]
    assert canon.hidden_phrases(df.limit(0), "id", "text", phrases).count() == 0
    assert canon.hidden_phrases(df, "id", "text", phrases.limit(0)).count() == 0
    got = {r.id: r.canonical for r in canon.canonical(df.where("id is not null"), "id", "text").collect()}
    assert got[1] == "common copy" and got[2] is None


# ---- term counts and distinctiveness

RECORDS = [(1, "Alpha", "alpha beta"), (2, None, "beta gamma"), (3, "", ""), (4, None, None), (5, "alpha", "x" * 5000 + " delta " * 2000), (5, "alpha", "beta"), (6, "ab abc abcd", "b ba bab")]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "doc_id bigint, title string, content string").withColumn("term", F.lit("clash")).withColumn("id", F.lit(0))


def counted():
    occurrences, seen = Counter(), Counter()
    for _, a, b in RECORDS:
        terms = slow_terms(a) + slow_terms(b)
        occurrences.update(terms)
        seen.update(set(terms))
    return {t: (n, seen[t]) for t, n in occurrences.items()}


@pytest.mark.parametrize("burst,routes", [(1, 1), (1, 64), (2048, 256)])
def test_counts(records, burst, routes):
    got = bursttrie.term_counts(records, "doc_id", ("title", "content"), burst, routes).collect()
    assert len(got) == len({r.term for r in got})
    assert {r.term: (r.occurrences, r.records) for r in got} == counted()


def test_marks(spark, records):
    got = {r.term: r.mark for r in bursttrie.marked(bursttrie.term_counts(records, "doc_id", ("title", "content")), len(RECORDS)).collect()}
    assert got["alpha"] == "common" and got["gamma"] == "rare" and got["beta"] == "common"
    assert bursttrie.term_counts(records.limit(0), "doc_id", ("title", "content")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abc", max_size=6), max_size=80), st.integers(1, 5))
def test_trie(terms, burst):
    trie = bursttrie.BurstTrie(burst)
    for t in terms:
        trie.add(t, 1, 1)
    got = Counter({p + s: c[0] for p, e in trie.subtrees() for s, c in e.items()})
    assert got == Counter(terms)
    assert all(len(e) <= burst or len(p) == 1 and burst >= len(e) for p, e in trie.subtrees())


def test_distinctiveness(records):
    import math

    got = distinct.distinctiveness(records.drop("term", "id"), "doc_id", ("title", "content")).collect()
    df = {t: r for t, (_, r) in counted().items()}
    for r in got:
        assert r.df == df[r.term]
    one = next(r for r in got if (r.doc_id, r.term) == (1, "alpha"))
    assert one.tf == 2 and one.score == pytest.approx(2 / 3 * (math.log(8 / 4) + 1))
    assert {r.doc_id for r in got} == {1, 2, 5, 6}
    assert distinct.distinctiveness(records.limit(0), "doc_id", ("title", "content")).count() == 0


def test_every_code_point_has_a_stable_form():
    for fold in (True, False):
        for code in range(0x110000):
            if not 0xD800 <= code < 0xE000:
                once = canon.canonical_text(chr(code), fold)
                if once != chr(code):
                    assert canon.canonical_text(once, fold) == once, hex(code)


@pytest.mark.parametrize("shown,plain", [("ꓮꓐꓚ", "ABC"), ("ⲤⲞⲢⲦ", "COPT"), ("𐐄𐐕", "OC"), ("ⲥⲟ", "co"), ("ᴠᴄᴏ", "vco"), ("ꜱᴜᴢ", "suz"), ("СОРТ", "COPT"), ("ΑΒΕ", "ABE"), ("ᎪᏟᎬ", "ACE"), ("ՏՕՍ", "SOU")])
def test_scripts(shown, plain):
    assert canon.canonical_text(shown, False) == plain


def test_tries_are_written_out(spark):
    rows = [(i, " ".join(f"t{j}x" for j in range(i, i + 50))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    whole = {r.prefix for r in bursttrie.subtrees(df, "doc_id", ("text",), 8).collect()}
    parts = bursttrie.subtrees(df, "doc_id", ("text",), 8, most=20)
    assert whole and sum(sum(r.occurrences) for r in parts.collect()) == 400 * 50
    got = {r.term: (r.occurrences, r.records) for r in bursttrie.term_counts(df, "doc_id", ("text",), 8, 4).collect()}
    assert got["t100x"] == (50, 50) and len(got) == 449 and sum(o for o, _ in got.values()) == 400 * 50
