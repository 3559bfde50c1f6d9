"""Queries over texts beyond ASCII, by hand and by brute force on small tables."""

import datetime as dt
from collections import Counter

import pytest

import __spark_entry__ as entry

TEXTS = [
    "The vector, a Vector.", "Évector vectoré vector\u00df \u00abvector\u00bb", "\u0648vector vector\u06f1 vector\u060c", "stra\u00dfe \u2013 archive \u00fcber VECTOR", "\u0130stanbul vector", None, "", "nichts dar\u00fcber",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, "", t) for i, t in enumerate(TEXTS)], "doc_id bigint, title string, content string").write.parquet(f"{path}/docs.parquet")
    return path


def rows(spark, folder, name):
    return sorted(tuple(r) for r in entry.queries()[name](spark, folder).collect())


def test_match_positions(spark, folder):
    assert rows(spark, folder, "q_match_positions") == [(0, 4), (0, 14), (1, 25), (2, 16), (3, 22), (4, 9)]


def test_highlight(spark, folder):
    marked = dict(rows(spark, folder, "q_highlight_full"))
    assert set(marked) == set(range(len(TEXTS)))
    assert marked[0] == "The <mark>vector</mark>, a <mark>Vector</mark>."
    assert marked[1] == "Évector vectoré vector\u00df \u00ab<mark>vector</mark>\u00bb"
    assert marked[2] == "\u0648vector vector\u06f1 <mark>vector</mark>\u060c"
    assert marked[3] == "stra\u00dfe \u2013 <mark>archive</mark> \u00fcber <mark>VECTOR</mark>"
    assert marked[4] == "\u0130stanbul <mark>vector</mark>" and marked[5] is None and marked[6] == ""


# ---- vocabulary

WORDS = ["vectr\u00e9", "\u00fcber", "\u0648\u0698\u0647", "vektor", "v\u00e9ctr", "archive", "na\u00efve"]


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame([(1, "", " ".join(WORDS))], "doc_id bigint, title string, content string").write.parquet(f"{path}/docs.parquet")
    return path


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def grams(term):
    return [f"${term}$"[i : i + 2] for i in range(len(term) + 1)]


def likeness(a, b):
    x, y = set(grams(a)), set(grams(b))
    return len(x & y) / len(x | y)


def test_whole_vocabulary(spark, words):
    assert rows(spark, words, "q_edit_distance") == sorted((w, distance(w, "vectr")) for w in WORDS)
    assert rows(spark, words, "q_edit_distance_capped") == sorted((w, min(4, distance(w, "vectr"))) for w in WORDS)
    assert rows(spark, words, "q_jaccard") == sorted((w, round(likeness(w, "vectr"), 6)) for w in WORDS)
    assert rows(spark, words, "q_kgram_counts") == sorted((w, len(w) + 1) for w in WORDS)


def test_suggestions_beyond_ascii(spark, words):
    def best(word):
        shared = {w: sum(n for g, n in Counter(grams(word)).items() if g in grams(w)) for w in WORDS}
        near = [w for w in WORDS if abs(len(w) - len(word)) <= 3 and shared[w] >= max(1, (len(word) + 1) // 4) and distance(w, word) <= 3]
        scored = sorted((-round(1 / (1 + distance(w, word)) * (0.5 + 0.5 * likeness(w, word)), 6), distance(w, word), w) for w in near)
        return [(w, d, -score) for score, d, w in scored[:5]]

    got = [r for r in rows(spark, words, "q_spell_suggest") if r[0] == "vectr"]
    assert [(r[1], r[2], r[4]) for r in sorted(got, key=lambda r: r[5])] == best("vectr")
    assert rows(spark, words, "q_did_you_mean") == [best("vectr")[0]] and not best("vectr")[0][0].isascii()
    assert rows(spark, words, "q_correct_query") == [(f"{best('vectr')[0][0]} archive bukcet", True)]


def test_all_sizes(spark, tmp_path):
    sizes = [0, 1023, 1024, 1536, 5 * 1024**2, 7 * 1024**3 // 2, 2 * 1024**4, None]
    spark.createDataFrame([(i, n, dt.datetime(2024, 1, 31)) for i, n in enumerate(sizes)], "doc_id bigint, file_size bigint, date_added timestamp_ntz").write.parquet(f"{tmp_path}/docs.parquet")
    assert [r[3] for r in rows(spark, str(tmp_path), "q_display")] == ["0 B", "1023 B", "1 KB", "1.5 KB", "5 MB", "3.5 GB", "2 TB", None]


def test_index_add_goes_through_add_documents(spark, folder, monkeypatch, tmp_path):
    from brindle.operators import index

    called, add = [], index.add_documents
    monkeypatch.setattr(index, "add_documents", lambda *a: called.append(1) or add(*a))
    spark.createDataFrame([(1, "", "alpha", None), (2, "", "alpha beta", None), (3, "", "beta", "x.md")], "doc_id bigint, title string, content string, file_name string").write.parquet(f"{tmp_path}/docs.parquet")
    assert rows(spark, str(tmp_path), "q_index_add") == [("alpha", 2), ("beta", 2)] and called
