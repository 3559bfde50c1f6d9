import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import text as X

TEXTS = [
    None, "", "   ", "C++ & C#", "état-major naïf", "نمایه‌سازی پویا", "a\tb\n c d", "the cat and THE dog", "a ab a1 1-2-3 -- x_y 2024q1ab",
    "w" * 30 + " " + "v" * 31, "Émile's state-of-the-art",
]


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_normalize(spark):
    got = column(spark, TEXTS, X.normalize)
    assert got[:5] == ["", "", "", "c c", "état-major naïf"]
    assert got[5] == "نمایه سازی پویا"
    assert got[6] == "a b c d"


def test_tokenize_agrees_with_driver(spark):
    assert column(spark, TEXTS, X.tokenize) == [X.tokenize_query(t) for t in TEXTS]


def test_stop_rule(spark):
    assert column(spark, TEXTS, X.tokenize)[8:10] == [["ab", "x_y", "2024q1ab"], ["w" * 30]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_tokenize_any(spark, texts):
    texts = [t.replace("\x00", "") for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)] or ["x"]
    ascii_or_latin = [t for t in texts if all(ord(c) < 0x250 and c != "İ" for c in t)] or ["x"]
    assert column(spark, ascii_or_latin, X.tokenize) == [X.tokenize_query(t) for t in ascii_or_latin]


def test_kgrams(spark):
    assert column(spark, ["ab", "", None], X.kgrams) == [["$a", "ab", "b$"], [], []]
    assert column(spark, ["abc", "ab"], lambda c: X.kgrams(c, 3, 3)) == [["$ab", "abc", "bc$"], []]


def test_jaccard_is_symmetric(spark):
    df = spark.createDataFrame([("night", "nacht"), ("a", "a"), ("abc", "xyz")], "a string, b string")
    rows = df.select(X.jaccard(F.col("a"), F.col("b")), X.jaccard(F.col("b"), F.col("a"))).collect()
    assert all(x == y for x, y in rows)
    assert [r[0] for r in rows][1:] == [1.0, 0.0]


def test_edit_distance(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "abc"), ("é", "e"), ("abcdef", "uvwxyz")], "a string, b string")
    assert [tuple(r) for r in df.select(X.edit_distance(F.col("a"), F.col("b")), X.edit_distance(F.col("a"), F.col("b"), 3)).collect()] == [(3, 3), (3, 3), (1, 1), (6, 4)]


@pytest.mark.parametrize(
    "word,expected",
    [
        ("running", ["runn", "runne", "runned", "runns"]), ("used", ["use", "using", "uss"]),
        ("cats", ["cat", "cating", "cated"]), ("faster", ["fast", "faste", "fastest", "fasting"]), ("class", ["classs", "classed", "classing", "classer", "classly"]),
    ],
)
def test_variations(spark, word, expected):
    assert column(spark, [word], X.variations)[0] == expected


def test_extension(spark):
    names = ["a.tar.gz", ".gitignore", "name.", "NAME.TXT", "plain", None]
    assert column(spark, names, X.file_extension) == ["gz", "gitignore", "unknown", "txt", "unknown", None]
    assert column(spark, ["pdf", "md", "xyz"], X.file_type_name) == ["PDF Documents", "Markdown Files", "XYZ Files"]


def test_size_category(spark):
    sizes = [0, 1023, 1024, 10239, 10240, 102399, 102400, 1048575, 1048576, None]
    assert column(spark, sizes, X.size_category, "bigint") == [0, 0, 1, 1, 2, 2, 3, 3, 4, None]
    assert column(spark, [5, 2048, None], X.size_category_label, "bigint") == ["< 1 KB", "1-10 KB", None]
    assert column(spark, [0, 500, 1536, 1 << 20], X.human_size, "bigint") == ["0 B", "500 B", "1.5 KB", "1 MB"]


def test_truncate_and_preview(spark):
    texts = ["x" * 199, "x" * 200, "x" * 201, "a" * 170 + " " + "b" * 60, "a" * 100 + " " + "b" * 160, None]
    got = column(spark, texts, X.truncate)
    assert got == ["x" * 199, "x" * 200, "x" * 200 + "...", "a" * 170 + "...", "a" * 100 + " " + "b" * 99 + "...", ""]
    assert column(spark, ["y" * 220, "y" * 221], X.preview) == ["y" * 220, "y" * 220 + "..."]


def test_like_pattern():
    assert X.like_pattern("a*b?c") == "a%b_c"
    assert X.like_pattern("50%_x\\*") == "50\\%\\_x\\\\%"
    assert X.like_pattern("") == ""


def test_shown_values(spark):
    from brindle.functions import text as X

    row = spark.sql("select 2.345d x, timestamp'2024-01-31 23:30:00' t, cast(null as double) n").select(
        X.shown_number(F.col("x"), 2), X.shown_number(F.col("x"), 0), X.shown_date(F.col("t"), "Asia/Tehran"), X.shown_date(F.col("t"), long=True),
    ).first()
    assert tuple(row) == ("2.35", "2", "Feb 01, 2024", "Wednesday, January 31, 2024 11:30:00 PM")
    assert X.pager(3) == [0, 1, 2] and X.pager(9) == [0, 1, 2, 3, 4] and X.pager(0) == [] and X.query_kgrams("ab") == ["$a", "ab", "b$"]
