import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from brindle.functions.text import tokenize_query
from brindle.operators import analytics, documents, expand, facets, highlight, index, rank, search, spell, stats

T0 = dt.datetime(2024, 1, 31, 23, 30)
DOCS = [
    (1, "Vector search", "vector index vector", T0, "a.TXT", 10), (2, "", "an index of vectors", dt.datetime(2024, 2, 1), "b.pdf", 2000),
    (3, "Empty", "", dt.datetime(2024, 2, 2), None, 1 << 20), (4, None, None, dt.datetime(2024, 3, 1), "", 0), (5, "Search vector", "index search engine", dt.datetime(2024, 3, 1), "c", 500_000),
]
SCHEMA = "doc_id bigint, title string, content string, date_added timestamp_ntz, file_name string, file_size bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumn("is_indexed", F.col("doc_id") < 3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA + ", is_indexed boolean")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_postings_number_title_then_content(docs):
    got = {(r.doc_id, r.field, r.pos, r.raw, r.term) for r in index.postings(docs).where("doc_id = 1").collect()}
    assert got == {(1, "title", 0, "vector", "vector"), (1, "title", 1, "search", "search"), (1, "content", 2, "vector", "vector"), (1, "content", 3, "index", "index"), (1, "content", 4, "vector", "vector")}


def test_index_changes(docs, spark):
    built = index.postings(docs)
    changed = spark.createDataFrame([(1, "new", "words"), (9, "extra", "words")], "doc_id bigint, title string, content string")
    after = index.add_documents(built, changed)
    assert sorted(r.raw for r in after.where("doc_id in (1, 9)").collect()) == ["extra", "new", "words", "words"]
    assert index.remove_documents(built, docs.select("doc_id")).count() == 0
    empty, unmarked = index.clear(built, docs)
    assert empty.count() == 0 and unmarked.where("is_indexed").count() == 0
    assert index.mark_indexed(docs).where("is_indexed").count() == 5


def test_lists_and_lookups(docs, spark, tmp_path):
    built = index.postings(docs)
    lists = {r.term: r.doc_ids for r in index.posting_blocks(built).collect()}
    assert lists["vector"] == [1, 2, 5] and lists["index"] == [1, 2, 5]
    blocks = [r.doc_ids for r in index.posting_blocks(built, per_block=2).where("term = 'vector'").collect()]
    assert sorted(sum(blocks, [])) == [1, 2, 5] and all(b == sorted(b) for b in blocks)
    assert {r[0] for r in index.lookup(built, "engin").collect()} == {5}
    assert {r.term for r in index.range_scan(built, "e", "f").collect()} == {"engin", "empti"}
    assert [r[0] for r in index.vocabulary(built).collect()] == sorted({stem for stem in lists})
    assert rows(index.term_count(built))[0][0] == len(lists)
    path = str(tmp_path / "index")
    index.write_index(built, docs, path, 2)
    again = index.read_index(spark, path).postings
    assert sorted(rows(again.select("doc_id", "pos", "term"))) == sorted(rows(built.select("doc_id", "pos", "term")))
    assert sum(r.n_postings for r in index.index_layout(again).collect()) == built.count()
    index.index_to_json(built, str(tmp_path / "json"))
    nested = spark.read.schema("doc_id bigint, positions map<string, array<int>>").json(str(tmp_path / "json"))
    assert sorted(rows(index.index_from_json(nested).select("doc_id", "pos", "term"))) == sorted(rows(built.select("doc_id", "pos", "term")))


def test_persisted_index_prunes_by_term(docs, spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(index.postings(docs), docs, path, 2)
    plan = index.lookup(index.read_index(spark, path).postings, "vector")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,vector)" in plan and "ReadSchema: struct<doc_id:bigint,term:string>" in plan


def test_blocks_do_not_depend_on_the_ids(spark):
    scattered = spark.range(1000).select(F.xxhash64("id").alias("doc_id"), F.lit("word").alias("term"))
    sizes = [len(r.doc_ids) for r in index.posting_blocks(scattered, per_block=100).collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) < 160


def test_stored_index(docs, spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(index.postings(docs), docs, path, 2)
    stored = index.read_index(spark, path)
    assert dict(rows(stored.lengths)) == {1: 5, 2: 2, 3: 1, 4: 0, 5: 5} and rows(stored.figures) == [(5, 13 / 5)]
    assert sorted(rows(stored.vocabulary)) == sorted(rows(index.term_stats(index.postings(docs))))
    assert sorted(rows(stored.kgrams)) == sorted(rows(index.kgram_index(stored.vocabulary.select("term"))))
    for built in (stored, index.postings(docs)):
        assert dict(rows(search.ranked(docs, "vectors index", index=built))) == {i: pytest.approx(v) for i, v in rows(search.ranked(docs, "vectors index"))}
        assert rows(search.simple_search(docs, "vector search", "raw", built)) == [(1, 6.0)]
        assert rows(search.simple_search(docs, "engine zzz", "raw", built)) == [(5, 1.0)]
        assert {r[0] for r in search.boolean_search(docs, None, index=built).collect()} == set()
    vocab = index.term_stats(index.postings(docs))
    assert rows(spell.suggestions(stored.vocabulary, ["vectr"], grams=stored.kgrams)) == rows(spell.suggestions(vocab, ["vectr"]))
    # neither the title nor the content is read in a search over a written index
    docs.write.parquet(str(tmp_path / "docs"))
    written = spark.read.parquet(str(tmp_path / "docs"))
    for found in (search.ranked(written, "vectors index", index=stored), search.simple_search(written, "vectors", index=stored)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "content" not in plan and "title:" not in plan and "title#" not in plan
    parts = [rank.in_places(spark.range(1000).repartition(7), F.desc("id"))]
    assert [tuple(r) for r in parts[0].orderBy("rank").collect()] == [(999 - i, i + 1) for i in range(1000)]


def test_words_of_documents(docs, nothing):
    assert index.word_stats(nothing).count() == 0
    assert sorted(rows(index.word_stats(docs))) == sorted(rows(index.term_stats(index.raw_postings(docs), "raw")))


def test_statistics(docs, nothing):
    lengths = dict(rows(stats.document_lengths(docs)))
    assert lengths == {1: 5, 2: 2, 3: 1, 4: 0, 5: 5}
    assert rows(stats.collection_stats(docs)) == [(5, 13 / 5)]
    assert rows(stats.collection_stats(nothing)) == [(0, 0.0)]
    assert rows(stats.indexed_counts(docs)) == [(2, 5)]
    tf = {r.raw: (r.tf, r.title_tf, r.content_tf) for r in stats.term_frequencies(index.raw_postings(docs), "raw").where("doc_id = 1").collect()}
    assert tf["vector"] == (3, 1, 2)


def bm25_by_hand(words):
    tokens = {d[0]: tokenize_query(d[1]) + tokenize_query(d[2]) for d in DOCS}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {w: sum(w in t for t in tokens.values()) for w in words}
    out = {}
    for i, t in tokens.items():
        if all(w in t for w in words):
            out[i] = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * max(1, len(t)) / max(1, avg))) for w in set(words))
    return out


@pytest.mark.parametrize("words", [["vector"], ["vector", "index"], ["vector", "vector", "search"], ["nowhere"]])
def test_bm25(docs, words):
    expected = bm25_by_hand(words)
    for got in (rank.rank_documents(docs, words), rank.rank_postings(index.raw_postings(docs), docs, words, key="raw")):
        assert {i: pytest.approx(s) for i, s in expected.items()} == dict(rows(got))


def test_ranking_of_nothing(docs, nothing):
    assert rank.rank_documents(docs, []).count() == 0 and rank.rank_postings(index.raw_postings(docs), docs, [], key="raw").count() == 0
    assert rank.rank_documents(nothing, ["vector"]).count() == 0


def test_pages(docs):
    scored = docs.select("doc_id", F.lit(1.0).alias("score"))
    assert [r.doc_id for r in rank.page(scored, 1, 2).collect()] == [3, 4]
    assert [r.doc_id for r in rank.page(scored, 9, 2).collect()] == []
    assert [r.doc_id for r in rank.page(scored, -1, 2).collect()] == [1, 2]
    assert rank.page(scored, 3, 0).count() == 5
    assert (rank.page_count(0, 10), rank.page_count(11, 10), rank.page_count(5, 0)) == (0, 2, 1)
    assert "TakeOrderedAndProject" in rank.page(scored)._jdf.queryExecution().executedPlan().toString()


def test_simple_search(docs):
    assert [tuple(r) for r in search.simple_search(docs, "vector search", "raw").collect()] == [(1, 6.0)]  # only document 1 has the phrase
    # no phrase: any of the words, title matches twice, a repeated word counts again
    assert rows(search.simple_search(docs, "engine zzz", "raw")) == [(5, 1.0)]
    assert rows(search.simple_search(docs, "engine engine", "raw")) == [(5, 2.0)]
    assert search.simple_search(docs, "the", "raw").count() == 0
    assert {r[0] for r in search.simple_search(docs, "vectors").collect()} == {1, 2, 5}


def test_ranked_search(docs):
    vocab = index.term_stats(index.postings(docs))
    found = search.ranked_search(docs, "vectors index", vocab=vocab)
    assert (found.total, found.pages, found.error) == (3, 1, None)
    got = found.results.collect()
    assert [r.doc_id for r in got] == [1, 2, 5] or len(got) == 3
    assert any("<mark>vector</mark>" in r.snippet.text for r in got) and [r["rank"] for r in got] == [1, 2, 3]
    second = search.ranked_search(docs, "vectors index", 1, 2, highlight=False).results.collect()
    assert [r["rank"] for r in second] == [3] and [r["rank"] for r in search.ranked_search(docs, "vectors index", 0, 0).results.collect()] == [1, 2, 3]

    class Frequency:
        name = "frequency"

        def score(self):
            return F.col("tf")

    assert dict(rows(search.ranked(docs, "vector", "raw", ranking=Frequency()))) == {1: 3.0, 5: 1.0}
    assert search.ranked_search(docs.drop("content"), "vector", safe=True).error
    assert search.ranked_search(docs, "the").total == 0


def test_suggestions(spark):
    vocab = spark.createDataFrame([("vector",), ("victor",), ("sector",), ("index",), ("vectors",), ("zebra",)], "term string")
    got = rows(spell.suggestions(vocab, ["vecter"]).select("term", "edit_distance"))
    assert got[0] == ("vector", 1) and ("zebra", 5) not in got
    assert rows(spell.suggestions(vocab, ["Index"])) == [("index", "index", 0, 0.0, 1.0, 1)]
    assert spell.suggestions(vocab, ["", " "]).count() == 0
    fixed = spell.correct_query(vocab, "vecter the index qqqqqq").first()
    assert (fixed.corrected_query, fixed.has_corrections, fixed.corrections) == ("vector index qqqqqq", True, {"vecter": "vector"})
    assert spell.correct_query(vocab, "").first().corrected_query == ""
    assert rows(search.did_you_mean(vocab, "vectr"))[0][0] == "vector"


def test_expansion(spark):
    assert len(expand.synonym_pairs()) == 189 and len({p[0] for p in expand.synonym_pairs()}) == 45
    asked = spark.createDataFrame([("search",), ("files",), ("vector",)], "term string")
    got = {r.term: [s.syn for s in sorted(r.s)] for r in expand.synonyms(asked).groupBy("term").agg(F.collect_list(F.struct("ord", "syn")).alias("s")).collect()}
    assert got["search"][:7] == ["find", "query", "lookup", "seek", "locate", "retrieve", "request"]
    assert got["files"] == ["document", "record", "data"]
    assert "vector" not in got
    assert expand.expand_terms(["search", "vector"]) == ["search", "vector", "find", "query", "lookup"]
    assert dict(rows(expand.expand(asked)))["vector"] == ["vector"]
    related = dict(rows(expand.related(asked)))
    assert related["vector"] == ["vectors", "vectored", "vectoring", "vectorer", "vectorly"] and len(related["search"]) == 10


def test_facets(docs, nothing):
    assert rows(facets.type_facet(docs)) == [("pdf", "PDF Documents", 1), ("txt", "Text Files", 1), ("unknown", "UNKNOWN Files", 1)]
    assert rows(facets.month_facet(docs)) == [("2024-03", "March 2024", 2), ("2024-02", "February 2024", 2), ("2024-01", "January 2024", 1)]
    assert [r.value for r in facets.size_facet(docs).collect()] == ["Tiny", "Small", "Large", "VeryLarge"]
    assert rows(facets.term_facet(docs).select("value", "count")) == [("index", 3), ("search", 2), ("vector", 2)]
    assert facets.extract_facets(docs).count() == 3 + 3 + 4 + 3
    assert facets.extract_facets(nothing).count() == 0
    options = facets.filter_options(docs).first()
    assert options.types == ["pdf", "txt", "unknown"] and options.size_to == 1 << 20 and options.n_docs == 5
    assert tuple(facets.filter_options(nothing).first())[3:] == (0, 0, 0)


def test_filters(docs):
    ids = lambda **f: sorted(r.doc_id for r in facets.apply_filters(docs, **f).collect())
    assert ids() == [1, 2, 3, 4, 5]
    assert ids(types=["txt", "unknown"]) == [1, 5]
    assert ids(date_from=dt.datetime(2024, 2, 1), date_to=dt.datetime(2024, 2, 2)) == [2, 3]
    assert ids(size_from=10, size_to=2000) == [1, 2]
    assert ids(sizes=[4]) == [3]
    assert ids(required=["VECT"]) == [1, 2, 5] and ids(required=["vector"], excluded=["engine"]) == [1, 2]


def test_documents(docs, spark):
    assert [r.doc_id for r in documents.newest_first(docs).collect()] == [4, 5, 3, 2, 1]
    assert documents.exists(docs, 3) and not documents.exists(docs, 99)
    new = docs.where("doc_id < 3").withColumn("title", F.lit("x"))
    assert documents.insert(docs, new).count() == 5
    assert {r.title for r in documents.update(docs, new.unionByName(new.withColumn("doc_id", F.lit(77).cast("bigint")))).where("doc_id in (1, 2, 77)").collect()} == {"x"}
    assert documents.delete(docs, new).count() == 3


LOG = [("Alpha ", T0, 3, 1.0), ("alpha", T0 + dt.timedelta(hours=1), 1, 3.0), ("beta", T0 - dt.timedelta(hours=30), 0, 2.0), (None, T0, 1, 1.0), ("gamma", T0 - dt.timedelta(hours=23), None, None)]
CLICKS = [("alpha", 1), (" ALPHA", 1), ("alpha", 2), ("other", 2), ("beta", None), (None, 2)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, "query string, ts timestamp_ntz, result_count int, search_time_ms double"), spark.createDataFrame(CLICKS, "query string, doc_id bigint")


def test_rollup(log):
    got = {r.query: r for r in analytics.query_rollup(*log).collect()}
    assert set(got) == {"alpha", "beta", "gamma"}
    a = got["alpha"]
    assert (a.n_searches, a.total_results, a.total_time_ms, a.first_searched, a.n_clicked_docs, a.n_clicks, a.avg_results, a.ctr) == (2, 4, 4.0, T0, 2, 3, 2.0, 1.5)


def test_reports(log):
    searches, clicks = log
    assert rows(analytics.top_queries(searches, 2)) == [("alpha", 2), ("beta", 1)]
    assert rows(analytics.zero_result_queries(searches)) == [("beta", 1), ("gamma", 1)]
    assert rows(analytics.popular_documents(clicks)) == [(2, 3), (1, 2)]
    assert analytics.recent_searches(searches, 1).first().query == "alpha"
    assert sum(r.n_searches for r in analytics.volume_by_hour(searches).collect()) == 4
    s = analytics.summary(searches, clicks).first()
    assert (s.n_searches, s.n_queries, s.avg_results, s.n_clicks, s.n_zero_result_queries) == (4, 3, pytest.approx(2 / 3), 5, 2)
    assert rows(analytics.query_suggestions(searches, "AL")) == [("alpha", 2)]
    assert analytics.query_suggestions(searches, " AL").count() == 0 and analytics.query_suggestions(searches, "al ").count() == 0
    none = searches.limit(0)
    assert analytics.summary(none, clicks.limit(0)).first().n_searches == 0


def test_matches_and_marks():
    assert highlight.find_matches("Vector vector_vectors vector", ["vector"]) == [(0, 6, "vector"), (7, 13, "vector"), (22, 28, "vector")]
    assert highlight.mark("Big mark of a BIG bigger", ["mark", "big"]) == "<mark>Big</mark> <mark>mark</mark> of a <mark>BIG</mark> bigger"
    assert highlight.mark("état et", ["état"]) == "<mark>état</mark> et"
    assert highlight.find_matches(None, ["x"]) == [] and highlight.mark(None, ["x"]) is None
    assert highlight.find_matches("İx vector", ["vector"]) == [(3, 9, "vector")]


def test_snippets():
    text = "word " * 60 + "alpha beta alpha " + "tail " * 60
    s = highlight.snippet(text, ["alpha"])
    assert s["total_matches"] == 2 and s["text"].startswith("...") and s["text"].endswith("...") and s["text"].count("<mark>alpha</mark>") == 2
    assert (s["snippet_start"], s["snippet_end"]) == (250, 450) and s["match_positions"] == [dict(start=50, end=55), dict(start=61, end=66)]
    assert highlight.snippet("alpha beta", ["alpha"])["text"] == "<mark>alpha</mark> beta"
    assert highlight.snippet("x" * 300, ["alpha"])["text"] == "x" * 200 + "..."
    assert highlight.snippet(None, ["alpha"])["text"] == "" and highlight.snippet("", [])["text"] == ""
    many = highlight.snippets("alpha " + "w " * 200 + "alpha alpha " + "w " * 200 + "alpha", ["alpha"], 2)
    assert [m["total_matches"] for m in many] == [2, 1]
    apart = "word " * 60 + "alphabetical alpha " + "tail " * 60
    found = highlight.snippets(apart, ["alpha"])[0]
    assert (found["snippet_start"], found["snippet_end"]) == (235, 388) and apart[234] == apart[388] == " "  # widened to white space
    assert highlight.snippets("nothing", ["alpha"])[0]["text"] == "nothing"


def test_highlight_columns(spark):
    df = spark.createDataFrame([(1, "alpha b alpha " + "w " * 100 + "alpha"), (2, None), (3, "x")], "doc_id bigint, content string")
    found = df.select("doc_id", F.explode(highlight.match_positions(F.col("content"), ["alpha"])).alias("m")).select("doc_id", "m.start", "m.end")
    assert rows(highlight.clusters(found, 150)) == [(1, 1, 0, 13, 2), (1, 2, 214, 219, 1)]
    assert [r[0] for r in df.orderBy("doc_id").select(highlight.highlight_content(F.col("content"), ["X", "a.b"])).collect()][1:] == [None, "<mark>x</mark>"]
    assert df.select(highlight.best_snippet(F.col("content"), ["alpha"]).alias("s")).select("s.total_matches").orderBy("total_matches").collect()[-1][0] == 3
    assert df.select(F.size(highlight.multiple_snippets(F.col("content"), ["alpha"]))).count() == 3
