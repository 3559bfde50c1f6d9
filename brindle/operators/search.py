"""The two searches: phrase with a fall-back to any word, and ranked search for all words."""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from brindle.functions.stem import stem
from brindle.functions.text import tokenize_query
from brindle.operators.highlight import best_snippet
from brindle.operators.index import StoredIndex, hits, postings_of, stem_hits
from brindle.operators.rank import Ranking, in_places, page, page_count, rank_documents, rank_postings
from brindle.operators.spell import correct_query, suggestions
from brindle.plans import ast
from brindle.plans.compiler import compile_node, moved


@dataclass
class Response:
    """One page of a ranked search."""

    query: str
    results: DataFrame | None
    total: int = 0
    page: int = 0
    page_size: int = 10
    pages: int = 0
    correction: Row | None = None
    search_time_ms: float = 0.0
    error: str | None = None
    extras: dict = field(default_factory=dict)


def analyze(query: str, analyzer: str = "stem") -> list[str]:
    """Words of a query, as the analyzer compares them."""
    words = tokenize_query(query)
    return [stem(w) for w in words] if analyzer == "stem" else words


Index = DataFrame | StoredIndex


def _postings(docs: DataFrame, words: list[str], analyzer: str, index: Index | None) -> DataFrame:
    """(doc_id, field, pos, term) of the query's words; in an index, sorted by stems, words as they stand are sought under theirs."""
    key = "term" if analyzer == "stem" else "raw"
    if index is not None:
        asked = F.col("term").isin(*(words if analyzer == "stem" else {stem(w) for w in words}))
        return postings_of(index).where(asked & F.col(key).isin(*words)).select("doc_id", "field", "pos", F.col(key).alias("term"))
    rows = stem_hits(docs, words) if analyzer == "stem" else hits(docs, words)
    return rows.select("doc_id", "field", "pos", F.col(key).alias("term"))


def _found(docs: DataFrame, words: list[str], analyzer: str, index: Index | None) -> DataFrame:
    """(doc_id, score) of phrase matches, or of documents with any word where there are none; one aggregation by document."""
    rows = _postings(docs, words, analyzer, index)
    weight = F.lit(0)
    for w, n in Counter(words).items():
        weight = F.when(F.col("term") == w, n).otherwise(weight)
    places = [F.collect_list(F.when(F.col("term") == w, F.col("pos"))).alias(f"at_{i}") for i, w in enumerate(words)]
    per_doc = rows.groupBy("doc_id").agg(F.sum(weight * F.when(F.col("field") == "title", 2).otherwise(1)).cast("double").alias("score"), *places)
    starts = F.col("at_0")
    for i in range(1, len(words)):
        starts = F.array_intersect(starts, moved(F.col(f"at_{i}"), -i))
    marked = per_doc.select("doc_id", "score", (F.size(starts) > 0).alias("as_phrase"))
    any_phrase = marked.agg(F.coalesce(F.bool_or("as_phrase"), F.lit(False)).alias("any_phrase"))
    found = marked.where(F.col("as_phrase") | ~any_phrase.scalar())
    return found.select("doc_id", "score").join(docs.select("doc_id"), "doc_id", "left_semi")


def matches(docs: DataFrame, query: str, analyzer: str = "stem", index: Index | None = None) -> DataFrame:
    """(doc_id) of the documents that hold the query as a phrase, or, where there are none, any of its words."""
    words = analyze(query, analyzer)
    return _found(docs, words, analyzer, index).select("doc_id") if words else docs.select("doc_id").limit(0)


def simple_search(docs: DataFrame, query: str, analyzer: str = "stem", index: Index | None = None) -> DataFrame:
    """(doc_id, score) of ``matches``, by weighted count of the words, best first."""
    words = analyze(query, analyzer)
    if not words:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    return _found(docs, words, analyzer, index).orderBy(F.desc("score"), "doc_id")


def did_you_mean(vocab: DataFrame, query: str) -> DataFrame:
    """(term, edit_distance, score) for a query without hits: the query as one word, within distance 2."""
    found = suggestions(vocab, [query], 1).where("edit_distance <= 2")
    return found.select("term", "edit_distance", "score")


def ranked(docs: DataFrame, query: str, analyzer: str = "stem", index: Index | None = None, ranking: Ranking | None = None) -> DataFrame:
    """(doc_id, score) of the documents that hold all words of the query, by BM25 or a given ranking."""
    words = analyze(query, analyzer)
    if index is None:
        return rank_documents(docs, words, ranking, stems=analyzer == "stem")
    return rank_postings(_postings(docs, words, analyzer, index), docs, words, ranking, index=index)


def ranked_page(scored: DataFrame, number: int = 0, size: int = 10) -> DataFrame:
    """One page of (doc_id, score) with ``rank``, the place among all results, from 1."""
    first = max(0, number * size) if size > 0 else 0
    shown = page(scored, number, size)
    if size <= 0:  # all results: their places are counted over sorted ranges, not in one task
        return in_places(scored, F.desc("score"), F.col("doc_id"))
    # a window without keys over the rows of one page
    return shown.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) + first)


def ranked_search(
    docs: DataFrame, query: str, number: int = 0, size: int = 10, analyzer: str = "stem", index: Index | None = None,
    vocab: DataFrame | None = None, highlight: bool = True, safe: bool = False, grams: DataFrame | None = None, ranking: Ranking | None = None,
) -> Response:
    """One page of ranked results with rank, title, score and highlighted snippet; the snippet is made for the page's rows only.

    The scores are kept, so that counting and showing them is one evaluation. With a vocabulary the spelling correction is reported, never applied. With ``safe`` an
    error is text in the response.
    """
    began = time.perf_counter()
    out = Response(query, None, page=number, page_size=size)
    try:
        if vocab is not None:
            out.correction = correct_query(vocab, query, grams=grams).first()
        scored = ranked(docs, query, analyzer, index, ranking).persist()
        out.total = scored.count()
        out.pages = page_count(out.total, size)
        rows = ranked_page(scored, number, size).join(docs, "doc_id")
        if highlight:
            rows = rows.withColumn("snippet", best_snippet(F.col("content"), analyze(query, analyzer)))
        out.results = rows.orderBy("rank")
    except Exception as e:  # the caller asked for errors as text
        if not safe:
            raise
        out.error = str(e)
    out.search_time_ms = (time.perf_counter() - began) * 1000
    return out


def boolean_search(docs: DataFrame, node: ast.Node | None, analyzer: str = "raw", index: Index | None = None) -> DataFrame:
    """(doc_id) of a parsed boolean query."""
    return compile_node(docs, node, analyzer, index)
