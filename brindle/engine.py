"""One object for a document collection: build, search, facets, spelling, analytics."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import analytics, documents, expand, facets, index, rank, search, spell, stats
from brindle.plans.compiler import compile_query
from brindle.session import materialise, ship_package

KEPT = 1000  # newest searches and clicks that an engine remembers; a log of its own is a table, see streaming


class Engine:
    """Holds documents, their index once it is built, and the newest searches and clicks; every method returns a frame or a new state.

    Its parts can be exchanged: the ranking, and the expansion of terms.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, ranking: rank.Ranking | None = None, expander: Callable[[list[str], int], list[str]] = expand.expand_terms) -> None:
        ship_package(spark)
        self.spark, self.docs = spark, docs
        self.ranking, self.expander = ranking, expander
        self.index: index.StoredIndex | DataFrame | None = None
        self._vocabulary: DataFrame | None = None
        self.log: deque[tuple[str, object, int, float]] = deque(maxlen=KEPT)
        self.clicks: deque[tuple[str, int, object]] = deque(maxlen=KEPT)

    def _changed(self, postings: DataFrame) -> None:
        self.index, self._vocabulary = postings, None

    # documents
    def add(self, new: DataFrame) -> None:
        self.docs = documents.insert(self.docs, new)

    def update(self, changed: DataFrame) -> None:
        self.docs = documents.update(self.docs, changed)
        if self.index is not None:
            self._changed(index.add_documents(index.postings_of(self.index), changed.join(self.docs.select("doc_id"), "doc_id", "left_semi")))

    def delete(self, ids: DataFrame) -> None:
        self.docs = documents.delete(self.docs, ids)
        if self.index is not None:
            self._changed(index.remove_documents(index.postings_of(self.index), ids))

    def listing(self) -> DataFrame:
        return documents.newest_first(self.docs)

    def get(self, doc_id: int) -> DataFrame:
        return documents.by_id(self.docs, doc_id)

    # index
    def index_all(self, path: str | None = None) -> None:
        """Build the postings; with a path the whole index is written there and read back from it."""
        built = index.postings(self.docs)
        if path is not None:
            index.write_index(built, self.docs, path)
            self.index, self._vocabulary = index.read_index(self.spark, path), None
        else:
            self._changed(built)
        self.docs = index.mark_indexed(self.docs)

    def index_documents(self, docs: DataFrame) -> None:
        self._changed(index.postings(docs) if self.index is None else index.add_documents(index.postings_of(self.index), docs))

    def clear_index(self) -> None:
        if self.index is not None:
            empty, self.docs = index.clear(index.postings_of(self.index), self.docs)
            self._changed(empty)

    def vocabulary(self) -> DataFrame:
        """(term, df, cf) of the index: as written with it, or counted once for each state of the postings."""
        if self.index is None:
            self.index_all()
        if self._vocabulary is None:
            self._vocabulary = self.index.vocabulary if isinstance(self.index, index.StoredIndex) else materialise(index.term_stats(self.index))
        return self._vocabulary

    def _grams(self) -> DataFrame | None:
        return self.index.kgrams if isinstance(self.index, index.StoredIndex) else None

    def index_page(self) -> DataFrame:
        self.vocabulary()
        return index.index_summary(index.postings_of(self.index), self.docs)

    # search
    def search(self, query: str) -> DataFrame:
        return search.simple_search(self.docs, query, index=self.index)

    def ranked_search(self, query: str, page: int = 0, page_size: int = 10, spell_check: bool = True, highlight: bool = True) -> search.Response:
        vocab = self.vocabulary() if spell_check else None
        found = search.ranked_search(self.docs, query, page, page_size, index=self.index, vocab=vocab, highlight=highlight, safe=True, grams=self._grams(), ranking=self.ranking)
        self.log.append((query, self.spark.sql("select current_timestamp()").first()[0], found.total, found.search_time_ms))
        return found

    def record_click(self, query: str, doc_id: int) -> None:
        """Note that a result of a query was opened."""
        self.clicks.append((query, doc_id, self.spark.sql("select current_timestamp()").first()[0]))

    def boolean_search(self, query: str, analyzer: str = "raw") -> DataFrame:
        return compile_query(self.docs, query, analyzer, self.index)

    def suggest(self, word: str, most: int = 5) -> DataFrame:
        return spell.suggestions(self.vocabulary(), [word], most, grams=self._grams())

    def correct(self, query: str) -> DataFrame:
        return spell.correct_query(self.vocabulary(), query, grams=self._grams())

    def expand(self, terms: list[str], most: int = 3) -> list[str]:
        return self.expander(terms, most)

    # facets and figures
    def facets(self) -> DataFrame:
        return facets.extract_facets(self.docs)

    def filter(self, **filters) -> DataFrame:
        return facets.apply_filters(self.docs, **filters)

    def filter_options(self) -> DataFrame:
        return facets.filter_options(self.docs)

    def statistics(self) -> DataFrame:
        return stats.collection_stats(self.docs)

    def _logged(self) -> tuple[DataFrame, DataFrame]:
        searches = self.spark.createDataFrame(list(self.log), "query string, ts timestamp, result_count int, search_time_ms double")
        return searches, self.spark.createDataFrame(list(self.clicks), "query string, doc_id bigint, ts timestamp")

    def analytics(self) -> DataFrame:
        return analytics.summary(*self._logged())

    def query_rollup(self) -> DataFrame:
        return analytics.query_rollup(*self._logged())

    def popular_documents(self, most: int = 10) -> DataFrame:
        return analytics.popular_documents(self._logged()[1], most)

    def recent_searches(self, most: int = 50) -> DataFrame:
        return self._logged()[0].orderBy(F.desc("ts")).limit(most)
