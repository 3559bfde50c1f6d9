"""The inverted index as tables.

Canonical table: postings(doc_id, field, pos, raw, term). Positions run on from the title into the content, stop words
are taken out before numbering. ``term`` is the stem of ``raw``. Everything else is derived: vocabulary, document
lengths, term frequencies, posting blocks, k-grams. A persisted index is written once per build, range-partitioned and sorted by
term, so that lookups and range scans read the row groups that hold the term; with it go the lengths, the collection's figures, the
vocabulary and the k-grams, so that a search over a written index reads no text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.stem import stem_arrays
from brindle.functions.text import kgrams, like_pattern, tokenize
from brindle.session import materialise, one_row, spread


def token_arrays(docs: DataFrame) -> DataFrame:
    """(doc_id, title_tokens, content_tokens) of every document; narrow."""
    texts = spread(docs.select("doc_id", "title", "content"))
    return texts.select("doc_id", tokenize(F.col("title")).alias("title_tokens"), tokenize(F.col("content")).alias("content_tokens"))


def _exploded(docs: DataFrame, stems: bool, keep=None) -> DataFrame:
    """(doc_id, field, pos, raw [, term]); with ``keep``, only the entries that it accepts leave the row.

    Narrow: a document's tokens are numbered, stemmed and filtered inside its row.
    """
    arrays = token_arrays(docs).select("doc_id", F.size("title_tokens").alias("_in_title"), F.concat("title_tokens", "content_tokens").alias("_raw"))
    if stems:
        zipped = F.arrays_zip(F.col("_raw").alias("raw"), stem_arrays(F.col("_raw")).alias("term"))
        entries = F.transform(zipped, lambda e, i: F.struct(i.alias("pos"), e["raw"].alias("raw"), e["term"].alias("term")))
    else:
        entries = F.transform("_raw", lambda t, i: F.struct(i.alias("pos"), t.alias("raw")))
    if keep is not None:
        entries = F.filter(entries, keep)
    rows = arrays.select("doc_id", "_in_title", F.explode(entries).alias("_e"))
    field = F.when(F.col("_e.pos") < F.col("_in_title"), "title").otherwise("content")
    return rows.select("doc_id", field.alias("field"), "_e.*")


def raw_postings(docs: DataFrame) -> DataFrame:
    """Postings without stems."""
    return _exploded(docs, False)


def postings(docs: DataFrame) -> DataFrame:
    """Postings with stems."""
    return _exploded(docs, True)


def _any(tested: Column, words: list[str], patterns: list[str]) -> Column:
    found = tested.isin(*words) if words else F.lit(False)
    for p in patterns:
        found = found | tested.like(like_pattern(p))
    return found


def may_hold(words: list[str], patterns: list[str] = (), every: bool = False) -> Column:
    """Whether a document's lower-cased text holds any (or every) word as a substring: a cheap test before it is cut into tokens."""
    pieces = [*words, *(max(re.split(r"[*?]", p), key=len) for p in patterns)]
    tests = [F.lower("title").contains(w) | F.lower("content").contains(w) for w in pieces]
    tests = [F.coalesce(t, F.lower("title").contains(w), F.lower("content").contains(w), F.lit(False)) for t, w in zip(tests, pieces, strict=True)]
    return reduce(and_ if every else or_, tests, F.lit(every))


def hits(docs: DataFrame, words: list[str], patterns: list[str] = ()) -> DataFrame:
    """Raw postings of some words and wildcard patterns only; the other tokens never leave their row."""
    return _exploded(docs.where(may_hold(words, patterns)), False, lambda e: _any(e["raw"], words, patterns))


def stem_hits(docs: DataFrame, stems: list[str], patterns: list[str] = (), words: list[str] = ()) -> DataFrame:
    """Postings of some stems, wildcard patterns over stems, and words as they stand."""
    return _exploded(docs, True, lambda e: _any(e["term"], stems, patterns) | _any(e["raw"], list(words), []))


def add_documents(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Index with the postings of ``docs``; documents that are in it already are replaced."""
    return remove_documents(index, docs.select("doc_id")).unionByName(postings(docs))


def remove_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Index without the postings of some documents."""
    return index.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def clear(index: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty index and the documents marked as not indexed."""
    return index.limit(0), docs.withColumn("is_indexed", F.lit(False))


def mark_indexed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("is_indexed", F.lit(True))


def posting_blocks(index: DataFrame, key: str = "term", per_block: int = 100_000) -> DataFrame:
    """(term, block, doc_ids): posting lists in blocks of about ``per_block`` documents, whatever their ids, so that no list grows without bound.

    A term's number of blocks follows its document frequency; a document's block follows its id's hash.
    """
    once = index.select(key, "doc_id").distinct()
    sized = once.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / per_block).alias("_blocks"))
    dealt = once.join(sized, key).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")))
    return dealt.groupBy(key, "block").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def word_stats(docs: DataFrame) -> DataFrame:
    """(raw, df, cf) of the words of documents: each row gives its words and its distinct words, and one shuffle adds them up, combined on the map side."""
    tokens = F.concat("title_tokens", "content_tokens")
    both = token_arrays(docs).select(tokens.alias("_t")).select(F.posexplode(F.array(F.array_distinct("_t"), F.col("_t"))).alias("_all", "_words"))
    words = both.select("_all", F.explode("_words").alias("raw"))
    return words.groupBy("raw").agg(F.count_if(F.col("_all") == 0).alias("df"), F.count_if(F.col("_all") == 1).alias("cf"))


def positions(index: DataFrame) -> DataFrame:
    """(doc_id, positions MAP<term, positions>): the forward positional index, one row per document."""
    per_term = index.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    return per_term.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("positions"))


def term_stats(index: DataFrame, key: str = "term") -> DataFrame:
    """(term, df, cf): in how many documents and how often each term occurs."""
    per_doc = index.groupBy(key, "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy(key).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def term_count(index: DataFrame, key: str = "term") -> DataFrame:
    """One row with the number of distinct terms."""
    return index.agg(F.countDistinct(key).alias("n_terms"))


def term_count_estimate(index: DataFrame, key: str = "term", error: float = 0.02) -> DataFrame:
    """Approximate ``term_count`` of one pass without a shuffle of terms."""
    return index.agg(F.approx_count_distinct(key, error).alias("n_terms"))


def lookup(index: DataFrame, term: str, key: str = "term") -> DataFrame:
    """(doc_id) of one term."""
    return index.where(F.col(key) == term).select("doc_id").distinct()


def range_scan(index: DataFrame, low: str, high: str, key: str = "term") -> DataFrame:
    """Postings of the terms from ``low`` to ``high``, both included."""
    return index.where(F.col(key).between(low, high))


def vocabulary(index: DataFrame, key: str = "term") -> DataFrame:
    """All distinct terms in order."""
    return index.select(key).distinct().orderBy(key)


def wildcard_terms(index: DataFrame, pattern: str, key: str = "term") -> DataFrame:
    """Distinct terms that fit a wildcard pattern."""
    return index.select(key).distinct().where(F.col(key).like(like_pattern(pattern.lower())))


def kgram_index(terms: DataFrame, k: int = 2, least: int = 1, key: str = "term") -> DataFrame:
    """(kgram, term, len) of distinct terms, each k-gram of a term once."""
    return terms.select(F.explode(F.array_distinct(kgrams(F.col(key), k, least))).alias("kgram"), F.col(key).alias("term"), F.length(key).alias("len"))


def kgram_report(terms: DataFrame, k: int = 2, key: str = "term") -> DataFrame:
    """One row: k, number of k-grams, number of terms."""
    grams = kgram_index(terms, k, key=key)
    return grams.agg(F.lit(k).alias("k"), F.countDistinct("kgram").alias("n_kgrams"), F.countDistinct("term").alias("n_terms"))


@dataclass(frozen=True)
class StoredIndex:
    """An index that was written: postings, (doc_id, total_terms), one row (n_docs, avg_len), (term, df, cf), (kgram, term, len)."""

    postings: DataFrame
    lengths: DataFrame
    figures: DataFrame
    vocabulary: DataFrame
    kgrams: DataFrame


_PARTS = ("postings", "lengths", "figures", "vocabulary", "kgrams")
K = 2  # of the written k-grams


def write_index(index: DataFrame, docs: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write postings of ``docs`` once, sorted by term within ranges of terms, and what is derived from them.

    A term that fills more than one range is split by document id, so that no file grows with the most frequent term. The derived tables
    are made from the written postings; of the documents only the ids are read.
    """
    keys = ["term", "doc_id"]
    index = materialise(index)  # ranges are found by a pass of their own, which would cut and stem the texts once more
    placed = index.repartitionByRange(partitions, *keys) if partitions else index.repartitionByRange(*keys)
    placed.sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(f"{path}/postings")
    written = docs.sparkSession.read.parquet(f"{path}/postings")
    lengths_of(written, docs).write.mode("overwrite").parquet(f"{path}/lengths")
    figures_of(docs.sparkSession.read.parquet(f"{path}/lengths")).write.mode("overwrite").parquet(f"{path}/figures")
    materialise(term_stats(written)).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    grams = kgram_index(docs.sparkSession.read.parquet(f"{path}/vocabulary").select("term"), K)
    grams.repartitionByRange("kgram", "term").sortWithinPartitions("kgram", "term").write.mode("overwrite").parquet(f"{path}/kgrams")


def read_index(spark, path: str) -> StoredIndex:
    return StoredIndex(*(spark.read.parquet(f"{path}/{part}") for part in _PARTS))


def postings_of(index: DataFrame | StoredIndex) -> DataFrame:
    return index.postings if isinstance(index, StoredIndex) else index


def lengths_of(index: DataFrame | StoredIndex, docs: DataFrame) -> DataFrame:
    """(doc_id, total_terms): as written, or counted from the postings; documents without tokens have 0."""
    if isinstance(index, StoredIndex):
        return index.lengths
    counted = index.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("total_terms"))
    return docs.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("total_terms", F.lit(0)).alias("total_terms"))


def figures_of(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, avg_len)."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("total_terms"), F.lit(0.0)).alias("avg_len"))


def index_from_json(exported: DataFrame) -> DataFrame:
    """Postings from a nested export: one row per document with ``positions MAP<term, ARRAY<INT>>``.

    The export has no fields and no raw words: ``field`` is null and ``raw`` is the term.
    """
    per_term = exported.select("doc_id", F.explode("positions").alias("term", "at"))
    return per_term.select("doc_id", F.lit(None).cast("string").alias("field"), F.explode("at").alias("pos"), F.col("term").alias("raw"), "term")


def index_to_json(index: DataFrame, path: str) -> None:
    """Nested export, one JSON object per document."""
    positions(index).write.mode("overwrite").json(path)


def index_layout(index: DataFrame) -> DataFrame:
    """(part, first_term, last_term, n_terms, n_postings) of every partition of an index as it lies."""
    return index.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.countDistinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings")
    )


def index_summary(index: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for the index page: documents, indexed documents, distinct terms, postings."""
    counted = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("is_indexed").alias("n_indexed"))
    figures = index.agg(F.countDistinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"))
    return counted.withColumn("_f", one_row(figures)).select("n_docs", "n_indexed", "_f.*")
