"""Queries over the tables of TESTDATA.md, named by problem, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, bursttrie, canon, collapse, dartminhash, distinct, heavyhitters, markup, mojibake, packing
from brindle.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = table(spark, sf_dir, "ref_phrases")
    docs = canon.hidden_phrases(table(spark, sf_dir, "docs"), "doc_id", "content", phrases)
    searches = canon.hidden_phrases(table(spark, sf_dir, "searches"), "event_id", "query", phrases)
    return docs.select(F.lit("document").alias("kind"), "record_id", "ref_id").unionByName(searches.select(F.lit("search").alias("kind"), "record_id", "ref_id"))


def p1_canonical_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.canonical(table(spark, sf_dir, "searches"), "event_id", "query")


def p1_canonical_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.canonical(table(spark, sf_dir, "docs"), "doc_id", "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "docs")
    return bursttrie.marked(bursttrie.term_counts(docs, "doc_id", ("title", "content")), docs.count())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.record_pairs(table(spark, sf_dir, "docs"), "doc_id", "content", threshold=0.7, min_terms=10).select(
        F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b")
    )


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes_with_links(table(spark, sf_dir, "docs"), "doc_id", "content", threshold=0.7, min_terms=10)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_scores(spark, sf_dir).where("tf >= 5 and df <= 5").select("doc_id", "term")


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinct.distinctiveness(table(spark, sf_dir, "docs"), "doc_id", ("title", "content"))
    return scored.withColumn("score", F.round("score", 9))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_clean(spark, sf_dir).where("syntax is not null").select("doc_id", "syntax", F.explode("elements").alias("element"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_text(table(spark, sf_dir, "docs"), "doc_id", "content", "file_name")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavyhitters.frequent(table(spark, sf_dir, "searches"), "query", share=1 / 200).select(F.col("value").alias("query"))


def p6_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heavyhitters.frequent(table(spark, sf_dir, "searches"), "query", share=1 / 200)
    return found.select(F.col("value").alias("query"), "n")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = collapse.copies(table(spark, sf_dir, "searches"), "event_id", "query", ("ts", "result_count", "search_time_ms"))
    stats = collapse.copies(table(spark, sf_dir, "query_stats"), "stat_id", "query", ("instance_id",))
    return searches.select(F.lit("searches").alias("table_name"), "keep_id", "copy_id").unionByName(stats.select(F.lit("query_stats").alias("table_name"), "keep_id", "copy_id"))


def p7_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(table(spark, sf_dir, "searches"), "event_id", "query", ("ts", "result_count", "search_time_ms"))


def p7_collapsed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(table(spark, sf_dir, "query_stats"), "stat_id", "query", ("instance_id",))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bpe.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, table(spark, sf_dir, "pack_specs"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_repaired(spark, sf_dir).where("garbled").select("doc_id")


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_canonical_queries, p1_canonical_docs, p2_found, p2_terms, p3_found, p3_classes, p4_found, p4_scores, p5_found, p5_clean, p6_found, p6_top,
            p7_found, p7_collapsed, p7_collapsed_stats, p8_ids, p9_packed, p10_found, p10_repaired,
        )
    }


_TERMS = r"""
docs_terms AS (
  SELECT doc_id, unnest(string_split(regexp_replace(lower(coalesce(title, '') || chr(10) || coalesce(content, '')), '[^\p{L}\p{Mn}\p{Nd}\p{Pc}\-]+', ' ', 'g'), ' ')) AS term
  FROM docs),
kept AS (SELECT doc_id, term FROM docs_terms WHERE regexp_matches(term, '\p{L}')),
per_doc AS (SELECT doc_id, term, count(*) AS tf FROM kept GROUP BY ALL),
counts AS (SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM per_doc GROUP BY term)"""

_MARKED = """
SELECT term, occurrences, records,
       CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.2 * (SELECT count(*) FROM docs) THEN 'common' END AS mark
FROM counts"""

_TRIMMED = r"regexp_replace(lower(query), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"

_FREQUENT = f"""
SELECT {_TRIMMED} AS query, count(*) AS n FROM searches
WHERE query IS NOT NULL AND {_TRIMMED} <> ''
GROUP BY 1 HAVING count(*) * 200 >= (SELECT count(*) FROM searches)"""

# a marker character before each clause opener; the openers are cut at it, cleaned, sorted and joined
_CANON = r"""array_to_string(list_concat(
    list_filter([trim(regexp_replace(string_split(marked, chr(1))[1], '[\p{P}\p{Z}\s]+', ' ', 'g'))], lambda c: length(c) > 0),
    list_sort(list_transform(string_split(marked, chr(1))[2:], lambda c: trim(regexp_replace(c, '[\p{P}\p{Z}\s]+', ' ', 'g'))))), ' ')"""
_MARKER = r"regexp_replace(lower(query), '(^|[^\p{L}\p{M}\p{N}])((title|content|filename):)', '\1' || chr(1) || '\2', 'g')"

_COPIES = f"""
WITH s AS (SELECT event_id, ts, result_count, search_time_ms, {_MARKER} AS marked FROM searches WHERE query IS NOT NULL),
sk AS (SELECT event_id, min(event_id) OVER (PARTITION BY {_CANON}, ts, result_count, search_time_ms) AS keep_id FROM s),
q AS (SELECT stat_id, instance_id, {_MARKER} AS marked FROM query_stats WHERE query IS NOT NULL),
qk AS (SELECT stat_id, min(stat_id) OVER (PARTITION BY {_CANON}, instance_id) AS keep_id FROM q)
SELECT 'searches' AS table_name, keep_id, event_id AS copy_id FROM sk WHERE keep_id <> event_id
UNION ALL SELECT 'query_stats', keep_id, stat_id FROM qk WHERE keep_id <> stat_id"""

_COLLAPSED = f"""
WITH s AS (SELECT event_id, ts, result_count, search_time_ms, {_MARKER} AS marked FROM searches WHERE query IS NOT NULL)
SELECT min(event_id) AS keep_id, count(*) AS copies FROM s GROUP BY {_CANON}, ts, result_count, search_time_ms
UNION ALL SELECT event_id, 1 FROM searches WHERE query IS NULL"""

_COLLAPSED_STATS = f"""
WITH q AS (SELECT stat_id, instance_id, {_MARKER} AS marked FROM query_stats WHERE query IS NOT NULL)
SELECT min(stat_id) AS keep_id, count(*) AS copies FROM q GROUP BY {_CANON}, instance_id
UNION ALL SELECT stat_id, 1 FROM query_stats WHERE query IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_terms": f"WITH {_TERMS} {_MARKED}",
        "p2_found": f"WITH {_TERMS} SELECT term, mark FROM ({_MARKED}) WHERE mark IS NOT NULL",
        "p4_found": f"WITH {_TERMS} SELECT doc_id, term FROM per_doc JOIN counts USING (term) WHERE tf >= 5 AND records <= 5",
        "p4_scores": f"""WITH {_TERMS}, lengths AS (SELECT doc_id, sum(tf) AS n_terms FROM per_doc GROUP BY doc_id)
SELECT doc_id, term, CAST(tf AS INT) AS tf, records AS df, round(tf / n_terms * (ln(((SELECT count(*) FROM docs) + 1.0) / (records + 1.0)) + 1.0), 9) AS score
FROM per_doc JOIN counts USING (term) JOIN lengths USING (doc_id)""",
        "p6_found": f"SELECT query FROM ({_FREQUENT})",
        "p6_top": _FREQUENT,
        "p7_found": _COPIES,
        "p7_collapsed": _COLLAPSED,
        "p7_collapsed_stats": _COLLAPSED_STATS,
    }
