"""Queries of the text search over the test tables, and the SQL to hold them against.

Documents are the table docs, the log is searches and clicks. Words are those of the collection: ``vector``, ``archive``, ``bucket`` and others. The SQL has its
own copies of the stop words, file types and size categories; stems and synonyms are taken from the rules and the dictionary.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.functions.stem import stem, stem_sql, with_stems
from brindle.operators import analytics as A
from brindle.operators import documents as D
from brindle.operators import expand as E
from brindle.operators import facets as C
from brindle.operators import highlight as H
from brindle.operators import index as I
from brindle.operators import rank as R
from brindle.operators import search as S
from brindle.operators import spell as P
from brindle.operators import stats as T
from brindle.plans.compiler import compile_query
from brindle.session import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs")


def _searches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "searches")


def _clicks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clicks")


_WRITTEN: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> I.StoredIndex:
    """The index of a folder's docs, written to the application's shared folder when it is first asked for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        docs, path = _docs(spark, d), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        I.write_index(I.postings(docs), docs, path)
        _WRITTEN[key] = path
    return I.read_index(spark, _WRITTEN[key])


# ---- SQL building blocks --------------------------------------------------------------------------------------

# The stop words.
_STOP = """'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'he', 'in', 'is', 'it', 'its', 'of', 'on', 'that', 'the', 'to', 'was', 'were', 'will', 'with',
'this', 'but', 'they', 'have', 'been', 'being', 'had', 'having', 'do', 'does', 'did', 'doing', 'would', 'should', 'could', 'ought', 'i', 'you', 'we', 'she', 'him', 'her', 'their', 'them',
'what', 'which', 'who', 'when', 'where', 'why', 'how', 'all', 'each', 'every', 'both', 'few', 'more', 'most', 'other', 'some', 'such', 'no', 'nor', 'not', 'only', 'own', 'same', 'so',
'than', 'too', 'very', 'can', 'just'"""
_KEEP = rf"length(t) <= 30 AND length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) >= 2 AND t NOT IN ({_STOP})"


def _tok(column: str) -> str:
    clean = rf"trim(regexp_replace(lower(coalesce({column}, '')), '[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}\-]+', ' ', 'g'))"
    return f"list_filter(string_split({clean}, ' '), lambda t: {_KEEP})"


_ARRAYS = f"SELECT doc_id, {_tok('title')} AS tt, {_tok('content')} AS ct FROM docs"
_POST = f"""
SELECT doc_id, CASE WHEN pos < nt THEN 'title' ELSE 'content' END AS field, CAST(pos AS INT) AS pos, raw FROM (
  SELECT doc_id, len(tt) AS nt, unnest(list_concat(tt, ct)) AS raw, unnest(range(len(tt) + len(ct))) AS pos FROM ({_ARRAYS}))"""
_WITH = f"WITH post AS ({_POST}), lens AS (SELECT doc_id, len(tt) + len(ct) AS total_terms FROM ({_ARRAYS}))"
_STEMMED = f"{_WITH}, stems AS ({stem_sql('SELECT raw FROM post')}), spost AS (SELECT doc_id, field, pos, raw, term FROM post JOIN stems USING (raw))"


def _has(word: str, key: str = "raw", source: str = "post") -> str:
    return f"SELECT DISTINCT doc_id FROM {source} WHERE {key} = '{word}'"


def _phrase(*words: str) -> str:
    joins = " ".join(f"JOIN post p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i} AND p{i}.raw = '{w}'" for i, w in enumerate(words) if i)
    return f"SELECT DISTINCT p0.doc_id FROM post p0 {joins} WHERE p0.raw = '{words[0]}'"


def _bm25(words: list[str], key: str, source: str) -> str:
    terms = ", ".join(f"'{w}'" for w in words)
    return f"""
tf AS (SELECT doc_id, {key} AS term, count(*) AS tf FROM {source} WHERE {key} IN ({terms}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
coll AS (SELECT count(*) AS n, avg(total_terms) AS a FROM lens),
scores AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(total_terms, 1) / greatest(a, 1)))), 6) AS score
           FROM tf JOIN df USING (term) JOIN lens USING (doc_id), coll GROUP BY doc_id HAVING count(*) = {len(set(words))})"""


# ---- text and index -------------------------------------------------------------------------------------------


@_query("q_tokenize", f"{_WITH} SELECT raw AS token, count(*) AS n FROM post GROUP BY raw")
def _(spark, d):
    return I.word_stats(_docs(spark, d)).select(F.col("raw").alias("token"), F.col("cf").alias("n"))


@_query("q_normalize", rf"SELECT doc_id, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}\-]+', ' ', 'g')) AS norm FROM docs")
def _(spark, d):
    return _docs(spark, d).select("doc_id", X.normalize(F.col("title")).alias("norm"))


@_query("q_postings", f"{_WITH} SELECT raw AS term, count(DISTINCT doc_id) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM post GROUP BY raw")
def _(spark, d):
    blocks = I.posting_blocks(I.raw_postings(_docs(spark, d)), "raw")
    return blocks.groupBy(F.col("raw").alias("term")).agg(
        F.sum(F.size("doc_ids")).alias("n"), F.min(F.element_at("doc_ids", 1)).alias("first_doc"), F.max(F.element_at("doc_ids", -1)).alias("last_doc")
    )


@_query("q_positions", f"{_WITH} SELECT doc_id, raw AS term, array_to_string(list_sort(list(pos)), ' ') AS at FROM post WHERE raw IN ('vector', 'archive') GROUP BY doc_id, raw")
def _(spark, d):
    per_doc = I.positions(I.hits(_docs(spark, d), ["vector", "archive"]).withColumn("term", F.col("raw")))
    return per_doc.select("doc_id", F.explode("positions").alias("term", "p")).select("doc_id", "term", F.array_join(F.col("p").cast("array<string>"), " ").alias("at"))


@_query("q_term_stats", f"{_WITH} SELECT raw AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM post GROUP BY raw")
def _(spark, d):
    return I.word_stats(_docs(spark, d)).withColumnRenamed("raw", "term")


@_query("q_term_count", f"{_WITH} SELECT count(DISTINCT raw) AS n_terms FROM post")
def _(spark, d):
    return I.term_count(I.raw_postings(_docs(spark, d)), "raw")


@_query("q_range_scan", f"{_WITH} SELECT DISTINCT raw AS term FROM post WHERE raw BETWEEN 'ba' AND 'bo'")
def _(spark, d):
    return I.range_scan(I.raw_postings(_docs(spark, d)), "ba", "bo", "raw").select(F.col("raw").alias("term")).distinct()


@_query("q_vocabulary", f"{_WITH} SELECT term, row_number() OVER (ORDER BY term) AS rank FROM (SELECT DISTINCT raw AS term FROM post)")
def _(spark, d):
    words = I.vocabulary(I.raw_postings(_docs(spark, d)), "raw").withColumnRenamed("raw", "term")
    return R.in_places(words, F.col("term"))


@_query("q_stem_vocab", f"{_WITH} {stem_sql('SELECT raw FROM post').replace('WITH words AS', ', words AS', 1)}")
def _(spark, d):
    return with_stems(I.raw_postings(_docs(spark, d)).select("raw").distinct())


@_query("q_stem_postings", f"{_STEMMED} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, count(DISTINCT raw) AS n_raw FROM spost GROUP BY term")
def _(spark, d):
    return I.postings(_docs(spark, d)).groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.count(F.lit(1)).alias("cf"), F.countDistinct("raw").alias("n_raw"))


def _kgram_sql(k: int, least: int) -> str:
    return f"""{_WITH}, v AS (SELECT DISTINCT raw AS term, '$' || raw || '$' AS p FROM post WHERE length(raw) >= {least})
SELECT DISTINCT substr(p, CAST(i AS INT), {k}) AS kgram, term, length(term) AS len FROM (SELECT term, p, unnest(range(1, length(p) - {k} + 2)) AS i FROM v)"""


@_query("q_kgrams2", _kgram_sql(2, 1))
def _(spark, d):
    return I.kgram_index(I.raw_postings(_docs(spark, d)).select("raw").distinct(), 2, key="raw").withColumn("len", F.col("len").cast("bigint"))


@_query("q_kgrams3", _kgram_sql(3, 3))
def _(spark, d):
    return I.kgram_index(I.raw_postings(_docs(spark, d)).select("raw").distinct(), 3, 3, key="raw").withColumn("len", F.col("len").cast("bigint"))


@_query("q_kgram_report", f"WITH g AS ({_kgram_sql(2, 1)}) SELECT 2 AS k, count(DISTINCT kgram) AS n_kgrams, count(DISTINCT term) AS n_terms FROM g")
def _(spark, d):
    return I.kgram_report(I.raw_postings(_docs(spark, d)).select("raw").distinct(), 2, "raw")


@_query("q_index_layout", f"{_STEMMED} SELECT min(term) AS first_term, max(term) AS last_term, count(*) AS n_postings, count(DISTINCT term) AS n_terms, 0 AS n_split FROM spost")
def _(spark, d):
    # the layout of an index ordered by term: its parts follow one another, so that no term is in two of them
    parts = I.index_layout(I.postings(_docs(spark, d)).repartitionByRange("term")).withColumn("after", F.lead("first_term").over(Window.orderBy("first_term")))
    return parts.agg(
        F.min("first_term").alias("first_term"), F.max("last_term").alias("last_term"), F.sum("n_postings").alias("n_postings"), F.sum("n_terms").alias("n_terms"),
        F.count_if(F.col("after") <= F.col("last_term")).cast("int").alias("n_split"),
    )


@_query("q_index_build", f"{_STEMMED} SELECT (SELECT count(*) FROM lens) AS n_docs, round((SELECT avg(total_terms) FROM lens), 6) AS avg_len, count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM spost")
def _(spark, d):
    _WRITTEN.pop((spark.sparkContext.applicationId, d), None)  # built anew, and used by the queries that follow
    built = _index(spark, d)
    figures = built.figures.select("n_docs", F.round("avg_len", 6).alias("avg_len"))
    return figures.withColumn("n_terms", built.vocabulary.agg(F.count(F.lit(1))).scalar()).withColumn("n_postings", built.postings.agg(F.count(F.lit(1))).scalar())


@_query("q_index_lookup", f"{_STEMMED} {_has(stem('migrations'), 'term', 'spost')}")
def _(spark, d):
    return I.lookup(_index(spark, d).postings, stem("migrations"))


@_query("q_index_range", f"{_STEMMED} SELECT DISTINCT term FROM spost WHERE term BETWEEN 'ba' AND 'bo'")
def _(spark, d):
    return I.range_scan(_index(spark, d).vocabulary, "ba", "bo").select("term")


@_query("q_index_vocabulary", f"{_STEMMED} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM spost GROUP BY term")
def _(spark, d):
    return _index(spark, d).vocabulary


@_query("q_index_kgrams", f"""{_STEMMED}, v AS (SELECT DISTINCT term, '$' || term || '$' AS p FROM spost)
SELECT DISTINCT substr(p, CAST(i AS INT), 2) AS kgram, term, CAST(length(term) AS INT) AS len FROM (SELECT term, p, unnest(range(1, length(p))) AS i FROM v)""")
def _(spark, d):
    return _index(spark, d).kgrams


@_query("q_index_bm25", f"{_STEMMED}, {_bm25([stem('migrations'), stem('vectors')], 'term', 'spost')} SELECT doc_id, score FROM scores")
def _(spark, d):
    return _rounded(S.ranked(_docs(spark, d), "migrations vectors", index=_index(spark, d)))


@_query("q_index_boolean", f"{_STEMMED} ({_has(stem('vectors'), 'term', 'spost')} UNION {_has(stem('migrations'), 'term', 'spost')}) EXCEPT {_has('index', 'term', 'spost')}")
def _(spark, d):
    return compile_query(_docs(spark, d), "(vectors OR migrations) AND NOT index", "stem", _index(spark, d))


@_query("q_index_summary", f"{_STEMMED} SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(*) FROM docs WHERE is_indexed) AS n_indexed, count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM spost")
def _(spark, d):
    docs = _docs(spark, d)
    return I.index_summary(I.postings(docs), docs)


# ---- searches -------------------------------------------------------------------------------------------------


@_query("q_term_search", f"{_WITH} {_has('vector')}")
def _(spark, d):
    return compile_query(_docs(spark, d), "vector")


@_query("q_phrase", f"{_WITH} {_phrase('come', 'end', 'archive')} UNION {_phrase('belong', 'public')}")
def _(spark, d):
    docs = _docs(spark, d)
    return compile_query(docs, '"come end archive" OR "belong public"')


@_query("q_and", f"{_WITH} {_has('vector')} INTERSECT {_has('bucket')}")
def _(spark, d):
    return compile_query(_docs(spark, d), "vector bucket")


@_query("q_bool_and", f"{_WITH} ({_has('vector')} INTERSECT {_has('bucket')}) INTERSECT {_has('index')}")
def _(spark, d):
    return compile_query(_docs(spark, d), "vector AND bucket AND index")


@_query("q_bool_or", f"{_WITH} {_has('vector')} UNION {_has('bucket')}")
def _(spark, d):
    return compile_query(_docs(spark, d), "vector OR bucket")


@_query("q_bool_not", f"{_WITH} SELECT doc_id FROM docs WHERE doc_id NOT IN ({_has('vector')})")
def _(spark, d):
    return compile_query(_docs(spark, d), "NOT vector")


@_query("q_bool_mixed", f"{_WITH} ({_has('vector')} UNION {_has('bucket')}) EXCEPT {_has('index')}")
def _(spark, d):
    return compile_query(_docs(spark, d), "(vector OR bucket) AND NOT index")


@_query("q_implicit_and", f"{_WITH} ({_has('vector')} UNION {_has('bucket')}) INTERSECT {_has('index')}")
def _(spark, d):
    return compile_query(_docs(spark, d), "vector OR bucket index")


@_query("q_bool_stem", f"{_STEMMED} ({_has('vector', 'term', 'spost')} UNION {_has(stem('migrations'), 'term', 'spost')}) EXCEPT {_has('index', 'term', 'spost')}")
def _(spark, d):
    return compile_query(_docs(spark, d), "(vectors OR migrations) AND NOT index", "stem")


@_query("q_bool_mixed_analyzer", f"{_STEMMED} {_has('vectors', 'term', 'spost')} UNION {_has('migrat', 'term', 'spost')}")
def _(spark, d):
    return compile_query(_docs(spark, d), "vectors OR migrat", "mixed")


@_query("q_wildcard_star", f"{_WITH} SELECT DISTINCT doc_id FROM post WHERE raw LIKE 'vect%'")
def _(spark, d):
    return compile_query(_docs(spark, d), "vect*")


@_query("q_wildcard_qmark", f"{_WITH} SELECT DISTINCT doc_id FROM post WHERE raw LIKE 'b_cket'")
def _(spark, d):
    return compile_query(_docs(spark, d), "b?cket")


@_query("q_wildcard_terms", f"{_WITH} SELECT DISTINCT raw AS term FROM post WHERE raw LIKE 'vect%'")
def _(spark, d):
    return I.wildcard_terms(I.raw_postings(_docs(spark, d)), "vect*", "raw").withColumnRenamed("raw", "term")


@_query("q_field_title", f"{_WITH} SELECT DISTINCT doc_id FROM post WHERE field = 'title' AND raw = 'vector'")
def _(spark, d):
    return compile_query(_docs(spark, d), "title:vector")


@_query("q_field_content", f"{_WITH} SELECT DISTINCT doc_id FROM post WHERE field = 'content' AND raw = 'vector'")
def _(spark, d):
    return compile_query(_docs(spark, d), "content:vector")


@_query("q_field_filename", f"SELECT doc_id FROM docs WHERE list_contains({_tok('file_name')}, 'txt')")
def _(spark, d):
    return compile_query(_docs(spark, d), "filename:txt")


@_query("q_near", f"{_WITH} SELECT DISTINCT a.doc_id FROM post a JOIN post b USING (doc_id) WHERE a.raw = 'vector' AND b.raw = 'bucket' AND abs(b.pos - a.pos) - 1 <= 20")
def _(spark, d):
    return compile_query(_docs(spark, d), "vector NEAR/20 bucket")


@_query(
    "q_near_phrase",
    f"{_WITH} SELECT DISTINCT a.doc_id FROM post a JOIN post a2 ON a2.doc_id = a.doc_id AND a2.pos = a.pos + 1 JOIN post b ON b.doc_id = a.doc_id "
    "WHERE a.raw = 'notes' AND a2.raw = 'about' AND b.raw = 'belong' AND abs(b.pos - (a.pos + 1)) - 1 <= 3",
)
def _(spark, d):
    return compile_query(_docs(spark, d), '"notes about" NEAR/3 belong')


@_query("q_phrase_search", f"{_WITH} SELECT doc_id FROM ({_phrase('notes', 'about')})")
def _(spark, d):
    return S.matches(_docs(spark, d), "notes about", "raw", _index(spark, d))


@_query("q_or_fallback", f"{_WITH} {_has('vector')} UNION {_has('zzz')}")
def _(spark, d):
    return S.matches(_docs(spark, d), "vector zzz", "raw", _index(spark, d))


_WEIGHTED = """SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT doc_id, CAST(sum(CASE WHEN field = 'title' THEN 2 ELSE 1 END) AS DOUBLE) AS score FROM {source} WHERE {key} IN ({terms}) GROUP BY doc_id)"""


def _placed(found: DataFrame) -> DataFrame:
    return R.in_places(found, F.desc("score"), F.col("doc_id"))


@_query("q_relevance_simple", f"{_WITH} {_WEIGHTED.format(source='post', key='raw', terms=repr('vector') + ', ' + repr('zzz'))}")
def _(spark, d):
    return _placed(S.simple_search(_docs(spark, d), "vector zzz", "raw", _index(spark, d)))


@_query("q_relevance_stem", f"{_STEMMED} {_WEIGHTED.format(source='spost', key='term', terms=repr(stem('migrations')))}")
def _(spark, d):
    return _placed(S.simple_search(_docs(spark, d), "migrations"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@_query("q_bm25_raw", f"{_WITH}, {_bm25(['vector', 'archive'], 'raw', 'post')} SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 10")
def _(spark, d):
    return _rounded(R.page(_rounded(S.ranked(_docs(spark, d), "vector archive", "raw", _index(spark, d))), 0, 10))


@_query("q_bm25_all", f"{_WITH}, {_bm25(['vector', 'archive'], 'raw', 'post')} SELECT doc_id, score FROM scores")
def _(spark, d):
    return _rounded(S.ranked(_docs(spark, d), "vector archive", "raw"))


@_query("q_bm25_stem", f"{_STEMMED}, {_bm25([stem('migrations'), stem('vectors')], 'term', 'spost')} SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 10")
def _(spark, d):
    return R.page(_rounded(S.ranked(_docs(spark, d), "migrations vectors", index=_index(spark, d))), 0, 10)


@_query("q_bm25_page2", f"{_WITH}, {_bm25(['vector'], 'raw', 'post')} SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10")
def _(spark, d):
    return R.page(_rounded(S.ranked(_docs(spark, d), "vector", "raw", _index(spark, d))), 1, 10)


@_query("q_page_meta", f"{_WITH}, {_bm25(['vector'], 'raw', 'post')} SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM scores")
def _(spark, d):
    return S.ranked(_docs(spark, d), "vector", "raw").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 10).alias("pages"))


# ---- statistics -----------------------------------------------------------------------------------------------


@_query("q_doc_stats", f"{_WITH} SELECT doc_id, CAST(total_terms AS BIGINT) AS total_terms FROM lens")
def _(spark, d):
    return T.document_lengths(_docs(spark, d)).withColumn("total_terms", F.col("total_terms").cast("bigint"))


@_query(
    "q_term_freq",
    f"{_WITH} SELECT doc_id, raw AS term, count(*) AS tf, count(*) FILTER (field = 'title') AS title_tf, count(*) FILTER (field = 'content') AS content_tf FROM post GROUP BY doc_id, raw",
)
def _(spark, d):
    return T.term_frequencies(I.raw_postings(_docs(spark, d)), "raw").withColumnRenamed("raw", "term")


@_query("q_doc_freq", f"{_WITH} SELECT raw AS term, count(DISTINCT doc_id) AS df FROM post GROUP BY raw")
def _(spark, d):
    return T.document_frequencies(I.raw_postings(_docs(spark, d)), "raw").withColumnRenamed("raw", "term")


@_query("q_collection_stats", f"{_WITH} SELECT count(*) AS n_docs, avg(total_terms) AS avg_len FROM lens")
def _(spark, d):
    return T.collection_stats(_docs(spark, d))


@_query("q_indexed_counts", "SELECT count(*) FILTER (is_indexed) AS n_indexed, count(*) AS n_docs FROM docs")
def _(spark, d):
    return T.indexed_counts(_docs(spark, d))


# ---- spelling and expansion -----------------------------------------------------------------------------------

_VOCAB = f"{_WITH}, v AS (SELECT DISTINCT raw AS term FROM post)"


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return I.word_stats(_docs(spark, d)).select(F.col("raw").alias("term"))


def _levenshtein(term: str, word: str) -> str:
    """DuckDB's distance counts bytes: of a term, what is beyond ASCII becomes a character that no ASCII word holds."""
    return rf"levenshtein(regexp_replace({term}, '[^\x00-\x7F]', '#', 'g'), {word})"


def _bigrams(word: str) -> str:
    return f"list_transform(range(1, length({word}) + 2), lambda i: substr('$' || {word} || '$', CAST(i AS INT), 2))"


_JACCARD = f"len(list_intersect(list_distinct({_bigrams('term')}), list_distinct({_bigrams('word')}))) / CAST(len(list_distinct(list_concat({_bigrams('term')}, {_bigrams('word')}))) AS DOUBLE)"


def _edit_distance(vocab: DataFrame) -> DataFrame:
    return vocab.select("term", X.edit_distance(F.col("term"), F.lit("vectr")).cast("bigint").alias("distance"))


@_query("q_edit_distance", f"{_VOCAB} SELECT term, {_levenshtein('term', repr('vectr'))} AS distance FROM v")
def _(spark, d):
    return _edit_distance(_vocab(spark, d))


def _edit_distance_capped(vocab: DataFrame) -> DataFrame:
    return vocab.select("term", X.edit_distance(F.col("term"), F.lit("vectr"), 3).cast("bigint").alias("distance"))


@_query("q_edit_distance_capped", f"{_VOCAB} SELECT term, least({_levenshtein('term', repr('vectr'))}, 4) AS distance FROM v")
def _(spark, d):
    return _edit_distance_capped(_vocab(spark, d))


def _jaccard(vocab: DataFrame) -> DataFrame:
    return vocab.select("term", F.round(X.jaccard(F.col("term"), F.lit("vectr")), 6).alias("similarity"))


@_query("q_jaccard", f"{_VOCAB} SELECT term, round({_JACCARD}, 6) AS similarity FROM (SELECT term, 'vectr' AS word FROM v)")
def _(spark, d):
    return _jaccard(_vocab(spark, d))


def _suggest_sql(words: list[str]) -> str:
    values = ", ".join(f"('{w}')" for w in words)
    return f"""{_VOCAB}, w(word) AS (VALUES {values}),
pairs AS (SELECT word, term FROM w, v WHERE word NOT IN (SELECT term FROM v) AND abs(length(term) - length(word)) <= 3
          AND len(list_filter({_bigrams('word')}, lambda g: list_contains({_bigrams('term')}, g))) >= greatest(1, (length(word) + 1) // 4)),
scored AS (SELECT word, term, {_levenshtein('term', 'word')} AS edit_distance, round({_JACCARD}, 6) AS jaccard, round(1.0 / (1 + {_levenshtein('term', 'word')}) * (0.5 + 0.5 * {_JACCARD}), 6) AS score
           FROM pairs WHERE {_levenshtein('term', 'word')} <= 3),
all_of AS (SELECT * FROM scored UNION ALL SELECT word, word, 0, 0.0, 1.0 FROM w WHERE word IN (SELECT term FROM v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, edit_distance, term) AS rank FROM all_of)"""


def _spell_suggest(vocab: DataFrame) -> DataFrame:
    found = P.suggestions(vocab, ["vectr", "bukcet", "vector"], 5)
    return found.select("word", "term", F.col("edit_distance").cast("bigint").alias("edit_distance"), F.round("jaccard", 6).alias("jaccard"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@_query("q_spell_suggest", f"{_suggest_sql(['vectr', 'bukcet', 'vector'])} SELECT word, term, edit_distance, jaccard, score, rank FROM ranked WHERE rank <= 5")
def _(spark, d):
    return _spell_suggest(_vocab(spark, d))


def _correct_query(vocab: DataFrame) -> DataFrame:
    return P.correct_query(vocab, "vectr archive bukcet").select("corrected_query", "has_corrections")


@_query(
    "q_correct_query",
    f"{_suggest_sql(['vectr', 'bukcet', 'archive'])}, best AS (SELECT word, term FROM ranked WHERE rank = 1 AND edit_distance <= 2), "
    "q(nth, word) AS (VALUES (0, 'vectr'), (1, 'archive'), (2, 'bukcet')) "
    "SELECT string_agg(coalesce(b.term, q.word), ' ' ORDER BY nth) AS corrected_query, bool_or(b.term IS NOT NULL AND b.term <> q.word) AS has_corrections FROM q LEFT JOIN best b USING (word)",
)
def _(spark, d):
    return _correct_query(_vocab(spark, d))


def _did_you_mean(vocab: DataFrame) -> DataFrame:
    return S.did_you_mean(vocab, "vectr").select("term", F.col("edit_distance").cast("bigint").alias("edit_distance"), F.round("score", 6).alias("score"))


@_query("q_did_you_mean", f"{_suggest_sql(['vectr'])} SELECT term, edit_distance, score FROM ranked WHERE rank = 1 AND edit_distance <= 2")
def _(spark, d):
    return _did_you_mean(_vocab(spark, d))


_ASKED = ["search", "data", "big", "running", "system", "vector"]
_ASKED_SQL = "asked(term) AS (VALUES " + ", ".join(f"('{t}', '{stem(t)}')" for t in _ASKED) + ")"
_ASKED_SQL = _ASKED_SQL.replace("asked(term)", "asked(term, root)")
_DICTIONARY_SQL = "dict(key, syn, ord) AS (VALUES " + ", ".join(f"('{k}', '{s}', {i})" for k, s, i in E.synonym_pairs()) + ")"
_SYNONYMS_SQL = f"""WITH {_ASKED_SQL}, {_DICTIONARY_SQL},
found AS (
  SELECT term, syn, ord AS place FROM asked JOIN dict ON term = key
  UNION ALL SELECT term, p.key, 1000000 + 2 * (SELECT min(ord) FROM dict x WHERE x.key = p.key) FROM asked JOIN dict p ON term = p.syn
  UNION ALL SELECT term, s.syn, 1000001 + 2 * s.ord FROM asked JOIN dict p ON term = p.syn JOIN dict s ON s.key = p.key
  UNION ALL SELECT term, syn, 3000000 + ord FROM asked JOIN dict ON root = key),
syns AS (SELECT term, syn, CAST(min(place) AS INT) AS ord FROM found WHERE syn <> term GROUP BY term, syn)"""


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in _ASKED], "term string")


@_query("q_synonyms", f"{_SYNONYMS_SQL} SELECT term, syn, ord FROM syns")
def _(spark, d):
    return E.synonyms(_asked(spark))


@_query("q_expand", f"{_SYNONYMS_SQL} SELECT a.term, array_to_string(list_distinct_in_order, ' ') AS expanded FROM (SELECT term, list_concat([term], coalesce((SELECT list(syn ORDER BY ord)[1:3] FROM syns s WHERE s.term = asked.term), [])) AS list_distinct_in_order FROM asked) a")
def _(spark, d):
    return E.expand(_asked(spark)).select("term", F.array_join("expanded", " ").alias("expanded"))


_VARIATION_SQL = """list_filter(CASE
  WHEN t LIKE '%ing' THEN list_transform(['', 'e', 'ed', 's'], lambda e: left(t, length(t) - 3) || e)
  WHEN t LIKE '%ed' THEN list_transform(['', 'e', 'ing', 's'], lambda e: left(t, length(t) - 2) || e)
  WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN list_transform(['', 'ing', 'ed'], lambda e: left(t, length(t) - 1) || e)
  WHEN t LIKE '%er' THEN list_transform(['', 'e', 'est', 'ing'], lambda e: left(t, length(t) - 2) || e)
  ELSE list_transform(['s', 'ed', 'ing', 'er', 'ly'], lambda e: t || e) END, lambda v: length(v) > 2)"""


@_query("q_variations", f"{_WITH}, v AS (SELECT DISTINCT raw AS t FROM post) SELECT t AS term, array_to_string({_VARIATION_SQL}, ' ') AS variations FROM v")
def _(spark, d):
    terms = I.raw_postings(_docs(spark, d)).select(F.col("raw").alias("term")).distinct()
    return terms.select("term", F.array_join(X.variations(F.col("term")), " ").alias("variations"))


@_query("q_related", f"{_SYNONYMS_SQL}, both_of AS (SELECT t AS term, list_concat(coalesce((SELECT list(syn ORDER BY ord) FROM syns s WHERE s.term = a.t), []), {_VARIATION_SQL}) AS l FROM (SELECT term AS t FROM asked) a), firsts AS (SELECT term, x, min(i) AS i FROM (SELECT term, unnest(l) AS x, unnest(range(len(l))) AS i FROM both_of) WHERE x <> term GROUP BY term, x) SELECT term, array_to_string(list(x ORDER BY i)[1:10], ' ') AS related FROM firsts GROUP BY term")
def _(spark, d):
    return E.related(_asked(spark)).select("term", F.array_join("related", " ").alias("related"))


# ---- facets and filters ---------------------------------------------------------------------------------------

_EXT = r"CASE WHEN regexp_extract(file_name, '\.([^./\\]+)$', 1) = '' THEN 'unknown' ELSE lower(regexp_extract(file_name, '\.([^./\\]+)$', 1)) END"
# Names of file types, and the size categories.
_TYPE_NAME = """CASE value WHEN 'pdf' THEN 'PDF Documents' WHEN 'txt' THEN 'Text Files' WHEN 'md' THEN 'Markdown Files' WHEN 'doc' THEN 'Word Documents' WHEN 'docx' THEN 'Word Documents'
  WHEN 'xls' THEN 'Excel Spreadsheets' WHEN 'xlsx' THEN 'Excel Spreadsheets' WHEN 'html' THEN 'Web Pages' WHEN 'htm' THEN 'Web Pages' WHEN 'json' THEN 'JSON Files' WHEN 'xml' THEN 'XML Files'
  ELSE upper(value) || ' Files' END"""
_SIZES = (("0", "1", "2", "3", "4"), ("'Tiny'", "'Small'", "'Medium'", "'Large'", "'VeryLarge'"), ("'< 1 KB'", "'1-10 KB'", "'10-100 KB'", "'100 KB - 1 MB'", "'> 1 MB'"))


def _size_sql(field: int) -> str:
    a, b, c, d, e = _SIZES[field]
    return f"CASE WHEN file_size < 1024 THEN {a} WHEN file_size < 10240 THEN {b} WHEN file_size < 102400 THEN {c} WHEN file_size < 1048576 THEN {d} ELSE {e} END"


_TYPE_FACET = f"SELECT value, {_TYPE_NAME} AS display_name, count(*) AS count FROM (SELECT {_EXT} AS value FROM docs WHERE coalesce(file_name, '') <> '') GROUP BY value"
_MONTH_FACET = "SELECT strftime(date_added, '%Y-%m') AS value, strftime(date_added, '%B %Y') AS display_name, count(*) AS count FROM docs GROUP BY ALL"
_SIZE_FACET = f"SELECT {_size_sql(1)} AS value, {_size_sql(2)} AS display_name, count(*) AS count FROM docs GROUP BY ALL"
_TERM_FACET = f"""SELECT value, value AS display_name, count(*) AS count FROM (SELECT unnest(list_distinct({_tok("concat_ws(' ', title, content)")})) AS value FROM docs)
GROUP BY value HAVING count(*) >= 2 ORDER BY count(*) DESC, value LIMIT 20"""


@_query("q_facet_type", _TYPE_FACET)
def _(spark, d):
    return C.type_facet(_docs(spark, d))


@_query("q_facet_month", _MONTH_FACET)
def _(spark, d):
    return C.month_facet(_docs(spark, d))


@_query("q_facet_size", _SIZE_FACET)
def _(spark, d):
    return C.size_facet(_docs(spark, d)).select("value", "display_name", "count")


@_query("q_facet_terms", _TERM_FACET)
def _(spark, d):
    return C.term_facet(_docs(spark, d))


@_query("q_facets_all", " UNION ALL ".join(f"SELECT '{n}' AS facet, * FROM ({s})" for n, s in (("file_type", _TYPE_FACET), ("date", _MONTH_FACET), ("size", _SIZE_FACET), ("term", _TERM_FACET))))
def _(spark, d):
    return C.extract_facets(_docs(spark, d))


@_query("q_filter_type", f"SELECT doc_id FROM docs WHERE coalesce(file_name, '') <> '' AND {_EXT} IN ('pdf', 'md')")
def _(spark, d):
    return C.apply_filters(_docs(spark, d), types=["pdf", "md"]).select("doc_id")


@_query("q_filter_dates", "SELECT doc_id FROM docs WHERE date_added BETWEEN TIMESTAMP '2024-02-01 00:00:00' AND TIMESTAMP '2025-03-01 00:00:00'")
def _(spark, d):
    return C.apply_filters(_docs(spark, d), date_from=F.expr("timestamp_ntz'2024-02-01 00:00:00'"), date_to=F.expr("timestamp_ntz'2025-03-01 00:00:00'")).select("doc_id")


@_query("q_filter_size", "SELECT doc_id FROM docs WHERE file_size BETWEEN 500 AND 2000")
def _(spark, d):
    return C.apply_filters(_docs(spark, d), size_from=500, size_to=2000).select("doc_id")


@_query("q_filter_size_category", f"SELECT doc_id FROM docs WHERE {_size_sql(0)} IN (0, 3)")
def _(spark, d):
    return C.apply_filters(_docs(spark, d), sizes=[0, 3]).select("doc_id")


@_query("q_filter_terms", "SELECT doc_id FROM docs WHERE (lower(title) LIKE '%vector%' OR lower(content) LIKE '%vector%') AND NOT (lower(title) LIKE '%bucket%' OR lower(content) LIKE '%bucket%')")
def _(spark, d):
    return C.apply_filters(_docs(spark, d), required=["vector"], excluded=["bucket"]).select("doc_id")


@_query("q_filter_all", f"SELECT doc_id FROM docs WHERE coalesce(file_name, '') <> '' AND {_EXT} IN ('txt', 'html') AND file_size >= 300 AND (lower(title) LIKE '%vector%' OR lower(content) LIKE '%vector%') AND {_size_sql(0)} IN (0, 1)")
def _(spark, d):
    return C.apply_filters(_docs(spark, d), types=["txt", "html"], size_from=300, required=["vector"], sizes=[0, 1]).select("doc_id")


@_query("q_filter_options", f"SELECT array_to_string(list_sort(list(DISTINCT e)), ' ') AS types, min(date_added) AS date_from, max(date_added) AS date_to, min(file_size) AS size_from, max(file_size) AS size_to, count(*) AS n_docs FROM (SELECT *, CASE WHEN coalesce(file_name, '') <> '' THEN {_EXT} END AS e FROM docs)")
def _(spark, d):
    return C.filter_options(_docs(spark, d)).withColumn("types", F.array_join("types", " "))


@_query("q_file_types", f"SELECT doc_id, {_EXT} AS ext, {_size_sql(0)} AS ordinal, {_size_sql(2)} AS label FROM docs WHERE file_name IS NOT NULL")
def _(spark, d):
    named = _docs(spark, d).where("file_name is not null")
    return named.select("doc_id", X.file_extension(F.col("file_name")).alias("ext"), X.size_category(F.col("file_size")).alias("ordinal"), X.size_category_label(F.col("file_size")).alias("label"))


# ---- analytics ------------------------------------------------------------------------------------------------

_Q = "trim(lower(query))"
_ROLLUP = f"""SELECT {_Q} AS query, count(*) AS n_searches, CAST(coalesce(sum(result_count), 0) AS BIGINT) AS total_results, coalesce(sum(search_time_ms), 0) AS total_time_ms,
  min(ts) AS first_searched, max(ts) AS last_searched FROM searches WHERE query IS NOT NULL GROUP BY 1"""


@_query("q_query_stats", f"SELECT query, n_searches, total_results, round(total_time_ms, 3) AS total_time_ms, first_searched, last_searched FROM ({_ROLLUP})")
def _(spark, d):
    rolled = A.query_rollup(_searches(spark, d))
    return rolled.select("query", "n_searches", "total_results", F.round("total_time_ms", 3).alias("total_time_ms"), "first_searched", "last_searched")


@_query("q_ctr", f"SELECT s.query, coalesce(c.k, 0) AS n_clicks, coalesce(c.n, 0) AS n_clicked_docs, round(coalesce(c.k, 0) / s.n_searches, 6) AS ctr, round(total_results / n_searches, 6) AS avg_results FROM ({_ROLLUP}) s LEFT JOIN (SELECT {_Q} AS query, count(*) AS k, count(DISTINCT doc_id) AS n FROM clicks WHERE query IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1) c USING (query)")
def _(spark, d):
    rolled = A.query_rollup(_searches(spark, d), _clicks(spark, d))
    return rolled.select("query", "n_clicks", "n_clicked_docs", F.round("ctr", 6).alias("ctr"), F.round("avg_results", 6).alias("avg_results"))


@_query("q_top_queries", f"SELECT {_Q} AS query, count(*) AS n_searches FROM searches WHERE query IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return A.top_queries(_searches(spark, d))


@_query("q_zero_result", f"SELECT query, n_searches FROM ({_ROLLUP}) WHERE total_results = 0 ORDER BY n_searches DESC, query LIMIT 10")
def _(spark, d):
    return A.zero_result_queries(_searches(spark, d))


@_query("q_popular_docs", "SELECT doc_id, count(*) AS n_clicks FROM clicks WHERE doc_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return A.popular_documents(_clicks(spark, d))


@_query("q_recent", "SELECT event_id, query, ts FROM searches ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, d):
    return A.recent_searches(_searches(spark, d).select("event_id", "query", "ts"), 50, "event_id")


@_query("q_bounded_log", "SELECT event_id, query, ts FROM searches ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(spark, d):
    return A.recent_searches(_searches(spark, d).select("event_id", "query", "ts"), 1000, "event_id")


@_query("q_volume_hour", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n_searches FROM searches WHERE ts >= (SELECT max(ts) FROM searches) - INTERVAL 24 HOUR GROUP BY 1")
def _(spark, d):
    return A.volume_by_hour(_searches(spark, d))


@_query("q_summary", f"""SELECT CAST(sum(n_searches) AS BIGINT) AS n_searches, count(*) AS n_queries, round(avg(total_results / n_searches), 6) AS avg_results, round(avg(total_time_ms / n_searches), 4) AS avg_time_ms,
  round(sum(total_results) / sum(n_searches), 6) AS weighted_avg_results, count(*) FILTER (total_results = 0) AS n_zero_result_queries, (SELECT count(*) FROM clicks WHERE doc_id IS NOT NULL) AS n_clicks FROM ({_ROLLUP})""")
def _(spark, d):
    s = A.summary(_searches(spark, d), _clicks(spark, d))
    return s.select("n_searches", "n_queries", F.round("avg_results", 6).alias("avg_results"), F.round("avg_time_ms", 4).alias("avg_time_ms"), F.round("weighted_avg_results", 6).alias("weighted_avg_results"), "n_zero_result_queries", "n_clicks")


@_query("q_suggest_prefix", f"SELECT {_Q} AS query, count(*) AS n_searches FROM searches WHERE {_Q} LIKE 'title:%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    return A.query_suggestions(_searches(spark, d), "Title:")


@_query("q_boolean_operators", "SELECT event_id FROM searches WHERE upper(query) LIKE '% AND %' OR upper(query) LIKE '% OR %' OR upper(query) LIKE '% NOT %' OR upper(query) LIKE 'NOT %'")
def _(spark, d):
    return _searches(spark, d).where(X.has_boolean_operators(F.col("query"))).select("event_id")


# ---- highlighting ---------------------------------------------------------------------------------------------


def _matches_sql(words: tuple[str, ...], source: str) -> str:
    """(doc_id, start, end, term) of whole words: the places between the pieces of the lower-cased text, with no letter or digit beside them."""
    one = """SELECT doc_id, CAST(pos AS INT) AS start, CAST(pos + {n} AS INT) AS "end", '{w}' AS term FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * {n})) AS pos, unnest(range(1, len(parts))) AS i, parts
  FROM (SELECT doc_id, string_split(lower(content), '{w}') AS parts FROM {s}))
WHERE NOT regexp_matches(right(parts[i], 1), '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(left(parts[i + 1], 1), '[\\p{{L}}\\p{{N}}]')"""
    return " UNION ALL ".join(one.format(w=w, n=len(w), s=source) for w in words)


@_query("q_match_positions", f"SELECT doc_id, start FROM ({_matches_sql(('vector',), 'docs')})")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(H.match_positions(F.col("content"), ["vector"])).alias("m")).select("doc_id", F.col("m.start").alias("start"))


def _clusters_sql(distance: int) -> str:
    return f"""gaps AS (SELECT *, coalesce(start - lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end") >= {distance}, true) AS opens FROM m),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS c FROM gaps),
grouped AS (SELECT doc_id, c, min(start) AS first_start, max("end") AS last_end, count(*) AS n, sum(start) AS total FROM numbered GROUP BY doc_id, c),
clusters AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c) AS INT) AS rank FROM grouped)"""


@_query("q_clusters", f"WITH m AS ({_matches_sql(('vector', 'bucket'), 'docs')}), {_clusters_sql(150)} SELECT doc_id, rank, first_start, last_end, n FROM clusters")
def _(spark, d):
    found = _docs(spark, d).select("doc_id", F.explode(H.match_positions(F.col("content"), ["vector", "bucket"])).alias("m")).select("doc_id", "m.start", "m.end")
    return H.clusters(found, 150)


_WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _marked_sql(text: str, letters: str = r"\p{L}\p{N}_") -> str:
    runs = f"regexp_extract_all({text}, '[{letters}]+|[^{letters}]+')"
    return f"array_to_string(list_transform({runs}, lambda w: CASE WHEN lower(w) IN ('archive', 'vector') THEN '<mark>' || w || '</mark>' ELSE w END), '')"


def _cut_sql(length: int) -> str:
    return f"""CASE WHEN length(content) <= {length} THEN content ELSE
  CASE WHEN left(content, {length}) LIKE '% %' AND {length} - instr(reverse(left(content, {length})), ' ') > {length} * 0.8 THEN left(content, {length} - instr(reverse(left(content, {length})), ' '))
  ELSE left(content, {length}) END || '...' END"""


# windows (doc_id, content, low, high) to (..., wide_low, wide_high) and the marked text between
_WIDE = rf"""wide AS (SELECT *, low - length(regexp_extract(left(content, low), '[^{_WS}]*$')) AS wide_low, high + length(regexp_extract(substr(content, high + 1), '^[^{_WS}]*')) AS wide_high FROM windows),
texts AS (SELECT *, CASE WHEN wide_low > 0 THEN '...' ELSE '' END || regexp_replace(substr(content, wide_low + 1, wide_high - wide_low), '^[{_WS}]+|[{_WS}]+$', '', 'g')
  || CASE WHEN wide_high < length(content) THEN '...' ELSE '' END AS cut FROM wide)"""


def _snippet_sql(source: str) -> str:
    """(doc_id, text, snippet_start, snippet_end, total_matches, n_inside) of the documents of ``source``."""
    return f"""m AS ({_matches_sql(('vector', 'archive'), source)}),
tried AS (SELECT a.doc_id, greatest(0, a.start - 50) AS low, count(b.start) AS n FROM m a JOIN m b ON b.doc_id = a.doc_id AND b.start >= greatest(0, a.start - 50) AND b."end" <= greatest(0, a.start - 50) + 200
  GROUP BY a.doc_id, a.start, a.term),
best AS (SELECT doc_id, arg_max(low, n * 10000000 - low) AS low FROM tried GROUP BY doc_id),
windows AS (SELECT doc_id, content, low, least(length(content), low + 200) AS high FROM best JOIN {source} USING (doc_id)),
{_WIDE},
snippets AS (SELECT doc_id, {_marked_sql('cut')} AS text, CAST(low AS INT) AS snippet_start, CAST(high AS INT) AS snippet_end,
    CAST((SELECT count(*) FROM m WHERE m.doc_id = t.doc_id) AS INT) AS total_matches, CAST((SELECT count(*) FROM m WHERE m.doc_id = t.doc_id AND m.start >= low AND m."end" <= high) AS INT) AS n_inside FROM texts t
  UNION ALL SELECT doc_id, {_cut_sql(200)}, 0, 0, 0, 0 FROM {source} WHERE doc_id NOT IN (SELECT doc_id FROM m))"""


def _flat(snippet: str) -> list:
    fields = [F.col(f"{snippet}.{c}").alias(c) for c in ("text", "snippet_start", "snippet_end", "total_matches")]
    return [*fields, F.size(f"{snippet}.match_positions").alias("n_inside")]


@_query("q_snippet", f"WITH asked AS (SELECT doc_id, content FROM docs WHERE lower(content) LIKE '%vector%'), {_snippet_sql('asked')} SELECT * FROM snippets")
def _(spark, d):
    found = _docs(spark, d).where(F.lower("content").contains("vector"))
    return found.select("doc_id", H.best_snippet(F.col("content"), ["vector", "archive"]).alias("snippet")).select("doc_id", *_flat("snippet"))


@_query("q_multi_snippet", f"""WITH asked AS (SELECT doc_id, content FROM docs WHERE lower(content) LIKE '%vector%'), m AS ({_matches_sql(('vector', 'archive'), 'asked')}), {_clusters_sql(150)},
windows AS (SELECT doc_id, content, rank, n, greatest(0, CAST(total // n AS BIGINT) - 75) AS low, least(length(content), greatest(0, CAST(total // n AS BIGINT) - 75) + 150) AS high FROM clusters JOIN asked USING (doc_id) WHERE rank <= 3),
{_WIDE}
SELECT doc_id, CAST(rank - 1 AS INT) AS nth, {_marked_sql('cut')} AS text, CAST(wide_low AS INT) AS snippet_start, CAST(wide_high AS INT) AS snippet_end, CAST(n AS INT) AS total_matches FROM texts
UNION ALL SELECT doc_id, 0, {_cut_sql(150)}, 0, 0, 0 FROM asked WHERE doc_id NOT IN (SELECT doc_id FROM m)""")
def _(spark, d):
    found = _docs(spark, d).where(F.lower("content").contains("vector"))
    several = found.select("doc_id", F.posexplode(H.multiple_snippets(F.col("content"), ["vector", "archive"])).alias("nth", "snippet"))
    return several.select("doc_id", "nth", *_flat("snippet")[:4])


# the word characters of the JVM's Unicode word boundaries
_HIGHLIGHTED = _marked_sql("content", r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}")


@_query("q_highlight_full", f"SELECT doc_id, CASE WHEN content = '' THEN '' ELSE {_HIGHLIGHTED} END AS content FROM docs")
def _(spark, d):
    return _docs(spark, d).select("doc_id", H.highlight_content(F.col("content"), ["vector", "archive"]).alias("content"))


@_query("q_result_page", f"""{_WITH}, {_bm25(['vector', 'archive'], 'raw', 'post')}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores ORDER BY score DESC, doc_id LIMIT 10),
asked AS (SELECT doc_id, content FROM docs SEMI JOIN top USING (doc_id)), {_snippet_sql('asked')}
SELECT rank, doc_id, score, title, text, snippet_start, snippet_end, total_matches, n_inside FROM top JOIN docs USING (doc_id) JOIN snippets USING (doc_id)""")
def _(spark, d):
    docs = _docs(spark, d)
    top = S.ranked_page(_rounded(S.ranked(docs, "vector archive", "raw", _index(spark, d))), 0, 10).join(docs, "doc_id")
    shown = top.select(F.col("rank").cast("bigint").alias("rank"), "doc_id", "score", "title", H.best_snippet(F.col("content"), ["vector", "archive"]).alias("snippet")).orderBy("rank")
    return shown.select("rank", "doc_id", "score", "title", *_flat("snippet"))


@_query("q_truncate", "SELECT doc_id, CASE WHEN content IS NULL THEN '' WHEN length(content) <= 200 THEN content ELSE CASE WHEN c LIKE '% %' AND 200 - instr(reverse(c), ' ') > 160 THEN left(c, 200 - instr(reverse(c), ' ')) ELSE c END || '...' END AS text FROM (SELECT doc_id, content, left(content, 200) AS c FROM docs)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", X.truncate(F.col("content"), 200).alias("text"))


@_query("q_preview", "SELECT doc_id, CASE WHEN length(content) > 220 THEN left(content, 220) || '...' ELSE content END AS text FROM docs")
def _(spark, d):
    return _docs(spark, d).select("doc_id", X.preview(F.col("content")).alias("text"))


# ---- documents ------------------------------------------------------------------------------------------------


@_query("q_newest_first", "SELECT doc_id, title, date_added, row_number() OVER (ORDER BY date_added DESC, doc_id) AS rank FROM docs")
def _(spark, d):
    return R.in_places(D.newest_first(_docs(spark, d)).select("doc_id", "title", "date_added"), F.desc("date_added"), F.col("doc_id"))


@_query("q_crud_upsert", "SELECT doc_id, CASE WHEN file_name IS NULL THEN 'untitled file' ELSE title END AS title FROM docs UNION ALL SELECT -doc_id, 'copy' FROM docs WHERE file_name IS NULL")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", "title", "file_name")
    unnamed = docs.where("file_name is null")
    changed = D.update(docs, unnamed.withColumn("title", F.lit("untitled file")))
    new = unnamed.select((-F.col("doc_id")).alias("doc_id"), F.lit("copy").alias("title"), "file_name").unionByName(unnamed)
    return D.insert(changed, new).select("doc_id", "title")


@_query("q_crud_delete", "SELECT doc_id FROM docs WHERE file_name IS NOT NULL")
def _(spark, d):
    docs = _docs(spark, d)
    return D.delete(docs, docs.where("file_name is null")).select("doc_id")


@_query("q_index_delete", f"{_WITH} SELECT raw AS term, count(*) AS cf FROM post WHERE doc_id IN (SELECT doc_id FROM docs WHERE file_name IS NOT NULL) GROUP BY raw")
def _(spark, d):
    docs = _docs(spark, d)
    kept = I.remove_documents(I.raw_postings(docs), docs.where("file_name is null"))
    return kept.groupBy(F.col("raw").alias("term")).agg(F.count(F.lit(1)).alias("cf"))


@_query("q_clear", "SELECT doc_id, false AS is_indexed FROM docs")
def _(spark, d):
    docs = _docs(spark, d)
    return I.clear(I.raw_postings(docs), docs)[1].select("doc_id", "is_indexed")


@_query("q_by_id", "SELECT doc_id, title FROM docs WHERE doc_id = 5000000005")
def _(spark, d):
    return D.by_id(_docs(spark, d), 5_000_000_005).select("doc_id", "title")


def _shown_sql(unit: int, name: str) -> str:
    return rf"regexp_replace(printf('%.2f', ((file_size * 200 + {unit}) // (2 * {unit})) / 100.0), '\.?0+$', '') || ' {name}'"


_SHOWN = " ".join(f"WHEN file_size < {1024 ** (i + 2)} THEN {_shown_sql(1024 ** (i + 1), u)}" for i, u in enumerate(("KB", "MB", "GB")))


@_query("q_display", f"SELECT doc_id, strftime(date_added, '%Y-%m') AS month, strftime(date_added, '%b %d, %Y') AS day, CASE WHEN file_size <= 0 THEN '0 B' WHEN file_size < 1024 THEN file_size || ' B' {_SHOWN} ELSE {_shown_sql(1024**4, 'TB')} END AS size FROM docs")
def _(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", F.date_format("date_added", "yyyy-MM").alias("month"), X.shown_date(F.col("date_added")).alias("day"), X.human_size(F.col("file_size")).alias("size"))


@_query("q_index_add", f"{_WITH} SELECT raw AS term, count(*) AS cf FROM post GROUP BY raw")
def _(spark, d):
    docs = _docs(spark, d)
    # of the documents added, those with an even id are in the index already and are replaced
    index = I.postings(docs.where("file_name is not null or doc_id % 2 = 0"))
    whole = I.add_documents(index, docs.where("file_name is null"))
    return whole.groupBy(F.col("raw").alias("term")).agg(F.count(F.lit(1)).alias("cf"))


_STEM_OF_NAME = r"regexp_replace(file_name, '(.)\.[^.]*$', '\1')"


@_query("q_ingest", f"SELECT doc_id, coalesce(nullif(trim(title), ''), {_STEM_OF_NAME}, '') AS title, strlen(coalesce(content, '')) AS file_size FROM docs WHERE trim(coalesce(content, '')) <> '' OR file_name IS NOT NULL")
def _(spark, d):
    from brindle.sources.files import from_contents

    made = from_contents(_docs(spark, d).select("doc_id", "title", "content", "date_added", "file_name"))
    return made.select("doc_id", "title", "file_size")


@_query("q_json_positions", f"{_WITH} SELECT doc_id, raw AS term, CAST(pos AS INT) AS pos FROM post WHERE raw IN ('vector', 'archive')")
def _(spark, d):
    nested = I.positions(I.hits(_docs(spark, d), ["vector", "archive"]).withColumn("term", F.col("raw")))
    there_and_back = nested.select("doc_id", F.from_json(F.to_json("positions"), "map<string, array<int>>").alias("positions"))
    return I.index_from_json(there_and_back).select("doc_id", "term", "pos")


def _kgram_counts(vocab: DataFrame) -> DataFrame:
    return vocab.select("term", F.size(X.kgrams(F.col("term"))).cast("bigint").alias("n"))


@_query("q_kgram_counts", f"{_VOCAB} SELECT term, len({_bigrams('term')}) AS n FROM v")
def _(spark, d):
    return _kgram_counts(_vocab(spark, d))


# ---- streaming


def _run(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """The table of an aggregating stream over a whole log, in the application's shared folder."""
    from brindle.streaming import analytics as Z

    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return Z.run_to_folder(stream, f"{path}/table", keys, f"{path}/checkpoint")


@_query("q_stream_volume", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n_searches FROM searches GROUP BY 1")
def _(spark, d):
    from brindle.streaming import analytics as Z

    stream = Z.with_event_time(Z.read_log(spark, f"{d}/searches.parquet"))
    return _run(spark, Z.volume_by_hour(stream), ["hour"]).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n_searches")


@_query("q_stream_last_day", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n_searches FROM searches GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM searches) - INTERVAL 24 HOUR")
def _(spark, d):
    from brindle.streaming import analytics as Z

    stream = Z.with_event_time(Z.read_log(spark, f"{d}/searches.parquet"))
    return Z.last_hours(_run(spark, Z.volume_by_hour(stream), ["hour"])).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n_searches")


@_query("q_stream_query_stats", f"SELECT query, n_searches, total_results FROM ({_ROLLUP})")
def _(spark, d):
    from brindle.streaming import analytics as Z

    return _run(spark, Z.query_rollup(Z.read_log(spark, f"{d}/searches.parquet")), ["query"]).select("query", "n_searches", "total_results")


@_query("q_stream_once", "SELECT DISTINCT click_id FROM clicks")
def _(spark, d):
    from brindle.streaming import analytics as Z

    clicks = Z.with_event_time(Z.read_log(spark, f"{d}/clicks.parquet"))
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return Z.append_to_folder(Z.without_redelivery(clicks, "click_id").select("click_id"), f"{path}/table", f"{path}/checkpoint")


@_query("q_stream_clicks", "SELECT doc_id, count(*) AS n_clicks FROM clicks WHERE doc_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    from brindle.streaming import analytics as Z

    return _run(spark, Z.click_counts(Z.read_log(spark, f"{d}/clicks.parquet")), ["doc_id"])


@_query("q_stream_newest", "SELECT event_id, query, ts FROM searches ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(spark, d):
    from brindle.streaming import analytics as Z

    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = Z.read_log(spark, f"{d}/searches.parquet").select("event_id", "query", "ts")
    Z.run_batches(stream, Z.keep_newest(f"{path}/table"), f"{path}/checkpoint")
    return Z.newest(spark, f"{path}/table")
