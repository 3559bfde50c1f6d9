"""How distinctive a term is per record (problem 4).

score = (tf / terms in the record) * (ln((N + 1) / (df + 1)) + 1): term frequency normalised by the record's
length, times the smoothed inverse document frequency. Records are reduced to distinct (record, term, tf) rows in
the task that reads them. The document frequencies are those rows counted by term: each task counts the terms of its own records and sends each of them
once, then they are added and joined back on the term; terms that most records share are split
by adaptive skew handling, and a filter on tf or df moves below the join. The texts are cut into terms twice, once for each side: writing the rows
instead would take several times the space of the texts, of which a filter keeps little.

Cases: null texts count as empty; a record without terms has no rows but counts in N; ties have equal scores; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.arrow import map_batches, named
from brindle.llm.terms import TermSplitter


def term_rows(df: DataFrame, id_col: str, text_cols: tuple[str, ...]) -> DataFrame:
    """(id, term, tf, n_terms): one row for each distinct term of each record."""
    width = len(text_cols)

    def run(batches):
        split = TermSplitter().split
        for batch in batches:
            ids, terms, tfs, sizes = [], [], [], []
            for i, *texts in zip(*(c.to_pylist() for c in batch.columns[: 1 + width]), strict=True):
                counted = Counter(t for text in texts for t in split(text))
                ids += [i] * len(counted)
                terms += counted
                tfs += counted.values()
                sizes += [counted.total()] * len(counted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(sizes, pa.int32())], ["id", "term", "tf", "n_terms"]
            )

    return map_batches(named(df, id_col, *text_cols), run, "id bigint, term string, tf int, n_terms int")


def document_frequencies(df: DataFrame, id_col: str, text_cols: tuple[str, ...]) -> DataFrame:
    """(term, df); every task counts its own records first and sends each of its terms once."""
    width = len(text_cols)
    limit = 1 << 20

    def run(batches):
        split, found = TermSplitter().split, Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["term", "n"])

        for batch in batches:
            for texts in zip(*(c.to_pylist() for c in batch.columns[1 : 1 + width]), strict=True):
                found.update({t for text in texts for t in split(text)})
            if len(found) > limit:  # sends what it has, so that memory stays bounded
                yield rows()
                found.clear()
        yield rows()

    partial = map_batches(named(df, id_col, *text_cols), run, "term string, n bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("df"))


def distinctiveness(df: DataFrame, id_col: str, text_cols: tuple[str, ...]) -> DataFrame:
    """(id_col, term, tf, df, score) of every distinct term of every record."""
    n = df.count()
    rows = term_rows(df, id_col, text_cols)
    joined = rows.join(document_frequencies(df, id_col, text_cols), "term")
    idf = F.log((F.lit(float(n)) + 1.0) / (F.col("df") + 1.0)) + 1.0
    return joined.select(F.col("id").alias(id_col), "term", "tf", "df", (F.col("tf") / F.col("n_terms") * idf).alias("score"))
