"""Spelling suggestions by shared bigrams and edit distance."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.stem import stem
from brindle.functions.text import edit_distance, jaccard, query_kgrams, tokenize_query
from brindle.operators.index import kgram_index

MOST_DISTANCE, LENGTH_BAND, FOR_CORRECTION = 3, 3, 2


def candidates(grams: DataFrame, words: list[str], k: int = 2) -> DataFrame:
    """(word, term): terms that share at least a quarter of the word's k-grams (one at least) and are of similar length.

    ``grams`` are (kgram, term, len) rows, each k-gram of a term once. The words' k-grams are a few literals, by which a written k-gram table
    is pruned, and are joined by equality; repeated k-grams of a word count again.
    """
    asked = [(w, len(w), g, n) for w in dict.fromkeys(words) for g, n in Counter(query_kgrams(w, k)).items()]
    literal = grams.sparkSession.createDataFrame(asked, "word string, word_len int, kgram string, times int")
    met = grams.where(F.col("kgram").isin(*{g for _, _, g, _ in asked})).join(F.broadcast(literal), "kgram")
    shared = met.where(F.abs(F.col("len") - F.col("word_len")) <= LENGTH_BAND).groupBy("word", "word_len", "term").agg(F.sum("times").alias("shared"))
    # a word of n characters has n + 3 - k k-grams
    return shared.where(F.col("shared") >= F.greatest(F.lit(1), F.floor((F.col("word_len") + 3 - k) / 4))).select("word", "term")


def suggestions(vocab: DataFrame, words: list[str], most: int = 5, k: int = 2, key: str = "term", grams: DataFrame | None = None) -> DataFrame:
    """(word, term, edit_distance, jaccard, score, rank) of the best suggestions for each word.

    A word that is in the vocabulary is its own only suggestion, with distance 0, similarity 0 and score 1. Equal scores
    are ordered by distance, then by term. ``grams`` are the vocabulary's k-grams where they are written; else they are made.
    """
    words = [w.lower() for w in words if w and w.strip()]
    pairs = candidates(kgram_index(vocab, k, key=key) if grams is None else grams, words, k) if words else None
    if pairs is None:
        empty = vocab.select(F.col(key).alias("word"), F.col(key).alias("term")).limit(0)
        return empty.select("word", "term", F.lit(0).alias("edit_distance"), F.lit(0.0).alias("jaccard"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    # a word of the vocabulary shares all its k-grams with itself, so it is among its own candidates
    itself, own = F.col("word") == F.col("term"), Window.partitionBy("word")
    near = (
        pairs.withColumn("edit_distance", edit_distance(F.col("word"), F.col("term"), MOST_DISTANCE)).where(F.col("edit_distance") <= MOST_DISTANCE)
        .withColumn("known", F.bool_or(itself).over(own)).where(itself | ~F.col("known"))
        .withColumn("jaccard", F.when(itself, 0.0).otherwise(jaccard(F.col("word"), F.col("term"))))
        .withColumn("score", F.when(itself, 1.0).otherwise(F.lit(1.0) / (1 + F.col("edit_distance")) * (F.lit(0.5) + 0.5 * F.col("jaccard"))))
    )
    ranked = near.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "edit_distance", "term")))
    return ranked.where(F.col("rank") <= most).select("word", "term", "edit_distance", "jaccard", "score", "rank")


def correct_query(vocab: DataFrame, query: str, key: str = "term", grams: DataFrame | None = None) -> DataFrame:
    """One row (original_query, corrected_query, has_corrections, corrections MAP).

    A token stays if it or its stem is in the vocabulary, else its best suggestion within distance 2 takes its place.
    """
    spark = vocab.sparkSession
    tokens = tokenize_query(query)
    if not tokens:
        return spark.createDataFrame([(query, "", False, {})], "original_query string, corrected_query string, has_corrections boolean, corrections map<string,string>")
    placed = spark.createDataFrame([(i, t, stem(t)) for i, t in enumerate(tokens)], "at int, word string, stemmed string")
    words = list(dict.fromkeys([*tokens, *map(stem, tokens)]))
    known = vocab.where(F.col(key).isin(*words)).select(F.col(key).alias("known")).distinct()
    best = suggestions(vocab, tokens, 1, key=key, grams=grams).where(F.col("edit_distance") <= FOR_CORRECTION).select("word", F.col("term").alias("best"))
    marked = (
        placed.join(F.broadcast(known), (F.col("word") == F.col("known")) | (F.col("stemmed") == F.col("known")), "left")
        .groupBy("at", "word").agg(F.max("known").isNotNull().alias("is_known"))
        .join(F.broadcast(best), "word", "left")  # at most one row for each token
    )
    changed = marked.withColumn("fixed", F.when(~F.col("is_known") & F.col("best").isNotNull(), F.col("best")))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("fixed", "word").alias("w"))))
    pairs = F.array_distinct(F.collect_list(F.when(F.col("fixed").isNotNull(), F.struct("word", "fixed"))))
    out = changed.agg(ordered.alias("ws"), pairs.alias("pairs"))
    return out.select(
        F.lit(query).alias("original_query"), F.array_join(F.transform("ws", lambda w: w["w"]), " ").alias("corrected_query"),
        (F.size("pairs") > 0).alias("has_corrections"), F.map_from_entries("pairs").alias("corrections"),
    )
