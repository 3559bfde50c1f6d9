"""Duplicates hidden by formatting differences (problem 7).

The canonical form of a query is made by built-in functions inside the JVM: lower case, field clauses split off
and sorted, punctuation and white space to single spaces. Together with the columns that must agree as they are it is
hashed to 128 bits (two seeded 64-bit hashes); a third, independent hash of 32 bits is the collision check: keys that share the 128 bits
but not the check are kept apart, so that two different keys would have to agree in 160 bits to be taken for one. Copies are
counted per hash with map-side combining, so a group that holds a third of all rows is one row per task before
anything is shuffled. For the list of copies the hashed rows are written once, as four numbers each.

Cases: rows with a null text are no copies of anything and, in ``collapse``, each stays a row of its own with one
copy; empty and blank texts are equal to each other; equal rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import materialise

# The field names that open a clause.
CLAUSE_FIELDS = ("title", "content", "filename")

def canonical(text: Column, fields: tuple[str, ...] = CLAUSE_FIELDS) -> Column:
    """Canonical form of a text: equal for texts that differ in case, white space, punctuation or clause order."""
    opener = f"(?<![\\p{{L}}\\p{{M}}\\p{{N}}])(?=(?:{'|'.join(fields)}):)"
    clean = _plain(text)
    # cut before the openers; the space in front makes the first part that of no clause
    parts = F.transform(F.split(F.concat(F.lit(" "), F.lower(text)), opener), _plain)
    lead = F.filter(F.slice(parts, 1, 1), lambda c: F.length(c) > 0)
    clauses = F.array_sort(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    # a text without a colon has no clause
    return F.when(text.contains(":"), F.array_join(F.concat(lead, clauses), " ")).otherwise(clean)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\p{P}\p{Z}\s]+", " "))


HASH = ["h1", "h2", "check"]


def _hashed(df: DataFrame, id_col: str, text_col: str, same: tuple[str, ...]) -> DataFrame:
    """(id, h1, h2, check) of the rows with a text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null")) for c in same]
    key = F.concat_ws("\u0000", canonical(F.col(f"`{text_col}`")), *parts)
    rows = df.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), key.alias("key"))
    return rows.select("id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), "key").alias("h2"), F.hash("key").alias("check"))


def _groups(hashed: DataFrame) -> DataFrame:
    """(h1, h2, check, keep_id, copies) with partial aggregation before the shuffle."""
    return hashed.groupBy(*HASH).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def collapse(df: DataFrame, id_col: str, text_col: str, same: tuple[str, ...] = ()) -> DataFrame:
    """One row per group of copies: (keep_id, copies), keep_id being the smallest id of the group."""
    alone = df.where(F.col(f"`{text_col}`").isNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    return _groups(_hashed(df, id_col, text_col, same)).select("keep_id", "copies").unionByName(alone)


def copies(df: DataFrame, id_col: str, text_col: str, same: tuple[str, ...] = ()) -> DataFrame:
    """One row per copy but the first: (keep_id, copy_id). Groups of one row are dropped before the join."""
    hashed = materialise(_hashed(df, id_col, text_col, same))  # read twice
    groups = _groups(hashed).where("copies > 1").select(*HASH, "keep_id")
    return hashed.join(groups, HASH).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
