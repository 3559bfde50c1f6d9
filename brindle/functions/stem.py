"""The stemmer: a Porter variant driven by rule tables.

Words shorter than three characters or with a character that is no letter stay as they are. A word is read as a
string of consonants (C) and vowels (V): a, e, i, o and u are vowels, y is one after a consonant, every other letter
is a consonant. The measure of a stem is the number of VC in that string. Unlike the classic algorithm, a failed measure
in step 4 does not end the step: shorter endings are tried.

The same tables make the SQL of the stemmer (``stem_sql``), so that both can be compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings and what replaces them, in the order in which they are tried.
STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log",
)
STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """The word as C and V."""
    out = ""
    for c in word:
        vowel = c in "aeiou" or (c == "y" and out[-1:] == "C")
        out += "V" if vowel else "C"
    return out


class _Word:
    """A word with the shape of its prefixes at hand."""

    def __init__(self, text: str) -> None:
        self.text, self.shape = text, shape(text)

    def without(self, ending: str) -> int:
        return len(self.text) - len(ending)

    def measure(self, end: int) -> int:
        return self.shape[:end].count("VC")

    def has_vowel(self, end: int) -> bool:
        return "V" in self.shape[:end]

    def closes_short(self, end: int) -> bool:
        """Whether the prefix ends in consonant, vowel, consonant other than w, x and y."""
        return end >= 3 and self.shape[end - 3 : end] == "CVC" and self.text[end - 1] not in "wxy"


def _plural(w: str) -> str:
    for ending, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(ending):
            return w[: len(w) - len(ending)] + to
    return w


def _past(w: str) -> str:
    word = _Word(w)
    if w.endswith("eed"):
        return w[:-1] if word.measure(word.without("eed")) > 0 else w
    for ending in ("ed", "ing"):
        end = word.without(ending)
        if w.endswith(ending) and word.has_vowel(end):
            return _mended(w[:end])
    return w


def _mended(w: str) -> str:
    word = _Word(w)
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and word.shape[-1] == "C" and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if word.measure(len(w)) == 1 and word.closes_short(len(w)) else w


def _final_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and _Word(w).has_vowel(len(w) - 1) else w


def _replaced(w: str, rules: dict[str, str]) -> str:
    """The first ending that fits decides, whether or not its stem is long enough."""
    ending = next((e for e in rules if w.endswith(e)), None)
    if ending is None:
        return w
    end = len(w) - len(ending)
    return w[:end] + rules[ending] if _Word(w).measure(end) > 0 else w


def _bare(w: str) -> str:
    word = _Word(w)
    for ending in STEP_4:
        end = word.without(ending)
        if w.endswith(ending) and word.measure(end) > 1 and (ending != "ion" or w[end - 1 : end] in ("s", "t")):
            return w[:end]
    return w


def _final_e(w: str) -> str:
    if w.endswith("e"):
        word, end = _Word(w), len(w) - 1
        m = word.measure(end)
        if m > 1 or (m == 1 and not word.closes_short(end)):
            w = w[:end]
    return w[:-1] if w.endswith("ll") and _Word(w).measure(len(w)) > 1 else w


def stem(word: str | None) -> str | None:
    """Stem of one word; null gives null."""
    if word is None:
        return None
    word = word.lower()
    if len(word) < 3 or not word.isalpha():
        return word
    w = _final_y(_past(_plural(word)))
    return _final_e(_bare(_replaced(_replaced(w, STEP_2), STEP_3)))


def stem_column(word: Column) -> Column:
    """Stem of each word through an Arrow UDF; for distinct words, see ``with_stems``."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return run(word)


def stem_arrays(words: Column) -> Column:
    """Stems of an array of words; in each batch the distinct words are stemmed once, without a shuffle."""

    @F.arrow_udf("array<string>")
    def run(arrays: pa.Array) -> pa.Array:
        arrays = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
        coded = arrays.flatten().dictionary_encode()
        stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        lengths = arrays.value_lengths().fill_null(0)
        ends = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), stems)

    return run(words)


def with_stems(df: DataFrame, word_col: str = "raw", stem_col: str = "term") -> DataFrame:
    """``df`` with the stem of each word. Only the distinct words go through Python; they are joined back."""
    stems = df.select(word_col).distinct().select(word_col, stem_column(F.col(word_col)).alias(stem_col))
    return df.join(stems, word_col)


# ---- the same rules as SQL ------------------------------------------------------------------------------------


def _sql_shape(w: str) -> str:
    step = "acc || CASE WHEN c IN ('a','e','i','o','u') OR (c = 'y' AND right(acc, 1) = 'C') THEN 'V' ELSE 'C' END"
    return f"list_reduce(list_prepend('', string_split({w}, '')), lambda acc, c: {step})"


def _sql_measure(prefix: str) -> str:
    return f"(length({prefix}) - length(replace({prefix}, 'VC', ''))) / 2"


def stem_sql(relation: str, word: str = "raw") -> str:
    """DuckDB SQL of (word, term) for the distinct words of a relation."""

    def cut(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def head(n: int) -> str:
        return f"left(s, length(s) - {n})"

    def step(name: str, source: str, expression: str) -> str:
        return f"{name} AS (SELECT {word}, {expression} AS w FROM (SELECT {word}, w, {_sql_shape('w')} AS s FROM {source}))"

    def table(rules: dict[str, str]) -> str:
        cases = " ".join(f"WHEN w LIKE '%{e}' THEN CASE WHEN {_sql_measure(head(len(e)))} > 0 THEN {cut(len(e))} || '{to}' ELSE w END" for e, to in rules.items())
        return f"CASE {cases} ELSE w END"

    short = "right(s, 3) = 'CVC' AND right(w, 1) NOT IN ('w','x','y')"
    short_e = f"right({head(1)}, 3) = 'CVC' AND right({cut(1)}, 1) NOT IN ('w','x','y')"
    past = (
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_sql_measure(head(3))} > 0 THEN {cut(1)} ELSE w END "
        f"WHEN w LIKE '%ed' AND contains({head(2)}, 'V') THEN chr(1) || {cut(2)} WHEN w LIKE '%ing' AND contains({head(3)}, 'V') THEN chr(1) || {cut(3)} ELSE w END"
    )
    mended = (
        "CASE WHEN w LIKE '%at' OR w LIKE '%bl' OR w LIKE '%iz' THEN w || 'e' "
        f"WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(s, 1) = 'C' AND right(w, 1) NOT IN ('l','s','z') THEN {cut(1)} "
        f"WHEN {_sql_measure('s')} = 1 AND {short} THEN w || 'e' ELSE w END"
    )
    bare = "CASE " + " ".join(
        f"WHEN w LIKE '%{e}' AND {_sql_measure(head(len(e)))} > 1" + (f" AND right({cut(3)}, 1) IN ('s','t')" if e == "ion" else "") + f" THEN {cut(len(e))}" for e in STEP_4
    ) + " ELSE w END"
    final_e = f"CASE WHEN w LIKE '%e' AND ({_sql_measure(head(1))} > 1 OR ({_sql_measure(head(1))} = 1 AND NOT ({short_e}))) THEN {cut(1)} ELSE w END"
    return f"""
WITH words AS (SELECT DISTINCT {word} FROM ({relation})),
plain AS (SELECT {word} FROM words WHERE length({word}) >= 3 AND NOT regexp_matches({word}, '[^\\p{{L}}]')),
s1 AS (SELECT {word}, CASE WHEN {word} LIKE '%sses' THEN left({word}, length({word}) - 2) WHEN {word} LIKE '%ies' THEN left({word}, length({word}) - 2)
       WHEN {word} LIKE '%ss' THEN {word} WHEN {word} LIKE '%s' THEN left({word}, length({word}) - 1) ELSE {word} END AS w FROM plain),
{step('s2', 's1', past)},
s3 AS (SELECT {word}, w FROM s2 WHERE left(w, 1) <> chr(1)
       UNION ALL SELECT {word}, {mended} FROM (SELECT {word}, w, {_sql_shape('w')} AS s FROM (SELECT {word}, substr(w, 2) AS w FROM s2 WHERE left(w, 1) = chr(1)))),
{step('s4', 's3', f"CASE WHEN w LIKE '%y' AND contains({head(1)}, 'V') THEN {cut(1)} || 'i' ELSE w END")},
{step('s5', 's4', table(STEP_2))},
{step('s6', 's5', table(STEP_3))},
{step('s7', 's6', bare)},
{step('s8', 's7', final_e)},
{step('s9', 's8', f"CASE WHEN w LIKE '%ll' AND {_sql_measure('s')} > 1 THEN {cut(1)} ELSE w END")}
SELECT {word}, w AS term FROM s9
UNION ALL SELECT {word}, {word} FROM words WHERE NOT (length({word}) >= 3 AND NOT regexp_matches({word}, '[^\\p{{L}}]'))"""
