"""Match positions, snippets and highlighting.

These are meant for the rows of one result page, after the limit. Positions are in characters. A match is a whole word: no letter or
digit beside it. Marking uses word boundaries, all terms in one pattern with the longest first, so that marks never nest.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<mark>", "</mark>"
LEAD = 50  # characters before the first match of a snippet's window

_POSITIONS = "array<struct<start:int,end:int,term:string>>"
_SNIPPET = "struct<text:string,match_positions:array<struct<start:int,end:int>>,snippet_start:int,snippet_end:int,total_matches:int>"


def _terms(terms: list[str]) -> list[str]:
    return sorted({t.lower() for t in terms if t}, key=lambda t: (-len(t), t))


def find_matches(text: str | None, terms: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, term) of all whole-word matches, by start, then end."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered; positions are those of the text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = []
    for term in _terms(terms):
        for m in re.finditer(f"(?={re.escape(term)})", low):
            start, end = m.start(), m.start() + len(term)
            if not (start and low[start - 1].isalnum()) and not (end < len(low) and low[end].isalnum()):
                found.append((start, end, term))
    return sorted(found)


def best_window(matches: list[tuple[int, int, str]], length: int, size: int) -> tuple[int, int]:
    """The window that holds most matches whole, the first of several; windows start a little before a match."""
    starts = [m[0] for m in matches]
    best, most = 0, 0
    for start in starts:
        low = max(0, start - LEAD)
        inside = matches[bisect_left(starts, low) : bisect_left(starts, low + length)]
        n = sum(m[1] <= low + length for m in inside)
        if n > most:
            best, most = low, n
    return best, min(size, best + length)


def widened(text: str, start: int, end: int) -> tuple[int, int]:
    """The two places moved outwards to white space."""
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return start, end


def cut_out(text: str, start: int, end: int) -> str:
    """The text between two places, widened to white space, trimmed, with three dots on the sides where something is left out."""
    start, end = widened(text, start, end)
    return ("..." if start > 0 else "") + text[start:end].strip() + ("..." if end < len(text) else "")


def mark(text: str | None, terms: list[str], start: str = START, end: str = END) -> str | None:
    """The text with all whole-word terms marked, whatever their case."""
    wanted = _terms(terms)
    if not text or not wanted or not text.strip():
        return text
    return re.sub(rf"\b({'|'.join(map(re.escape, wanted))})\b", lambda m: start + m[1] + end, text, flags=re.I)


def cut_off(text: str | None, length: int) -> str:
    """The beginning of a text; see functions.text.truncate."""
    if not text or len(text) <= length:
        return text or ""
    head = text[:length]
    space = head.rfind(" ")
    return (head[:space] if space > length * 0.8 else head) + "..."


def snippet(text: str | None, terms: list[str], length: int = 200, start: str = START, end: str = END) -> dict:
    """The best snippet of one text as a dictionary of the snippet's fields; positions count from the window's start."""
    matches = find_matches(text, terms) if text and text.strip() else []
    if not matches:
        return dict(text=cut_off(text, length), match_positions=[], snippet_start=0, snippet_end=0, total_matches=0)
    low, high = best_window(matches, length, len(text))
    inside = [dict(start=a - low, end=b - low) for a, b, _ in matches if a >= low and b <= high]
    return dict(text=mark(cut_out(text, low, high), terms, start, end), match_positions=inside, snippet_start=low, snippet_end=high, total_matches=len(matches))


def groups(matches: list[tuple[int, int, str]], distance: int) -> list[list[tuple[int, int, str]]]:
    """Matches in clusters, a new one where the gap to the match before is ``distance`` or more; largest first, then by place."""
    out: list[list[tuple[int, int, str]]] = []
    for m in matches:
        if out and m[0] - out[-1][-1][1] < distance:
            out[-1].append(m)
        else:
            out.append([m])
    return sorted(out, key=lambda c: -len(c))


def snippets(text: str | None, terms: list[str], most: int = 3, length: int = 150) -> list[dict]:
    """Up to ``most`` snippets around the clusters of matches."""
    matches = find_matches(text, terms)
    if not matches:
        return [dict(text=cut_off(text, length), match_positions=[], snippet_start=0, snippet_end=0, total_matches=0)]
    out = []
    for cluster in groups(matches, length)[:most]:
        low = max(0, sum(m[0] for m in cluster) // len(cluster) - length // 2)
        low, high = widened(text, low, min(len(text), low + length))
        out.append(dict(text=mark(cut_out(text, low, high), terms), match_positions=[], snippet_start=low, snippet_end=high, total_matches=len(cluster)))
    return out


def match_positions(text: Column, terms: list[str]) -> Column:
    """All matches of a text."""

    @F.pandas_udf(_POSITIONS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(start=a, end=b, term=w) for a, b, w in find_matches(t, terms)])

    return run(text)


def best_snippet(text: Column, terms: list[str], length: int = 200, start: str = START, end: str = END) -> Column:
    """The best snippet as a struct."""

    @F.pandas_udf(_SNIPPET)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet(t, terms, length, start, end) for t in texts], columns=["text", "match_positions", "snippet_start", "snippet_end", "total_matches"])

    return run(text)


def multiple_snippets(text: Column, terms: list[str], most: int = 3, length: int = 150) -> Column:
    """Several snippets as an array of structs."""

    @F.pandas_udf(f"array<{_SNIPPET}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippets(t, terms, most, length))

    return run(text)


def highlight_content(text: Column, terms: list[str], start: str = START, end: str = END) -> Column:
    """The whole text with marks, by a regular expression inside the JVM."""
    wanted = _terms(terms)
    if not wanted:
        return text
    pattern = "(?iuU)\\b(" + "|".join("\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in wanted) + ")\\b"
    quoted = [s.replace("\\", "\\\\").replace("$", "\\$") for s in (start, end)]
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{quoted[0]}$1{quoted[1]}"))


def clusters(matches: DataFrame, distance: int, key: str = "doc_id") -> DataFrame:
    """(doc_id, rank, first_start, last_end, n) of the clusters of (doc_id, start, end) rows, largest first within a document."""
    by_place = Window.partitionBy(key).orderBy("start", "end")
    opens = F.coalesce(F.col("start") - F.lag("end").over(by_place) >= distance, F.lit(True))
    numbered = matches.withColumn("_open", opens.cast("int")).withColumn("_cluster", F.sum("_open").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(key, "_cluster").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "_cluster"))
    return found.select(key, rank.alias("rank"), "first_start", "last_end", "n")
