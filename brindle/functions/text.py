"""Text analysis as Column expressions, and the same analysis in Python for query strings.

Token characters are letters, nonspacing marks, decimal digits, connector punctuation and the hyphen; everything else
separates. A token is dropped if it is longer than 30 characters, a stop word, or holds fewer than two letters.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with this but they have "
    "been being had having do does did doing would should could ought i you we she him her their them what which who when "
    "where why how all each every both few more most other some such no nor not only own same so than too very can just"
).split()

MOST_CHARACTERS, LEAST_LETTERS = 30, 2

_SEPARATORS = r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}\-]+"


def normalize(text: Column) -> Column:
    """Lower case, separators to single spaces, trimmed; null and blank give an empty string."""
    return F.trim(F.regexp_replace(F.coalesce(F.lower(text), F.lit("")), _SEPARATORS, " "))


def is_kept(token: Column) -> Column:
    """Whether a token is no stop token."""
    letters = F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    return (F.length(token) <= MOST_CHARACTERS) & (letters >= LEAST_LETTERS) & ~token.isin(*STOP_WORDS)


def tokenize(text: Column) -> Column:
    """Kept tokens of a text in order, as an array."""
    return F.filter(F.split(normalize(text), " "), is_kept)


def tokenize_query(text: str | None) -> list[str]:
    """``tokenize`` for one string on the driver."""
    pieces = regex.sub(_SEPARATORS, " ", (text or "").lower()).split()
    stop = set(STOP_WORDS)
    return [p for p in pieces if len(p) <= MOST_CHARACTERS and p not in stop and len(regex.findall(r"\p{L}", p)) >= LEAST_LETTERS]


def kgrams(term: Column, k: int = 2, least: int = 1) -> Column:
    """k-grams of the term between ``$`` signs, in order and with repeats; terms shorter than ``least`` have none."""
    padded = F.concat(F.lit("$"), term, F.lit("$"))
    count = F.length(padded) - k + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(padded, i, k))
    return F.when((F.length(term) >= least) & (count >= 1), grams).otherwise(F.array().cast("array<string>"))


def query_kgrams(word: str, k: int = 2) -> list[str]:
    """``kgrams`` for one string on the driver."""
    padded = f"${word}$"
    return [padded[i : i + k] for i in range(len(padded) - k + 1)]


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of the bigram sets of two terms; 0 where both are empty."""
    a, b = F.array_distinct(kgrams(left)), F.array_distinct(kgrams(right))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_distance(left: Column, right: Column, most: int | None = None) -> Column:
    """Levenshtein distance; ``most + 1`` where it exceeds ``most``."""
    if most is None:
        return F.levenshtein(left, right)
    found = F.levenshtein(left, right, most)
    return F.when(found < 0, F.lit(most + 1)).otherwise(found)


def variations(term: Column) -> Column:
    """Morphological variations of a term by its ending, longer than two characters."""
    rules = [  # ending, characters to drop, endings to put on
        (term.endswith("ing"), 3, ("", "e", "ed", "s")),
        (term.endswith("ed"), 2, ("", "e", "ing", "s")),
        (term.endswith("s") & ~term.endswith("ss"), 1, ("", "ing", "ed")),
        (term.endswith("er"), 2, ("", "e", "est", "ing")),
    ]
    out = F.array(*[F.concat(term, F.lit(e)) for e in ("s", "ed", "ing", "er", "ly")])
    for applies, drop, endings in reversed(rules):
        base = F.substring(term, F.lit(1), F.length(term) - drop)
        out = F.when(applies, F.array(*[F.concat(base, F.lit(e)) for e in endings])).otherwise(out)
    return F.filter(out, lambda v: F.length(v) > 2)


def file_extension(name: Column) -> Column:
    """Lower-case extension without the dot, ``unknown`` where there is none."""
    found = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.when(found == "", "unknown").otherwise(found)


# Names of file types by extension.
FILE_TYPES = {
    "pdf": "PDF Documents", "txt": "Text Files", "md": "Markdown Files", "doc": "Word Documents", "docx": "Word Documents",
    "xls": "Excel Spreadsheets", "xlsx": "Excel Spreadsheets", "html": "Web Pages", "htm": "Web Pages", "json": "JSON Files", "xml": "XML Files",
}


def file_type_name(extension: Column) -> Column:
    """Display name of a file type."""
    known = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(extension)), F.concat(F.upper(extension), F.lit(" Files")))


# Size categories as ordinal, name, label and upper bound in bytes.
SIZE_CATEGORIES = (
    (0, "Tiny", "< 1 KB", 1 << 10), (1, "Small", "1-10 KB", 10 << 10), (2, "Medium", "10-100 KB", 100 << 10),
    (3, "Large", "100 KB - 1 MB", 1 << 20), (4, "VeryLarge", "> 1 MB", None),
)


def _by_size(size: Column, field: int) -> Column:
    out = F.lit(SIZE_CATEGORIES[-1][field])
    for category in reversed(SIZE_CATEGORIES[:-1]):
        out = F.when(size < category[3], F.lit(category[field])).otherwise(out)
    return F.when(size.isNotNull(), out)


def size_category(size: Column) -> Column:
    return _by_size(size, 0)


def size_category_name(size: Column) -> Column:
    return _by_size(size, 1)


def size_category_label(size: Column) -> Column:
    return _by_size(size, 2)


def human_size(size: Column) -> Column:
    """Size with a unit of 1024 steps, rounded to two places; sizes beyond terabytes stay in terabytes."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = None
    for step in range(len(units) - 1, -1, -1):
        shown = F.concat(F.regexp_replace(F.format_string("%.2f", size / float(1024**step)), r"\.?0+$", ""), F.lit(f" {units[step]}"))
        out = shown if out is None else F.when(size < 1024 ** (step + 1), shown).otherwise(out)
    return F.when(size <= 0, F.lit("0 B")).when(size.isNotNull(), out)


def preview(text: Column, length: int = 220) -> Column:
    """The first characters, with three dots where something is cut off."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def truncate(text: Column, length: int = 200) -> Column:
    """Cut at ``length``, back to the last space if that lies beyond 80 % of it, with three dots; null gives an empty string."""
    cut = F.substring(text, 1, length)
    before_last_space = F.length(cut) - F.instr(F.reverse(cut), " ")
    backed = F.when((F.instr(cut, " ") > 0) & (before_last_space > length * 0.8), F.substring(cut, F.lit(1), before_last_space)).otherwise(cut)
    return F.coalesce(F.when(F.length(text) <= length, text).otherwise(F.concat(backed, F.lit("..."))), F.lit(""))


def log_form(query: Column) -> Column:
    """The form under which the search log counts a query: lower case, trimmed."""
    return F.trim(F.lower(query))


def has_boolean_operators(query: Column) -> Column:
    """Whether a query string holds a boolean operator word."""
    upper = F.upper(query)
    return upper.contains(" AND ") | upper.contains(" OR ") | upper.contains(" NOT ") | upper.startswith("NOT ")


def like_pattern(wildcard: str) -> str:
    """LIKE pattern of a wildcard term: * any characters, ? one character."""
    escaped = wildcard.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return escaped.replace("*", "%").replace("?", "_")


def shown_number(value: Column, places: int) -> Column:
    """A number rounded to some places, as it is displayed: scores with 2 or 3, averages with 1 or 0."""
    return F.format_string(f"%.{places}f", F.round(value.cast("double"), places))


def shown_date(when: Column, zone: str = "UTC", long: bool = False) -> Column:
    """A UTC time in a zone, short as ``Jan 31, 2024``, long with the weekday and the time."""
    local = F.from_utc_timestamp(when.cast("timestamp"), zone)
    return F.date_format(local, "EEEE, MMMM d, yyyy h:mm:ss a" if long else "MMM dd, yyyy")


def pager(pages: int, most: int = 5) -> list[int]:
    """Numbers of the pages that a pager offers, from 0."""
    return list(range(min(pages, most)))
