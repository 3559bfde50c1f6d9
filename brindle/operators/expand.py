"""Query expansion from a synonym dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.stem import stem, stem_column
from brindle.functions.text import variations

# The synonym dictionary, a key and its synonyms in order on each line.
SYNONYMS = """
computer: pc machine system workstation laptop desktop
software: program application app code system
search: find query lookup seek locate retrieve
data: information records content dataset
algorithm: method procedure process technique
network: internet web connection system
file: document record data
user: client customer person account
error: bug fault issue problem defect mistake
fix: repair solve correct patch resolve
research: study investigation analysis examination
paper: article publication document report study
method: approach technique procedure process way
result: outcome finding conclusion output
analysis: study examination evaluation assessment
model: framework system approach design
theory: concept principle hypothesis framework
index: catalog listing directory inventory
document: file text record article page
query: search request question lookup
relevance: pertinence importance significance
ranking: ordering scoring sorting rating
term: word token keyword
frequency: count occurrence rate
big: large huge great major significant
small: little tiny minor slight
fast: quick rapid speedy swift
slow: sluggish gradual leisurely
good: great excellent fine positive
bad: poor negative terrible awful
new: recent modern latest fresh
old: ancient previous former outdated
start: begin initiate commence launch
stop: end halt terminate cease
create: make build generate produce construct
delete: remove erase eliminate discard
change: modify alter update revise transform
show: display present reveal demonstrate
hide: conceal mask obscure
help: assist support aid guide
problem: issue challenge difficulty trouble
solution: answer resolution fix remedy
important: significant crucial essential vital key
simple: easy basic straightforward plain
complex: complicated difficult intricate elaborate
"""


def synonym_pairs() -> list[tuple[str, str, int]]:
    """(term, syn, ord) of the dictionary; ord numbers all pairs."""
    lines = [line.split(":") for line in SYNONYMS.strip().splitlines()]
    pairs = [(key, syn) for key, syns in lines for syn in syns.split()]
    return [(key, syn, i) for i, (key, syn) in enumerate(pairs)]


def synonym_table(spark: SparkSession) -> DataFrame:
    """The dictionary as (term, syn, ord)."""
    return spark.createDataFrame(synonym_pairs(), "term string, syn string, ord int")


def synonyms(terms: DataFrame, term_col: str = "term", dictionary: DataFrame | None = None, with_stems: bool = True) -> DataFrame:
    """(term, syn, ord): those of the term, then the keys it is a synonym of with all theirs, then those of its stem; itself left out.

    ``ord`` is the first place in that order.
    """
    pairs = dictionary if dictionary is not None else synonym_table(terms.sparkSession)
    pairs = F.broadcast(pairs.select(F.col("term").alias("key"), "syn", "ord"))  # the fixed dictionary above, or one as small
    asked = terms.select(F.col(term_col).alias("asked"), F.lower(F.col(term_col)).alias("low")).distinct()
    direct = asked.join(pairs, F.col("low") == F.col("key")).select("asked", "low", "syn", F.col("ord").alias("place"))
    parents = asked.join(pairs, F.col("low") == F.col("syn")).select("asked", "low", F.col("key").alias("parent"))
    named = parents.join(pairs.groupBy("key").agg(F.min("ord").alias("ord")), F.col("parent") == F.col("key")).select("asked", "low", F.col("parent").alias("syn"), (1_000_000 + 2 * F.col("ord")).alias("place"))
    siblings = parents.join(pairs, F.col("parent") == F.col("key")).select("asked", "low", "syn", (1_000_001 + 2 * F.col("ord")).alias("place"))
    parts = [direct, named, siblings]
    if with_stems:
        stems = terms.select(F.col(term_col).alias("asked"), F.lower(F.col(term_col)).alias("low")).distinct().withColumn("root", stem_column(F.col("low")))
        parts.append(stems.join(pairs, F.col("root") == F.col("key")).select("asked", "low", "syn", (3_000_000 + F.col("ord")).alias("place")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("syn <> low").groupBy(F.col("asked").alias("term"), "syn").agg(F.min("place").cast("int").alias("ord"))


def expand_terms(terms: list[str], most: int = 3) -> list[str]:
    """The terms, then the first ``most`` synonyms of each, without repeats; for the handful of terms of one query."""
    return list(dict.fromkeys([*terms, *(s for t in terms for s in _ordered(t)[:most])]))


def _ordered(term: str) -> list[str]:
    """Synonyms of one term in order, from the dictionary at hand."""
    pairs, low, root = synonym_pairs(), term.lower(), stem(term.lower())
    of: dict[str, list[str]] = {}
    for key, syn, _ in pairs:
        of.setdefault(key, []).append(syn)
    parents = [key for key, syns in of.items() if low in syns]
    found = [*of.get(low, []), *(s for p in parents for s in [p, *of[p]]), *of.get(root, [])]
    return [s for s in dict.fromkeys(found) if s != low]


def expand(terms: DataFrame, term_col: str = "term", most: int = 3) -> DataFrame:
    """(term, expanded ARRAY): each term with its first ``most`` synonyms."""
    syns = synonyms(terms, term_col).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("ord", "syn"))).alias("_s"))
    joined = terms.select(F.col(term_col).alias("term")).distinct().join(syns, "term", "left")
    first = F.slice(F.transform(F.coalesce("_s", F.array()), lambda s: s["syn"]), 1, most)
    return joined.select("term", F.array_distinct(F.concat(F.array("term"), first)).alias("expanded"))


def related(terms: DataFrame, term_col: str = "term", most: int = 10) -> DataFrame:
    """(term, related ARRAY): synonyms, then morphological variations, without the term itself."""
    syns = synonyms(terms, term_col).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("ord", "syn"))).alias("_s"))
    joined = terms.select(F.col(term_col).alias("term")).distinct().join(syns, "term", "left")
    ordered = F.transform(F.coalesce("_s", F.array()), lambda s: s["syn"])
    both = F.array_distinct(F.concat(ordered, variations(F.lower("term"))))
    return joined.select("term", F.slice(F.array_remove(both, F.lower("term")), 1, most).alias("related"))
