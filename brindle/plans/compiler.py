"""Query nodes to one DataFrame plan.

All leaves of a query are answered by one pass over the documents' tokens and one aggregation by document: the tokens that any leaf
asks for leave the row, a document's hits meet, each leaf becomes a boolean, and the query is a boolean expression over
them. AND, OR and NOT so cost nothing but a filter, whatever their number and order. Only a query that a document without a hit can
answer (a NOT on its own) reads all ids.

Analyzers: ``raw`` compares words as they stand, ``stem`` compares stems, ``mixed`` compares the words of the query, unstemmed, with the
stems of the index and checks proximity on the words (what a reader of a stemmed index gets who does not stem the query).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.stem import stem
from brindle.functions.text import like_pattern, tokenize
from brindle.operators.index import StoredIndex, hits, postings_of, stem_hits
from brindle.plans import ast
from brindle.plans.parser import parse

ANALYZERS = ("raw", "stem", "mixed")


def _leaves(node: ast.Node) -> list[ast.Node]:
    if isinstance(node, (ast.And, ast.Or)):
        return _leaves(node.left) + _leaves(node.right)
    return _leaves(node.operand) if isinstance(node, ast.Not) else [node]


def _sides(node: ast.Node) -> tuple[str, ...]:
    """Words of one side of a NEAR: those of a term or a phrase, else none."""
    return node.words if isinstance(node, ast.Phrase) else (node.word,) if isinstance(node, ast.Term) else ()


def _words(leaf: ast.Node) -> tuple[str, ...]:
    if isinstance(leaf, ast.Near):
        return _sides(leaf.left) + _sides(leaf.right)
    if isinstance(leaf, ast.Field):
        return (leaf.word,)
    return _sides(leaf)


def _holds(node: ast.Node, value) -> object:
    """The query over the values of its leaves."""
    if isinstance(node, ast.And):
        return _holds(node.left, value) & _holds(node.right, value)
    if isinstance(node, ast.Or):
        return _holds(node.left, value) | _holds(node.right, value)
    if isinstance(node, ast.Not):
        inner = _holds(node.operand, value)
        return (not inner) if isinstance(inner, bool) else ~inner
    return value(node)


class _Marks:
    """Aggregates that a document's hits are gathered in."""

    def __init__(self) -> None:
        self.named: dict[str, Column] = {}

    def any(self, condition: Column) -> Column:
        name = f"any_{len(self.named)}"
        self.named[name] = F.bool_or(F.coalesce(condition, F.lit(False)))
        return F.col(name)

    def at(self, key: str, word: str) -> Column:
        name = f"at_{key}_{word}"
        self.named[name] = F.collect_list(F.when(F.col(key) == word, F.col("pos")))
        return F.col(f"`{name}`")


def moved(positions: Column, by: int) -> Column:
    """Positions moved by a number of places."""
    return F.transform(positions, lambda p: p + by)


def _phrase_starts(marks: _Marks, key: str, words: tuple[str, ...]) -> Column:
    """Positions at which a phrase starts."""
    starts = marks.at(key, words[0])
    for i, word in enumerate(words[1:], 1):
        starts = F.array_intersect(starts, moved(marks.at(key, word), -i))
    return starts


def _leaf(leaf: ast.Node, marks: _Marks, analyzer: str) -> Column:
    key = "raw" if analyzer == "raw" else "term"
    form = stem if analyzer == "stem" else (lambda w: w)
    if isinstance(leaf, ast.Term):
        return marks.any(F.col(key) == form(leaf.word))
    if isinstance(leaf, ast.Phrase):
        return F.size(_phrase_starts(marks, key, tuple(map(form, leaf.words)))) > 0
    if isinstance(leaf, ast.Wildcard):
        return marks.any(F.col(key).like(like_pattern(leaf.pattern)))
    if isinstance(leaf, ast.Field):
        return marks.any((F.col("field") == leaf.name) & (F.col("raw") == leaf.word))
    left, right = _sides(leaf.left), _sides(leaf.right)
    if not left or not right:
        return F.lit(False)
    key = "raw" if analyzer == "mixed" else key
    form = (lambda w: w) if analyzer == "mixed" else form
    last = moved(_phrase_starts(marks, key, tuple(map(form, left))), len(left) - 1)
    first = _phrase_starts(marks, key, tuple(map(form, right)))
    near = F.exists(last, lambda a: F.exists(first, lambda b: F.abs(b - a) - 1 <= leaf.distance))
    if analyzer == "mixed":
        for words in (left, right):
            near = near & (F.size(_phrase_starts(marks, "term", words)) > 0)
    return near


def _file_name_hits(docs: DataFrame, words: list[str]) -> DataFrame:
    named = docs.select("doc_id", F.explode(F.filter(tokenize(F.col("file_name")), lambda t: t.isin(*words))).alias("raw"))
    return named.select("doc_id", F.lit("filename").alias("field"), F.lit(None).cast("int").alias("pos"), "raw")


def compile_node(docs: DataFrame, node: ast.Node | None, analyzer: str = "raw", index: DataFrame | StoredIndex | None = None) -> DataFrame:
    """(doc_id) of the documents that answer a query; ``index`` are stemmed postings where they are at hand."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer must be one of {ANALYZERS}")
    if node is None:
        return docs.select("doc_id").limit(0)
    leaves = list(dict.fromkeys(_leaves(node)))
    words = list(dict.fromkeys(w for leaf in leaves for w in _words(leaf)))
    patterns = [leaf.pattern for leaf in leaves if isinstance(leaf, ast.Wildcard)]
    if index is not None:
        asked = [F.col("raw").isin(*words), F.col("term").isin(*words, *map(stem, words))] if words else []
        asked += [F.col(k).like(like_pattern(p)) for p in patterns for k in ("raw", "term")]
        rows = postings_of(index).where(reduce(or_, asked, F.lit(False))).select("doc_id", "field", "pos", "raw", "term")
    elif analyzer == "raw":
        rows = hits(docs, words, patterns).withColumn("term", F.lit(None).cast("string"))
    else:
        # fields and proximity compare words as they stand
        rows = stem_hits(docs, [stem(w) for w in words] if analyzer == "stem" else words, patterns, words)
    if in_names := [x.word for x in leaves if isinstance(x, ast.Field) and x.name == "filename"]:
        rows = rows.unionByName(_file_name_hits(docs, in_names).withColumn("term", F.lit(None).cast("string")))
    marks = _Marks()
    value = {leaf: _leaf(leaf, marks, analyzer) for leaf in leaves}
    if not marks.named:
        gathered = rows.select("doc_id").distinct()
    else:
        gathered = rows.groupBy("doc_id").agg(*[c.alias(n) for n, c in marks.named.items()])
    answer = _holds(node, value.__getitem__)
    ids = docs.select("doc_id")
    found = gathered.where(answer).select("doc_id")
    if not _holds(node, lambda leaf: False):
        return found.join(ids, "doc_id", "left_semi")
    # a document without a hit answers the query: take all but those whose hits deny it
    denied = gathered.where(~answer).select("doc_id")
    return ids.join(denied, "doc_id", "left_anti")


def compile_query(docs: DataFrame, query: str, analyzer: str = "raw", index: DataFrame | StoredIndex | None = None) -> DataFrame:
    """(doc_id) of the documents that answer a query string."""
    return compile_node(docs, parse(query), analyzer, index)


def phrase_documents(docs: DataFrame, words: list[str], analyzer: str = "raw") -> DataFrame:
    """(doc_id) of the documents that hold the words one after the other."""
    return compile_node(docs, ast.Phrase(tuple(words)) if len(words) > 1 else ast.Term(words[0]) if words else None, analyzer)



