"""Frequency of every distinct term by burst tries (problem 2).

Each task keeps its terms in a burst trie: inner nodes branch on one character, leaves are small hash containers
from term to (occurrences, records); a container that outgrows ``burst`` entries bursts into a node with one
container per next character. So prefixes become as long as the data makes them, and a task holds each
distinct term once. A trie that has ``MOST_ENTRIES`` is written out and started anew. A finished trie is cut into subtrees, one row per container: its prefix, its sorted
suffixes and their two counters.

Subtrees of the same region must meet. A routing table says how long a prefix decides the place: starting from
the empty prefix, each prefix that holds more than its share of entries is lengthened by one character. It
is made from the written subtrees' own prefixes, in one job, and has at most ``MOST_ROUTES`` entries for each length, whatever the collection, so that it can be sent to all tasks.
Subtrees are shuffled by their route, as they are; there the counters of equal suffixes are added by an aggregation that spills, so that a route may hold more
than a task's memory.

Cases: null texts count as empty; a record without terms counts as a record; an empty table gives no terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.arrow import map_batches, named
from brindle.llm.terms import TermSplitter
from brindle.session import materialise

BURST = 2048


class BurstTrie:
    """Burst trie from term to [occurrences, records]."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        # a node maps the next character to a node or a container; "" keeps the counters of the term that ends here
        self.root: dict = {}
        self.entries = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while True:
            if depth == len(term):
                if (c := node.get("")) is None:
                    node[""] = [occurrences, records]
                    self.entries += 1
                else:
                    c[0] += occurrences
                    c[1] += records
                return
            head = term[depth]
            depth += 1
            child = node.get(head)
            if child is None:
                child = node[head] = _Container()
            if type(child) is _Container:
                rest = term[depth:]
                if (c := child.get(rest)) is None:
                    child[rest] = [occurrences, records]
                    self.entries += 1
                    if len(child) > self.burst:
                        node[head] = self._burst(child)
                else:
                    c[0] += occurrences
                    c[1] += records
                return
            node = child

    def _burst(self, container: _Container) -> dict:
        node: dict = {}
        for rest, counters in container.items():
            if rest:
                node.setdefault(rest[0], _Container())[rest[1:]] = counters
            else:
                node[""] = counters
        return {h: self._burst(c) if type(c) is _Container and len(c) > self.burst else c for h, c in node.items()}

    def subtrees(self):
        """(prefix, {suffix: counters}) of every container; a term that ends at a node is a subtree of its own."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for head, child in node.items():
                if head == "":
                    yield prefix, {"": child}
                elif type(child) is _Container:
                    yield prefix + head, child
                else:
                    stack.append((prefix + head, child))


class _Container(dict):
    pass


_SUBTREE = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"


def _rows(parts: list[tuple[str, dict]]) -> pa.RecordBatch:
    prefixes, suffixes, occurrences, records, ends = [], [], [], [], [0]
    for prefix, entries in parts:
        prefixes.append(prefix)
        for s in sorted(entries):
            suffixes.append(s)
            o, r = entries[s]
            occurrences.append(o)
            records.append(r)
        ends.append(len(suffixes))
    at = pa.array(ends, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(prefixes, pa.string())] + [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((suffixes, pa.string()), (occurrences, pa.int64()), (records, pa.int64()))],
        ["prefix", "suffixes", "occurrences", "records"],
    )


MOST_ENTRIES = 1_000_000  # of one trie


def subtrees(df: DataFrame, id_col: str, text_cols: tuple[str, ...], burst: int = BURST, most: int = MOST_ENTRIES) -> DataFrame:
    """Subtrees of the burst tries of each task."""
    width = len(text_cols)

    def written(trie: BurstTrie):
        parts, size = [], 0
        for part in trie.subtrees():
            parts.append(part)
            size += len(part[1])
            if size > 50_000:
                yield _rows(parts)
                parts, size = [], 0
        if parts:
            yield _rows(parts)

    def run(batches):
        trie, split = BurstTrie(burst), TermSplitter().split
        for batch in batches:
            occurrences: Counter[str] = Counter()
            records: Counter[str] = Counter()
            for texts in zip(*(batch.column(1 + k).to_pylist() for k in range(width)), strict=True):
                terms = [t for text in texts for t in split(text)]
                occurrences.update(terms)
                records.update(set(terms))
            for term, n in occurrences.items():
                trie.add(term, n, records[term])
            if trie.entries > most:
                yield from written(trie)
                trie = BurstTrie(burst)
        yield from written(trie)

    return map_batches(named(df, id_col, *text_cols), run, _SUBTREE)


ENTRIES_PER_ROUTE = 500_000  # what one route holds on average, as long as there are not more than MOST_ROUTES
MOST_ROUTES = 1 << 14


def _routing(trees: DataFrame, routes: int) -> list[str]:
    """Prefixes that are to be lengthened: each holds more than its part of all entries.

    The entries are divided into ``routes`` parts, or more where a part would exceed ``ENTRIES_PER_ROUTE``, up to ``MOST_ROUTES``. Of one length, at most that many
    prefixes can hold more than a part, and a lengthened prefix is never longer than the tries' own, so the list is small.
    """
    sized = trees.select("prefix", F.size("suffixes").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = max(routes, min(total // ENTRIES_PER_ROUTE, MOST_ROUTES))
    begins = sized.where(F.length("prefix") > 0).select(F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("depth"), "prefix", "n")
    heavy = begins.groupBy(F.substring("prefix", F.lit(1), F.col("depth")).alias("p")).agg(F.sum("n").alias("n")).where(F.col("n") * parts > total)
    return ["", *(r[0] for r in heavy.select("p").collect())]


def term_counts(df: DataFrame, id_col: str, text_cols: tuple[str, ...], burst: int = BURST, routes: int = 256) -> DataFrame:
    """(term, occurrences, records) of every distinct term of the text columns taken together per record."""
    trees = materialise(subtrees(df, id_col, text_cols, burst))
    heavy = set(_routing(trees, routes))

    def route(batches):
        # a subtree that lies above a longer route is divided among the routes below it
        for batch in batches:
            out: list[tuple[str, str, dict]] = []
            for row in batch.to_pylist():
                prefix = row["prefix"]
                at = next((d for d in range(len(prefix) + 1) if prefix[:d] not in heavy), None)
                entries = zip(row["suffixes"], row["occurrences"], row["records"], strict=True)
                if at is not None:
                    out.append((prefix[:at], prefix, {s: (o, r) for s, o, r in entries}))
                    continue
                parts: dict[str, dict] = defaultdict(dict)
                for s, o, r in entries:
                    term = prefix + s
                    d = next((d for d in range(len(prefix) + 1, len(term) + 1) if term[:d] not in heavy), len(term))
                    parts[term[:d]][s] = (o, r)
                out += [(p, prefix, e) for p, e in parts.items()]
            if out:
                made = _rows([(prefix, e) for _, prefix, e in out])
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in out], pa.string()), *made.columns], ["route", *made.schema.names])

    routed = trees.mapInArrow(route, "route string, " + _SUBTREE).repartition("route")
    entries = routed.select("route", "prefix", F.explode(F.arrays_zip("suffixes", "occurrences", "records")).alias("e"))
    # rows of a route lie together, so that no further shuffle is needed
    merged = entries.groupBy("route", F.concat("prefix", "e.suffixes").alias("term")).agg(F.sum("e.occurrences").alias("occurrences"), F.sum("e.records").alias("records"))
    return merged.select("term", "occurrences", "records")


def marked(counts: DataFrame, n_records: int, rare_records: int = 2, common_share: float = 0.2) -> DataFrame:
    """``counts`` with ``mark``: rare in at most ``rare_records`` records, common in more than ``common_share`` of all, else null."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(common_share * n_records), "common"))
