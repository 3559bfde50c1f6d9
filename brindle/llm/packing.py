"""Filling containers of fixed capacity (problem 9).

Best-fit decreasing, exact and over the whole collection, without ever holding the items in one place. The
order of decreasing size means that all items of one size meet the same open bins, so the items enter as a histogram: size and number.
A texts longer than the capacity is cut into full pieces and a rest first, so that there are at most ``capacity``
sizes. One task per container kind walks the sizes downward; a segment tree over remaining capacities gives
the tightest bin that still takes the size in logarithmic time, and a run of equal bins is filled with items of that size in a few
steps. The walk yields steps (size, first rank, number, first bin): item number r of that size goes to bin
first bin + (r - first rank). Their number depends on the capacity, not on the number of items.

Each item then gets its rank among the items of its size: sizes are counted per hash part (fixed by the
item's id, so that a lost task gives the same ranks when it runs again), the parts' offsets are summed,
and the rank is the offset plus the place within the part. A size that a third of all items share is spread over all parts. Within a part, items and
steps are merged in the order of their ranks, so that an item costs the same however many steps its size has.

Cases: a null or empty text has size 0 and goes to the tightest bin like any other, so it is kept and uses no room; where
there are only such texts, one bin is opened; an item is cut only if it is longer than the capacity, into full
pieces and one rest; equal items are ordered by id; a null id or an empty table gives no rows; capacities below 1 are refused.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import materialise

MOST_CAPACITY = 1 << 22  # sizes of a histogram and leaves of a segment tree that one task holds


class RoomTree:
    """Segment tree over remaining capacities: whether a bin with that much room is open, and the tightest that takes a size."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.open = bytearray(2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        node = self.leaves + room
        self.open[node] = is_open
        while node > 1:
            node //= 2
            now = self.open[2 * node] | self.open[2 * node + 1]
            if self.open[node] == now:
                return
            self.open[node] = now

    def tightest(self, size: int) -> int:
        """Smallest room >= size among the open bins, or -1."""
        node = self.leaves + size
        if self.open[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return -1


def best_fit_steps(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Steps (size, first rank, number, first bin) of best-fit decreasing over sizes up to ``capacity``."""
    tree = RoomTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first bin, number of bins)], lowest bins last
    steps, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        runs.setdefault(room, []).append((first, n))
        tree.set(room, True)

    for size in sorted((s for s, n in histogram.items() if n and s > 0), reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, first, n = capacity, bins, left
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            # a bin stays the tightest until it takes no more of this size, so bins of equal room are filled one by one
            per = room // size
            full = min(n, left // per)
            if full:
                for k in range(per):
                    steps.append((size, rank + k * full, full, first))
                put(room - per * size, first, full)
                rank, left = rank + per * full, left - per * full
            used = full
            if full < n and 0 < left < per:
                for k in range(left):
                    steps.append((size, rank + k, 1, first + full))
                put(room - left * size, first + full, 1)
                rank, left, used = rank + left, 0, full + 1
            if first == bins:
                bins += used
            elif used < n:
                put(room, first + used, n - used)
    if zeros := histogram.get(0, 0):
        room = tree.tightest(0)
        first = runs[room][-1][0] if room >= 0 else 0
        steps.append((0, 0, zeros, -first - 1))  # a negative bin: all of them into that one
    return steps


_STEP = "spec bigint, size bigint, first_rank bigint, number bigint, first_bin bigint"


def _items(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, id, piece, first_token, size): whole texts, or full pieces and a rest where a text exceeds the capacity."""
    size, capacity = F.col("n"), F.col("capacity")
    pieces = F.greatest(F.ceil(size / capacity), F.lit(1)).cast("bigint")
    kinds = specs.collect()  # checked below to be few
    both = sizes.withColumn("kind", F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("spec"), F.lit(c).cast("bigint").alias("capacity")) for s, c in kinds])))
    cut = both.select("id", "n", "kind.*").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    return cut.select("spec", "id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(capacity, size - F.col("piece") * capacity).alias("size"))


def pack(sizes: DataFrame, specs: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", parts: int | None = None) -> DataFrame:
    """(spec_id, bin_id, doc_id, piece, first_token, n_tokens): every item of ``sizes`` in a bin of every kind of container.

    ``parts`` is over how many tasks the items of one size are ranked, by default as many as the session's shuffle partitions suggest.
    ``specs`` has spec_id and capacity; there may be at most 1,000 kinds, each of a capacity up to ``MOST_CAPACITY``.
    """
    parts = parts or max(64, 4 * int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = specs.where("spec_id is not null and capacity is not null").select(F.col("spec_id").cast("bigint"), F.col("capacity").cast("bigint")).distinct()
    known = wanted.limit(1001).collect()
    if len(known) > 1000 or any(not 1 <= c <= MOST_CAPACITY for _, c in known):
        raise ValueError("1,000 kinds of containers at most, with capacities from 1 to MOST_CAPACITY")
    if not known:
        return sizes.sparkSession.createDataFrame([], f"spec_id bigint, bin_id bigint, {id_col} bigint, piece bigint, first_token bigint, n_tokens bigint")
    capacity_of = {s: c for s, c in known}
    kept = materialise(sizes.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("n")))
    items = _items(kept, wanted).withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).cast("int"))
    counted = materialise(items.groupBy("spec", "size", "part").count())

    def walk(group: pa.Table) -> pa.Table:
        spec = group.column("spec")[0].as_py()
        steps = best_fit_steps(dict(zip(group.column("size").to_pylist(), group.column("n").to_pylist(), strict=True)), capacity_of[spec])
        columns = list(zip(*steps, strict=True)) or [[]] * 4
        return pa.table({"spec": pa.array([spec] * len(steps), pa.int64())} | {k: pa.array(c, pa.int64()) for k, c in zip(("size", "first_rank", "number", "first_bin"), columns, strict=True)})

    histogram = counted.groupBy("spec", "size").agg(F.sum("count").alias("n"))
    steps = histogram.groupBy("spec").applyInArrow(walk, _STEP)
    # the steps of a size meet the rank ranges that its parts hold
    upto = Window.partitionBy("spec", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counted.withColumn("offset", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    met = ranges.join(steps, ["spec", "size"]).where((F.col("first_rank") < F.col("offset") + F.col("count")) & (F.col("first_rank") + F.col("number") > F.col("offset")))
    met = met.select("spec", "size", "part", (F.greatest("first_rank", "offset") - F.col("offset")).alias("place"), F.struct("offset", "first_rank", "first_bin").alias("step"))
    ordered = Window.partitionBy("spec", "size", "part").orderBy("id", "piece")
    ranked = items.withColumn("place", (F.row_number().over(ordered) - 1).cast("bigint"))
    placed = assign(ranked, met).withColumn("rank", F.col("step.offset") + F.col("place"))
    bin_id = F.when(F.col("step.first_bin") < 0, -F.col("step.first_bin") - 1).otherwise(F.col("step.first_bin") + F.col("rank") - F.col("step.first_rank"))
    return placed.select(F.col("spec").alias("spec_id"), bin_id.alias("bin_id"), F.col("id").alias(id_col), "piece", "first_token", F.col("size").alias("n_tokens"))


def assign(ranked: DataFrame, steps: DataFrame) -> DataFrame:
    """The items (spec, size, part, place, id, piece, first_token) with the last of their part's steps (spec, size, part, place, step) that begins at or before their place."""
    both = ranked.select("spec", "size", "part", "place", "id", "piece", "first_token").unionByName(steps, allowMissingColumns=True)
    upto = Window.partitionBy("spec", "size", "part").orderBy("place", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("step", F.last("step", ignorenulls=True).over(upto)).where("id is not null")
