"""Most frequent values in bounded memory (problem 6).

Each task runs a sketch of fixed size. The heavy part is an array of buckets with a few slots each; a slot holds
one exact value and its positive votes. A value that finds its bucket full casts a vote against the bucket's
weakest slot; once the votes against reach the weakest's own, that value is evicted, its count falls into the light part (a
count-min array of counters) and the newcomer takes the slot. Sketches merge by bucket recombination: per
bucket the votes of equal values are added, the strongest stay in the slots and the others fall into the light
part; the light arrays are added. Memory depends on the sketch's parameters alone.

``frequent`` then counts the surviving candidates exactly in one pass over the rows; they are at most ``buckets * slots``, so
that they can be broadcast. It is complete: a value not in any slot can only have fallen into the light part,
and every bucket knows how much fell from it; a bucket from which as much fell as the threshold asks for is counted
exactly by itself (its values are a 1/``buckets`` part of all).

Cases: null and blank values are no items, but count as rows for the share; an empty table gives no rows; equal counts are
ordered by value; values are compared lower-cased and trimmed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import materialise

BUCKETS, SLOTS, LIGHT, DEPTH = 1024, 8, 1 << 14, 3


class ElasticSketch:
    """Heavy buckets with vote eviction over a count-min array."""

    def __init__(self, buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT) -> None:
        self.buckets, self.slots, self.width = buckets, slots, light
        self.heavy: list[dict[str, int]] = [{} for _ in range(buckets)]
        self.against = [0] * buckets
        self.fallen = np.zeros(buckets, dtype=np.int64)
        self.light = np.zeros((DEPTH, light), dtype=np.int64)

    def bucket_of(self, value: str) -> int:
        return xxhash.xxh64_intdigest(value.encode(), 11) % self.buckets

    def _cells(self, value: str) -> list[int]:
        h = xxhash.xxh128_intdigest(value.encode(), 5)
        return [(h >> (40 * d)) % self.width for d in range(DEPTH)]

    def _fall(self, bucket: int, value: str, n: int) -> None:
        self.fallen[bucket] += n
        for d, c in enumerate(self._cells(value)):
            self.light[d, c] += n

    def add(self, value: str, n: int = 1) -> None:
        at = self.bucket_of(value)
        slots = self.heavy[at]
        if value in slots:
            slots[value] += n
        elif len(slots) < self.slots:
            slots[value] = n
        else:
            weakest = min(slots, key=lambda v: (slots[v], v))
            self.against[at] += n
            if self.against[at] >= slots[weakest]:
                self._fall(at, weakest, slots.pop(weakest))
                slots[value] = n
                self.against[at] = 0
            else:
                self._fall(at, value, n)

    def merge(self, bucket: int, values: list[str], votes: list[int], fallen: int) -> None:
        """Recombine one bucket of another sketch; its light counters are added apart."""
        slots = self.heavy[bucket]
        for v, n in zip(values, votes, strict=True):
            slots[v] = slots.get(v, 0) + n
        self.fallen[bucket] += fallen
        for v in sorted(slots, key=lambda v: (-slots[v], v))[self.slots :]:
            self._fall(bucket, v, slots.pop(v))

    def estimate(self, value: str) -> int:
        """Never below the true count: the votes of its slot and what may have fallen."""
        return self.heavy[self.bucket_of(value)].get(value, 0) + int(min(self.light[d, c] for d, c in enumerate(self._cells(value))))

    def row(self) -> pa.RecordBatch:
        used = [(i, sorted(b.items())) for i, b in enumerate(self.heavy) if b]
        return pa.RecordBatch.from_pydict(
            {
                "bucket": [[i for i, _ in used]],
                "values": [[[v for v, _ in b] for _, b in used]],
                "votes": [[[n for _, n in b] for _, b in used]],
                "fallen": [self.fallen.tolist()],
                "light": [self.light.astype("<i8").tobytes()],
            },
            schema=_ROW_ARROW,
        )

    def absorb(self, row: dict) -> None:
        for at, values, votes in zip(row["bucket"], row["values"], row["votes"], strict=True):
            self.merge(at, values, votes, 0)
        self.fallen += np.asarray(row["fallen"], dtype=np.int64)
        self.light += np.frombuffer(row["light"], "<i8").reshape(self.light.shape)


_ROW = "bucket array<int>, values array<array<string>>, votes array<array<bigint>>, fallen array<bigint>, light binary"
_ROW_ARROW = pa.schema([
    ("bucket", pa.list_(pa.int32())), ("values", pa.list_(pa.list_(pa.string()))), ("votes", pa.list_(pa.list_(pa.int64()))),
    ("fallen", pa.list_(pa.int64())), ("light", pa.binary()),
])


def written(value: Column) -> Column:
    """The form in which values are compared; null where there is nothing to compare."""
    form = F.regexp_replace(F.lower(value), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(F.length(form) > 0, form)


def sketch(df: DataFrame, value_col: str, buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT, fan_in: int = 32) -> DataFrame:
    """One row with the sketch of all values; partial sketches are merged ``fan_in`` at a time."""

    def first(batches):
        own = ElasticSketch(buckets, slots, light)
        for batch in batches:
            # repeated values of a batch are one vote of their number
            for v, n in Counter(batch.column(0).to_pylist()).items():
                own.add(v, n)
        yield own.row()

    def join(batches):
        own = ElasticSketch(buckets, slots, light)
        seen = False
        for batch in batches:
            for row in batch.to_pylist():
                own.absorb(row)
                seen = True
        if seen:
            yield own.row()

    values = df.select(written(F.col(f"`{value_col}`")).alias("v")).where("v is not null")
    parts = values.rdd.getNumPartitions()
    out = values.mapInArrow(first, _ROW)
    while parts > 1:
        parts = -(-parts // fan_in)
        out = out.repartition(parts).mapInArrow(join, _ROW)
    return out


def candidates(sketched: DataFrame, buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT) -> DataFrame:
    """(value, bucket, estimate) of the values in the sketch: at most ``buckets * slots`` rows."""

    def run(batches):
        for batch in batches:
            own = ElasticSketch(buckets, slots, light)
            for row in batch.to_pylist():
                own.absorb(row)
            rows = [(v, i, own.estimate(v)) for i, b in enumerate(own.heavy) for v in b]
            yield pa.RecordBatch.from_pydict(
                {"value": [r[0] for r in rows], "bucket": [r[1] for r in rows], "estimate": [r[2] for r in rows]},
                schema=pa.schema([("value", pa.string()), ("bucket", pa.int32()), ("estimate", pa.int64())]),
            )

    return sketched.mapInArrow(run, "value string, bucket int, estimate bigint")


def _overfull(sketched: DataFrame, least: int) -> list[int]:
    """Buckets from which at least ``least`` counts fell: at most ``buckets`` numbers."""
    rows = sketched.select(F.posexplode("fallen").alias("bucket", "n")).where(F.col("n") >= least).select("bucket").collect()
    return [r[0] for r in rows]


MOST_BUCKETS = 1 << 16


def buckets_for(share: float) -> int:
    """Buckets at which few of them can lose as many counts as a frequent value has: some for every value that can be frequent."""
    wanted, buckets = 4 / share, BUCKETS
    while buckets < min(wanted, MOST_BUCKETS):
        buckets *= 2
    return buckets


def frequent(df: DataFrame, value_col: str, share: float, buckets: int | None = None, slots: int = SLOTS, light: int = LIGHT) -> DataFrame:
    """(value, estimate, n) of every value that makes up at least ``share`` of all rows; n is exact.

    The number of buckets follows the share unless it is given.
    """
    buckets = buckets or buckets_for(share)
    total = df.count()
    least = max(1, int(np.ceil(share * total - 1e-9)))
    sketched = materialise(sketch(df, value_col, buckets, slots, light))
    kept = candidates(sketched, buckets, slots, light).where(F.col("estimate") >= least).select("value", "estimate")
    values = df.select(written(F.col(f"`{value_col}`")).alias("value")).where("value is not null")
    exact = values.join(F.broadcast(kept), "value").groupBy("value").agg(F.first("estimate").alias("estimate"), F.count(F.lit(1)).alias("n"))
    if full := _overfull(sketched, least):
        numbers = set(full)

        def inside(batches):
            own = ElasticSketch(buckets, 1, 1)
            for batch in batches:
                mask = [own.bucket_of(v) in numbers for v in batch.column(0).to_pylist()]
                yield batch.filter(pa.array(mask, pa.bool_()))

        missed = (
            values.mapInArrow(inside, "value string").join(F.broadcast(kept), "value", "left_anti")
            .groupBy("value").agg(F.count(F.lit(1)).alias("n")).select("value", F.col("n").alias("estimate"), "n")
        )
        exact = exact.unionByName(missed)
    return exact.where(F.col("n") >= least)
