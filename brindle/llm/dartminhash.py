"""Near-duplicate records with small edits (problem 3).

Similarity is the weighted Jaccard similarity of term counts: terms in common divided by terms in either, repeats
counted. A term that occurs c times is an element of weight c, seen as c unit regions. Every region throws
the same darts in every record: a Poisson process of hashed darts along the rank axis, each aimed at one of k
coordinates. A record of total weight W takes the darts of its regions up to rank t/W, about k ln k + 2k in all
whatever the record's size, and each coordinate keeps its earliest dart; where a coordinate stays empty the record takes
further darts. Two records keep the same dart at a coordinate with a probability equal to their similarity.

1. One pass over the texts gives each record its class, the 128-bit fingerprint of its term counts (exact copies are one class from the start),
   and the first record of a class in each task its bands (``rows`` coordinates each) and a sketch, one bit of every coordinate. This is written once.
   The smallest of a class's signed ids stands for it from then on; the other tasks' are set aside.
2. Bands that are far fuller than others are found before anything meets: rows are counted by a fixed number of slots of their keys, the keys of
   overfull slots by themselves. Rows of such bands are dealt out over a grid of cells of bounded size, and only
   cells meet. All other bands are shuffled by their key, once; those of more than ``MOST_IN_TASK`` rows go to the grid from there.
3. A pair that shares a band must agree in enough of 64 sketch bits that lie outside that band, in at least one band in which it meets, and
   then in enough of the whole sketch, where each coordinate counts once. ``slack`` says how far below the expectation a pair may fall;
   with ``slack=None`` every pair that shares a band is checked.
4. The records in a candidate pair are read again, and every pair is checked exactly on their regions.

With the defaults (7 rows, 52 bands) a pair at similarity 0.7 shares no band with a probability of 1.1 %, at 0.75 of 0.06 %. A pair at the
threshold that meets is lost by the 64 bits of one band with a probability of 0.08 %, and only if it is in every band it meets in; by the sketch, of 0.001 %.

Cases: null and empty texts, texts of fewer than ``min_terms`` terms and rows with a null id belong to no class; an empty table gives
no rows; equal texts are one class, repeated rows count once; different texts under one id are taken for one record, with the copies and links of each.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.arrow import map_batches, named
from brindle.llm.terms import TermSplitter, has_letter
from brindle.session import materialise

ROWS, BANDS = 7, 52
_U = np.uint64
_NONE = np.inf


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """64-bit hashes of terms, each made once; 0 for pieces without a letter, which are no terms."""

    def __missing__(self, piece: str) -> int:
        self[piece] = h = (xxhash.xxh64_intdigest(piece.encode(), 77) or 1) if has_letter(piece) else 0
        return h


class Regions:
    """The unit regions of records: region j of a term has the hash of the term moved on j times."""

    LIMIT = 1 << 19  # hashes remembered; beyond it the memory starts anew
    AT_ONCE = 1 << 18  # pieces taken together

    def __init__(self) -> None:
        self._pieces = TermSplitter().pieces
        self._hash = _Hashes()

    def of(self, text: str | None, min_terms: int) -> np.ndarray | None:
        """Sorted region hashes of a text, or None where it has fewer than ``min_terms`` terms."""
        return next(iter(self.of_all([text], min_terms)))

    def of_all(self, texts: list[str | None], min_terms: int):
        """``of`` of each text, many at a time."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(self._pieces(text))
            size += len(waiting[-1])
            if size >= self.AT_ONCE:
                yield from self._together(waiting, min_terms)
                waiting, size = [], 0
        yield from self._together(waiting, min_terms)

    def _together(self, records: list[list[str]], min_terms: int) -> list[np.ndarray | None]:
        if len(self._hash) > self.LIMIT:
            self._hash.clear()
        lengths = np.array([len(r) for r in records], dtype=np.int64)
        hashes = np.fromiter(map(self._hash.__getitem__, chain.from_iterable(records)), dtype=np.uint64, count=lengths.sum())
        owner = np.repeat(np.arange(len(records)), lengths)[hashes != 0]
        hashes = hashes[hashes != 0]
        ends = np.cumsum(np.bincount(owner, minlength=len(records)))
        places = [(e - n, e) for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]
        for start, end in places:
            hashes[start:end].sort()
        # how many equal ones of the same record stand before each
        opens = np.ones(len(hashes), dtype=bool)
        opens[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        at = np.arange(len(hashes))
        nth = at - np.maximum.accumulate(np.where(opens, at, 0))
        regions = _mix(hashes + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        for start, end in places:
            regions[start:end].sort()
        return [regions[start:end] if end - start >= max(1, min_terms) else None for start, end in places]


def class_of(regions: np.ndarray) -> bytes:
    """128-bit fingerprint of the term counts."""
    return xxhash.xxh128_digest(regions.tobytes(), 3)


class DartMinHash:
    """Signatures of k coordinates."""

    CHUNK = 16  # darts of a region are thrown so many at a time
    AT_ONCE = 1 << 18

    def __init__(self, k: int) -> None:
        self.k = k
        self.darts = k * np.log(k) + 2 * k

    def _throw(self, regions: np.ndarray, first: int, chunk: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Darts first .. first + chunk - 1 of each region: coordinates, darts, and the last ranks; gaps between ranks are exponential.

        A dart is its rank to 2^-20 above 22 bits of its name, as a whole number that a float holds exactly, so that the smaller dart is the earlier one.
        """
        n = np.arange(first, first + chunk, dtype=np.uint64)
        names = _mix(regions[:, None] + (n + _U(1))[None, :] * _U(0xD6E8FEB86659FD93))
        ranks = np.cumsum(-np.log(((names >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53), axis=1)
        ranks += begin[:, None]
        aims = names * _U(0x9FB21C651E98DF25)
        aims ^= aims >> _U(28)
        return ((aims >> _U(32)) * _U(self.k) >> _U(32)).astype(np.int64), self._dart(ranks) + (aims & _U(0x3FFFFF)), ranks[:, -1]

    @staticmethod
    def _dart(ranks: np.ndarray) -> np.ndarray:
        return np.floor(ranks * 2.0**20) * 2.0**22

    def signatures(self, records: list[np.ndarray]) -> np.ndarray:
        """One row of k earliest darts for each record's regions."""
        out = np.zeros((len(records), self.k), dtype=np.uint64)
        todo = np.arange(len(records))
        reach = np.array([self.darts / len(r) for r in records])
        while len(todo):
            order = todo[np.argsort(-reach[todo], kind="stable")]
            again = []
            at = 0
            while at < len(order):
                # records of similar reach together, as many darts at once as a processor's cache holds
                width = reach[order[at]] + self._chunk(reach[order[at]])
                size, stop = len(records[order[at]]) * width, at + 1
                while stop < len(order) and (size := size + len(records[order[stop]]) * width) < self.AT_ONCE:
                    stop += 1
                block = order[at:stop]
                full = self._earliest([records[i] for i in block], reach[block], out, block)
                again += block[~full].tolist()
                at = stop
            todo = np.array(again, dtype=np.int64)
            reach[todo] *= 1.5
        return out

    def _chunk(self, reach: float) -> int:
        """Darts to throw at a time: few where only few regions have a dart within reach, as in very long records."""
        return min(self.CHUNK, max(1, int(np.ceil(reach))))

    def _earliest(self, records: list[np.ndarray], reach: np.ndarray, out: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Fills the rows ``at`` of ``out``; tells which records have no empty coordinate."""
        lengths = np.array([len(r) for r in records])
        regions, back = np.unique(np.concatenate(records), return_inverse=True)
        owner = np.repeat(np.arange(len(records)) * self.k, lengths)
        limit = self._dart(np.repeat(reach, lengths))
        best = np.full(len(records) * self.k, _NONE)
        begin = np.zeros(len(regions))
        live, first, chunk = np.arange(len(owner)), 0, self._chunk(float(reach.max()))
        while len(live):
            aim, dart, begin = self._throw(regions, first, chunk, begin)
            row = back[live]
            darts = np.take(dart, row, axis=0)
            hit = darts <= limit[live, None]
            places = np.flatnonzero(hit)
            at_row = places // chunk
            cell = np.take(aim, row[at_row] * chunk + places % chunk)
            cell += owner[live[at_row]]
            np.minimum.at(best, cell, np.take(darts, places))
            live = live[hit[:, -1]]
            first += chunk
            if chunk < self.CHUNK:  # few regions are left: the others need no further darts
                left, place = np.unique(back[live], return_inverse=True)
                regions, begin, back = regions[left], begin[left], np.zeros(len(owner), dtype=np.int64)
                back[live] = place
        best = best.reshape(len(records), self.k)
        out[at] = np.where(best != _NONE, best, 0).astype(np.uint64)
        return (best != _NONE).all(axis=1)


@lru_cache(maxsize=4)
def _hasher(k: int) -> DartMinHash:
    return DartMinHash(k)


AROUND = 64  # sketch bits that are compared with a band's rows


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """The key of every band, a hash of its coordinates and number."""
    mixed = _mix(signatures)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        keys = _mix(keys * _U(0x9E3779B97F4A7C15) + mixed[:, r : bands * rows : rows])
    return keys


def sketches(signatures: np.ndarray) -> np.ndarray:
    """One bit of every coordinate in whole 64-bit numbers; the first coordinates follow again on the last, so that each has ``AROUND`` bits behind it."""
    n, k = signatures.shape
    bits = (_mix(signatures) & _U(1)).astype(np.uint8)
    words = np.zeros((n, _words(k) * 64), dtype=np.uint8)
    words[:, :k] = bits
    words[:, k : k + AROUND] = np.tile(bits, (1, -(-AROUND // k)))[:, :AROUND]
    return np.packbits(words, axis=1).view(">u8").astype(np.uint64)


def _words(k: int) -> int:
    return -(-(k + AROUND) // 64) + 1


def _records(df: DataFrame, id_col: str, text_col: str, min_terms: int, make, schema: str) -> DataFrame:
    """``make(ids, regions, seen)`` on the records of each batch that belong to a class; ``seen`` lasts for the task."""

    def run(batches):
        regions_of, seen = Regions(), set()
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), regions_of.of_all(batch.column(1).to_pylist(), min_terms), strict=True)
            kept = [(i, r) for i, r in pairs if r is not None]
            if kept:
                yield make([i for i, _ in kept], [r for _, r in kept], seen)

    return map_batches(named(df, id_col, text_col).where("id is not null"), run, schema)


_SIGNED = "id bigint, h1 bigint, h2 bigint, size smallint, bands array<bigint>, sketch array<bigint>"


def signed(df: DataFrame, id_col: str, text_col: str, min_terms: int = 10, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, h1, h2, size, bands, sketch) of each record; bands and sketch of the first of a class in its task only.

    h1 and h2 are the fingerprint, size the number of terms in sixteenths of a doubling.
    """
    k = rows * bands

    def lists(values: np.ndarray, at: np.ndarray, n: int) -> pa.ListArray:
        sizes = np.zeros(n + 1, dtype=np.int32)
        sizes[1:][at] = values.shape[1]
        absent = np.ones(n, dtype=bool)
        absent[at] = False
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(values.ravel().view(np.int64)), mask=pa.array(absent))

    def make(ids, regions, seen):
        names = [class_of(r) for r in regions]
        fresh = []
        for i, c in enumerate(names):
            if c not in seen:
                seen.add(c)
                fresh.append(i)
        signatures = np.concatenate([np.zeros((0, k), dtype=np.uint64)] + [_hasher(k).signatures([regions[i] for i in fresh[at : at + 2000]]) for at in range(0, len(fresh), 2000)])
        halves = np.frombuffer(b"".join(names), dtype=">i8").astype(np.int64).reshape(-1, 2)
        sizes = np.round(16 * np.log2([len(r) for r in regions])).astype(np.int16)
        at = np.array(fresh, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes), lists(band_keys(signatures, rows, bands), at, len(ids)), lists(sketches(signatures), at, len(ids))],
            ["id", "h1", "h2", "size", "bands", "sketch"],
        )

    return _records(df, id_col, text_col, min_terms, make, _SIGNED)


MOST_BROADCAST = 1 << 18  # rows of three numbers sent to every task, 6 MB; more are joined by a shuffle


def _few(df: DataFrame) -> DataFrame:
    """``df``, a written table of three numbers, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _representatives(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, class) of every class, and the signed rows of the records that stand for their class."""
    signers = records.where("bands is not null")
    classes = signers.groupBy("h1", "h2").agg(F.min("id").alias("class"))
    # of a class that several tasks met, one signature is kept
    others = materialise(signers.select("id", "h1", "h2").join(classes, ["h1", "h2"]).where("id <> class").select("id", "h1", "h2"))
    return classes, signers.join(_few(others), ["id", "h1", "h2"], "left_anti")


MOST_IN_TASK = 500  # rows of one band that are compared in one list
BLOCK = 4000  # rows of one side of a cell
SLOTS = 1 << 16  # counters of band rows
HOT = 20_000  # rows of a band that are not moved to one task in any case
# deviations below the expected number of equal bits at the threshold that a pair may stay: in the 64 bits of any band it meets in, in the sketches
SLACK = (3.6, 4.5)


def _least_equal(bits: int, threshold: float, slack: float) -> float:
    """Equal ones of a number of one-bit coordinates that a pair at the threshold has but for ``slack`` deviations."""
    p = (1 + threshold) / 2
    return bits * p - slack * (bits * p * (1 - p)) ** 0.5


def band_rows(representatives: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(key, class, size, bits): one row for each band of each class, with the ``AROUND`` sketch bits of the coordinates that follow the band."""
    k = rows * bands
    each = representatives.select(F.col("id").alias("class"), "size", "sketch", F.posexplode("bands").alias("band", "key"))
    first = (F.col("band") + 1) * rows % k
    word, by = F.floor(first / 64).cast("int"), (first % 64).cast("int")
    # a shift by 64 is none, so the second word is shifted by 1 and then by the rest
    bits = F.expr("shiftleft(sketch[word], by) | shiftrightunsigned(shiftrightunsigned(sketch[word + 1], 1), 63 - by)")
    return each.withColumn("word", word).withColumn("by", by).select("key", "class", "size", bits.alias("bits"))


def _hot_keys(banded: DataFrame) -> DataFrame | None:
    """(key, n) of the bands of more than ``HOT`` rows and of more than two slots' share of all rows; None if there are none.

    The counters are a fixed number, the keys at most half as many as slots, so both fit anywhere.
    """
    slots = max(SLOTS, 16 * int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slot = F.pmod("key", F.lit(slots))
    counts = materialise(banded.groupBy(slot.alias("slot")).count())
    share = F.greatest(F.lit(HOT), 2 * counts.agg(F.sum("count")).scalar() / F.lit(slots))
    full = [r[0] for r in counts.where(F.col("count") > share).select("slot").collect()]
    if not full:
        return None
    asked = banded.join(F.broadcast(banded.sparkSession.createDataFrame([(s,) for s in full], "slot bigint")), slot == F.col("slot"), "left_semi")
    return materialise(asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share))


def _grid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the cells (key, i, j), i <= j, in which the rows (key, n, ...) of full bands meet: each pair in one cell.

    A band's n rows are dealt to blocks of about ``BLOCK`` by their class; a cell holds one block a side.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int")).drop("n")
    left = dealt.select("*", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = dealt.select("*", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    return left.drop("block", "blocks"), right.drop("block", "blocks")


def meeting_pairs(banded: DataFrame, threshold: float, slack: float | None = SLACK[0]) -> DataFrame:
    """(a, b), a < b, with repeats: pairs of classes that share a band, have sizes that allow the threshold, and agree in enough bits around it."""
    apart = int(np.ceil(16 * np.log2(1 / threshold))) + 1  # both sizes are rounded
    least = 0.0 if slack is None else _least_equal(AROUND, threshold, slack)

    def near(size_a: Column, bits_a: Column, size_b: Column, bits_b: Column) -> Column:
        return (F.abs(size_a - size_b) <= apart) & (AROUND - F.bit_count(bits_a.bitwiseXOR(bits_b)) >= least)

    hot = _hot_keys(banded)
    usual = banded if hot is None else banded.join(F.broadcast(hot), "key", "left_anti")
    band = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = usual.repartition("key").select("*", F.count(F.lit(1)).over(band).alias("n")).where("n > 1")
    fits = F.col("n") <= MOST_IN_TASK
    others = shared.select("*", F.collect_list(F.when(fits, F.struct("class", "bits", "size"))).over(band).alias("others"))
    later = F.filter("others", lambda y: (F.col("class") < y["class"]) & near(F.col("size"), F.col("bits"), y["size"], y["bits"]))
    # a row of a full band has no others: it stays a row, with b null
    paired = others.select("key", "class", "size", "bits", "n", F.explode_outer(later).alias("y")).where(~fits | F.col("y").isNotNull())
    met = materialise(paired.select(F.when(~fits, F.col("key")).alias("key"), "class", F.when(~fits, F.col("size")).alias("size"), F.when(~fits, F.col("bits")).alias("bits"), F.when(~fits, F.col("n")).alias("n"), F.col("y.class").alias("b")))
    full = met.where("n is not null").select("key", "class", "size", "bits", "n")
    if hot is not None:
        full = full.unionByName(banded.join(F.broadcast(hot), "key").select("key", "class", "size", "bits", "n"))
    left, right = _grid(full)
    x, y = left.alias("x"), right.alias("y")
    ordered = (F.col("x.i") < F.col("x.j")) & (F.col("x.class") != F.col("y.class")) | (F.col("x.class") < F.col("y.class"))
    same_cell = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    many = x.join(y, same_cell & ordered & near(F.col("x.size"), F.col("x.bits"), F.col("y.size"), F.col("y.bits")))
    many = many.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))
    return met.where("b is not null").select(F.col("class").alias("a"), "b").unionByName(many)


def candidate_pairs(representatives: DataFrame, threshold: float, rows: int = ROWS, bands: int = BANDS, slack: tuple[float, float] | None = SLACK) -> DataFrame:
    """(a, b), a < b: pairs of classes that meet in a band and whose sketches agree in enough of all coordinates, each pair once."""
    k = rows * bands
    pairs = meeting_pairs(band_rows(representatives, rows, bands), threshold, slack and slack[0]).distinct()
    if slack is None:
        return pairs
    whole, rest = divmod(k, 64)
    bits = representatives.select(F.col("id").alias("class"), "sketch")
    pairs = pairs.join(bits.select(F.col("class").alias("a"), F.col("sketch").alias("x")), "a").join(bits.select(F.col("class").alias("b"), F.col("sketch").alias("y")), "b")
    differ = [F.bit_count(F.col("x")[w].bitwiseXOR(F.col("y")[w])) for w in range(whole)]
    if rest:
        differ.append(F.bit_count(F.shiftrightunsigned(F.col("x")[whole].bitwiseXOR(F.col("y")[whole]), 64 - rest)))
    return pairs.where(k - sum(differ, F.lit(0)) >= _least_equal(k, threshold, slack[1])).select("a", "b")


BITS_EACH, MOST_BITS = 16, 1 << 27  # of the bit map that sorts out records before they are read again; 16 MB at most


def _asked_for(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, ...) but for most of those whose id is not among ``ids``, by a bit map whose size follows their number.

    Above its largest size it lets more rows pass, up to all; the join that follows decides.
    """
    size = 1 << 15
    wanted = BITS_EACH * ids.count()
    while size < min(wanted, MOST_BITS):
        size *= 2
    spot = F.pmod(F.xxhash64("id"), F.lit(size))
    spots = ids.select(spot.alias("spot"))
    maps = spots.groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("map"))
    asked = rows.withColumn("spot", spot).withColumn("bucket", F.bitmap_bucket_number("spot")).withColumn("bit", F.bitmap_bit_position("spot"))
    byte = F.conv(F.hex(F.substring("map", F.expr("cast(bit div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    met = asked.join(F.broadcast(maps), "bucket").withColumn("byte", byte)
    return met.where("(shiftright(byte, cast(bit % 8 as int)) & 1) = 1").select(*rows.columns)


def members_and_links(
    df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_terms: int = 10, rows: int = ROWS, bands: int = BANDS, slack: tuple[float, float] | None = SLACK,
) -> tuple[DataFrame, DataFrame]:
    """(id, class) of every record with enough terms, and (a, b, similarity) of every found pair of classes at or above the threshold.

    A class is named by the id of one of its records.
    """
    records = materialise(signed(df, id_col, text_col, min_terms, rows, bands))
    classes, representatives = _representatives(records)
    members = materialise(records.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "class").distinct())
    pairs = materialise(candidate_pairs(representatives, threshold, rows, bands, slack))
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def make(ids, regions, seen):
        ends = np.concatenate([[0], np.cumsum([len(r) for r in regions])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(regions).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["id", "regions"])

    again = _asked_for(df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")), ids)
    regions = _records(again, "id", "text", min_terms, make, "id bigint, regions array<bigint>")
    left = regions.select(F.col("id").alias("a"), F.col("regions").alias("regions_a"))
    right = regions.select(F.col("id").alias("b"), F.col("regions").alias("regions_b"))
    # lengths alone rule a pair out where the shorter is below the threshold of the longer
    sizes = F.least(F.size("regions_a"), F.size("regions_b")) >= F.lit(threshold) * F.greatest(F.size("regions_a"), F.size("regions_b"))
    both = pairs.join(left, "a").join(right, "b").where(sizes)
    common = F.size(F.array_intersect("regions_a", "regions_b"))
    both = both.select("a", "b", common.alias("common"), (F.size("regions_a") + F.size("regions_b")).alias("total"))
    links = both.withColumn("similarity", F.col("common") / (F.col("total") - F.col("common"))).where(F.col("similarity") >= threshold)
    return members, links.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def record_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_terms: int = 10, slack: tuple[float, float] | None = SLACK) -> DataFrame:
    """(id_a, id_b), smaller first: every pair of records at or above the threshold, copies written out as pairs."""
    members, links = members_and_links(df, id_col, text_col, threshold, min_terms, slack=slack)
    x = members.select(F.col("id").alias("x"), F.col("class").alias("a"))
    y = members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    shared = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
    copied = members.join(shared, "class", "left_semi")
    inside = (
        copied.select(F.col("id").alias("id_a"), "class").join(copied.select(F.col("id").alias("id_b"), "class"), "class")
        .where("id_a < id_b").select("id_a", "id_b")
    )
    return across.unionByName(inside)


def classes_with_links(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_terms: int = 10, slack: tuple[float, float] | None = SLACK) -> DataFrame:
    """(id_col, class_id, n_links) of every record with enough terms: class_id is the smallest id of its exact copies, n_links the number of similar classes."""
    members, links = members_and_links(df, id_col, text_col, threshold, min_terms, slack=slack)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    first = members.groupBy("class").agg(F.min("id").alias("class_id")).join(degree, "class", "left")
    return members.join(first, "class").select(F.col("id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
