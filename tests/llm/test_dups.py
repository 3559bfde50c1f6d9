import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import collapse, dartminhash, heavyhitters
from brindle.llm.terms import TermSplitter


def similar(a, b):
    x, y = Counter(TermSplitter().split(a)), Counter(TermSplitter().split(b))
    m = (x & y).total()
    return m / max(1, (x | y).total())


def corpus(seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}x" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(12, 120))]
        texts.append(" ".join(base))
        for _ in range(3):
            changed = list(base)
            for _ in range(rnd.randint(0, len(base) // 4)):
                changed[rnd.randrange(len(changed))] = rnd.choice(words)
            rnd.shuffle(changed)
            texts.append(" ".join(changed))
    texts += ["same text of eleven words that all stand here once again", "SAME text; of eleven words that all stand here once again!"] * 20
    texts += [None, "", "few words only", "la " * 30, "la " * 40, "la " * 50]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, content string").withColumn("class", F.lit("clash")).repartition(5).cache()


def expected(threshold, min_terms=10):
    known = [(i, t) for i, t in corpus() if len(TermSplitter().split(t)) >= min_terms]
    return {(a, b) for k, (a, x) in enumerate(known) for b, y in known[k + 1 :] if similar(x, y) >= threshold}


@pytest.mark.parametrize("most", [1, 3, 500])
def test_pairs_against_brute_force(docs, monkeypatch, most):
    monkeypatch.setattr(dartminhash, "MOST_IN_TASK", most)
    got = [tuple(r) for r in dartminhash.record_pairs(docs, "doc_id", "content", 0.7).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    want = expected(0.7)
    assert not set(got) - want
    assert len(want - set(got)) <= 0.01 * len(want)


def test_classes(docs):
    got = {r.doc_id: r for r in dartminhash.classes_with_links(docs, "doc_id", "content", 0.7).collect()}
    texts = dict(corpus())
    assert set(got) == {i for i, t in texts.items() if len(TermSplitter().split(t)) >= 10}
    assert len({got[i].class_id for i, t in texts.items() if t and t.lower().startswith("same text")}) == 1
    assert dartminhash.classes_with_links(docs.limit(0), "doc_id", "content", 0.7).count() == 0


def meeting(signatures):
    keys = dartminhash.band_keys(signatures, 7, 52)
    return (keys[::2] == keys[1::2]).any(axis=1)


def test_pairs_that_meet_stay_candidates(spark):
    rows = []
    for i in range(3000):  # 35 of 50 terms in common: similarity 0.7
        shared = [f"s{i}x{j}" for j in range(35)]
        rows += [(2 * i, " ".join(shared + [f"a{i}x{j}" for j in range(7)])), (2 * i + 1, " ".join(shared + [f"b{i}x{j}" for j in range(8)]))]
    df = spark.createDataFrame(rows, "doc_id bigint, content string")
    regions = list(dartminhash.Regions().of_all([t for _, t in rows], 10))
    meet = {(2 * i, 2 * i + 1) for i in np.flatnonzero(meeting(dartminhash.DartMinHash(364).signatures(regions))).tolist()}
    signed = dartminhash.signed(df, "doc_id", "content").where("bands is not null").cache()
    got = {tuple(r) for r in dartminhash.candidate_pairs(signed, 0.7).collect()}
    assert len(meet) > 2900 and len(meet - got) <= 3  # 0.1 %
    assert meet <= {tuple(r) for r in dartminhash.candidate_pairs(signed, 0.7, slack=None).collect()}


def test_bits_around_a_band():
    # the numbers that the JVM cuts out of a sketch are those of the coordinates behind the band
    signatures = dartminhash.DartMinHash(364).signatures([dartminhash.Regions().of(" ".join(f"x{i}" for i in range(40)), 1)])
    bits = (dartminhash._mix(signatures[0]) & np.uint64(1)).tolist()
    words = [int(w) for w in dartminhash.sketches(signatures)[0]]
    whole = "".join(f"{w:064b}" for w in words)
    for band in range(52):
        first = (band + 1) * 7 % 364
        assert [int(c) for c in whole[first : first + 64]] == [bits[(first + j) % 364] for j in range(64)]


def test_bits_are_cut_in_the_jvm_as_in_python(spark):
    df = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(40)))], "doc_id bigint, content string")
    row = dartminhash.signed(df, "doc_id", "content").cache()
    whole = "".join(f"{w % 2**64:064b}" for w in row.first().sketch)
    got = {r.key: r.bits for r in dartminhash.band_rows(row).collect()}
    keys = row.first().bands
    assert {k: f"{got[k] % 2**64:064b}" for k in keys} == {k: whole[(b + 1) * 7 % 364 :][:64] for b, k in enumerate(keys)}


def test_a_full_band_is_dealt_out(spark):
    # 100,000 classes in one band and others of their own; every cell holds a bounded number of rows
    n = 100_000
    band = spark.range(n).select(F.lit(7).cast("bigint").alias("key"), F.col("id").alias("class"), F.lit(100).cast("smallint").alias("size"), F.xxhash64("id").alias("bits"))
    alone = band.withColumn("key", F.col("class") + 100)
    hot = dartminhash._hot_keys(band.unionByName(alone))
    assert [tuple(r) for r in hot.collect()] == [(7, n)]
    left, right = dartminhash._grid(band.join(hot, "key"))
    for side in (left, right):
        cells = side.groupBy("key", "i", "j").count()
        most, number = cells.agg(F.max("count"), F.count(F.lit(1))).first()
        assert most < 1.2 * dartminhash.BLOCK and number == 25 * 26 // 2
    assert hot.count() == 1 and dartminhash._hot_keys(alone) is None


def test_pairs_of_a_full_band(spark, monkeypatch):
    # the classes of one band: i and i + 1000 agree in all bits, others hardly
    monkeypatch.setattr(dartminhash, "HOT", 1500)
    monkeypatch.setattr(dartminhash, "BLOCK", 100)
    band = spark.range(2000).select(F.lit(7).cast("bigint").alias("key"), F.col("id").alias("class"), F.lit(100).cast("smallint").alias("size"), F.xxhash64(F.col("id") % 1000).alias("bits"))
    got = [tuple(r) for r in dartminhash.meeting_pairs(band, 0.9).collect()]
    assert len(got) == len(set(got)) and {(i, i + 1000) for i in range(1000)} <= set(got)
    assert dartminhash.meeting_pairs(band, 0.9, None).count() == 2000 * 1999 // 2


def test_hostile_rows(spark):
    text = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text.upper()), (3, text + " twelve"), (4, None)], "doc_id bigint, content string")
    df = df.withColumn("h1", F.lit("x")).withColumn("bands", F.lit("y"))
    assert sorted(tuple(r) for r in dartminhash.record_pairs(df, "doc_id", "content", 0.7).collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(tuple(r) for r in dartminhash.classes_with_links(df, "doc_id", "content", 0.7).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 1)]


def test_signature_estimates_similarity():
    h = dartminhash.DartMinHash(512)
    regions = dartminhash.Regions()
    rnd = random.Random(2)
    for _ in range(5):
        words = [f"t{rnd.randrange(60)}" for _ in range(100)]
        other = words[:60] + [f"u{rnd.randrange(60)}" for _ in range(40)]
        a, b = " ".join(words), " ".join(other)
        s = h.signatures([regions.of(a, 1), regions.of(b, 1)])
        assert abs((s[0] == s[1]).mean() - similar(a, b)) < 0.09
    # alone or with others, a record has the same signature
    both = h.signatures([regions.of("one two three", 1), regions.of(" ".join(f"x{i}" for i in range(3000)), 1)])
    assert (both[0] == h.signatures([regions.of("three one two", 1)])[0]).all() and (both != 0).all()
    assert regions.of("ab", 2) is None and np.unique(regions.of("la " * 9, 1)).size == 9


# ---- copies

ROWS = [
    (1, "title:Draft content:scan", 5), (2, "CONTENT: scan,  title:draft", 5), (3, "title:draft content:scan", 6), (4, "a b", None), (5, " A—b! ", None), (6, "b a", None),
    (7, None, None), (8, None, None), (9, "", 1), (10, "  ", 1), (11, "x subtitle:y", 1), (12, "subtitle:y x", 1), (13, "free title:a", 1), (14, "title:a free", 1), (15, "a b", None),
    (16, "title:x title:x content:y", 2), (17, "content:y title:x title:x", 2), (18, "content:y title:x", 2),
]


def test_copies(spark):
    df = spark.createDataFrame(ROWS, "event_id bigint, query string, n int").withColumn("h1", F.lit(0)).withColumn("copies", F.lit("x"))
    got = sorted(tuple(r) for r in collapse.copies(df, "event_id", "query", ("n",)).collect())
    assert got == [(1, 2), (4, 5), (4, 15), (9, 10), (16, 17)]
    groups = {r.keep_id: r.copies for r in collapse.collapse(df, "event_id", "query", ("n",)).collect()}
    assert sum(groups.values()) == len(ROWS) and groups[4] == 3 and groups[7] == groups[8] == 1
    assert collapse.copies(df.limit(0), "event_id", "query").count() == 0
    long = spark.createDataFrame([(1, "A " * 50_000), (2, "a " * 50_000)], "event_id bigint, query string")
    assert [tuple(r) for r in collapse.copies(long, "event_id", "query").collect()] == [(1, 2)]


def test_noncharacters_cut_nothing(spark):
    df = spark.createDataFrame([(1, "a\ufdd0b x:"), (2, "a b x:"), (3, "b x: a"), (4, "title:b\ufdd0a content:c"), (5, "content:c title:b\ufdd0a")], "event_id bigint, query string")
    assert [tuple(r) for r in collapse.copies(df, "event_id", "query").collect()] == [(4, 5)]


def test_buckets_follow_the_share():
    assert heavyhitters.buckets_for(1 / 200) == heavyhitters.BUCKETS and heavyhitters.buckets_for(1e-4) >= 4e4 and heavyhitters.buckets_for(1e-9) == heavyhitters.MOST_BUCKETS


def test_one_group_of_a_third(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), "id")).alias("q"))
    got = collapse.copies(df, "id", "q")
    assert got.count() == 999 and got.where("keep_id <> 0").count() == 0


# ---- frequent values


def frequent(df, share, **kw):
    return {r.value: (r.estimate, r.n) for r in heavyhitters.frequent(df, "q", share, **kw).collect()}


@pytest.mark.parametrize("size", [dict(), dict(buckets=2, slots=2, light=16), dict(buckets=1, slots=1, light=1)])
def test_frequent(spark, size):
    rnd = random.Random(3)
    values = ["Top "] * 300 + ["next"] * 120 + ["edge"] * 50 + [None] * 200 + [" "] * 30 + [f"r{rnd.randrange(5000)}" for _ in range(9300)]
    rnd.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "q string").repartition(7)
    got = frequent(df, 1 / 200, **size)
    truth = Counter(v.strip().lower() for v in values if v and v.strip())
    assert {v: n for v, (_, n) in got.items()} == {v: n for v, n in truth.items() if n * 200 >= len(values)}
    assert all(e >= n for e, n in got.values())


def test_frequent_edges(spark):
    df = spark.createDataFrame([("a",), ("A",), (None,)], "q string")
    assert frequent(df, 0.5) == {"a": (2, 2)}
    assert frequent(df.limit(0), 0.5) == {}
    assert frequent(spark.createDataFrame([(None,)], "q string"), 0.5) == {}


def test_sketch_never_underestimates():
    s = heavyhitters.ElasticSketch(4, 2, 8)
    rnd = random.Random(4)
    truth = Counter()
    for _ in range(3000):
        v = f"v{int(rnd.paretovariate(0.7))}"
        s.add(v)
        truth[v] += 1
    assert all(s.estimate(v) >= n for v, n in truth.items())
