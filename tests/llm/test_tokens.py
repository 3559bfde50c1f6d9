import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import bpe, packing

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.tokenizer_dir()), reason="no vocabulary files")
TEXTS = [None, "", " ", "Hello world", "naïve café 👩‍💻", "<|endoftext|> it's", "x" * 20_000, "\n\n  \t a", "نمایه‌سازی", "1234567", "Hello world"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(bpe.tokenizer_dir(), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=80))
def test_any_text_as_the_library(library, text):
    e = bpe.encoder()
    ids = e.encode(text)
    assert ids == library(text)
    assert e.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text("abeilnorst ", max_size=60))
def test_hard_merges_as_the_library(library, text):
    assert bpe.encoder().encode(text) == library(text)


def test_other_vocabulary():
    tiktoken = pytest.importorskip("tiktoken")
    path = os.path.join(bpe.tokenizer_dir(), "byte_bpe_multi_50k.tiktoken")
    e = bpe.encoder("byte_bpe_multi_50k")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(0)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "б", " ", "ing", "é", "1", "!", "ن", "\n", "the"]) for _ in range(30))
        assert e.encode(text) == other.encode_ordinary(text)


def test_frames(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    encoded = bpe.encode(df)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: library(t) for i, t in enumerate(TEXTS)} and got[0] == got[1] == []
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(df.limit(0)).count() == 0
    with pytest.raises(FileNotFoundError):
        bpe.encoder("no_such_vocabulary")


# ---- packing


def plain_best_fit(sizes, capacity):
    """Bins of best-fit decreasing, item by item."""
    rooms = []
    for s in sorted((s for s in sizes if s), reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= s]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(20, 25))
def test_steps_are_best_fit_decreasing(sizes, capacity):
    histogram = {s: sizes.count(s) for s in set(sizes)}
    rooms, placed = {}, {s: 0 for s in histogram}
    for size, rank, n, first in packing.best_fit_steps(histogram, capacity):
        assert rank == placed[size]
        placed[size] += n
        if size:
            for k in range(n):
                rooms[first + k] = rooms.get(first + k, capacity) - size
    assert placed == {s: n for s, n in histogram.items()} and all(r >= 0 for r in rooms.values())
    assert sorted(rooms.values()) == plain_best_fit(sizes, capacity)
    assert sorted(rooms) == list(range(len(rooms)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 37), max_size=20), st.integers(0, 37))
def test_room_tree(rooms, size):
    tree = packing.RoomTree(37)
    for r in rooms:
        tree.set(r, True)
    assert tree.tightest(size) == min((r for r in rooms if r >= size), default=-1)


def test_pack(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0, 1, 7, 7, 7, rnd.randrange(1, 60), rnd.randrange(90, 350)])) for i in range(600)] + [(1000, None)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("size", F.lit("clash"))
    specs = spark.createDataFrame([(1, "small", 64), (2, "large", 200), (3, "none", None)], "spec_id bigint, name string, capacity bigint")
    got = packing.pack(sizes, specs, parts=5).collect()
    for spec, capacity in ((1, 64), (2, 200)):
        own = [r for r in got if r.spec_id == spec]
        fill, parts = {}, {}
        for r in own:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        for i, n in rows:
            n, pieces = n or 0, sorted(parts[i])
            assert len(pieces) == max(1, -(-n // capacity)) and [p[1] for p in pieces] == [k * capacity for k in range(len(pieces))] and sum(p[2] for p in pieces) == n
        flat = [p[2] for ps in parts.values() for p in ps]
        assert sorted(capacity - f for f in fill.values()) == plain_best_fit(flat, capacity)
    assert packing.pack(sizes.limit(0), specs).count() == 0 and packing.pack(sizes, specs.limit(0)).count() == 0
    zeros = packing.pack(sizes.where("n_tokens = 0"), specs.limit(1)).collect()
    assert {r.bin_id for r in zeros} == {0}
    with pytest.raises(ValueError):
        packing.pack(sizes, specs.withColumn("capacity", F.lit(0)))


def test_a_million_steps_of_one_size(spark):
    n = 1_000_000
    items = spark.range(n).select(F.lit(1).alias("spec"), F.lit(7).alias("size"), (F.col("id") % 4).alias("part"), F.floor(F.col("id") / 4).alias("place"), "id", F.lit(0).alias("piece"), F.lit(0).alias("first_token"))
    steps = spark.range(n).select(F.lit(1).alias("spec"), F.lit(7).alias("size"), (F.col("id") % 4).alias("part"), F.floor(F.col("id") / 4).alias("place"), F.struct(F.col("id").alias("bin")).alias("step"))
    placed = packing.assign(items, steps)
    assert placed.where("id = step.bin").count() == n
    # a step that begins before an item serves all up to the next
    some = packing.assign(items.where("id < 40"), steps.where("id in (0, 1, 2, 3, 20)"))
    assert {r.id: r.step.bin for r in some.collect()} == {i: 20 if i % 4 == 0 and i >= 20 else i % 4 for i in range(40)}
