import pytest

from brindle.functions.stem import shape, stem, with_stems

GOLDEN = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "caress": "caress", "agreed": "agre", "feed": "feed", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "hoping": "hope", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "element": "elem", "replacement": "replac", "adoption": "adopt", "rate": "rate",
    "cease": "ceas", "controll": "control", "état": "état", "état-major": "état-major", "state-of": "state-of", "ab": "ab", "x2y": "x2y",
    "conflated": "conflat", "sized": "size", "triplicate": "triplic", "formative": "form", "goodness": "good", "revival": "reviv",
}


@pytest.mark.parametrize("word,expected", GOLDEN.items())
def test_golden(word, expected):
    assert stem(word) == expected


def test_shape():
    assert shape("toy") == "CVC"
    assert shape("syzygy") == "CVCVCV"
    assert shape("yes") == "CVC"
    assert shape("éa") == "CV"


def test_null_and_case():
    assert stem(None) is None
    assert stem("Running") == "run"


def test_frame(spark):
    df = spark.createDataFrame([(1, "cats"), (2, "cats"), (3, "ponies")], "id int, raw string")
    assert {(r.id, r.term) for r in with_stems(df).collect()} == {(1, "cat"), (2, "cat"), (3, "poni")}
