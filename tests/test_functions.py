"""Hand-computed results of the column functions."""

import json

import pytest
from credence.functions import parsing, text, vectors
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_normal_answer(spark):
    assert one(spark, "The  Beatles, a band!", text.normal_answer) == "beatles band"
    assert one(spark, "théâtre an été", text.normal_answer) == "théâtre été"
    assert one(spark, None, text.normal_answer) is None


def test_plain(spark):
    assert one(spark, "  U.S. Army-1 ", text.plain) == "u s  army 1"


def test_keys_and_kinds(spark):
    assert one(spark, "x", lambda c: text.key("chunk-", c)) == "chunk-x"
    assert one(spark, "proposition-a", text.kind_of) == "belief"
    assert one(spark, "chunk-a", text.kind_of) == "chunk"
    assert one(spark, "entity-a", text.kind_of) == "entity"
    assert one(spark, "entity-entity-a", text.content_of) == "entity-a"


@pytest.mark.parametrize(
    ("response", "answer"),
    [("Thought… Answer: 1862", "1862"), ("no marker", "no marker"), ("", text.NO_ANSWER), (None, text.NO_ANSWER), ("Answer: a Answer: b", "a Answer: b")],
)
def test_answer_of(spark, response, answer):
    assert one(spark, response, text.answer_of) == answer


def test_owner_and_truth(spark):
    assert one(spark, "", text.owner_of) == "GlobalContext"
    assert one(spark, None, text.owner_of) == "GlobalContext"
    assert one(spark, "A", text.owner_of) == "A"
    assert one(spark, "Yes", text.truth) is True
    assert one(spark, "0", text.truth) is False
    assert one(spark, "maybe", text.truth) is None


def test_triples(spark):
    rows = [["a", "r", "b"], ["a", "r", "b"], ["a", "r"]]
    assert one(spark, rows, text.valid_triples, "array<array<string>>") == [["a", "r", "b"]]
    known = spark.createDataFrame([([["A.", "r", "b"], ["c", "r", "b"]], ["a", "B"])], "t array<array<string>>, e array<string>")
    assert known.select(text.known_triples(F.col("t"), F.col("e"))).first()[0] == [["A.", "r", "b"]]


def test_template():
    assert text.template("{a} costs $5 {{x}}") == "${a} costs $$5 {x}"


def test_minmax_and_dot(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 5.0), (2, 5.0)], "g int, x double")
    got = [r[0] for r in rows.select(vectors.minmax(F.col("x"), "g"), "g", "x").orderBy("g", "x").collect()]
    assert got == [0.0, 0.5, 1.0, None, None]
    assert one(spark, [3.0, 4.0], vectors.unit, "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.unit, "array<double>") is None
    assert one(spark, float("nan"), vectors.reset_weight, "double") == 0
    assert one(spark, -1.0, vectors.reset_weight, "double") == 0


def test_combined(spark):
    paths = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [1.0, 0.0])], "v array<array<double>>, q array<double>")
    modes = {m: paths.select(vectors.combined(F.col("v"), m, F.col("q"))).first()[0] for m in ("average", "weighted_average", "max_pool", "attention")}
    assert modes["average"] == pytest.approx([0.5**0.5] * 2)
    assert modes["max_pool"] == pytest.approx([0.5**0.5] * 2)
    assert modes["weighted_average"][1] > modes["weighted_average"][0]
    assert modes["attention"][0] > modes["attention"][1]


@pytest.mark.parametrize(
    ("broken", "whole"),
    [
        ('{"a": 1', {"a": 1}),
        ('{"a": [1, 2', {"a": [1, 2]}),
        ('{"a": "x', {"a": "x"}),
        ('{"a": 1, "b"', {"a": 1}),
        ('{"a": 1, "b":', {"a": 1}),
        ('{"a": {"b": [true, nul', {"a": {"b": [True]}}),
        ('{"a": "line\nbreak"}', {"a": "line\nbreak"}),
        ('{"a": 1} and more', {"a": 1}),
    ],
)
def test_repair(broken, whole):
    assert json.loads(parsing.repaired(broken)) == whole


def test_repair_gives_up():
    assert parsing.repaired("nothing here") is None
    assert parsing.repaired(None) is None


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), st.data())
def test_repair_of_any_cut_is_json(value, data):
    whole = json.dumps({"k": value})
    cut = whole[: data.draw(st.integers(1, len(whole)))]
    assert isinstance(json.loads(parsing.repaired(cut)), dict)


def test_escapes_and_objects(spark):
    assert one(spark, "caf\\u00e9 \\ud83d\\ude00", parsing.decode_escapes) == "café 😀"
    assert one(spark, "\\ud83d", parsing.decode_escapes) == "\\ud83d"
    found = one(spark, 'Sure: {"named_entities": ["a", "b"]} done', lambda c: parsing.object_with(c, "named_entities"))
    assert json.loads(found) == {"named_entities": ["a", "b"]}
    assert one(spark, "none", lambda c: parsing.object_with(c, "named_entities")) is None
