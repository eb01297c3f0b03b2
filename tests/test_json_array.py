"""The splittable JSON reader against json.loads, in splits of some bytes."""

from __future__ import annotations

import json
import random

import pytest

from tarn.sources.json_array import json_array, json_array_texts

MARKS = ["{", "}", "[", "]", '"', "\\", "\n", "å", ": [", '"companies": [', "\\}", " ", "a"]


def element(rng, depth=0):
    text = "".join(rng.choice(MARKS) for _ in range(rng.randrange(12)))
    out = {"id": rng.randrange(1000), rng.choice(["name", "companies", "x}"]): text}
    if depth < 3 and rng.random() < 0.5:
        out["inner"] = [element(rng, depth + 1) for _ in range(rng.randrange(3))]
    if rng.random() < 0.2:
        out["companies"] = [{"id": -5}]
    return out


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_under_a_key(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent or 0)
    want = []
    for k in range(3):
        listed = [element(rng) for _ in range(rng.randrange(30, 60))]
        want += listed
        whole = {"meta": {"companies": [{"id": -1}], "t": 'companies": ['}, "before": [{"id": -2}], "companies": listed, "after": [{"id": -3}, {"companies": [{"id": -4}]}]}
        (tmp_path / f"{k}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=k % 2 == 0), encoding="utf-8")
    df = json_array_texts(spark, str(tmp_path), "companies")
    got = [json.loads(r.element) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 5


def test_elements_at_the_top(spark, tmp_path, small_splits):
    rng = random.Random(9)
    want = [element(rng) for _ in range(80)]
    (tmp_path / "a.json").write_text(json.dumps(want) + "\n")
    got = [json.loads(r.element) for r in json_array_texts(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    ids = [r.id for r in json_array(spark, str(tmp_path), "id long, missing string").collect()]
    assert sorted(ids) == sorted(x["id"] for x in want)


def test_odd_files(spark, tmp_path):
    for k, text in enumerate(["", "{}", '{"other": [{"id": 1}]}', '{"companies": []}', '{"companies": [], "x": [{"id": 2}]}', '{"companies": [{"id": 3}, {"id": 4', '{"companies": [1, "a}", {"id": 5}, null, {"id": 6}]}']):
        (tmp_path / f"{k}.json").write_text(text)
    assert sorted(r.id for r in json_array(spark, str(tmp_path), "id long", "companies").collect()) == [3, 5, 6]
