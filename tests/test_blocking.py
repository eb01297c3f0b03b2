"""Pairs of blocking are scored where they meet; many strings are compared at a time."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tarn.functions.similarity import _jaro_winkler, _jaro_winklers
from tarn.operators import features, joins, resolution

SIDE = "id long, name string, identifier string, year int, postal string, city string"


def sides(spark, n=60):
    rng = random.Random(9)
    word = lambda: rng.choice(["Anna", "Annika", "Berg", "Bergman", "Bo", "Cai", "AB"])
    row = lambda k: (k, f"{word()} {word()}", rng.choice([None, None, str(rng.randrange(9))]), rng.choice([None, 1, 2]), rng.choice([None, "111", "11234", "9"]), None)
    return [spark.createDataFrame([row(k) for k in range(n)], SIDE) for _ in range(2)]


def brute_pairs(m, c):
    keys = [{r.id: {(x.tier, x.key) for x in rows if x.id == r.id} for r in df.collect()} for df in (m, c) for rows in [resolution.block_keys(df).collect()]]
    out = set()
    for a, own in keys[0].items():
        hits = [(tier, b) for b, other in keys[1].items() for tier, _ in own & other]
        out |= {(a, b) for tier, b in hits if tier == min(hits)[0]}
    return out


def test_pairs_come_once_and_whole_where_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(resolution, "PART_PAIRS", 20)
    monkeypatch.setattr(resolution, "PART_ROWS", 3)
    m, c = sides(spark)
    got = [tuple(r) for r in resolution.candidate_pairs(m, c).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(m, c)
    scored = {tuple(r) for r in resolution.compare_candidates(m, c).collect()}
    assert scored == {tuple(r) for r in resolution.compare(spark.createDataFrame(got, "mention long, candidate long"), m, c).collect()}


def test_blocked_features_equal_those_of_listed_pairs(spark):
    rng = random.Random(4)
    m, c = sides(spark)
    links = [spark.createDataFrame([(rng.randrange(50), rng.choice([None, *range(12)])) for _ in range(200)], "id long, link long") for _ in range(2)]
    person = [df.select("id", "name", "identifier", F.col("year").alias("birth_year"), F.lit(None).cast("date").alias("birth_date"), F.lit("F").alias("gender")) for df in (m, c)]
    p = resolution.candidate_pairs(m, c)
    want = features.pair_features(p, *person, "PERSON", features.network_overlap(p, *links))
    got = features.blocked_features(m, c, *person, "PERSON", tuple(links))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_many_strings_at_a_time_equal_the_loop():
    rng = random.Random(3)
    for letters in ("ab", "abcde\0é😀", "abcdefgh #0123"):
        a = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
        b = [x if rng.random() < 0.05 else "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for x in a]
        assert _jaro_winklers(a, b).tolist() == [_jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]


def test_exact_screening_makes_no_fuzzy_pairs(spark):
    q = spark.createDataFrame([(1, "Mr. Anna Berg.", None, 1), (2, "Bo Ek", "x", 1), (3, None, None, 1), (4, "Bo Ekk", None, 1)], "id long, name string, identifier string, born int")
    w = spark.createDataFrame([(7, "anna berg", "c", None, 2), (8, "Bo Ek", "d", "x", 1), (9, "bo ek", "e", "y", 1), (10, None, None, None, 1)], "id long, name string, alias string, identifier string, born int")
    got = {tuple(r) for r in resolution.screen_exact(q, w).collect()}
    assert got == {(r.query, r.entry) for r in resolution.screen(q, w).where("match = 'exact'").collect()} == {(1, 7), (2, 9)}


def test_precedence_over_the_least_value_of_each_key(spark):
    right = spark.createDataFrame([(5, "a"), (3, "a"), (4, "b"), (None, "b"), (9, None)], "v long, k string")
    assert {tuple(r) for r in joins.least_of(right, "k", "v").collect()} == {("a", 3), ("b", 4)}


def test_dealt_join_is_the_join_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART_PAIRS", 10)
    monkeypatch.setattr(joins, "PART_ROWS", 2)
    a = spark.createDataFrame([(k, k % 3 if k % 7 else None) for k in range(60)] + [(1, 1)], "x long, k long")
    b = spark.createDataFrame([(k, k % 4) for k in range(40)] + [(5, 1), (6, None)], "y long, k long")
    got, want = (sorted(tuple(r) for r in df.select("x", "y", "k").collect()) for df in (joins.dealt_join(a, b, ["k"]), a.join(b, "k")))
    assert got == want


def test_names_with_similar_token_sets_all_meet(spark):
    rng = random.Random(8)
    names = [sorted({" ".join(rng.sample("a b c d e f g h i".split(), rng.randrange(1, 8))) for _ in range(70)}) + ["", None] for _ in range(2)]
    left, right = (spark.createDataFrame([(x,) for x in some], "name string") for some in names)
    for share in (0.25, 0.625, 1.0):
        got = {tuple(r) for r in resolution.similar_names(left, right, share).collect()}
        alike = lambda x, y: len(x & y) >= share * len(x | y)
        want = {(x, y) for x in names[0] if x for y in names[1] if y and alike(set(x.split()), set(y.split()))}
        assert got >= want
        assert share < 0.6 or len(got) < 0.5 * len(names[0]) * len(names[1])
