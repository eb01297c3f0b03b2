"""Steps that grow with the tables: what is written once, dealt by size, or never listed, against plain algorithms."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarn import cluster
from tarn.operators import communities, graph, lifecycle, text


def edges_of(n, m, seed):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), 0 if rng.random() < 0.2 else rng.randrange(n)) for _ in range(m)) if a != b})


def test_propagation_reads_scores_once(spark):
    edges = edges_of(30, 90, 1)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    own = spark.createDataFrame([(k, k / 40) for k in range(32)], "node long, risk double").mapInPandas(counted, "node long, risk double")
    got = {r.node: r.risk for r in graph.propagate(spark.createDataFrame(edges, "src long, dst long"), own).collect()}
    near = {k: [b for a, b in edges if a == k] + [a for a, b in edges if b == k] for k in range(32)}
    want = {k: k / 40 for k in range(32)}
    for _ in range(10):
        want = {k: 0.15 * (k / 40) + 0.85 * sum(want[x] for x in near[k]) / len(near[k]) if near[k] else k / 40 for k in want}
    assert got == pytest.approx(want)
    assert read.value == 32


def test_clustering_beside_a_hub(spark):
    edges = edges_of(40, 200, 2)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {k: sum(q in near[p] for p, q in itertools.combinations(v, 2)) * 2 / (len(v) * (len(v) - 1)) if len(v) > 1 else 0.0 for k, v in near.items()}
    assert {r.node: r.coefficient for r in graph.clustering(spark.createDataFrame(edges, "src long, dst long")).collect()} == pytest.approx(want)


def test_labels_are_dealt_by_size(spark, monkeypatch):
    assert cluster.parts_for(spark, 10**9) == 2000
    monkeypatch.setattr(graph, "parts_for", lambda *a: 11)
    edges = edges_of(30, 90, 3)
    found = graph.communities(spark.createDataFrame(edges, "src long, dst long"))
    assert found.rdd.getNumPartitions() == 11
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {k: k for k in near}
    for _ in range(5):
        votes = {k: [want[x] for x in v] for k, v in near.items()}
        want = {k: min(v, key=lambda c: (-v.count(c), c)) for k, v in votes.items()}
    assert {r.node: r.community for r in found.collect()} == want


def test_linked_pairs_are_stored_once(spark):
    pairs, loops = communities.weighted(spark.createDataFrame([(1, 2), (2, 1), (2, 1), (3, 3), (4, None)], "src long, dst long"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 3)]
    assert [tuple(r) for r in loops.collect()] == [(3, 2)]


def test_accuracy_without_a_list_of_pairs(spark):
    rng = random.Random(4)
    scored = spark.createDataFrame([(m, c, rng.choice((0.5, 0.95, 1.0))) for m in range(60) for c in range(60) if m == c or rng.random() < 0.1], "mention long, candidate long, score double")
    labelled = scored.select(F.concat(F.lit("m"), "mention").alias("a"), F.concat(F.lit("e"), "candidate").alias("b"), F.expr("mention = candidate").alias("is_same"))
    best = scored.groupBy("mention").agg(F.min(F.struct((-F.col("score")).alias("s"), "candidate")).alias("b")).where("b.s <= -0.95")
    facts = best.select(F.concat(F.lit("e"), "b.candidate").alias("subject"), F.concat(F.lit("m"), "mention").alias("object"), F.expr("CASE WHEN mention % 10 = 0 THEN 1 END").alias("superseded"))
    want = lifecycle.resolution_accuracy(labelled, facts)
    found = lifecycle.blocking_accuracy(scored, F.expr("mention = candidate"), F.expr("mention % 10 = 0"), 0.95)
    assert found.dtypes == want.dtypes and found.collect() == want.collect()
    assert lifecycle.blocking_accuracy(scored.limit(0), F.expr("mention = candidate"), F.lit(False), 0.95).first()["total"] == 0


def test_spans_take_small_batches(spark):
    before = spark.conf.get(cluster.BATCH)
    try:
        spark.conf.set(cluster.BATCH, "10000")
        docs = spark.range(3).selectExpr("id AS doc_id", "'mail a@b.se' AS text")
        assert text.spans(docs).count() == 3 and spark.conf.get(cluster.BATCH) == "500"
    finally:
        spark.conf.set(cluster.BATCH, before)


def test_betweenness_by_tasks_and_by_joins(spark, monkeypatch):
    edges = spark.createDataFrame(edges_of(24, 60, 5), "src long, dst long")
    monkeypatch.setattr(graph, "SEARCH_PLACES", 200)
    tasks = {r.node: r.score for r in graph.betweenness(edges, 24).collect()}
    monkeypatch.setattr(graph, "SEARCHED_EDGES", 0)
    joins = {r.node: r.score for r in graph.betweenness(edges, 24, depth=30).collect()}
    assert tasks == pytest.approx(joins) and max(tasks.values()) > 0
