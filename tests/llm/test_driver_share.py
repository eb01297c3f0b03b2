"""What the duplicates' joins bring to the driver, and components that grow from round to round."""

from __future__ import annotations

import random

import numpy as np

from tarn.llm import components, jaccard
from tarn.llm._cluster import durable, ready
from tarn.llm.components import connected_components


def test_node_filter_is_packed_where_it_is_made(spark, monkeypatch):
    ready(spark)
    nodes = [hash((7, k)) for k in range(3000)] + [-1, 0, 1]
    df = spark.createDataFrame([(n,) for n in nodes * 2], "node long")
    frame, fetched = type(df), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (lambda rows: fetched.append(len(rows)) or rows)(collect(self)))
    monkeypatch.setattr(frame, "toPandas", lambda self: 1 / 0)
    found = jaccard._node_filter(df, 20)
    bits = np.unpackbits(found.view(np.uint8), bitorder="little")
    assert set(np.flatnonzero(bits)) == {n & ((1 << 20) - 1) for n in nodes}
    assert 0 < sum(fetched) <= 4
    assert not jaccard._node_filter(df.limit(0), 18).any()


def test_components_merge_what_new_links_join(spark):
    rng, named, every = random.Random(5), None, []
    for size in (30, 25, 0, 40):
        new = [(rng.randrange(100), rng.randrange(100, 150) if rng.random() < 0.3 else rng.randrange(100)) for _ in range(size)]
        new = [(a, b) for a, b in new if a != b]
        every += new
        named = jaccard._merged(named, durable(spark.createDataFrame(new, "a long, b long")))
        want = {tuple(r) for r in connected_components(spark.createDataFrame(every, "a long, b long")).collect()}
        got = [tuple(r) for r in named.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_rounds_read_the_texts_once(spark, monkeypatch):
    ready(spark)
    base = [f"w{k}" for k in range(60)]
    # the far ones link with each other, but not with the hub; that is settled in a later round
    texts = [" ".join(base)] + [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(0, 60, 3)]
    texts += [" ".join([f"z{k}" for k in range(25)] + base[25:59] + [f"end{k}"]) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    node = {r.doc_id: r.node for r in jaccard.document_sets(docs, "doc_id", "text", 5).collect()}
    todo = durable(spark.createDataFrame([(True, node[0], node[k]) for k in range(1, len(texts))], "hub boolean, a long, b long"))
    scans, rounds = [], []
    wanted, verified = jaccard._wanted_sets, jaccard._verified
    monkeypatch.setattr(jaccard, "_wanted_sets", lambda *a: scans.append(1) or wanted(*a))
    monkeypatch.setattr(jaccard, "_verified", lambda *a: rounds.append(1) or verified(*a))
    named = {r.node: r.root for r in jaccard.settled(docs.select("text"), todo, len(texts), 75, 5).collect()}
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(named[node[k]], []).append(k)
    assert sorted(groups.values()) == [list(range(21)), list(range(21, 27))]
    assert len(rounds) > 1 and len(scans) == 1


def test_components_that_are_stars_need_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "durable", lambda df: written.append(1) or durable(df))
    rows = lambda edges: {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows([(1, 5), (6, 1), (2, 7), (7, 2), (3, 3)]) == {(1, 1), (5, 1), (6, 1), (2, 2), (7, 2)}
    assert rows([]) == set()
    assert len(written) == 2
    assert rows([(k, k + 1) for k in range(40)] + [(50, 60), (51, 60)]) == {(k, 0) for k in range(41)} | {(50, 50), (51, 50), (60, 50)}


def test_no_plan_of_the_rounds_is_large(spark, monkeypatch):
    ready(spark)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base)] + [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(0, 60, 3)]
    # more far ones than a token's pairs are listed for, so that they get hubs of their own
    texts += [" ".join([f"z{k}" for k in range(25)] + base[25:59] + [f"end{k}"]) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    node = {r.doc_id: r.node for r in jaccard.document_sets(docs, "doc_id", "text", 5).collect()}
    todo = durable(spark.createDataFrame([(True, node[0], node[k]) for k in range(1, len(texts))], "hub boolean, a long, b long"))
    exchanges, hubs = [], []

    def counted(df):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return durable(df)

    for module in (jaccard, components):
        monkeypatch.setattr(module, "durable", counted)
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda sets, pairs, percent: hubs.append(pairs.where("hub").count()) or verified(sets, pairs, percent))
    named = {r.node: r.root for r in jaccard.settled(docs.select("text"), todo, len(texts), 75, 5, small_group=2).collect()}
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(named[node[k]], []).append(k)
    assert sorted(groups.values()) == [list(range(21)), list(range(21, 33))]
    assert len(hubs) > 1 and hubs[1] > 0
    assert max(exchanges) <= 12, exchanges
