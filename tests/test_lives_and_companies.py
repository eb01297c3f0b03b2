"""Merges, splits, anonymisation, company detectors, chains of digests and the priority view."""

from __future__ import annotations

import hashlib
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tarn.operators import companies, graph, lifecycle, sequences

DAY = date(2020, 1, 1)


def test_merge_outcomes(spark):
    e = spark.createDataFrame([(1, "PERSON", "ACTIVE"), (2, "PERSON", "MERGED"), (3, "COMPANY", "ACTIVE"), (4, "PERSON", "ACTIVE")], "id long, type string, status string")
    r = spark.createDataFrame([(1, 1, 0.5), (1, 4, 1.2), (1, 4, None), (1, 9, 0.5), (1, 3, 0.5), (1, 2, 0.5), (1, 4, 0.5)], "canonical long, secondary long, confidence double")
    got = [(x.secondary, x.confidence, x.error) for x in lifecycle.merge_outcomes(r, e).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 0.5, "itself"), (4, 1.2, "confidence"), (4, None, "confidence"), (9, 0.5, "unknown"), (3, 0.5, "type"), (2, 0.5, "status"), (4, 0.5, None)]))


def test_updated_closure_equals_a_new_one(spark):
    rng = random.Random(3)
    rows = []
    for k in range(90):
        a = rng.randrange(70)
        start = DAY + timedelta(days=rng.randrange(200))
        rows.append((a, rng.choice([x for x in range(70) if x != a]), start, start + timedelta(days=rng.randrange(20, 150)) if k % 2 else None))
    facts = spark.createDataFrame(rows, "subject long, object long, valid_from date, valid_to date")
    before, now = "2020-04-01", "2020-06-10"
    changed = facts.where(f"(valid_from > '{before}' AND valid_from <= '{now}') OR (valid_to > '{before}' AND valid_to <= '{now}')")
    got = lifecycle.updated_closure(lifecycle.closure(facts, before), facts, changed, now)
    want = {tuple(r) for r in lifecycle.closure(facts, now).collect()}
    assert {tuple(r) for r in got.select("node", "component").collect()} == want
    assert {tuple(r) for r in lifecycle.closure(facts, before).collect()} != want


def test_split(spark):
    facts = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30), (4, "a", 40)], "id long, entity string, value int")
    asked = [(1, "a", "new", [1, 2]), (2, "a", " ", [4]), (3, "a", "new", [3]), (4, "b", "new", []), (5, "a", "late", [2, 4]), (6, "b", "new", None)]
    moved, out = lifecycle.split(facts, spark.createDataFrame(asked, "request long, entity string, name string, facts array<long>"))
    outcome = {r.request: (r.new_entity, r.error) for r in out.collect()}
    assert {k: e for k, (_, e) in outcome.items()} == {1: None, 2: "name", 3: "foreign", 4: "nothing", 5: None, 6: "nothing"}
    assert {r.id: (r.entity, r.value) for r in moved.collect()} == {1: (outcome[1][0], 10), 2: (outcome[1][0], 20), 3: ("b", 30), 4: (outcome[5][0], 40)}


def test_anonymise(spark):
    e = spark.createDataFrame([(1, "PERSON", "ACTIVE", "Ann", "x"), (2, "PERSON", "ACTIVE", "Bo", "y"), (3, "COMPANY", "ACTIVE", "AB", "z"), (4, "PERSON", "ANONYMIZED", "-", None), (5, "PERSON", "ACTIVE", "Eva", "v")], "id long, type string, status string, name string, street string")
    r = spark.createDataFrame([(1, False), (2, False), (2, None), (3, True), (4, True), (5, True), (9, True)], "id long, override boolean")
    holds = spark.createDataFrame([(2,), (5,), (5,)], "id long")
    done, out = lifecycle.anonymise(e, r, holds, ["street"])
    assert {x.id: x.error for x in out.collect()} == {1: None, 2: "hold", 3: "type", 4: "status", 5: None, 9: "unknown"}
    name = lambda k: "ANONYMIZED_PERSON_" + hashlib.sha256(f"anonymize:{k}".encode()).hexdigest()[:8].upper()
    assert {x.id: (x.status, x.name, x.street) for x in done.collect()} == {1: ("ANONYMIZED", name(1), None), 2: ("ACTIVE", "Bo", "y"), 3: ("ACTIVE", "AB", "z"), 4: ("ANONYMIZED", "-", None), 5: ("ANONYMIZED", name(5), None)}


def test_resolution_accuracy(spark):
    labelled = spark.createDataFrame([("a", "b", True), ("c", "d", True), ("e", "f", False), ("g", "h", False), ("i", "j", None)], "a string, b string, is_same boolean")
    facts = spark.createDataFrame([("b", "a", None), ("c", "d", 7), ("e", "f", None), ("e", "f", None)], "subject string, object string, superseded long")
    r = lifecycle.resolution_accuracy(labelled, facts).first()
    assert (r.total, r.tp, r.fp, r.fn, r.tn, r.specificity, r.sensitivity) == (5, 1, 1, 1, 1, 0.5, 0.5)
    assert lifecycle.resolution_accuracy(labelled.limit(0), facts).first().sensitivity is None


def test_company_detectors(spark):
    day = lambda text: date.fromisoformat(text)
    wide = spark.createDataFrame([(1, day("2020-01-01"), day("2020-01-16"), 1), (2, day("2020-01-01"), day("2020-02-01"), 1), (3, None, day("2020-01-01"), 2), (4, day("2010-01-01"), None, 1), (5, day("2020-01-05"), day("2020-01-04"), 1)], "id long, formed date, taxed date, directors int")
    events = companies.events_of(wide, "id", {"formed": "formed", "taxed": "f_skatt_registered"})
    assert events.count() == 8
    assert [tuple(r) for r in companies.rapid_formation(events).collect()] == [(1, 15, 0.5, "medium")]
    assert [(r.id, round(r.age, 2), r.severity) for r in companies.dormant(wide, F.col("directors"), F.col("formed"), "2020-12-31").collect()] == [(4, 11.01, "low")]
    flags = {"single_director": F.col("directors") == 1, "young": F.col("formed") > "2020-01-01", "taxed": F.col("taxed").isNotNull()}
    got = {r.id: (r.matched, r.severity) for r in companies.indicated(wide, flags, least=2).collect()}
    assert got == {1: ("single_director,taxed", "medium"), 2: ("single_director,taxed", "medium"), 5: ("single_director,young,taxed", "high")}
    factory = [(1, True, False, 0, "2020-06-01", "virtual"), (2, True, None, None, "2020-06-01", "virtual"), (3, True, True, 0, "2020-06-01", "virtual"), (4, True, False, 0, "2019-06-01", "virtual"), (5, True, False, 0, "2020-06-01", "office"), (6, None, False, 0, "2020-06-01", "virtual"), (7, True, False, 3, "2020-06-01", "virtual")]
    df = spark.createDataFrame([(a, b, c, d, day(e), f) for a, b, c, d, e, f in factory], "company long, f_skatt boolean, vat boolean, employees int, formed date, address_type string")
    assert {r.company for r in companies.invoice_factories(df, "2020-12-31").collect()} == {1, 2}
    states = [(1, "active", "2020-10-01", "dormant", "2018-09-01"), (2, "active", "2020-10-01", "dormant", "2018-11-01"), (3, "active", "2020-05-01", "dormant", "2015-01-01"), (4, "closed", "2020-10-01", "dormant", "2015-01-01"), (5, "active", "2020-10-01", "active", "2015-01-01")]
    df = spark.createDataFrame([(a, b, day(c), d, day(e)) for a, b, c, d, e in states], "company long, status string, status_from date, previous_status string, previous_from date")
    assert {r.company for r in companies.reactivated(df, "2020-12-31").collect()} == {1}


def test_rotation_and_alike_companies(spark):
    d = [(1, k, DAY if k < 3 else None) for k in range(5)] + [(2, k, DAY if k < 2 else None) for k in range(4)] + [(3, k, DAY if k < 3 else None) for k in range(6)] + [(4, k, DAY) for k in range(3)]
    got = {tuple(r) for r in companies.rotating(spark.createDataFrame(d, "company long, person long, to_date date")).collect()}
    assert got == {(1, 5, 3)}
    at = lambda n: DAY + timedelta(days=n)
    boards = [(1, 10, "x", "451", at(0)), (1, 11, "x", "462", at(90)), (2, 12, "y", "451", at(0)), (2, 13, None, "452", at(90)), (3, 14, "u", "451", at(0)), (3, 15, "v", "461", at(29)), (4, 16, "u", "451", at(0)), (4, 17, "v", "461", at(30)), (5, 18, "u", "1", at(0)), (5, 18, "u", "1", at(0)), (6, 19, None, None, None), (6, 20, None, "451", None)]
    got = {r.person: tuple(r)[1:] for r in companies.alike(spark.createDataFrame(boards, "person long, company long, address string, industry string, formed date")).collect()}
    assert got == {1: (True, False, False, True), 2: (False, True, False, True), 3: (False, False, True, True), 4: (False, False, False, False), 6: (False, False, False, False)}


def test_chain_of_digests(spark):
    entries, before = [], None
    for k in range(5):
        own = hashlib.sha256(f"c{k}|{before or ''}".encode()).hexdigest()
        entries.append([1, k, f"c{k}", own, before])
        before = own
    entries[2][2] = "changed"
    entries[4][4] = "x"
    df = spark.createDataFrame(entries, "chain long, n long, content string, own string, previous string")
    got = {(r.n, r.fault) for r in sequences.verify_chain(df, "chain", "n", F.col("content"), "own", "previous").collect()}
    assert got == {(2, "content"), (4, "link")}


def test_playbook_search_names_what_is_expected(spark):
    rows = [(1, "formed", DAY), (1, "f_skatt_registered", DAY + timedelta(days=5)), (2, "vat_registered", DAY)]
    df = spark.createDataFrame([(a, b, c) for a, b, c in rows], "entity long, type string, ts date").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r.entity, r.confidence, r.stage, r.expected) for r in sequences.find_playbook(df, "invoice_factory", least=0.6).collect()]
    assert got == [(1, 0.75, 3, "address_to_virtual")]


@pytest.mark.parametrize("mode", ["connected", "high_risk"])
def test_priority_view(spark, mode):
    rng = random.Random(5)
    for cap, n_edges in ((20, 60), (20, 5)):
        edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(n_edges)]
        scores = [(k, rng.randrange(40) / 2) for k in range(60)]
        degree = {k: sum((a == k) + (b == k) for a, b in edges) for k, _ in scores}
        rank = {k: 10 * degree[k] + 5 * s if mode == "connected" else 100 * s + degree[k] for k, s in scores}
        want = []
        for k, _ in sorted(scores, key=lambda x: (-rank[x[0]], x[0])):
            if len(want) >= cap:
                break
            if mode == "connected" and degree[k] == 0 and len(want) < cap * 0.8:
                continue
            want.append(k)
        got = graph.priority_view(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(scores, "node long, score double"), cap, mode)
        assert {r.node for r in got.collect()} == set(want)
