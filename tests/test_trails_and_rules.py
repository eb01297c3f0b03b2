"""Money trails, communities, order statistics, clusters and case rules against brute force and exact values."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarn.operators import aggregates, casework, communities, features, graph, sequences, trails

START = datetime(2024, 1, 1, tzinfo=UTC)
PAYMENTS = "id long, src long, dst long, ts timestamp, amount decimal(18,2)"


def random_payments(seed, n=160, nodes=14, hours=900):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(nodes), rng.randrange(nodes), START + timedelta(hours=rng.randrange(hours)), Decimal(rng.choice([20_000, 50_000, 60_000, 210_000, 900_000]))) for k in range(n)]
    return rows + [(n, None, 1, START, Decimal(60_000)), (n + 1, 1, None, START, Decimal(60_000)), (n + 2, 1, 2, None, Decimal(60_000)), (n + 3, 1, 2, START, None)]


def brute_layering(rows, hops=3, longest=10, hours=72, least=50_000):
    out = defaultdict(list)
    for r in rows:
        if r[1] is not None and r[2] is not None and r[1] != r[2] and r[3] is not None:
            out[r[1]].append(r)
    found = set()

    def walk(path, seen):
        more = [r for r in out[path[-1][2]] if r[2] not in seen and r[3] >= path[-1][3]] if len(path) < longest else []
        for r in more:
            walk([*path, r], seen | {r[2]})
        if not more and len(path) >= hops and path[-1][3] - path[0][3] <= timedelta(hours=hours) and all(r[4] is not None and r[4] >= least for r in path):
            found.add(tuple(r[0] for r in path))

    for node in list(out):
        for r in out[node]:
            if r[3] is not None:
                walk([r], {r[1], r[2]})
    return found


@pytest.mark.parametrize("seed", [1])
def test_layering_against_brute_force(spark, seed):
    rows = random_payments(seed, n=60, nodes=25, hours=400)
    rows += [(1000 + 10 * c + k, 5000 + 20 * c + k, 5001 + 20 * c + k, START + timedelta(hours=30 * c + k), Decimal(60_000)) for c in range(4) for k in range(2 + 3 * c)]
    got = {tuple(r.transactions) for r in trails.layering(spark.createDataFrame(rows, PAYMENTS)).collect()}
    assert got == brute_layering(rows)
    assert {len(x) for x in got} >= {5, 8}


def test_layering_grades_and_windows(spark):
    chain = [(k, k, k + 1, START + timedelta(hours=2 * k), Decimal(60_000)) for k in range(4)]
    late = (9, 4, 77, START + timedelta(days=200), Decimal(5))
    r = trails.layering(spark.createDataFrame(chain, PAYMENTS)).orderBy(F.desc("hops")).first()
    assert (r.path, r.hops, r.hours, r.severity, round(r.confidence, 6), r.amount) == ([0, 1, 2, 3, 4], 4, 6.0, "medium", 0.9, Decimal(60_000))
    both = spark.createDataFrame([*chain, late], PAYMENTS)
    assert trails.layering(both).count() == 0  # goes on, however late
    assert {tuple(x.transactions) for x in trails.layering(both, windowed=True).collect()} == {(0, 1, 2, 3), (1, 2, 3)}
    assert trails.layering(both.limit(0)).count() == 0


def test_layering_in_a_window_of_payments_that_share_ids(spark):
    short = [(k, k, k + 1, START + timedelta(hours=k), Decimal(60_000)) for k in range(3)]
    longer = [(k, 50 + k, 51 + k, START + timedelta(hours=k), Decimal(60_000)) for k in range(4)]
    got = Counter(tuple(x.path) for x in trails.layering(spark.createDataFrame([*short, *longer], PAYMENTS), windowed=True).collect())
    assert got == {(0, 1, 2, 3): 1, (50, 51, 52, 53, 54): 1, (51, 52, 53, 54): 1}


def brute_round_trips(rows, longest=8, least=50_000, days=30, loss=Decimal("0.15")):
    out = defaultdict(list)
    kept = sorted((r for r in rows if r[1] is not None and r[2] is not None and r[1] != r[2] and r[3] is not None), key=lambda r: (r[3], r[0]))
    for r in kept:
        out[r[1]].append(r)
    seen, found = set(), set()
    for start in list(out):  # in the order of their first payments

        def walk(path, members):
            if len(path) >= longest:
                return
            for r in out.get(path[-1][2] if path else start, ()):
                if r[2] == start and path:
                    trip = [*path, r]
                    key = frozenset(x[0] for x in trip)
                    if key not in seen:
                        seen.add(key)
                        a, b = trip[0][4], trip[-1][4]
                        if a is not None and b is not None and a >= least and (a - b) / a <= loss and (trip[-1][3] - trip[0][3]).days <= days:
                            found.add(tuple(x[0] for x in trip))
                elif r[2] not in members:
                    walk([*path, r], members | {r[2]})

        walk([], {start})
    return found


@pytest.mark.parametrize("seed", [4])
def test_round_trips_against_brute_force(spark, seed):
    rows = random_payments(seed, n=44, nodes=14, hours=2500)
    got = [tuple(r.transactions) for r in trails.round_trips(spark.createDataFrame(rows, PAYMENTS)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_round_trips(rows)
    assert {len(x) for x in got} & {5, 6, 7, 8}


def test_round_trip_grades(spark):
    rows = [(1, 1, 2, START, Decimal(200_000)), (2, 2, 3, START + timedelta(days=1), Decimal(1)), (3, 3, 1, START + timedelta(days=30, hours=23), Decimal(170_000))]
    r = trails.round_trips(spark.createDataFrame(rows, PAYMENTS)).first()
    assert (r.path, r.hops, r.days, round(r.loss, 6), r.severity, r.confidence) == ([1, 2, 3, 1], 3, 30, 0.15, "medium", 0.8)
    rows[2] = (3, 3, 1, START + timedelta(days=31), Decimal(170_000))
    assert trails.round_trips(spark.createDataFrame(rows, PAYMENTS)).count() == 0


# communities


def plain_louvain(edges):
    """Sequential Louvain over weights; the modularity that it reaches."""
    w = defaultdict(Counter)
    for a, b in edges:
        w[a][b] += 1
        w[b][a] += 1
    total = sum(sum(x.values()) for x in w.values())
    while True:
        k = {v: sum(x.values()) for v, x in w.items()}
        com, tot, moved = {v: v for v in w}, dict(k), False
        for _ in range(30):
            again = False
            for v in sorted(w):
                near = Counter()
                for u, n in w[v].items():
                    if u != v:
                        near[com[u]] += n
                tot[com[v]] -= k[v]
                best = max(sorted({*near, com[v]}), key=lambda c: near[c] - k[v] * tot[c] / total)
                if near[best] - k[v] * tot[best] / total <= near[com[v]] - k[v] * tot[com[v]] / total:
                    best = com[v]
                tot[best] += k[v]
                again |= best != com[v]
                com[v] = best
            moved |= again
            if not again:
                break
        if not moved:
            return sum(w[v][v] / total - (k[v] / total) ** 2 for v in w)
        merged = defaultdict(Counter)
        for a, x in w.items():
            for b, n in x.items():
                merged[com[a]][com[b]] += n
        w = merged


def planted(seed, groups=12, size=14, inside=0.4, outside=0.02):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b) for a in range(n) for b in range(a) if rng.random() < (inside if a // size == b // size else outside)]


@pytest.mark.parametrize("edges", [planted(1), planted(2, inside=0.25, outside=0.03)])
def test_louvain_reaches_the_plain_one(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    labels = communities.louvain(df).collect()
    q = communities.modularity(df, spark.createDataFrame(labels, "node long, community long"))
    assert q >= 0.95 * plain_louvain(edges)
    assert all(r.community == min(x.node for x in labels if x.community == r.community) for r in labels)


def test_louvain_odd_edges(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (2, 3), (3, 2), (4, None), (None, 5)], "src long, dst long")
    for _ in range(2):
        assert sorted(map(tuple, communities.louvain(df).collect())) == [(1, 1), (2, 2), (3, 2)]
    assert communities.louvain(df.limit(0)).count() == 0


# statistics, windows, clusters


def python_nodes(df):
    plan = df._jdf.queryExecution().toString()
    return [x for x in ("ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "BatchEvalPython") if x in plan]


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "j"]])
def test_order_statistics(spark, keys):
    rng = random.Random(6)
    rows = [("hot" if n % 3 == 0 else rng.choice(["a", "b", None]), rng.randrange(2), float(rng.randrange(5000)) if rng.random() < 0.98 else None) for n in range(6000)] + [("few", 0, 1.0)] * 9
    got = aggregates.distribution(spark.createDataFrame(rows, "k string, j int, v double"), "v", keys)
    groups = defaultdict(list)
    for k, j, v in rows:
        if v is not None:
            groups[tuple({"k": k, "j": j}[x] for x in keys)].append(v)
    want = {}
    for g, vs in groups.items():
        vs.sort()
        n = len(vs)
        known = n >= 10
        mid = (vs[(n - 1) // 2] + vs[n // 2]) / 2
        want[g] = (n, *[(x if known else None) for x in (mid, *[vs[min(n * p // 100, n - 1)] for p in (75, 90, 95, 99)], vs[-1])])
    assert {tuple(r[k] for k in keys): (r.n, r.median, r.p75, r.p90, r.p95, r.p99, r["max"]) for r in got.collect()} == want


def random_events(seed, n=700):
    rng = random.Random(seed)
    return [(k, 0 if k % 3 == 0 else rng.randrange(1, 9), rng.choice(["a", "b", "c", None]), START + timedelta(minutes=30 * rng.randrange(1500))) for k in range(n)]


EVENTS = "id long, entity long, type string, ts timestamp"


@pytest.mark.parametrize("least", [2, 4])
def test_greedy_clusters_equal_the_loop(spark, least):
    rows = random_events(least)
    df = sequences.greedy_clusters(spark.createDataFrame(rows, EVENTS), least=least)
    want = set()
    for entity in {r[1] for r in rows}:
        own = sorted((r[3], r[0]) for r in rows if r[1] == entity)
        i = 0
        while i < len(own):
            n = sum(t - own[i][0] <= timedelta(days=1) for t, _ in own[i:])
            if n >= least:
                want.add((entity, own[i][1], n))
            i += n if n >= least else 1
    assert {(r.entity, r.first_id, r.n) for r in df.collect()} == want
    assert not python_nodes(df)


@pytest.mark.parametrize("seed", [8, 9])
def test_greedy_dedupe_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        a = rng.randrange(300)
        rows.append((k % 5, k, a, a + rng.randrange(20), rng.randrange(12) / 10, sorted({a // 3 + rng.randrange(6) for _ in range(rng.randrange(6))})))
    df = sequences.greedy_dedupe(spark.createDataFrame(rows, "entity long, id long, start long, end long, confidence double, events array<long>"))
    want = set()
    for entity in range(5):
        kept = []
        for r in sorted((r for r in rows if r[0] == entity), key=lambda r: (-r[4], r[1])):
            if not any(r[2] <= x[3] and x[2] <= r[3] and r[5] and set(r[5]) & set(x[5]) and 2 * len(set(r[5]) & set(x[5])) >= len(r[5]) for x in kept):
                kept.append(r)
        want |= {(entity, r[1]) for r in kept}
    assert {(r.entity, r.id) for r in df.collect()} == want
    assert not python_nodes(df)


@pytest.mark.parametrize("ahead", [False, True])
def test_distinct_counts_over_windows(spark, ahead):
    rows = random_events(10) + [(10_000 + k, 3, "a", START) for k in range(4)]
    got = sequences.with_distinct(spark.createDataFrame(rows, EVENTS), "entity", "type", "ts", 86_400, "n", ahead).collect()
    assert len(got) == len(rows)
    by = {r[0]: r for r in rows}
    for r in got:
        _, entity, _, ts = by[r.id]
        low, high = (ts, ts + timedelta(days=1)) if ahead else (ts - timedelta(days=1), ts)
        assert r.n == len({x[2] for x in rows if x[1] == entity and x[2] and low <= x[3] <= high})


def test_spans_do_not_overlap(spark):
    events = spark.createDataFrame(random_events(11), EVENTS)
    got = sequences.bursts(events, collapse=True).orderBy("entity", "start").collect()
    assert got
    assert all(a.entity != b.entity or a.end < b.start for a, b in zip(got, got[1:], strict=False))
    anchors = sequences.bursts(events)
    assert sum(r.anchors for r in got) == anchors.count()


# resolution


def test_typed_scores_and_their_denominators(spark):
    person = "id long, name string, identifier string, birth_year int, birth_date date, gender string"
    m = spark.createDataFrame([(1, "Anna Berg", None, 1970, None, "F"), (2, "Bo Ek", "x", None, None, None)], person)
    e = spark.createDataFrame([(7, "Anna Berg", "y", 1970, None, "M"), (8, "", "x", None, None, None)], person)
    pairs = spark.createDataFrame([(1, 7), (2, 8)], "mention long, candidate long")
    overlap = spark.createDataFrame([(1, 7, 0.5)], "mention long, candidate long, overlap double")
    f = features.pair_features(pairs, m, e, "PERSON", overlap)
    own = {r.mention: r.score for r in features.typed_score(f, "PERSON").collect()}
    compat = {r.mention: r.score for r in features.typed_score(f, "PERSON", compat=True).collect()}
    total = 2.0 + 1.5 + 1.0 + 1.5 + 0.5 * (2.5 + 2.0)
    assert own[1] == pytest.approx(total / (2.0 + 1.5 + 1.0 + 1.5 + 0.5 + 2.5 + 2.0))
    assert compat[1] == pytest.approx(total / 27.8)
    assert own[2] == compat[2] == 0.99
    for kind, sum_of_all in (("PERSON", 27.8), ("COMPANY", 30.8), ("ADDRESS", 33.0)):
        assert sum({**features.COMMON_WEIGHTS, **features.TYPE_WEIGHTS[kind]}.values()) == pytest.approx(sum_of_all)


def test_best_scores_without_an_identifier_stay_below_review(spark):
    person = "id long, name string, identifier string, birth_year int, birth_date date, gender string"
    df = spark.createDataFrame([(1, "Anna Berg", None, 1970, datetime(1970, 2, 3).date(), "F")], person)
    pairs = spark.createDataFrame([(1, 1)], "mention long, candidate long")
    f = features.pair_features(pairs, df, df, "PERSON", pairs.withColumn("overlap", F.lit(1.0)))
    assert features.typed_score(f, "PERSON", compat=True).first().score == pytest.approx(14.0 / 27.8)
    place = spark.createDataFrame([(1, "Storgatan 1", "11122", "Lund")], "id long, name string, postal string, city string")
    f = features.pair_features(pairs, place, place, "ADDRESS")
    assert f.first().address_similarity == pytest.approx(1.0)
    assert features.typed_score(f, "ADDRESS", compat=True).first().score == pytest.approx(9.0 / 33.0)
    firm = place.withColumn("identifier", F.lit(None).cast("string")).withColumn("city", F.lit("LUND"))
    f = features.pair_features(pairs, place.withColumn("identifier", F.lit("5")), firm, "COMPANY", pairs.withColumn("overlap", F.lit(1.0)))
    assert features.typed_score(f, "COMPANY", compat=True).first().score == pytest.approx(12.3 / 30.8)


def test_linked_candidates_lose_none(spark):
    rng = random.Random(12)
    sets = {k: {rng.randrange(8) if rng.random() < 0.3 else 100 + k // 3 * 5 + rng.randrange(5) for _ in range(rng.randrange(1, 9))} for k in range(120)}
    rows = [(k, x) for k, s in sets.items() for x in s] + [(500, None), (None, 3)]
    df = spark.createDataFrame(rows, "id long, link long")
    for least in (0.34, 0.5, 1.0):
        got = {(r.mention, r.candidate): r.overlap for r in features.linked_candidates(df, df, least).collect()}
        want = {(a, b): len(s & t) / len(s | t) for a, s in sets.items() for b, t in sets.items() if len(s & t) / len(s | t) >= least}
        assert got == pytest.approx(want)


# case rules


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[x.alias(k) for k, x in columns.items()]).collect()]


def test_alert_bands(spark):
    rows = [(0.85, 1), (0.1, 10), (0.7, 1), (0.1, 5), (0.5, 1), (0.49, 4), (None, None)]
    got = values(spark, rows, "s double, n int", a=casework.alert_severity("shell_network", F.col("s"), F.col("n")), b=casework.alert_severity("registration_mill", F.col("s"), F.col("n") * 2), c=casework.alert_severity("formation", F.col("s")))
    assert got == [("critical", "critical", "high"), ("critical", "critical", None), ("high", "high", "medium"), ("high", "high", None), ("medium", "medium", "low"), ("low", "medium", None), ("low", "medium", None)]


def test_report_priority_and_kind(spark):
    rows = [(["critical"], 1), ([], 5_000_000), (["high", "low"], 1), ([], 1_000_000), (["medium"], 1), ([], 500_000), (["low"], 499_999), (None, None)]
    got = values(spark, rows, "k array<string>, t long", p=casework.report_priority(F.col("k"), F.col("t")))
    assert [x for (x,) in got] == ["urgent", "urgent", "high", "high", "medium", "medium", "low", "low"]
    kinds = values(spark, [(["terrorist_financing", "x"],), (["layering"],), (None,)], "p array<string>", k=casework.report_type(F.col("p")))
    assert [x for (x,) in kinds] == ["tfar", "sar", "sar"]


def test_case_types_in_order(spark):
    rows = [(["pep", "sanctioned"],), (["ctf", "pep"],), (["fraud", "ctf"],), (["fraud", "smurfing"],), (["fraud"],), ([],), (None,)]
    assert [x for (x,) in values(spark, rows, "p array<string>", k=casework.case_type(F.col("p")))] == ["sanctions", "pep", "ctf", "aml", "fraud", "aml", "aml"]


def test_routing(spark):
    rows = [
        (1, "tax_fraud", 1_000_000.0, 0.75),
        (2, "tax_fraud", 400_000.0, 0.75),
        (3, "tax_fraud", 1_000_000.0, 0.65),
        (4, "money_laundering", 150_000.0, 0.5),
        (5, "money_laundering", 150_000.0, 0.49),
        (6, "arson", 1.0, 0.9),
        (7, "tax_fraud", 2_000_000.0, 0.95),
        (8, None, None, None),
    ]
    got = {r.id: tuple(r)[1:] for r in casework.route(spark.createDataFrame(rows, "id long, crime_type string, amount double, confidence double")).collect()}
    assert got == {
        1: ("EBM", "SKV", True, False),
        2: ("SKV", "EBM", True, False),
        3: ("SKV", "", True, False),
        4: ("FIU", "", True, True),
        5: ("POL", "", False, False),
        6: ("POL", "", False, False),
        7: ("EBM", "SKV", True, False),
        8: ("POL", "", False, False),
    }


def test_review(spark):
    rows = [(0.9, True, None, None), (0.9, False, None, None), (0.5, True, "ann", None), (0.5, True, None, None), (0.85, True, None, "approved"), (0.85, True, None, "rejected"), (0.49, True, None, None), (0.9, None, None, None)]
    df = spark.createDataFrame(rows, "s double, person boolean, who string, decision string").withColumn("tier", casework.review_tier(F.col("s"), F.col("person")))
    state = [F.col(k) for k in ("tier", "who", "decision")]
    got = [tuple(r) for r in df.select("tier", casework.may_export(*state), casework.review_status(*state)).collect()]
    assert got == [(3, False, "pending_approval"), (1, True, "no_review_needed"), (2, True, "acknowledged"), (2, False, "pending_acknowledgment"), (3, True, "decision_approved"), (3, False, "decision_rejected"), (1, True, "no_review_needed"), (1, True, "no_review_needed")]


def test_pattern_risk_and_tiers(spark):
    rows = [(1, "structuring", 0.8, True), (1, "unusual_time", 0.4, True), (2, "other", 0.9, False), (3, "rapid_in_out", 1.0, True)] + [(4, "velocity_spike", 0.2, True)] * 6
    got = {r.entity: (round(r.score, 6), r.tier, r.n) for r in casework.pattern_risk(spark.createDataFrame(rows, "entity long, pattern string, confidence double, affects_person boolean")).collect()}
    assert got == {1: (round((0.8 + 0.4 * 0.3) / 1.3 + 0.1, 6), 2, 2), 2: (0.95, 1, 1), 3: (1.0, 3, 1), 4: (0.4, 1, 6)}


def test_timeline_and_payment_rules(spark):
    assert [x for (x,) in values(spark, [(1_000_000,), (100_000,), (10_000,), (9_999,), (None,)], "a long", s=casework.payment_event(F.col("a")))] == ["significant", "moderate", "minor", "info", "info"]
    assert [x for (x,) in values(spark, [("critical",), ("high",), ("medium",), ("low",), ("odd",), (None,)], "s string", e=casework.alert_event(F.col("s")))] == ["critical", "significant", "moderate", "minor", "info", "minor"]
    assert [x for (x,) in values(spark, [("board_change",), ("update",), (None,)], "s string", e=casework.change_event(F.col("s")))] == ["moderate", "minor", "minor"]
    rows = [(1, 1_000_000.0, "Cash", 0.9, 0.2, 100.0, 200.0), (2, 10.0, "giro", None, None, None, None), (3, 150_000.0, "check", 0.4, 0.5, 100_000.0, 200_000.0)]
    df = spark.createDataFrame(rows, "id long, amount double, kind string, s double, r double, mean double, top double")
    got = {x.id: (round(x.score, 6), x.level) for x in casework.payment_risk(df, casework.payment_factors(*[F.col(k) for k in ("amount", "kind", "s", "r", "mean", "top")])).collect()}
    first = (0.7 * 1.2 + 0.6 * 1.1 + 0.9 + 0.6 + 0.4 * 0.8) / (1.2 + 1.1 + 1.0 + 1.0 + 0.8)
    third = (0.3 * 0.8 + 0.3 * 0.9 + 0.5) / (0.8 + 0.9 + 1.0)
    assert got == {1: (round(first, 6), "high"), 2: (0.1, "low"), 3: (round(third, 6), "medium")}


def test_evasion(spark):
    rows = [(2, 1, 0, 0, 2, 6, 6, True, 6, 2), (0, 0, 3, 4, 5, 6, 5, True, 6, 1), (0, 0, 0, 0, 0, 5, 5, True, 5, 5)]
    df = spark.createDataFrame(rows, "d int, l int, o int, p int, n int, f int, t int, idle boolean, m int, b int")
    c = F.col
    alone = casework.isolation(c("d"), c("l"), c("o"), c("p"), c("n"))
    got = [(round(r[0], 6), round(r[1], 6), r[2]) for r in df.select(alone, *casework.evasion(alone, casework.synthetic_compliance(c("f"), c("t"), c("idle")), casework.below_threshold(c("m"), c("b")))).collect()]
    assert got == [(0.45, 0.78, "high"), (0.25, 0.1, "low"), (0.7, 0.28, "low")]


# graph loops


def plain_betweenness(edges):
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        depth, ways, order = {s: 0}, Counter({s: 1}), [s]
        for v in order:
            for w in out[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    ways[w] += ways[v]
        load = Counter()
        for w in reversed(order):
            for v in order:
                if w in out[v] and depth[w] == depth[v] + 1:
                    load[v] += ways[v] / ways[w] * (1 + load[w])
            if w != s:
                total[w] += load[w]
    return total


def test_betweenness_components_and_expansion(spark):
    rng = random.Random(20)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(50, 50), (60 + 0, 61)] + [(70 + k, 71 + k) for k in range(5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = plain_betweenness(edges)
    got = {r.node: r.score for r in graph.betweenness(df, len(want)).collect()}
    scale = 1 / ((len(want) - 1) * (len(want) - 2))
    assert got == pytest.approx({k: v * scale for k, v in want.items()})

    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    depth = {70: 0, 0: 0}
    order = list(depth)
    for v in order:
        for w in sorted(near[v]):
            if w not in depth:
                depth[w] = depth[v] + 1
                order.append(w)
    seeds = spark.createDataFrame([(70,), (0,)], "node long")
    assert {r.node: r.depth for r in graph.expand(df, seeds, 4).collect()} == {k: d for k, d in depth.items() if d <= 4}
    named = {r.node: r.component for r in graph.components(df).collect()}
    reach = {}
    for v in sorted(near):
        if v not in reach:
            todo = [v]
            for x in todo:
                if x not in reach:
                    reach[x] = v
                    todo += near[x]
    assert named == reach
