"""Known answers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tarn import lists
from tarn.functions import addresses, identifiers, names, similarity
from tarn.operators import filters, graph, joins, rules, sequences, text

def as_of():
    return F.to_date(F.lit("2026-01-01"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("digits", "check"), [("556703748", 5), ("000000000", 0), ("811218987", 6), ("12a", None)])
def test_luhn(spark, digits, check):
    assert one(spark, identifiers.luhn(F.lit(digits))) == check


@pytest.mark.parametrize("raw", ["5567037485", "556703-7485", "165567037485", " 5567037485 "])
def test_organisation_number(spark, raw):
    x = one(spark, identifiers.organisation_number(F.lit(raw)))
    assert (x.valid, x.number, x.type) == (True, "5567037485", "5")
    assert one(spark, identifiers.format_orgnr(F.lit("5567037485"))) == "556703-7485"
    assert one(spark, identifiers.format_orgnr(F.lit("5567037485"), True)) == "16556703-7485"


@pytest.mark.parametrize("raw", ["5567037480", "5510000000", "55670A7485", "556703", "55670374851234", "", None])
def test_wrong_organisation_number(spark, raw):
    assert not one(spark, identifiers.organisation_number(F.lit(raw).cast("string"))).valid


@pytest.mark.parametrize(("raw", "number", "coordination"), [("198112189876", "198112189876", False), ("8112189876", "198112189876", False), ("811218-9876", "198112189876", False), ("121218+9870", "191212189870", False), ("198112789873", "198112789873", True)])
def test_personal_number(spark, raw, number, coordination):
    x = one(spark, identifiers.personal_number(F.lit(raw), as_of()))
    assert (x.valid, x.number, x.coordination, x.gender) == (True, number, coordination, "M")


@pytest.mark.parametrize("raw", ["198112189870", "199902301234", "19811218ABCD", "811218", "19811218987612", "19811218987", None])
def test_wrong_personal_number(spark, raw):
    assert not one(spark, identifiers.personal_number(F.lit(raw).cast("string"), as_of())).valid


def test_names_and_addresses(spark):
    x = one(spark, names.company_name(F.lit("Den Svenska Handelsbanken Aktiebolag")))
    assert (x.normalized, x.base, x.legal_form) == ("SVENSKA HANDELSBANKEN AB", "SVENSKA HANDELSBANKEN", "AB")
    assert one(spark, names.company_name(F.lit("Foo & Bar AB (i likvidation)"))).status == "I LIKVIDATION"
    assert str(one(spark, names.date_of(F.lit("3 maj 2021")))) == "2021-05-03"
    assert one(spark, names.date_of(F.lit("maj 2021"))) is None
    p = one(spark, addresses.parse(F.lit("c/o Sabis AB, Box 6015, 102 31 Stockholm")))
    assert (p.co_name, p.box, p.postal, p.city, p.virtual) == ("Sabis AB", "6015", "10231", "Stockholm", True)
    assert one(spark, addresses.same(F.lit("Kungsg. 12, 111 43 Stockholm"), F.lit("Kungsgatan 12, 11143 Stockholm")))


def test_similarity(spark):
    assert one(spark, similarity.levenshtein_ratio(F.lit("abcd"), F.lit("abce"))) == 0.75
    assert one(spark, similarity.token_jaccard(F.lit("a b"), F.lit("B c"))) == pytest.approx(1 / 3)
    assert round(one(spark, similarity.jaro_winkler(F.lit("MARTHA"), F.lit("marhta"))), 4) == 0.9611
    assert one(spark, similarity.jaro_winkler(F.lit(None).cast("string"), F.lit("a"))) == 0.0


def test_structuring_anchor(spark):
    rows = [(k, 1, 149000.0, f"2024-01-01 {k:02d}:00:00") for k in range(5)]
    t = spark.createDataFrame(rows, "id long, sender long, amount double, ts string").select("id", "sender", F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("ts").cast("timestamp").alias("ts"))
    last = max(sequences.structuring(t).collect(), key=lambda r: r.n)
    assert (last.n, last.total, last.severity, last.confidence) == (5, 745000.0, "high", 0.7)
    few = spark.createDataFrame([(0, 1, 145000.0), (1, 1, 148000.0), (2, 1, 140000.0)], "id long, sender long, amount double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert sequences.structuring(few).count() == 0


def test_rules_null_and_missing_fields(spark):
    df = spark.createDataFrame([(1, None, ["x"]), (2, "Cash in", ["y"])], "id long, kind string, tags array<string>")
    r = rules.Rule("r", [rules.Condition("kind", "contains", "CASH"), rules.Condition("tags", "contains", "y")])
    none = rules.Rule("n", [rules.Condition("absent", "eq", 1)])
    start = rules.Rule("s", [rules.Condition("kind", "matches", "in")])
    assert [(x.id, x.rule_id) for x in rules.evaluate(df, [r, none, start]).collect()] == [(2, "r")]


def test_interval_and_as_of_joins(spark):
    a = spark.createDataFrame([(1, "2024-01-01 23:59:00"), (2, "2024-01-01 10:00:00")], "k long, t string").withColumn("t", F.col("t").cast("timestamp"))
    b = spark.createDataFrame([(1, "2024-01-02 00:30:00", "x"), (1, "2024-01-01 23:00:00", "y"), (2, "2024-01-01 12:00:01", "z")], "k long, u string, v string").withColumn("u", F.col("u").cast("timestamp"))
    assert [r.v for r in joins.interval_join(a, b, ["k"], "t", "u", 7200).collect()] == ["x"]
    got = {r.k: r.v for r in joins.as_of_join(a, b, ["k"], "t", "u", ["v"]).collect()}
    assert got == {1: "y", 2: None}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (3, 4)], "src long, dst long")
    assert {tuple(r.path) for r in graph.cycles(e, 4).collect()} == {(1, 2, 3, 1)}
    assert {r.node: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    assert round(sum(r["rank"] for r in graph.pagerank(e, iterations=5).collect()), 9) == 1.0
    assert {r.node: r.coefficient for r in graph.clustering(e).collect()}[1] == 1.0
    line = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert {r.node: r.score for r in graph.betweenness(line, 3).collect()}[2] == 0.5


def test_greedy_clusters_and_dedupe(spark):
    rows = [(1, k, f"2024-01-01 0{k}:00:00") for k in range(6)] + [(1, 9, "2024-01-05 00:00:00")]
    e = spark.createDataFrame(rows, "entity long, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.first_id, r.n) for r in sequences.greedy_clusters(e, least=5).collect()] == [(0, 6)]
    p = spark.createDataFrame([(1, 1, 0, 10, 0.9, [1, 2]), (1, 2, 5, 12, 0.8, [2, 3]), (1, 3, 20, 30, 0.7, [9])], "entity long, id long, start long, end long, confidence double, events array<long>")
    assert {r.id for r in sequences.greedy_dedupe(p).collect()} == {1, 3}


def test_text(spark):
    docs = spark.createDataFrame([(1, "Write to a.b@c.se or 811218-9876.\nVD\nAnna Berg"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.kind, r.value) for r in text.extract(docs, as_of(), ["email", "personal_number"]).collect()} == {("email", "a.b@c.se"), ("personal_number", "811218-9876")}
    assert [(r.role, r.name, r.confidence) for r in text.roles_near_names(docs, ["vd"]).collect()] == [("vd", "Anna Berg", 0.65)]
    s = {(r.kind, r.value, r.start) for r in text.spans(docs).collect()}
    assert ("email", "a.b@c.se", 9) in s
    assert one(spark, text.summary(F.lit("One two. Three four five. Six."), 5)) == "One two. Three four five."
    assert one(spark, text.language(F.lit("och det är"))) == "sv"
    assert one(spark, text.language(F.lit("this is from the board"))) == "en"
    assert one(spark, text.language(F.lit("xyz"))) == "sv"
    assert not one(spark, text.justified(F.lit("asdfasdfasdf")))
    assert one(spark, text.justified(F.lit("Checked against the register")))


def test_round_classes(spark):
    assert [one(spark, filters.roundness(F.lit(x))) for x in (300000, 150000, 20000, 1234)] == [100000, 50000, 10000, None]


def payments(spark, rows):
    t = spark.createDataFrame(rows, "id long, sender string, receiver string, amount double, ts string")
    return t.withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize(("n", "amount", "grade"), [(6, 149_000, "critical"), (4, 149_000, "high"), (3, 149_000, "medium"), (10, 142_500, "critical"), (3, 142_500, "medium")])
def test_structuring_severity(spark, n, amount, grade):
    t = payments(spark, [(k, "s", "r", float(amount), f"2024-01-01 {k:02d}:00:00") for k in range(n)])
    last = max(sequences.structuring(t).collect(), key=lambda r: r.n)
    assert (last.n, last.severity) == (n, grade)


@pytest.mark.parametrize(("n", "amount", "grade", "sure"), [(3, 60_000, "low", 0.7), (3, 70_000, "medium", 0.7), (5, 40_000, "medium", 0.8), (7, 30_000, "high", 0.9), (10, 20_000, "critical", 0.95), (3, 400_000, "critical", 0.7), (3, 170_000, "high", 0.7)])
def test_smurfing_severity(spark, n, amount, grade, sure):
    t = payments(spark, [(k, f"s{k}", "r", float(amount), f"2024-01-01 {k:02d}:00:00") for k in range(n)])
    last = max(sequences.smurfing(t).collect(), key=lambda r: r.depositors)
    assert (last.depositors, last.severity, last.confidence) == (n, grade, pytest.approx(sure))


def test_rapid_movement(spark):
    times = {"in": "2024-01-01 00:00:00", "soon": "2024-01-01 01:30:00", "noon": "2024-01-01 12:00:00", "edge": "2024-01-02 00:00:00", "late": "2024-01-02 00:00:01", "before": "2023-12-31 23:59:59"}
    gone = {"a": [("soon", 90_000)], "b": [("noon", 100_000), ("before", 500_000)], "c": [("edge", 240_000)], "d": [("late", 900_000)], "e": [("soon", 79_000)], "f": [("soon", 99_000)], "g": [("soon", 10), ("edge", 2_000_000)]}
    amounts = {"a": 100_000, "b": 120_000, "c": 250_000, "d": 300_000, "e": 100_000, "f": 99_999, "g": 1_000_000}
    ins = payments(spark, [(k, "", a, float(x), times["in"]) for k, (a, x) in enumerate(amounts.items())]).withColumnRenamed("receiver", "account")
    outs = payments(spark, [(100, a, "", float(x), times[w]) for a, rows in gone.items() for w, x in rows]).withColumnRenamed("sender", "account")
    got = {r.account: (r.n, r.moved, r.hours, r.severity, r.confidence) for r in sequences.rapid_movement(ins, outs).collect()}
    assert got == {"a": (1, 90_000, 1.5, "critical", 0.75), "b": (1, 100_000, 12, "medium", 0.75), "c": (1, 240_000, 24, "medium", 0.75), "g": (2, 2_000_010, 24, "critical", 0.75)}


@pytest.mark.parametrize(("name", "shown"), [("Anna-Lisa", "annalisa"), ("Mr. John  Smith", "john smith"), ("Fröken Ek", "ek"), ("Herr Dr. Öst, jr.", "öst jr"), ("Drake", "drake"), ("Mr", "mr"), ("", "")])
def test_watchlist_name(spark, name, shown):
    assert one(spark, names.watchlist_name(F.lit(name))) == shown


def test_screen_against_all_pairs(spark):
    """Every pair is compared by hand; births halve, and halved scores below the limit are no match."""
    import random

    from tarn.operators import resolution

    dice = random.Random(3)
    words = [f"w{k}" for k in range(9)]
    made = lambda: " ".join(dice.choice(words) for _ in range(dice.randrange(1, 9)))
    listed = [(k, made(), made() if k % 4 == 0 else None, f"i{k}", dice.randrange(3) if k % 5 else None) for k in range(60)]
    asked = [(k, f"Dr. {dice.choice(listed)[1]} {dice.choice(['', '', 'x', dice.choice(words)])}" if k % 3 else made(), f"i{k}" if k % 10 == 0 else None, dice.randrange(3) if k % 4 else None) for k in range(80)] + [(900, None, None, 1), (901, "", None, 1)]

    def plain(x):
        return None if x is None else " ".join(x.lower().replace("dr. ", "").split())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for q, qn, qi, qb in asked:
        for e, en, ea, ei, eb in listed:
            a, b = plain(qn), plain(en)
            if qi == ei:
                want[q, e] = ("identifier", 1.0)
            elif a is not None and a == b:
                want[q, e] = ("exact", 1.0)
            elif a is not None and a == plain(ea):
                want[q, e] = ("alias", 0.95)
            elif a:
                x, y = set(a.split()), set(b.split())
                score = 0.6 * (1 - distance(a, b) / max(len(a), len(b))) + 0.4 * len(x & y) / len(x | y)
                score *= 0.5 if None not in (qb, eb) and qb != eb else 1
                if score >= 0.85:
                    want[q, e] = ("fuzzy", score)
    entries = spark.createDataFrame(listed, "id long, name string, alias string, identifier string, born long")
    queries = spark.createDataFrame(asked, "id long, name string, identifier string, born long")
    got = {(r["query"], r.entry): (r["match"], r.score) for r in resolution.screen(queries, entries).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)
    assert {"identifier", "exact", "fuzzy"} <= {m for m, _ in want.values()}


def test_merges_beyond_a_thousand_steps(spark):
    from tarn.operators import resolution

    rows = spark.range(1500).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("merged_into"))
    assert {r.final for r in resolution.follow_merges(rows).collect()} == {0}


def test_summary_stops_at_the_first_long_sentence(spark):
    assert one(spark, text.summary(F.lit("One two three four. Five. Six."), 3)) == ""
    assert one(spark, text.summary(F.lit("One two. Three four five six. Seven."), 4)) == "One two."


def test_short_street_forms(spark):
    assert [one(spark, addresses.street_of(F.lit(x))) for x in ("Kungsgt 12", "Kungsvg 3", "Storg. 1")] == ["kungsgatan 12", "kungsvägen 3", "storgatan 1"]


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_blind_index(spark, key):
    import hashlib
    import hmac

    assert one(spark, identifiers.blind_index(F.lit("5567-037485 a"), key)) == hmac.new(key, b"5567037485A", hashlib.sha256).hexdigest()


def test_pagerank_settles(spark):
    """A long chain with a bridge, against dense power iteration."""
    import numpy as np

    edges = [(k, k + 1) for k in range(40)] + [(5, 0), (40, 30), (41, 2), (42, 2), (42, 2), (7, 43)]
    nodes = sorted({x for e in edges for x in e})
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        m[nodes.index(b), nodes.index(a)] += 1
    loose = m.sum(axis=0) == 0
    m[:, ~loose] /= m.sum(axis=0)[~loose]
    m[:, loose] = 1 / len(nodes)
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(500):
        r = 0.15 / len(nodes) + 0.85 * m @ r
    got = {x.node: x["rank"] for x in graph.pagerank(spark.createDataFrame(edges, "src long, dst long"), tolerance=1e-9).collect()}
    assert got == {n: pytest.approx(v, abs=1e-7) for n, v in zip(nodes, r, strict=True)}


def test_text_lists(spark):
    long = "x" * 60 + " Knark och HELLS ANGELS i " + "y" * 60
    docs = spark.createDataFrame([(1, long), (2, "fakturaskojeri"), (3, "knarkare"), (4, None), (5, "")], "doc_id long, text string")
    got = text.vocabulary_matches(docs).collect()
    assert {(r.doc_id, r.category, r.word, r.severity) for r in got} == {(1, "drugs", "knark", "high"), (1, "gang", "hells angels", "high"), (2, "money_laundering", "fakturaskojeri", "high"), (2, "fraud", "fakturaskojeri", "high")}
    at = long.index("Knark")
    assert {r.context for r in got if r.word == "knark"} == {long[at - 50 : at + 55]}
    assert text.vocabulary_matches(docs, {"a": {"knark": "low"}}, least="high").count() == 0
    s = one(spark, text.sentiment(F.lit("Våldsam panik, bra")))
    assert s.fear == pytest.approx(2 * math.log(2) / math.log(19)) and s.violence == pytest.approx(2 * math.log(3) / math.log(24))
    assert (s.polarity, s.threat) == (1.0, 0.0) and s.risk == pytest.approx(0.35 * s.violence + 0.2 * s.fear)
    r = one(spark, text.combined_risk(F.lit("knark")))
    assert (r.risk, r.flag) == (0.5, True)
    assert tuple(one(spark, text.combined_risk(F.lit(None).cast("string")))) == (0.0, False)


def test_relations_in_text(spark):
    docs = spark.createDataFrame([(1, "Anna Berg är VD för Nordbolaget Sverige. X äger Y1."), (2, "Bo Ek äger " + "ord " * 20000 + "slut."), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.relation, r.subject, r.object[:20], r.confidence) for r in text.relations(docs).collect()}
    assert got == {(1, "ceo", "Anna Berg", "Nordbolaget Sverige", 0.8), (2, "owns", "Bo Ek", "ord ord ord ord ord ", 0.8)}


def test_token_entities(spark):
    docs = spark.createDataFrame([(1, "Anna Berg"), (2, None)], "doc_id long, text string")
    got = text.token_entities(docs, lambda texts: [[("PER", 0, 4, 0.9)] if t else [] for t in texts]).collect()
    assert [(r.doc_id, r.kind, r.value, r.confidence) for r in got] == [(1, "PER", "Anna", 0.9)]


def test_fixed_lists(spark):
    assert one(spark, names.role_of(F.lit(" Vice VD "))) == "VICE_VD"
    assert one(spark, names.role_of(F.lit("vald styrelseledamot"))) == "STYRELSELEDAMOT"
    assert one(spark, names.role_of(F.lit("kassör"))) == "UNKNOWN"
    assert one(spark, names.person_name(F.lit("Kalle Ek Jr"), lists.NICKNAMES)) == "karl ek"
    found = [one(spark, filters.first_category(F.lit(x).cast("string"), lists.EXCLUDED)) for x in ("KPMG AB", "Nordea Bank", "Lagerbolag i Norr", "Okänd Firma", None)]
    assert found == ["audit_firm", "bank", "corporate_service", None, None]
    assert one(spark, filters.not_excluded(F.lit("Lagerbolag"), lists.NO_SERIAL_DIRECTOR))
    assert not one(spark, filters.not_excluded(F.lit("Lagerbolag"), lists.NO_ADDRESS_CLUSTER))


def test_playbooks(spark):
    rows = [(1, "formed", 1), (1, "f_skatt_registered", 5), (1, "address_to_virtual", 9), (2, "owner_changed", 1), (2, "formed", 2), (2, "foreign_owner_added", 3)]
    events = spark.createDataFrame(rows, "entity long, type string, day int").select("entity", "type", F.timestamp_seconds(F.col("day") * 86400).alias("ts"))
    loose = {(r.entity, r.playbook): (r.confidence, r.stage, r.next, r.severity) for r in sequences.playbooks(events).collect()}
    assert loose[1, "invoice_factory"] == (1.0, 4, None, "high")
    # a repeated step meets the same event again, and order does not matter
    assert loose[2, "ownership_layering"] == (1.0, 4, None, "medium")
    strict = {(r.entity, r.playbook): (r.confidence, r.stage, r.next) for r in sequences.playbooks(events, strict_order=True).collect()}
    assert strict[1, "invoice_factory"] == (1.0, 4, None)
    assert strict[2, "ownership_layering"] == (0.5, 2, "owner_changed")
