"""Filters, set operations and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lists import EXCLUDED, NO_ADDRESS_CLUSTER, NO_SERIAL_DIRECTOR
from ..operators import filters as op
from ..operators.rules import evaluate
from .views import TXN, ctes, query

ENRICHED = "e AS (SELECT id, amount, kind, CASE sender % 9 WHEN 0 THEN 'IR' WHEN 1 THEN 'KP' ELSE 'SE' END AS country, CAST(sender % 200 AS INT) AS entity_age_days FROM txn)"


@query("flt_01_rules_engine", ctes("txn", more=ENRICHED) + """
SELECT id, 'high_value_cash' AS rule_id, 'high' AS severity, 'aml' AS category FROM e WHERE amount >= 50000 AND contains(lower(kind), 'cash')
UNION ALL SELECT id, 'near_threshold', 'high', 'structuring' FROM e WHERE amount >= 140000 AND amount < 150000
UNION ALL SELECT id, 'high_risk_country', 'critical', 'sanctions' FROM e WHERE country IN ('AF','IR','KP','SY','YE')
UNION ALL SELECT id, 'new_entity_large', 'high', 'kyc' FROM e WHERE entity_age_days < 90 AND amount >= 100000""")
def flt_01(t):
    country = F.when(F.col("sender") % 9 == 0, "IR").when(F.col("sender") % 9 == 1, "KP").otherwise("SE")
    e = t.txn.select("id", "amount", "kind", country.alias("country"), (F.col("sender") % 200).cast("int").alias("entity_age_days"))
    return evaluate(e, op.DEFAULT_RULES).select("id", "rule_id", "severity", "category")


@query("flt_02_default_rules", ctes("txn") + """
SELECT rule_id, count(*) AS matches FROM (SELECT 'high_value_cash' AS rule_id FROM txn WHERE amount >= 50000 AND contains(kind, 'cash')
UNION ALL SELECT 'near_threshold' FROM txn WHERE amount >= 140000 AND amount < 150000) GROUP BY rule_id""")
def flt_02(t):
    return evaluate(t.txn, op.DEFAULT_RULES, ["aml", "structuring"]).groupBy("rule_id").agg(F.count("*").alias("matches"))


FACTS = "f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS subject, CAST(l_shipdate AS DATE) AS valid_from, CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 400 END AS valid_to, CASE WHEN l_returnflag = 'A' THEN l_orderkey END AS superseded_by FROM lineitem)"


@query("flt_03_current_facts", f"WITH {FACTS} SELECT id, subject FROM f WHERE superseded_by IS NULL AND (valid_to IS NULL OR valid_to >= DATE '1998-01-01')")
def flt_03(t):
    day = F.to_date("l_shipdate")
    facts = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("subject"), F.when(F.col("l_linestatus") == "F", F.date_add(day, 400)).alias("valid_to"), F.when(F.col("l_returnflag") == "A", F.col("l_orderkey")).alias("superseded_by"))
    return op.current_facts(facts, F.to_date(F.lit("1998-01-01"))).select("id", "subject")


@query("flt_04_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_name, p_partkey LIMIT 50 OFFSET 10")
def flt_04(t):
    return op.search(t.part.select("p_partkey", "p_name"), "p_name", "an", 50, 10, ["p_name", "p_partkey"])


@query("flt_05_review_queue", """SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR (o_orderpriority = '1-URGENT' AND o_totalprice > 450000)
ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100""")
def flt_05(t):
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000)
    found = t.orders.where(((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)) | urgent)
    return found.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@query("flt_06_timeline_slice", ctes("event") + "SELECT id, entity, type FROM event WHERE entity IN (1, 2, 3, 5, 8) AND type IN ('view', 'purchase') AND ts BETWEEN (SELECT min(ts) + INTERVAL 2 DAY FROM event) AND (SELECT min(ts) + INTERVAL 20 DAY FROM event)")
def flt_06(t):
    start = t.event.agg(F.min("ts").alias("t0")).select(F.expr("t0 + INTERVAL 2 DAYS AS lo"), F.expr("t0 + INTERVAL 20 DAYS AS hi"))
    return op.timeline_slice(t.event.join(F.broadcast(start)), [1, 2, 3, 5, 8], F.col("lo"), F.col("hi"), ["view", "purchase"]).select("id", "entity", "type")


@query("flt_07_just_under", ctes("txn") + """SELECT id, amount >= 142500 AND amount < 150000 AS v1, amount >= 140000 AND amount < 150000 AS v2, amount > 127500 AND amount < 150000 AS v3
FROM txn WHERE amount > 127500 AND amount < 150000""")
def flt_07(t):
    a = F.col("amount")
    return t.txn.where(op.just_under(a, ratio=0.85, strict=True)).select("id", op.just_under(a).alias("v1"), ((a >= 140000) & (a < 150000)).alias("v2"), op.just_under(a, ratio=0.85, strict=True).alias("v3"))


@query("flt_08_round_amounts", """SELECT id, CASE WHEN a % 100000 = 0 THEN 100000 WHEN a % 50000 = 0 THEN 50000 WHEN a % 10000 = 0 THEN 10000 END AS step
FROM (SELECT o_orderkey AS id, CAST(floor(o_totalprice / 1000) AS BIGINT) * 1000 AS a FROM orders) WHERE a > 0 AND a % 10000 = 0""")
def flt_08(t):
    amounts = t.orders.select(F.col("o_orderkey").alias("id"), (F.floor(F.col("o_totalprice") / 1000) * 1000).alias("a"))
    return amounts.select("id", op.roundness(F.col("a")).alias("step")).where("step IS NOT NULL")


@query("flt_09_unusual_times", """SELECT event_id AS id, CASE WHEN dayofweek(ts) IN (0, 6) AND value * 1000 > 50000 THEN 'weekend' WHEN hour(ts) < 5 THEN 'night' END AS reason FROM events
WHERE (dayofweek(ts) IN (0, 6) AND value * 1000 > 50000) OR hour(ts) < 5""")
def flt_09(t):
    return t.events.select(F.col("event_id").alias("id"), op.unusual_time(F.col("ts"), F.col("value") * 1000).alias("reason")).where("reason IS NOT NULL")


#: Parts as companies: listed names and others.
FIRMS = "firm AS (SELECT p_partkey, p_name || CASE p_partkey % 9 WHEN 0 THEN ' KPMG AB' WHEN 1 THEN ' Nordea Bank' WHEN 2 THEN ' Advokatbyrå' WHEN 3 THEN ' Lagerbolag' WHEN 4 THEN ' Umeå Kommun' WHEN 5 THEN ' Ratos Invest AB' ELSE ' ' || p_type END AS name FROM part)"


def listed(column, literals):
    return "(" + " OR ".join(f"contains(lower({column}), '{x}')" for x in literals) + ")"


CATEGORY = "CASE " + " ".join(f"WHEN {listed('name', v)} THEN '{k}'" for k, v in EXCLUDED.items()) + " END"


@query("flt_10_exclusion_lists", f"""WITH {FIRMS}, x AS (SELECT p_partkey, {CATEGORY} AS category FROM firm)
SELECT *, category IS NULL OR category = 'corporate_service' AS for_directors, category IS NULL OR category NOT IN ('corporate_service', 'government') AS for_addresses FROM x""")
def flt_10(t):
    x, name = t.sql(f"WITH {FIRMS} SELECT * FROM firm"), F.col("name")
    return x.select("p_partkey", op.first_category(name).alias("category"), op.not_excluded(name, NO_SERIAL_DIRECTOR).alias("for_directors"), op.not_excluded(name, NO_ADDRESS_CLUSTER).alias("for_addresses"))


@query("flt_11_registration_anomalies", ctes("company", "directs", more="n AS (SELECT company, count(DISTINCT person) AS directors FROM directs GROUP BY company)") + """
SELECT c.company, NOT f_skatt AS no_f_skatt, employees <= 5 AND directors >= 1 AS few_employees, NOT vat AND revenue > 1000 AS no_vat FROM company c LEFT JOIN n ON n.company = c.company
WHERE NOT f_skatt OR (employees <= 5 AND directors >= 1) OR (NOT vat AND revenue > 1000)""")
def flt_11(t):
    n = t.directs.groupBy("company").agg(F.countDistinct("person").alias("directors"))
    c = t.company.join(n, "company", "left")
    few = (F.col("employees") <= 5) & (F.col("directors") >= 1)
    no_vat = ~F.col("vat") & (F.col("revenue") > 1000)
    return c.where(~F.col("f_skatt") | few | no_vat).select("company", (~F.col("f_skatt")).alias("no_f_skatt"), few.alias("few_employees"), no_vat.alias("no_vat"))


ALERTS = """a AS (SELECT o_orderkey AS id, 'txn' AS source, CASE WHEN o_totalprice > 400000 THEN 'critical' WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END AS severity, round(o_totalprice / 500000, 6) AS confidence FROM orders
 UNION ALL SELECT event_id, 'event', CASE WHEN type2 = 'error' THEN 'high' ELSE 'low' END, 0.5 FROM (SELECT event_id, event_type AS type2 FROM events WHERE event_type IN ('error', 'signup')))"""


def alerts(t):
    price = F.col("o_totalprice")
    severity = F.when(price > 400000, "critical").when(price > 300000, "high").when(price > 150000, "medium").otherwise("low")
    first = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("txn").alias("source"), severity.alias("severity"), F.round(price / 500000, 6).alias("confidence"))
    kinds = t.events.where(F.col("event_type").isin("error", "signup"))
    second = kinds.select(F.col("event_id").alias("id"), F.lit("event").alias("source"), F.when(F.col("event_type") == "error", "high").otherwise("low").alias("severity"), F.lit(0.5).alias("confidence"))
    return first.unionByName(second, allowMissingColumns=True)


RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query("flt_12_alert_listing", f"WITH {ALERTS} SELECT id, source, severity FROM a WHERE severity IN ('critical', 'high') ORDER BY {RANK}, confidence DESC, source, id LIMIT 40")
def flt_12(t):
    found = alerts(t).where(F.col("severity").isin("critical", "high"))
    return found.orderBy(op.severity_rank(F.col("severity")), F.desc("confidence"), "source", "id").limit(40).select("id", "source", "severity")


@query("tk_01_severity_order", f"WITH {ALERTS} SELECT id, source, severity, row_number() OVER (ORDER BY {RANK}, confidence DESC, source, id) AS place FROM a ORDER BY place LIMIT 200")
def tk_01(t):
    top = alerts(t).orderBy(op.severity_rank(F.col("severity")), F.desc("confidence"), "source", "id").limit(200)
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.orderBy(op.severity_rank(F.col("severity")), F.desc("confidence"), "source", "id"))
    return top.select("id", "source", "severity", place.alias("place"))


@query("tk_02_top_candidates", "SELECT sender, id, place FROM (SELECT sender, id, row_number() OVER (PARTITION BY sender ORDER BY amount DESC, id) AS place FROM (" + TXN + ")) WHERE place <= 5")
def tk_02(t):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("sender").orderBy(F.desc("amount"), "id"))
    return t.txn.select("sender", "id", place.alias("place")).where("place <= 5")


@query("tk_03_top_features", """SELECT p_partkey, array_to_string(list_transform(list_slice(list_reverse_sort(list_filter([{'v': p_size % 7, 'n': 'size'}, {'v': CAST(p_retailprice AS BIGINT) % 5, 'n': 'price'}, {'v': p_partkey % 3, 'n': 'key'}], lambda x: x.v > 0)), 1, 2), lambda x: x.n), ',') AS top
FROM (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, floor(p_retailprice) AS p_retailprice FROM part)""")
def tk_03(t):
    v = lambda x, n: F.struct(x.cast("long").alias("v"), F.lit(n).alias("n"))
    features = F.array(v(F.col("p_size") % 7, "size"), v(F.floor("p_retailprice") % 5, "price"), v(F.col("p_partkey") % 3, "key"))
    best = F.slice(F.sort_array(F.filter(features, lambda x: x["v"] > 0), asc=False), 1, 2)
    return t.part.select("p_partkey", F.array_join(F.transform(best, lambda x: x["n"]), ",").alias("top"))


@query("tk_04_at_risk", ctes("company") + "SELECT company, round(1.0 / (1 + employees), 6) AS p FROM company WHERE 1.0 / (1 + employees) >= 0.05 ORDER BY 1.0 / (1 + employees) DESC, company LIMIT 25")
def tk_04(t):
    p = 1.0 / (1 + F.col("employees"))
    return t.company.select("company", p.alias("q")).where("q >= 0.05").orderBy(F.desc("q"), "company").limit(25).select("company", F.round("q", 6).alias("p"))


@query("tk_05_newest", ctes("event") + "SELECT id, type FROM event WHERE type <> 'click' ORDER BY ts DESC, id LIMIT 100")
def tk_05(t):
    return t.event.where("type <> 'click'").orderBy(F.desc("ts"), "id").limit(100).select("id", "type")


@query("tk_07_pages", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def tk_07(t):
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey")


@query("set_01_union_all", "SELECT 'node' AS part, count(*) AS n FROM customer UNION ALL SELECT 'edge', count(*) FROM orders")
def set_01(t):
    return t.customer.agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "n").unionByName(t.orders.agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "n"))


@query("set_02_common_connections", ctes("directs") + "SELECT company FROM directs WHERE person IN (1, 2, 3, 4) INTERSECT SELECT company FROM directs WHERE person IN (5, 6, 7, 8, 9, 10)")
def set_02(t):
    d = t.directs
    return d.where("person IN (1, 2, 3, 4)").select("company").intersect(d.where("person IN (5, 6, 7, 8, 9, 10)").select("company"))


@query("set_03_difference", ctes("directs", "company") + "SELECT company FROM company EXCEPT SELECT company FROM directs")
def set_03(t):
    return t.company.select("company").join(t.directs, "company", "left_anti").distinct()


@query("set_04_distinct_union", "SELECT l_partkey AS id FROM lineitem UNION SELECT p_partkey FROM part")
def set_04(t):
    return t.lineitem.select(F.col("l_partkey").alias("id")).union(t.part.select("p_partkey")).distinct()


@query("set_05_keep_best", ctes("txn") + "SELECT sender, receiver, id FROM (SELECT *, row_number() OVER (PARTITION BY sender, receiver ORDER BY amount DESC, id) AS k FROM txn) WHERE k = 1")
def set_05(t):
    return op.keep_best(t.txn, ["sender", "receiver"], [F.desc("amount"), F.col("id")]).select("sender", "receiver", "id")


@query("set_06_undirected", ctes("paid") + "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM paid")
def set_06(t):
    return op.undirected(t.paid)


@query("set_07_alert_dedupe", ctes("event") + "SELECT entity, type, min(id) AS id FROM event GROUP BY entity, type")
def set_07(t):
    return t.event.groupBy("entity", "type").agg(F.min("id").alias("id"))
