"""Time-window and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lists import PLAYBOOKS
from ..operators import companies as co
from ..operators import sequences as op
from .views import ctes, query

TRAIL = "OVER (PARTITION BY {k} ORDER BY ts RANGE BETWEEN INTERVAL {d} DAY PRECEDING AND CURRENT ROW)"
AHEAD = "OVER (PARTITION BY {k} ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL {d} FOLLOWING)"


def trail(k, d):
    return TRAIL.format(k=k, d=d)


def ahead(k, d):
    return AHEAD.format(k=k, d=d)


@query("agg_w1_structuring_forward", ctes("txn") + f""", w AS (SELECT id, count(*) {ahead('sender', '365 DAY')} AS n, count(*) FILTER (WHERE amount >= 140000 AND amount < 150000) {ahead('sender', '365 DAY')} AS k, CAST(sum(amount) {ahead('sender', '365 DAY')} AS DOUBLE) AS total, max(amount) {ahead('sender', '365 DAY')} AS top, avg(amount) {ahead('sender', '365 DAY')} AS mean FROM txn)
SELECT id, 'near_threshold' AS kind, round(least(1.0, k / 5 * 0.9), 6) AS confidence FROM w WHERE n >= 2 AND k >= 2 UNION ALL SELECT id, 'split', round(least(1.0, (total / 150000 - 1) * 0.5 + 0.5), 6) FROM w WHERE n >= 2 AND total >= 150000 AND top < 150000 AND mean > 10000""")
def w1(t):
    return op.structuring_forward(t.txn, days=365, least=2)


@query("agg_w2_structuring", ctes("txn") + f""", u AS (SELECT * FROM txn WHERE amount >= 75000 AND amount < 150000), w AS (SELECT id, sender, count(*) {trail('sender', 30)} AS n, CAST(sum(amount) {trail('sender', 30)} AS DOUBLE) AS total FROM u)
SELECT id, sender, n, total, CASE WHEN total >= 750000 OR n >= 10 THEN 'critical' WHEN total >= 450000 OR n >= 7 THEN 'high' WHEN total >= 300000 OR n >= 5 THEN 'medium' ELSE 'low' END AS severity, round(least(0.95, 0.5 + (n - 2) * 0.1), 6) AS confidence FROM w WHERE n >= 2 AND total >= 150000""")
def w2(t):
    return op.structuring(t.txn, days=30, least=2, low=75_000)


#: Windows (key, a, b) merged into spans, with what lies in them.
ISLANDS = """f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM w),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM f), s AS (SELECT key, min(a) AS a, max(b) AS b, count(*) AS anchors FROM g GROUP BY key, k)"""
#: The same, where windows of equal ends get one number, whichever of them comes first.
ISLANDS_TIED = ISLANDS.replace("ORDER BY a, b ROWS UNBOUNDED PRECEDING", "ORDER BY a, b RANGE UNBOUNDED PRECEDING")


@query("agg_w2_structuring_spans", ctes("txn") + f""", u AS (SELECT * FROM txn WHERE amount >= 75000 AND amount < 150000), v AS (SELECT sender AS key, ts AS b, min(ts) {trail('sender', 30)} AS a, count(*) {trail('sender', 30)} AS n, sum(amount) {trail('sender', 30)} AS total FROM u),
w AS (SELECT * FROM v WHERE n >= 2 AND total >= 150000), {ISLANDS}, x AS (SELECT key, a, b, anchors, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM s JOIN u ON sender = key AND ts BETWEEN a AND b GROUP BY key, a, b, anchors)
SELECT key AS sender, CAST(a AS DATE) AS "start", CAST(b AS DATE) AS "end", anchors, n, total, CASE WHEN total >= 750000 OR n >= 10 THEN 'critical' WHEN total >= 450000 OR n >= 7 THEN 'high' WHEN total >= 300000 OR n >= 5 THEN 'medium' ELSE 'low' END AS severity, round(least(0.95, 0.5 + (n - 2) * 0.1), 6) AS confidence FROM x""")
def w2_spans(t):
    x = op.structuring(t.txn, days=30, least=2, low=75_000, collapse=True)
    return x.withColumns({c: F.to_date(c) for c in ("start", "end")})


@query("agg_w3_structuring_share", ctes("txn") + "SELECT sender, count(*) AS n, CAST(count(*) FILTER (WHERE amount > 127500 AND amount < 150000) AS BIGINT) AS k FROM txn GROUP BY sender HAVING count(*) > 5 AND count(*) FILTER (WHERE amount > 127500 AND amount < 150000) / count(*) > 0.1")
def w3(t):
    return op.structuring_share(t.txn, share=0.1)


@query("agg_w4_smurfing", ctes("txn") + f", w AS (SELECT id, receiver, CAST(len(list_distinct(list(sender) {trail('receiver', 7)})) AS INT) AS depositors, CAST(sum(amount) {trail('receiver', 7)} AS DOUBLE) AS total FROM txn) SELECT *, CASE WHEN total >= 1000000 OR depositors >= 10 THEN 'critical' WHEN total >= 500000 OR depositors >= 7 THEN 'high' WHEN total >= 200000 OR depositors >= 5 THEN 'medium' ELSE 'low' END AS severity, round(0.7 + least(0.25, (depositors - 3) * 0.05), 6) AS confidence FROM w WHERE depositors >= 3 AND total >= 150000")
def w4(t):
    return op.smurfing(t.txn)


@query("agg_w4_smurfing_spans", ctes("txn") + f""", v AS (SELECT receiver AS key, ts AS b, min(ts) {trail('receiver', 7)} AS a, len(list_distinct(list(sender) {trail('receiver', 7)})) AS n, sum(amount) {trail('receiver', 7)} AS total FROM txn),
w AS (SELECT * FROM v WHERE n >= 3 AND total >= 150000), {ISLANDS_TIED}, x AS (SELECT key, a, b, anchors, CAST(count(DISTINCT sender) AS INT) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM s JOIN txn ON receiver = key AND ts BETWEEN a AND b GROUP BY key, a, b, anchors)
SELECT key AS receiver, CAST(a AS DATE) AS "start", CAST(b AS DATE) AS "end", anchors, n AS depositors, total, CASE WHEN total >= 1000000 OR n >= 10 THEN 'critical' WHEN total >= 500000 OR n >= 7 THEN 'high' WHEN total >= 200000 OR n >= 5 THEN 'medium' ELSE 'low' END AS severity, round(0.7 + least(0.25, (n - 3) * 0.05), 6) AS confidence FROM x""")
def w4_spans(t):
    return op.smurfing(t.txn, collapse=True).withColumns({c: F.to_date(c) for c in ("start", "end")})


@query("agg_w5_velocity", ctes("event") + """, m AS (SELECT max(ts) AS t FROM event), h AS (SELECT entity, count(*) / greatest(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000), 1) AS base FROM event, m WHERE ts <= m.t - INTERVAL 1 DAY GROUP BY entity),
n AS (SELECT entity, count(*) AS n FROM event, m WHERE ts > m.t - INTERVAL 1 DAY GROUP BY entity), r AS (SELECT n.entity, n, n / coalesce(base, 1) AS ratio FROM n LEFT JOIN h ON h.entity = n.entity)
SELECT entity, n, round(ratio, 6) AS ratio, round(least(1.0, (ratio - 3) / 5 + 0.6), 6) AS confidence FROM r WHERE ratio > 1.5""")
def w5(t):
    last = F.broadcast(t.event.agg(F.max("ts").alias("t")))
    e = t.event.join(last)
    return op.velocity_spikes(e.where(F.expr("ts > t - INTERVAL 1 DAY")), e.where(F.expr("ts <= t - INTERVAL 1 DAY")), "entity", "ts", 1.5)


@query("agg_w6_bursts", ctes("event") + f""", w AS (SELECT id, entity, count(*) {ahead('entity', '24 HOUR')} AS n, CAST(len(list_distinct(list(type) {ahead('entity', '24 HOUR')})) AS INT) AS types, (epoch_us(max(ts) {ahead('entity', '24 HOUR')}) - epoch_us(ts)) / 3.6e9 AS span FROM event)
SELECT id, entity, n, types, round((least(1.0, n / 20) + least(1.0, types / 5) + 1 / (1 + span)) / 3, 6) AS risk FROM w WHERE n >= 3""")
def w6(t):
    return op.bursts(t.event)


@query("agg_w6_burst_spans", ctes("event") + f""", v AS (SELECT entity AS key, ts AS a, max(ts) {ahead('entity', '24 HOUR')} AS b, count(*) {ahead('entity', '24 HOUR')} AS n FROM event), w AS (SELECT * FROM v WHERE n >= 3), {ISLANDS},
x AS (SELECT key, a, b, anchors, count(*) AS n, CAST(count(DISTINCT type) AS INT) AS types, (epoch_us(b) - epoch_us(a)) / 3.6e9 AS span FROM s JOIN event ON entity = key AND ts BETWEEN a AND b GROUP BY key, a, b, anchors)
SELECT key AS entity, epoch_us(a) AS "start", epoch_us(b) AS "end", anchors, n, types, round((least(1.0, n / 20) + least(1.0, types / 5) + 1 / (1 + span)) / 3, 6) AS risk FROM x""")
def w6_spans(t):
    return op.bursts(t.event, collapse=True).withColumns({c: F.unix_micros(c) for c in ("start", "end")})


@query("agg_w7_coordinated", ctes("event") + ", e AS (SELECT * FROM event WHERE entity IN (1,2,3,4,5,6,7,8,9,10)) SELECT a.id, count(DISTINCT b.entity) AS n, round(count(DISTINCT b.entity) / 10, 6) AS confidence FROM e a JOIN e b ON b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY a.id HAVING count(DISTINCT b.entity) >= 2")
def w7(t):
    return op.coordinated(t.event, list(range(1, 11)))


@query("agg_w8_contiguous", ctes("event") + ", s AS (SELECT id, entity, type, lead(type, 1) OVER w AS t1, lead(type, 2) OVER w AS t2 FROM event WINDOW w AS (PARTITION BY entity ORDER BY ts, id)) SELECT id, entity FROM s WHERE type = 'view' AND t1 = 'click' AND t2 = 'purchase'")
def w8(t):
    return op.contiguous(t.event, ["view", "click", "purchase"])


@query("agg_w9_greedy_dedupe")
def w9(t):
    w = op.forward("entity", "ts", 86400)
    x = t.event.select("entity", "id", F.unix_micros("ts").alias("start"), F.max(F.unix_micros("ts")).over(w).alias("end"), F.count("*").over(w).cast("double").alias("confidence"), F.collect_list("id").over(w).alias("events"))
    return op.greedy_dedupe(x.where("confidence >= 3"))


@query("agg_w10_greedy_clusters", ctes("event").replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT entity, id, ts, row_number() OVER (PARTITION BY entity ORDER BY ts, id) AS i FROM event),
x AS (SELECT a.entity, a.id, a.i, count(*) AS n FROM o a JOIN o b ON b.entity = a.entity AND b.i >= a.i AND b.ts <= a.ts + INTERVAL 24 HOUR GROUP BY a.entity, a.id, a.i),
w AS (SELECT entity, CAST(1 AS BIGINT) AS i FROM o WHERE i = 1 UNION ALL SELECT w.entity, CASE WHEN n >= 4 THEN w.i + n ELSE w.i + 1 END FROM w JOIN x ON x.entity = w.entity AND x.i = w.i)
SELECT x.entity, id AS first_id, n FROM x JOIN w ON w.entity = x.entity AND w.i = x.i WHERE n >= 4""")
def w10(t):
    return op.greedy_clusters(t.event, least=4)


@query("agg_w11_off_hours", ctes("event") + "SELECT entity, count(*) AS n FROM event WHERE dayofweek(ts) IN (0, 6) OR hour(ts) < 6 OR hour(ts) >= 22 GROUP BY entity HAVING count(*) >= 3")
def w11(t):
    return op.off_hours(t.event)


#: Steps that occur in a company's life, dealt over the events.
STEPS = sorted({x for book in PLAYBOOKS.values() for x in book[0]})
LIFE = f"SELECT user_id AS entity, ts, CASE event_id % {len(STEPS)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(STEPS)) + " END AS type FROM events WHERE value > 60"


def book_sql(name, book):
    """One playbook over f, a row an entity with the first time of each type."""
    steps, absent, days, severity, typology = book
    present = [x for x in steps if x not in absent]
    met = []
    for k, x in enumerate(steps):
        before = [f"f.{y}" for y in present if y in steps[:k]]
        since = f"coalesce({', '.join(before)})" if before else "NULL"
        met.append(f"f.{x} IS NULL" if x in absent else f"f.{x} IS NOT NULL AND coalesce(floor((epoch_us(f.{x}) - epoch_us({since})) / 86400000000) <= {days}, true)" if before else f"f.{x} IS NOT NULL")
    listed = ", ".join(f"({m})::INT" for m in met)
    return f"""SELECT entity, '{name}' AS playbook, round(list_sum(m) / {len(steps)}, 6) AS confidence, list_max([m[k] * k for k in range(1, {len(steps) + 1})])::INT AS stage,
 ([{', '.join(f"'{x}'" for x in steps)}])[list_max([m[k] * k for k in range(1, {len(steps) + 1})]) + 1] AS next, '{severity}' AS severity, '{typology}' AS typology FROM (SELECT entity, [{listed}] AS m FROM f) WHERE list_sum(m) / {len(steps)} >= 0.5"""


@query("agg_w12_playbook", f"WITH event AS ({LIFE}), f AS (SELECT entity, {', '.join(f"min(ts) FILTER (WHERE type = '{x}') AS {x}" for x in STEPS)} FROM event GROUP BY entity) " + " UNION ALL ".join(book_sql(k, b) for k, b in PLAYBOOKS.items()))
def w12(t):
    return op.playbooks(t.sql(LIFE))


@query("agg_w12_strict_order", f"""WITH RECURSIVE event AS ({LIFE}), w AS (SELECT entity, 0 AS k, CAST(NULL AS TIMESTAMP) AS anchor, CAST(NULL AS TIMESTAMP) AS last, 0 AS n, 0 AS stage FROM (SELECT DISTINCT entity FROM event)
UNION ALL SELECT entity, k + 1, coalesce(anchor, hit), CASE WHEN met THEN hit ELSE last END, n + met::INT, CASE WHEN met THEN k + 1 ELSE stage END FROM (SELECT *, hit IS NOT NULL AND (anchor IS NULL OR floor((epoch_us(hit) - epoch_us(anchor)) / 86400000000) <= 365) AS met
 FROM (SELECT w.*, (SELECT min(e.ts) FROM event e WHERE e.entity = w.entity AND e.type = (['formed', 'foreign_owner_added', 'owner_changed', 'owner_changed'])[w.k + 1] AND (w.last IS NULL OR e.ts > w.last)) AS hit FROM w WHERE k < 4)))
SELECT entity, round(n / 4, 6) AS confidence, stage, (['formed', 'foreign_owner_added', 'owner_changed', 'owner_changed'])[stage + 1] AS next FROM w WHERE k = 4 AND n / 4 >= 0.5""")
def w12_strict(t):
    steps, absent, days, *_ = PLAYBOOKS["ownership_layering"]
    return op.playbook(t.sql(LIFE), steps, days, absent, strict_order=True)


@query("agg_w13_next_event", f"""WITH event AS ({LIFE}), f AS (SELECT entity, {', '.join(f"min(ts) FILTER (WHERE type = '{x}') AS {x}" for x in STEPS)} FROM event GROUP BY entity), m AS (""" + book_sql("invoice_factory", PLAYBOOKS["invoice_factory"]).replace(">= 0.5", ">= 0.6") + """)
SELECT entity, confidence, stage, array_to_string(list_filter((['formed', 'f_skatt_registered', 'vat_registered', 'address_to_virtual'])[stage + 1:], lambda x: x <> 'vat_registered'), ',') AS expected FROM m""")
def w13(t):
    return op.find_playbook(t.sql(LIFE), "invoice_factory", least=0.6).select("entity", "confidence", "stage", "expected")


#: A wide row a company, with a column a dated event.
WIDE = """SELECT p_partkey AS company, p_size % 5 AS directors, CASE WHEN p_partkey % 10 > 0 THEN CAST('1985-01-01' AS DATE) + CAST(p_partkey * 7 % 5000 AS INT) END AS formed, CASE WHEN p_partkey % 4 > 0 THEN CAST('1985-01-01' AS DATE) + CAST(p_partkey * 7 % 5000 + p_partkey % 45 - 5 AS INT) END AS f_skatt,
 CASE WHEN p_partkey % 3 = 0 THEN CAST('1992-01-01' AS DATE) + CAST(p_size * 9 AS INT) END AS vat, CASE WHEN p_partkey % 7 = 0 THEN CAST('1999-01-01' AS DATE) + CAST(p_size AS INT) END AS dissolved, p_partkey % 4 = 0 AS generic, p_size % 3 = 0 AS idle FROM part"""
DATED = {"formed": "formed", "f_skatt": "f_skatt_registered", "vat": "vat_registered", "dissolved": "dissolved"}


@query("agg_w14_event_extraction", f"WITH wide AS ({WIDE}) " + " UNION ALL ".join(f"SELECT company AS entity, '{kind}' AS type, CAST({column} AS DATE) AS day FROM wide WHERE {column} IS NOT NULL" for column, kind in DATED.items()))
def w14(t):
    return co.events_of(t.sql(WIDE), "company", DATED)


@query("agg_w15_rapid_formation", f"WITH wide AS ({WIDE}) SELECT company AS entity, CAST(date_diff('day', formed, f_skatt) AS INT) AS days, round(1 - date_diff('day', formed, f_skatt) / 30, 6) AS confidence, 'medium' AS severity FROM wide WHERE date_diff('day', formed, f_skatt) BETWEEN 0 AND 30")
def w15(t):
    return co.rapid_formation(co.events_of(t.sql(WIDE), "company", DATED)).withColumn("confidence", F.round("confidence", 6))


@query("agg_w15_dormant", f"WITH wide AS ({WIDE}) SELECT company, round(date_diff('day', formed, DATE '1998-06-30') / 365, 6) AS age, 0.5 AS confidence, 'low' AS severity FROM wide WHERE date_diff('day', formed, DATE '1998-06-30') / 365 >= 5 AND directors = 1")
def w15_dormant(t):
    return co.dormant(t.sql(WIDE), F.col("directors"), F.col("formed"), "1998-06-30").select("company", F.round("age", 6).alias("age"), "confidence", "severity")


SIGNS = {"single_director": "directors = 1", "generic_sni": "generic", "young_company": "formed > DATE '1996-06-30'", "no_employees": "idle"}


@query("agg_w15_indicators", f"WITH wide AS ({WIDE}), l AS (SELECT company, list_filter([" + ", ".join(f"CASE WHEN {x} THEN '{k}' END" for k, x in SIGNS.items()) + "], lambda x: x IS NOT NULL) AS k FROM wide) SELECT company, array_to_string(k, ',') AS matched, len(k) / 4 AS confidence, CASE WHEN len(k) >= 4 THEN 'high' ELSE 'medium' END AS severity FROM l WHERE len(k) >= 3")
def w15_indicators(t):
    return co.indicated(t.sql(WIDE), {k: F.expr(x) for k, x in SIGNS.items()}).select("company", "matched", "confidence", "severity")


CHANGES = "ch AS (SELECT person, company, from_date AS day, 'added' AS change FROM directs UNION ALL SELECT person, company, to_date, 'removed' FROM directs WHERE to_date IS NOT NULL)"


def changes(t):
    d = t.directs
    return d.select("person", "company", F.col("from_date").alias("day"), F.lit("added").alias("change")).unionByName(d.where("to_date IS NOT NULL").select("person", "company", F.col("to_date").alias("day"), F.lit("removed").alias("change")))


def rates_sql(key):
    return f"SELECT {key}, count(*) AS changes, CAST(count(*) FILTER (WHERE change = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (WHERE change = 'removed') AS BIGINT) AS removed, round(count(*) / (730 / 365.0), 6) AS per_year, count(*) / (730 / 365.0) > 2 AS high FROM ch WHERE day >= DATE '1998-01-01' - 730 AND day <= DATE '1998-01-01' GROUP BY {key}"


@query("agg_w16_director_velocity", ctes("directs", more=CHANGES) + rates_sql("person"))
def w16(t):
    return co.change_rates(changes(t), "person", "1998-01-01").withColumn("per_year", F.round("per_year", 6))


@query("agg_w16_company_velocity", ctes("directs", more=CHANGES) + rates_sql("company"))
def w16_company(t):
    return co.change_rates(changes(t), "company", "1998-01-01").withColumn("per_year", F.round("per_year", 6))


@query("agg_w16_velocity_summary", ctes("directs", more=CHANGES) + f", r AS ({rates_sql('company')}) SELECT count(*) AS keys, round(avg(per_year), 6) AS mean, max(per_year) AS largest, CAST(count(*) FILTER (WHERE high) AS BIGINT) AS n_high FROM r")
def w16_summary(t):
    return co.rate_summary(co.change_rates(changes(t), "company", "1998-01-01")).withColumn("mean", F.round("mean", 6))


@query("agg_w17_change_log", ctes("directs", more=CHANGES) + "SELECT * FROM ch")
def w17(t):
    return changes(t)


@query("agg_w18_trend", "WITH f AS (SELECT o_custkey, count(*) AS n, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS a, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS b FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN n < 2 OR a = 0 THEN 0 ELSE round((b - a) / a, 6) END AS trend FROM f")
def w18(t):
    x = op.trend(t.orders.withColumn("o", F.struct("o_orderdate", "o_orderkey")), "o_custkey", "o", "o_totalprice")
    return x.select("o_custkey", F.round("trend", 6).alias("trend"))


@query("agg_w19_adjacent_gaps", "WITH g AS (SELECT o_custkey, date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), CAST(o_orderdate AS DATE)) AS gap FROM orders) SELECT o_custkey, min(gap) AS gap FROM g GROUP BY o_custkey HAVING min(gap) < 30")
def w19_gaps(t):
    gap = F.datediff(F.to_date("o_orderdate"), F.lag(F.to_date("o_orderdate")).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return t.orders.select("o_custkey", gap.alias("gap")).groupBy("o_custkey").agg(F.min("gap").alias("gap")).where("gap < 30")


#: Directorships with each company's address, industry and formation.
BOARDS = "b AS (SELECT DISTINCT person, d.company, CASE WHEN d.company % 9 > 0 THEN d.company % 400 END AS address, CASE WHEN d.company % 8 > 0 THEN CAST(10 + d.company % 3 AS STRING) END AS industry, CASE WHEN d.company % 11 > 0 THEN CAST('1990-01-01' AS DATE) + CAST(d.company * 37 % 3000 AS INT) END AS formed FROM directs d)"


@query("agg_w19_alike_companies", ctes("directs", more=BOARDS) + """, g AS (SELECT person, date_diff('day', formed, lead(formed) OVER (PARTITION BY person ORDER BY formed, company)) AS gap FROM b WHERE formed IS NOT NULL), m AS (SELECT person, min(gap) AS gap FROM g GROUP BY person),
s AS (SELECT person, count(address) > count(DISTINCT address) AS shared_address, count(industry) > 1 AND count(DISTINCT substr(industry, 1, 2)) = 1 AS same_industry FROM b GROUP BY person HAVING count(DISTINCT company) >= 2)
SELECT s.person, shared_address, same_industry, coalesce(gap < 30, false) AS close_formation, shared_address OR same_industry OR coalesce(gap < 30, false) AS alike FROM s LEFT JOIN m ON m.person = s.person""")
def w19(t):
    return co.alike(t.sql(ctes("directs", more=BOARDS) + "SELECT * FROM b"))


@query("agg_w20_behaviour", ctes("txn") + ", b AS (SELECT id, sender, amount, avg(amount) OVER w AS mean, max(amount) OVER w AS top FROM txn WINDOW w AS (PARTITION BY sender ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT id, sender, coalesce(amount > 5 * mean, false) AS above_mean, coalesce(amount > 1.5 * top, false) AS above_max FROM b WHERE amount > 5 * mean OR amount > 1.5 * top")
def w20(t):
    return op.behaviour(t.txn)


HASHES = "h AS (SELECT event_id, user_id, sha256(CAST(event_id AS VARCHAR)) AS own, CASE WHEN event_id % 50 = 0 THEN 'x' ELSE lag(sha256(CAST(event_id AS VARCHAR))) OVER (PARTITION BY user_id ORDER BY event_id) END AS previous FROM events)"


#: Chains of two entries, the second made from the first; some stored digests and links are spoilt.
HASHES = """c AS (SELECT event_id, event_id // 2 AS chain, concat(event_type, ':', CAST(event_id AS STRING)) AS content FROM events), p AS (SELECT *, lag(sha256(content || '|')) OVER (PARTITION BY chain ORDER BY event_id) AS before FROM c),
h AS (SELECT event_id, chain, content, CASE WHEN event_id % 50 = 1 THEN 'x' ELSE before END AS previous FROM p), d AS (SELECT *, CASE WHEN event_id % 70 = 5 THEN 'y' ELSE sha256(content || '|' || coalesce(previous, '')) END AS own FROM h)"""


@query("agg_w21_hash_chain", f"WITH {HASHES}, l AS (SELECT *, lag(own) OVER (PARTITION BY chain ORDER BY event_id) AS expected FROM d) SELECT event_id, CASE WHEN previous IS DISTINCT FROM expected THEN 'link' ELSE 'content' END AS fault FROM l WHERE previous IS DISTINCT FROM expected OR own <> sha256(content || '|' || coalesce(previous, ''))")
def w21(t):
    content, nothing = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")), F.lit(None).cast("string")
    h = t.events.select("event_id", F.floor(F.col("event_id") / 2).alias("chain"), content.alias("content"))
    before = F.lag(op.entry_digest(F.col("content"), nothing)).over(Window.partitionBy("chain").orderBy("event_id"))
    h = h.withColumn("previous", F.when(F.col("event_id") % 50 == 1, "x").otherwise(before))
    h = h.withColumn("own", F.when(F.col("event_id") % 70 == 5, "y").otherwise(op.entry_digest(F.col("content"), F.col("previous"))))
    return op.verify_chain(h, "chain", "event_id", F.col("content"), "own", "previous").select("event_id", "fault")


@query("agg_w22_trend_bonus", ctes("event") + ", s AS (SELECT id, count(*) FILTER (WHERE value >= 50) OVER (PARTITION BY entity ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM event) SELECT id, CASE WHEN k >= 2 THEN round(least(0.15, 0.05 * k), 6) ELSE 0 END AS bonus FROM s")
def w22(t):
    k = F.count_if(F.col("value") >= 50).over(Window.partitionBy("entity").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1))
    return t.event.select("id", F.when(k >= 2, F.round(F.least(F.lit(0.15), 0.05 * k), 6)).otherwise(F.lit(0.0)).alias("bonus"))


@query("st_03_rate_limit", ctes("event") + ", w AS (SELECT id, count(*) OVER (PARTITION BY entity ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS n FROM event) SELECT id, n FROM w WHERE n > 3")
def st3(t):
    return op.rate_limited(t.event, "entity", "ts", 12 * 3600, 3).select("id", "n")
