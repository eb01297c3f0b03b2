"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import durable
from ..operators import communities, companies, trails
from ..operators import graph as op
from ..operators.aggregates import flow_nodes
from ..operators.filters import undirected
from ..operators.joins import shared_pairs
from .views import ctes, query

PAYS = ", e AS (SELECT DISTINCT src, dst FROM pay), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
ALL_PAYS = PAYS.replace("FROM pay)", "FROM paid)")
JOINED = "array_to_string({0}, '-')"


def text(path):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), "-")


def pairs(t):
    return t.pay.select("src", "dst").distinct()


def every_pair(t):
    return t.paid.select("src", "dst").distinct()


def seeds(t, *ids):
    return t.spark.createDataFrame([(i,) for i in ids], "node long")


def all_nodes(t):
    return pairs(t).select(F.col("src").alias("node")).distinct()


def recursive(body: str) -> str:
    return ctes("pay").replace("WITH ", "WITH RECURSIVE ", 1) + PAYS + ", " + body


WALK = "w AS (SELECT src AS start, dst AS node, [src, dst] AS path, 1 AS hops FROM e UNION ALL SELECT start, e.dst, list_append(path, e.dst), hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < {0} AND NOT list_contains(path, e.dst))"
LOOPS = "w AS (SELECT src AS start, dst AS node, [src, dst] AS path, 1 AS hops FROM e WHERE dst > src UNION ALL SELECT start, e.dst, list_append(path, e.dst), hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < {0} AND w.node <> start AND (e.dst = start OR (e.dst > start AND NOT list_contains(path, e.dst))))"
REACH = "reach AS (SELECT src AS a, src AS b FROM u UNION SELECT r.a, u.dst FROM reach r JOIN u ON u.src = r.b)"


@query("gr_01_neighbours", ctes("paid") + ALL_PAYS + " SELECT DISTINCT dst AS neighbour, 'out' AS way FROM e WHERE src = 7 UNION SELECT DISTINCT src, 'in' FROM e WHERE dst = 7")
def gr_01(t):
    return op.neighbours(t.paid, F.lit(7))


@query("gr_02_expand", recursive("w AS (SELECT CAST(30 AS BIGINT) AS node, 0 AS depth UNION SELECT u.dst, depth + 1 FROM w JOIN u ON u.src = w.node WHERE depth < 3) SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node"))
def gr_02(t):
    return op.expand(t.pay, seeds(t, 30), 3)


@query("gr_03_subgraph", recursive("w AS (SELECT CAST(30 AS BIGINT) AS node, 0 AS depth UNION SELECT u.dst, depth + 1 FROM w JOIN u ON u.src = w.node WHERE depth < 4), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node ORDER BY depth, node LIMIT 20) SELECT src, dst FROM e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)"))
def gr_03(t):
    kept = op.expand(t.pay, seeds(t, 30), 4).orderBy("depth", "node").limit(20)
    return pairs(t).join(kept, F.col("src") == F.col("node"), "left_semi").join(kept, F.col("dst") == F.col("node"), "left_semi")


@query("gr_04_shortest_path", recursive(WALK.format(4) + f", k AS (SELECT start, node, hops, path, row_number() OVER (PARTITION BY start, node ORDER BY hops, path) AS k FROM w WHERE start IN (7, 12, 30)) SELECT start, node, {JOINED.format('path')} AS path, hops FROM k WHERE k = 1"))
def gr_04(t):
    return op.shortest_paths(pairs(t), seeds(t, 7, 12, 30), 4).select("start", "node", text("path").alias("path"), "hops")


@query("gr_05_all_paths", recursive(WALK.format(4) + f" SELECT start, node, {JOINED.format('path')} AS path, round(pow(0.9, hops), 6) AS confidence FROM w WHERE start IN (7, 12)"))
def gr_05(t):
    return op.paths(pairs(t), seeds(t, 7, 12), 4).select("start", "node", text("path").alias("path"), F.round(F.pow(F.lit(0.9), "hops"), 6).alias("confidence"))


FLOW = "f AS (SELECT src, dst, CAST(sum(amount) AS DOUBLE) AS v FROM pay GROUP BY src, dst), w AS (SELECT src AS start, dst AS node, [src, dst] AS path, v AS value, 1 AS hops FROM f UNION ALL SELECT start, f.dst, list_append(path, f.dst), value + v, hops + 1 FROM w JOIN f ON f.src = w.node WHERE hops < 3 AND NOT list_contains(path, f.dst))"


def flow(t):
    return t.pay.groupBy("src", "dst").agg(F.sum("amount").cast("double").alias("v"))


def flow_paths(t):
    return op.paths(flow(t), all_nodes(t), 3, carry=("v",)).withColumn("value", F.aggregate("v_path", F.lit(0.0), lambda a, x: a + x))


@query("gr_06_flow_paths", recursive(FLOW + f" SELECT {JOINED.format('path')} AS path, round(value, 2) AS value FROM w"))
def gr_06(t):
    return flow_paths(t).select(text("path").alias("path"), F.round("value", 2).alias("value"))


@query("gr_07_circular_flows", recursive(LOOPS.format(5) + f" SELECT {JOINED.format('path')} AS path, CAST(hops AS INT) AS hops FROM w WHERE node = start AND hops >= 2"))
def gr_07(t):
    return op.cycles(pairs(t), 5).select(text("path").alias("path"), "hops")


@query("gr_08_pass_through_layers", recursive(FLOW + f""", o AS (SELECT src AS n, sum(v) AS v_out FROM f GROUP BY src), i AS (SELECT dst AS n, sum(v) AS v_in FROM f GROUP BY dst), p AS (SELECT o.n FROM o JOIN i ON o.n = i.n WHERE v_out / v_in BETWEEN 0.5 AND 2)
SELECT {JOINED.format('path')} AS path FROM w WHERE hops = 3 AND path[2] IN (SELECT n FROM p) AND path[3] IN (SELECT n FROM p)"""))
def gr_08(t):
    n = flow_nodes(flow(t), "src", "dst", "v").where(F.try_divide("v_out", "v_in").between(0.5, 2)).select("node")
    x = flow_paths(t).where("hops = 3").select(F.col("path"), F.get("path", F.lit(1)).alias("p1"), F.get("path", F.lit(2)).alias("p2"))
    return x.join(n, F.col("p1") == F.col("node"), "left_semi").join(n, F.col("p2") == F.col("node"), "left_semi").select(text("path").alias("path"))


T = "t AS (SELECT id, src, dst, CAST(epoch(ts) AS BIGINT) AS sec, amount FROM transfer{0})"
BAND = "CASE WHEN {0} >= {2} OR {1} >= 1000000 THEN 'critical' WHEN {0} >= {3} OR {1} >= 500000 THEN 'high' WHEN {0} >= {4} OR {1} >= 200000 THEN 'medium' ELSE 'low' END"
CHAIN = ctes("transfer").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {T.format('')},
w AS (SELECT [src, dst] AS path, [id] AS ids, dst AS node, sec AS first, sec AS last, amount, amount AS smallest, 1 AS hops FROM t WHERE amount >= 50000
 UNION ALL SELECT list_append(path, t.dst), list_append(ids, t.id), t.dst, first, t.sec, w.amount, least(smallest, t.amount), hops + 1
 FROM w JOIN t ON t.src = w.node WHERE hops < 10 AND t.sec >= last AND t.sec <= first + 72 * 3600 AND t.amount >= 50000 AND NOT list_contains(path, t.dst))
SELECT {JOINED.format('path')} AS path, {JOINED.format('ids')} AS transactions, CAST(hops AS INT) AS hops, (last - first) / 3600.0 AS hours, CAST(amount AS DOUBLE) AS amount, {BAND.format('hops', 'smallest', 7, 5, 4)} AS severity, round(0.7 + least(0.25, hops * 0.05), 6) AS confidence
FROM w WHERE hops >= 3 AND """


def chains(df):
    return df.select(text("path").alias("path"), text("transactions").alias("transactions"), "hops", "hours", F.col("amount").cast("double").alias("amount"), "severity", F.round("confidence", 6).alias("confidence"))


@query("gr_09_layering_chains", CHAIN + "(hops = 10 OR NOT EXISTS (SELECT 1 FROM t WHERE t.src = w.node AND t.sec >= w.last AND NOT list_contains(w.path, t.dst)))")
def gr_09(t):
    return chains(trails.layering(t.transfer))


@query("gr_09_layering_in_window", CHAIN + "(hops = 10 OR NOT EXISTS (SELECT 1 FROM t WHERE t.src = w.node AND t.sec >= w.last AND t.sec <= w.first + 72 * 3600 AND t.amount >= 50000 AND NOT list_contains(w.path, t.dst)))")
def gr_09_window(t):
    return chains(trails.layering(t.transfer, windowed=True))


@query("gr_10_round_trips", ctes("transfer").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {T.format(' WHERE lots >= 48')},
o AS (SELECT src AS node, row_number() OVER (ORDER BY min(struct_pack(sec := sec, id := id))) AS place FROM t GROUP BY src),
e AS (SELECT t.*, a.place AS ps, b.place AS pd FROM t JOIN o a ON a.node = t.src JOIN o b ON b.node = t.dst),
w AS (SELECT src AS start, ps AS place, dst AS node, [src, dst] AS path, [id] AS ids, amount AS a0, amount AS a1, sec AS s0, sec AS s1, 1 AS hops FROM e WHERE pd > ps AND amount >= 50000
 UNION ALL SELECT start, place, e.dst, list_append(path, e.dst), list_append(ids, e.id), a0, e.amount, s0, e.sec, hops + 1
 FROM w JOIN e ON e.src = w.node WHERE hops < 8 AND w.node <> start AND (e.dst = start OR (e.pd > place AND NOT list_contains(path, e.dst))))
SELECT {JOINED.format('path')} AS path, {JOINED.format('ids')} AS transactions, CAST(hops AS INT) AS hops, round((a0 - a1)::DOUBLE / a0::DOUBLE, 6) AS loss, CAST(floor((s1 - s0) / 86400.0) AS BIGINT) AS days, {BAND.format('hops', 'a0', 6, 4, 3)} AS severity
FROM w WHERE node = start AND (a0 - a1) <= 0.15 * a0 AND s1 < s0 + 31 * 86400""")
def gr_10(t):
    x = trails.round_trips(t.transfer.where("lots >= 48"))
    return x.select(text("path").alias("path"), text("transactions").alias("transactions"), "hops", F.round("loss", 6).alias("loss"), "days", "severity")


OWN = "o AS (SELECT owner AS src, owned AS dst, max(share) AS share FROM owns GROUP BY owner, owned)"


@query("gr_11_ownership_chain", ctes("owns").replace("WITH", "WITH RECURSIVE", 1) + f", {OWN}, w AS (SELECT CAST(9 AS BIGINT) AS node, 0 AS depth UNION SELECT o.src, depth + 1 FROM w JOIN o ON o.dst = w.node WHERE depth < 4) SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node")
def gr_11(t):
    up = t.owns.select(F.col("owned").alias("src"), F.col("owner").alias("dst"))
    return op.expand(up, seeds(t, 9), 4, directed=True)


def owned(t):
    return t.owns.groupBy(F.col("owner").alias("src"), F.col("owned").alias("dst")).agg(F.max("share").alias("share"))


@query("gr_12_circular_ownership", recursive(LOOPS.format(6) + f" SELECT {JOINED.format('path')} AS path FROM w WHERE node = start AND hops BETWEEN 2 AND 6"))
def gr_12(t):
    return op.cycles(owned(t), 6).select(text("path").alias("path"))


@query("gr_13_layered_ownership", ctes("owns").replace("WITH", "WITH RECURSIVE", 1) + f", {OWN}, e AS (SELECT src, dst FROM o WHERE share > 50), " + WALK.format(4) + f" SELECT {JOINED.format('path')} AS path FROM w WHERE hops >= 4")
def gr_13(t):
    e = owned(t).where("share > 50")
    return op.paths(e, e.select(F.col("src").alias("node")).distinct(), 4).where("hops >= 4").select(text("path").alias("path"))


@query("gr_14_cross_border", ctes("owns").replace("WITH", "WITH RECURSIVE", 1) + f", {OWN}, e AS (SELECT src, dst FROM o), " + WALK.format(3) + " SELECT DISTINCT start, node FROM w WHERE start % 10 = 0 AND node % 10 <> 0")
def gr_14(t):
    e = owned(t)
    return op.paths(e, e.select(F.col("src").alias("node")).where("node % 10 = 0").distinct(), 3).where("node % 10 <> 0").select("start", "node").distinct()


@query("gr_15_registration_mill", ctes("company", "directs") + """, s AS (SELECT address, person FROM directs d JOIN company c ON c.company = d.company GROUP BY address, person HAVING count(DISTINCT d.company) >= 2), n AS (SELECT address, count(*) AS companies FROM company GROUP BY address)
SELECT n.address, companies, count(*) AS directors FROM n JOIN s ON s.address = n.address WHERE companies > 5 GROUP BY n.address, companies""")
def gr_15(t):
    shared = t.directs.join(t.company.select("company", "address"), "company").groupBy("address", "person").agg(F.countDistinct("company").alias("n")).where("n >= 2")
    n = t.company.groupBy("address").agg(F.count("*").alias("companies")).where("companies > 5")
    return n.join(shared.groupBy("address").agg(F.count("*").alias("directors")), "address")


@query("gr_16_rapid_rotation", ctes("directs") + "SELECT company, count(*) AS n, CAST(count(to_date) AS BIGINT) AS ended FROM directs GROUP BY company HAVING count(*) > 3 AND count(to_date) > 2 AND count(to_date) / count(*) > 0.5")
def gr_16(t):
    return companies.rotating(t.directs)


#: Companies with dates and states.
STATES = """SELECT p_partkey AS company, p_partkey % 3 <> 0 AS f_skatt, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS vat, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN p_size END AS employees, CAST('1998-06-30' AS DATE) - CAST(p_partkey % 900 AS INT) AS formed,
 CASE WHEN p_partkey % 5 = 0 THEN 'virtual' ELSE 'office' END AS address_type, CASE WHEN p_partkey % 6 = 5 THEN 'closed' ELSE 'active' END AS status, CAST('1998-06-30' AS DATE) - CAST(p_partkey % 300 AS INT) AS status_from, CASE WHEN p_partkey % 2 = 0 THEN 'dormant' END AS previous_status, CAST('1997-06-30' AS DATE) - CAST(p_partkey % 1000 AS INT) AS previous_from FROM part"""


@query("gr_16_invoice_factory", f"SELECT company FROM ({STATES}) s WHERE f_skatt AND NOT coalesce(vat, false) AND coalesce(employees, 0) = 0 AND formed > DATE '1997-06-30' AND address_type = 'virtual'")
def gr_16_invoices(t):
    return companies.invoice_factories(t.sql(STATES), "1998-06-30").select("company")


@query("gr_16_dormant_reactivation", f"SELECT company FROM ({STATES}) s WHERE status = 'active' AND previous_status = 'dormant' AND previous_from + INTERVAL 2 YEAR < status_from AND status_from > DATE '1997-12-30'")
def gr_16_reactivated(t):
    return companies.reactivated(t.sql(STATES), "1998-06-30").select("company")


@query("gr_17_nominee_network", ctes("company", "directs") + ", d AS (SELECT DISTINCT person, directs.company, agent || address AS address FROM directs JOIN company ON company.company = directs.company) SELECT person, count(*) AS n FROM d GROUP BY person HAVING count(*) > 5 AND count(*) = count(DISTINCT address)")
def gr_17(t):
    d = t.directs.select("person", "company").distinct().join(t.company.select("company", F.concat("agent", F.col("address").cast("string")).alias("address")), "company")
    return d.groupBy("person").agg(F.count("*").alias("n"), F.countDistinct("address").alias("a")).where("n > 5 AND n = a").select("person", "n")


@query("gr_18_address_hopping", ctes("txn") + "SELECT sender, count(DISTINCT receiver % 25) AS places, array_to_string(list_sort(list_distinct(list(receiver % 25))), ',') AS all_places FROM txn GROUP BY sender HAVING count(DISTINCT receiver % 25) > 3")
def gr_18(t):
    x = t.txn.groupBy("sender").agg(F.collect_set(F.col("receiver") % 25).alias("s"))
    return x.where(F.size("s") > 3).select("sender", F.size("s").cast("long").alias("places"), F.array_join(F.sort_array("s"), ",").alias("all_places"))


@query("gr_20_degree_centrality", ctes("paid") + ALL_PAYS + ", n AS (SELECT count(DISTINCT src) AS n FROM u), d AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, round(count(*) / (SELECT n - 1 FROM n), 6) AS centrality FROM d GROUP BY node")
def gr_20(t):
    d = op.degrees(every_pair(t))
    return d.join(F.broadcast(d.agg(F.count("*").alias("n")))).select("node", F.round(F.col("degree") / (F.col("n") - 1), 6).alias("centrality"))


@query("gr_21_pagerank")
def gr_21(t):
    return op.pagerank(t.paid).select("node", F.round("rank", 8).alias("rank"))


@query("gr_22_betweenness")
def gr_22(t):
    e = pairs(t)
    n = e.select(F.explode(F.array("src", "dst")).alias("x")).distinct().count()
    return op.betweenness(e, n).select("node", F.round("score", 8).alias("score"))


@query("gr_23_clustering", ctes("paid") + ALL_PAYS + ", d AS (SELECT src AS node, count(*) AS d FROM u GROUP BY src), t AS (SELECT a.src AS node, count(*) / 2 AS t FROM u a JOIN u b ON b.src = a.src AND b.dst <> a.dst JOIN u c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src) SELECT d.node, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN t ON t.node = d.node")
def gr_23(t):
    return op.clustering(t.paid).select("node", F.round("coefficient", 6).alias("coefficient"))


@query("gr_24_communities")
def gr_24(t):
    return communities.louvain(t.paid)


@query("gr_24_label_propagation")
def gr_24_labels(t):
    return op.communities(t.paid)


@query("gr_25_components", recursive(REACH + " SELECT a AS node, min(b) AS component FROM reach GROUP BY a"))
def gr_25(t):
    return op.components(t.pay)


@query("gr_26_simple_cycles", recursive(LOOPS.format(4) + " SELECT CAST(hops AS INT) AS hops, count(*) AS n FROM w WHERE node = start AND hops >= 2 GROUP BY hops"))
def gr_26(t):
    return op.cycles(pairs(t), 4).groupBy("hops").agg(F.count("*").alias("n"))


SPREAD = ", b AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), o AS MATERIALIZED (SELECT DISTINCT src AS node, (src % 10)::DOUBLE / 10 AS own FROM b), r0 AS (SELECT node, own AS risk FROM o)"
SPREAD += "".join(f", r{k + 1} AS MATERIALIZED (SELECT o.node, CASE WHEN m IS NULL THEN own ELSE (1 - 0.85) * own + 0.85 * m END AS risk FROM o LEFT JOIN (SELECT src, avg(risk) AS m FROM b JOIN r{k} ON r{k}.node = dst GROUP BY src) x ON x.src = o.node)" for k in range(10))


@query("gr_27_risk_propagation", ctes("paid") + ALL_PAYS + SPREAD + " SELECT node, round(risk, 8) AS risk FROM r10")
def gr_27(t):
    e = durable(every_pair(t))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    own = nodes.withColumn("risk", F.pmod("node", F.lit(10)) / 10)
    return op.propagate(e, own).select("node", F.round("risk", 8).alias("risk"))


@query("gr_28_neighbour_features", ctes("paid") + ALL_PAYS + " SELECT src AS node, count(*) AS degree, round(sum(dst % 10) / (10 * count(*)), 6) AS mean_risk, max(dst % 10 / 10) AS max_risk, round(avg(CASE WHEN dst % 10 >= 7 THEN 1.0 ELSE 0 END), 6) AS flagged FROM u GROUP BY src")
def gr_28(t):
    risk = F.col("dst") % 10 / 10
    return op.both_ways(t.paid).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.round(F.sum(F.col("dst") % 10) / (10 * F.count("*")), 6).alias("mean_risk"), F.max(risk).alias("max_risk"), F.round(F.avg((F.col("dst") % 10 >= 7).cast("int")), 6).alias("flagged"))


@query("gr_29_serial_directors", ctes("directs") + "SELECT person, count(DISTINCT company) AS n, CASE WHEN count(DISTINCT company) >= 25 THEN 'high' ELSE 'medium' END AS severity FROM directs GROUP BY person HAVING count(DISTINCT company) >= 3")
def gr_29(t):
    x = t.directs.groupBy("person").agg(F.countDistinct("company").alias("n")).where("n >= 3")
    return x.withColumn("severity", F.when(F.col("n") >= 25, "high").otherwise("medium"))


@query("gr_30_director_triangles", ctes("directs") + ", p AS (SELECT DISTINCT a.person AS a, b.person AS b FROM directs a JOIN directs b ON a.company = b.company AND a.person < b.person) SELECT x.a AS x, x.b AS y, y.b AS z FROM p x JOIN p y ON y.a = x.b JOIN p z ON z.a = x.a AND z.b = y.b")
def gr_30(t):
    p = shared_pairs(t.directs, "person", "company", 1).select(F.col("g1").alias("a"), F.col("g2").alias("b"))
    return op.triangles(p)


@query("gr_31_graph_build", ctes("company", "directs") + "SELECT 'directs' AS kind, CAST(person AS VARCHAR) AS src, CAST(company AS VARCHAR) AS dst FROM (SELECT DISTINCT person, company FROM directs) UNION ALL SELECT 'registered_at', CAST(company AS VARCHAR), CAST(address AS VARCHAR) FROM company WHERE address IN (SELECT address FROM company GROUP BY address HAVING count(*) >= 2)")
def gr_31(t):
    shared = t.company.groupBy("address").agg(F.count("*").alias("n")).where("n >= 2")
    at = t.company.join(shared, "address", "left_semi").select(F.lit("registered_at").alias("kind"), F.col("company").cast("string").alias("src"), F.col("address").cast("string").alias("dst"))
    return t.directs.select(F.lit("directs").alias("kind"), F.col("person").cast("string").alias("src"), F.col("company").cast("string").alias("dst")).distinct().unionByName(at)


@query("gr_32_shell_network", ctes("company", "directs") + ", s AS (SELECT DISTINCT d.person, c.company, c.address FROM directs d JOIN company c ON c.company = d.company WHERE employees < 20) SELECT person, count(*) AS shells, count(DISTINCT address) AS addresses, round(least(0.5 + 0.1 * count(*), 1.0), 6) AS risk FROM s GROUP BY person HAVING count(*) >= 3")
def gr_32(t):
    s = t.directs.select("person", "company").distinct().join(t.company.where("employees < 20").select("company", "address"), "company")
    x = s.groupBy("person").agg(F.count("*").alias("shells"), F.countDistinct("address").alias("addresses")).where("shells >= 3")
    return x.withColumn("risk", F.round(F.least(0.5 + 0.1 * F.col("shells"), F.lit(1.0)), 6))


@query("gr_33_mill_risk", ctes("company") + "SELECT address, count(*) AS companies, CAST(count(*) FILTER (WHERE employees < 10) AS BIGINT) AS shells, round(least(0.3 + 0.05 * count(*) + 0.1 * count(*) FILTER (WHERE employees < 10), 1.0), 6) AS risk FROM company GROUP BY address HAVING count(*) >= 5")
def gr_33(t):
    x = t.company.groupBy("address").agg(F.count("*").alias("companies"), F.count_if(F.col("employees") < 10).alias("shells")).where("companies >= 5")
    return x.withColumn("risk", F.round(F.least(0.3 + 0.05 * F.col("companies") + 0.1 * F.col("shells"), F.lit(1.0)), 6))


@query("gr_34_network_correlation", recursive("w AS (SELECT CAST(12 AS BIGINT) AS node, 0 AS depth UNION SELECT u.dst, depth + 1 FROM w JOIN u ON u.src = w.node WHERE depth < 2) SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node"))
def gr_34(t):
    return op.expand(t.pay, seeds(t, 12), 2)


#: Every part and customer number is a node; many have no payment of the largest lines.
VIEW = """n AS (SELECT p_partkey AS node, CAST(p_partkey % 50 AS DOUBLE) AS score FROM part), pe AS (SELECT src, dst FROM pay),
d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM pe UNION ALL SELECT dst FROM pe) GROUP BY node), r AS (SELECT n.node, coalesce(degree, 0) AS degree, score, 10 * coalesce(degree, 0) + 5 * score AS priority FROM n LEFT JOIN d ON d.node = n.node),
h AS (SELECT *, row_number() OVER (ORDER BY priority DESC, node) AS k FROM r), c AS (SELECT * FROM h WHERE degree > 0 ORDER BY k LIMIT 80), z AS (SELECT max(k) AS k, count(*) AS n FROM c),
v AS (SELECT node, degree, score, priority FROM c UNION ALL (SELECT h.node, degree, score, priority FROM h, z WHERE h.k > z.k AND z.n = 80 ORDER BY h.k LIMIT 20))"""


def view(t):
    scores = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 50).cast("double").alias("score"))
    return op.priority_view(t.pay, scores, 100)


@query("gr_35_priority_view", ctes("pay", more=VIEW) + "SELECT * FROM v")
def gr_35(t):
    return view(t)


@query("gr_35_ranked_clusters", ctes("pay", more=VIEW).replace("WITH ", "WITH RECURSIVE ", 1) + """, i AS (SELECT DISTINCT src, dst FROM pe WHERE src <> dst AND src IN (SELECT node FROM v) AND dst IN (SELECT node FROM v)), b AS (SELECT src, dst FROM i UNION SELECT dst, src FROM i),
reach AS (SELECT src AS a, src AS b FROM b UNION SELECT r.a, b.dst FROM reach r JOIN b ON b.src = r.b), m AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)
SELECT component, count(*) AS size, round(avg(score), 6) AS mean_score, max(score) AS max_score, CAST(row_number() OVER (ORDER BY max(score) DESC, count(*) DESC, component) AS INT) AS rank FROM m JOIN v ON v.node = m.node GROUP BY component""")
def gr_35_clusters(t):
    return op.ranked_clusters(t.pay, durable(view(t)).select("node", "score")).withColumn("mean_score", F.round("mean_score", 6))


@query("gr_36_hops", recursive("w AS (SELECT CAST(30 AS BIGINT) AS node, 0 AS depth UNION SELECT u.dst, depth + 1 FROM w JOIN u ON u.src = w.node WHERE depth < 3) SELECT DISTINCT node FROM w"))
def gr_36(t):
    return op.expand(t.pay, seeds(t, 30), 3).select("node")


@query("tk_06_graph_view", ctes("paid") + ALL_PAYS + ", d AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY src ORDER BY degree DESC, node LIMIT 30) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src IN (SELECT node FROM d) AND dst IN (SELECT node FROM d)")
def tk_06(t):
    top = op.both_ways(t.paid).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(30)
    inside = every_pair(t).join(top, F.col("src") == F.col("node"), "left_semi").join(top, F.col("dst") == F.col("node"), "left_semi")
    return undirected(inside)


@query("spec_01_same_as_closure", recursive(REACH + " SELECT b AS entity, min(a) AS canonical FROM reach GROUP BY b HAVING min(a) <> b"))
def spec_01(t):
    return op.components(t.pay).where("node <> component").select(F.col("node").alias("entity"), F.col("component").alias("canonical"))


@query("spec_02_bfs_first_depth", recursive("w AS (SELECT CAST(9 AS BIGINT) AS node, 0 AS depth UNION SELECT u.dst, depth + 1 FROM w JOIN u ON u.src = w.node WHERE depth < 3) SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node ORDER BY depth, node LIMIT 25"))
def spec_02(t):
    return op.expand(t.pay, seeds(t, 9), 3).orderBy("depth", "node").limit(25)


@query("spec_04_director_shells", ctes("company", "directs") + "SELECT person, count(DISTINCT d.company) AS n FROM directs d JOIN company c ON c.company = d.company WHERE employees <= 20 AND revenue < 1500 GROUP BY person HAVING count(DISTINCT d.company) >= 3")
def spec_04(t):
    shell = t.company.where("employees <= 20 AND revenue < 1500").select("company")
    return t.directs.join(shell, "company").groupBy("person").agg(F.countDistinct("company").alias("n")).where("n >= 3")
