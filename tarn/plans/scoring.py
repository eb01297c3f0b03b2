"""Score queries, over features derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import casework as case
from ..operators import scores as op
from .views import ctes, query

R = lambda x: F.round(x, 6)
FEATURES = """f AS (SELECT p_partkey AS id, CAST(p_size % 6 AS INT) AS employees, CAST(p_retailprice * 100 AS DOUBLE) AS revenue, p_partkey % 4 = 0 AS generic, CAST(p_partkey % 900 AS INT) AS age_days, p_partkey % 9 = 0 AS postal, (p_partkey % 40) / 10.0 AS velocity,
 p_partkey % 3 <> 0 AS reports, (p_partkey % 10) / 10.0 AS foreign_share, p_partkey % 50 = 0 AS circular, p_partkey % 8 = 0 AS foreign_director, CAST(p_partkey % 5 AS INT) AS shared, p_partkey % 7 = 0 AS dormant, p_partkey % 6 <> 0 AS f_skatt, p_partkey % 5 <> 0 AS vat FROM part)"""


def features(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), (F.col("p_size") % 6).cast("int").alias("employees"), (F.col("p_retailprice") * 100).alias("revenue"), (k % 4 == 0).alias("generic"), (k % 900).cast("int").alias("age_days"), (k % 9 == 0).alias("postal"), (k % 40 / 10).alias("velocity"), (k % 3 != 0).alias("reports"), (k % 10 / 10).alias("foreign_share"), (k % 50 == 0).alias("circular"), (k % 8 == 0).alias("foreign_director"), (k % 5).cast("int").alias("shared"), (k % 7 == 0).alias("dormant"), (k % 6 != 0).alias("f_skatt"), (k % 5 != 0).alias("vat"))


def term(condition, value):
    return f"CASE WHEN {condition} THEN {value} ELSE 0 END"


c = F.col


def picked(value, options):
    """The option that equals the value, as a CASE in both dialects."""
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in options.items() if k) + f" ELSE '{options[None]}' END"


SEEN = picked("type", {"error": "structuring", "purchase": "rapid_in_out", "signup": "new_counterparty", "click": "round_amounts", None: "unusual_time"})
PATTERNS = f"p AS (SELECT entity, {SEEN} AS pattern, least(value / 100, 1.0) AS confidence, entity % 3 <> 0 AS affects_person FROM event WHERE value IS NOT NULL)"
TIER = "CASE WHEN NOT {1} THEN 1 WHEN {0} >= 0.85 THEN 3 WHEN {0} >= 0.5 THEN 2 ELSE 1 END"


@query("sc_01_pattern_risk", ctes("event", more=PATTERNS) + f""", w AS (SELECT *, CASE pattern WHEN 'structuring' THEN 1.0 WHEN 'rapid_in_out' THEN 0.8 WHEN 'velocity_spike' THEN 0.7 WHEN 'dormant_reactivation' THEN 0.6 WHEN 'round_amounts' THEN 0.4 WHEN 'unusual_time' THEN 0.3 ELSE 0.5 END::DOUBLE AS w FROM p),
s AS (SELECT entity, round(least(1.0, sum(confidence * w) / sum(w) + least(0.2, 0.05 * count(*))), 6) AS score, count(*) AS n, bool_or(affects_person) AS affects FROM w GROUP BY entity) SELECT entity, score, {TIER.format('score', 'affects')} AS tier, n FROM s""")
def sc_01(t):
    seen = t.event.where("value IS NOT NULL").select("entity", F.expr(SEEN).alias("pattern"), F.least(c("value") / 100, F.lit(1.0)).alias("confidence"), (c("entity") % 3 != 0).alias("affects_person"))
    return case.pattern_risk(seen).withColumn("score", R(c("score")))


@query("sc_02_person_risk", f"WITH {FEATURES} SELECT id, round(least(1.0, {term('shared + employees >= 5', 'least(0.3, 0.1 + 0.05 * (shared + employees - 5))')} + least(0.5, 0.3 * (shared % 3)) + {term('velocity > 2', 'least(0.2, 0.1 * (velocity - 2))')} + least(0.15, 0.05 * employees) + 0.2 * foreign_share), 6) AS score FROM f")
def sc_02(t):
    return features(t).select("id", R(op.person_risk(c("shared") + c("employees"), c("shared") % 3, c("velocity"), c("employees"), c("foreign_share"))).alias("score"))


@query("sc_03_company_risk", f"WITH {FEATURES} SELECT id, round(least(1.0, {term('employees = 0', 0.15)} + {term('revenue < 100000', 0.15)} + {term('generic', 0.15)} + {term('age_days / 30 < 12', '0.1 * (1 - age_days / 30 / 12)')} + {term('postal', 0.15)} + {term('velocity > 2', 'least(0.2, 0.1 * (velocity - 2))')} + {term('NOT reports', 0.15)} + {term('foreign_share > 0.5', 'least(0.2, foreign_share * 0.2)')} + {term('circular', 0.2)}), 6) AS score FROM f")
def sc_03(t):
    return features(t).select("id", R(op.company_risk(c("employees"), c("revenue"), c("generic"), c("age_days"), c("postal"), c("velocity"), c("reports"), c("foreign_share"), c("circular"))).alias("score"))


@query("sc_04_address_risk", ctes("company", "directs") + f", a AS (SELECT address, count(DISTINCT c.company) AS companies, count(DISTINCT person) AS persons FROM company c LEFT JOIN directs d ON d.company = c.company GROUP BY address) SELECT address, round(least(1.0, {term('companies >= 10', 'least(0.4, 0.1 + 0.05 * companies / greatest(persons, 1))')} + CASE address % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.2 WHEN 2 THEN 0.1 ELSE 0 END + {term('address % 10 / 10 > 0.3', 'least(0.2, address % 10 / 10 * 0.3)')}), 6) AS score FROM a")
def sc_04(t):
    a = t.company.join(t.directs, "company", "left").groupBy("address").agg(F.countDistinct("company").alias("companies"), F.countDistinct("person").alias("persons"))
    level = F.when(c("address") % 4 == 0, "PARTICULARLY").when(c("address") % 4 == 1, "RISK").when(c("address") % 4 == 2, "OTHER")
    return a.select("address", R(op.address_risk(c("companies"), c("persons"), level, c("address") % 10 / 10)).alias("score"))


A_FLAGS = {"no_employees": "employees = 0", "minimal_revenue": "revenue < 100000", "generic_sni_code": "generic", "recently_formed": "age_days < 365", "no_physical_address": "postal", "high_director_turnover": "velocity > 2", "no_annual_reports": "NOT reports", "foreign_director": "foreign_director", "multiple_directors_shared": "shared >= 2", "dormant": "dormant"}
B_FLAGS = {"no_employees": "employees = 0", "minimal_revenue": "revenue < 100000", "generic_sni_code": "generic", "c_o_address": "postal", "no_annual_reports": "NOT reports"}
D_FLAGS = {"no_employees": "employees = 0", "generic_sni": "generic", "recently_formed": "age_days < 365", "f_skatt_no_vat": "f_skatt AND NOT vat", "single_director": "shared = 1", "no_revenue": "revenue < 95000"}
F_FLAGS = {"no_tax_registrations": "NOT f_skatt AND NOT vat", "f_skatt_no_vat": "f_skatt AND NOT vat", "vat_no_f_skatt": "vat AND NOT f_skatt", "no_employees": "employees = 0", "ab_no_activity": "dormant", "generic_sni": "generic", "recently_formed": "age_days < 730"}


def shell(flags, weights):
    return "least(1.0, " + " + ".join(term(flags[k], w) for k, w in weights.items()) + ")", "[x for x in [" + ", ".join(f"CASE WHEN {flags[k]} THEN '{k}' END" for k in weights) + "] if x IS NOT NULL]"


def shell_sql(flags, weights, high, medium):
    score, names = shell(flags, weights)
    return f"WITH {FEATURES}, s AS (SELECT id, round({score}, 6) AS score, array_to_string(list_sort({names}), ',') AS flags FROM f) SELECT id, score, flags, CASE WHEN score >= {high} THEN 'high' WHEN score >= {medium} THEN 'medium' ELSE 'low' END AS band FROM s"


def shell_query(t, flags, weights, high, medium):
    score, names = op.flagged({k: F.expr(flags[k]) for k in weights}, weights)
    x = features(t).select("id", R(score).alias("score"), names.alias("flags"))
    return x.withColumn("band", op.bands(c("score"), high, medium))


@query("sc_05_shell_indicators", shell_sql(A_FLAGS, op.SHELL_INDICATORS, 0.6, 0.4).replace(", CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band", ", CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END AS n, len(string_split(flags, ',')) >= 3 OR score >= 0.4 AS shell_like"))
def sc_05(t):
    x = shell_query(t, A_FLAGS, op.SHELL_INDICATORS, 0.6, 0.4)
    n = F.when(c("flags") == "", 0).otherwise(F.size(F.split("flags", ",")))
    return x.select("id", "score", "flags", n.alias("n"), op.shell_like(c("score"), n).alias("shell_like"))


for _name, _flags, _weights, _high, _medium in (("sc_06_shell_network", B_FLAGS, op.SHELL_NETWORK, 0.6, 0.4), ("sc_08_shell_registry", D_FLAGS, op.SHELL_REGISTRY, 0.6, 0.4), ("sc_24_shell_tax", F_FLAGS, op.SHELL_TAX, 0.5, 0.25)):
    query(_name, shell_sql(_flags, _weights, _high, _medium))(lambda t, a=_flags, w=_weights, h=_high, m=_medium: shell_query(t, a, w, h, m))


@query("sc_07_shell_mean", f"WITH {FEATURES}, s AS (SELECT id, (employees = 0)::INT + postal::INT + (f_skatt AND NOT vat)::INT + (age_days < 365)::INT + generic::INT + (velocity > 2)::INT + dormant::INT AS n FROM f) SELECT id, round(n / 7, 6) AS score, round(n / 7 * 3, 6) AS z FROM s")
def sc_07(t):
    n = sum(x.cast("int") for x in (c("employees") == 0, c("postal"), c("f_skatt") & ~c("vat"), c("age_days") < 365, c("generic"), c("velocity") > 2, c("dormant")))
    return features(t).select("id", R(n / 7).alias("score"), R(n / 7 * 3).alias("z"))


@query("sc_09_demo_shell", ctes("company", "directs") + f", p AS (SELECT person, count(DISTINCT company) AS n FROM directs GROUP BY person), s AS (SELECT DISTINCT company FROM directs d JOIN p ON p.person = d.person WHERE n >= 15), a AS (SELECT address FROM company GROUP BY address HAVING count(*) >= 10) SELECT c.company, round({term('s.company IS NOT NULL', 0.3)} + {term('a.address IS NOT NULL', 0.2)} + {term('NOT f_skatt', 0.2)} + {term('employees < 3', 0.15)}, 6) AS score FROM company c LEFT JOIN s ON s.company = c.company LEFT JOIN a ON a.address = c.address")
def sc_09(t):
    d = t.directs.select("person", "company").distinct()
    serial = d.groupBy("person").agg(F.count("*").alias("n")).where("n >= 15")
    s = d.join(serial, "person", "left_semi").select(c("company").alias("s")).distinct()
    a = t.company.groupBy(c("address").alias("a")).agg(F.count("*").alias("n")).where("n >= 10").select("a")
    x = t.company.join(s, c("company") == c("s"), "left").join(a, c("address") == c("a"), "left")
    one = lambda p, w: F.when(p, w).otherwise(0.0)
    return x.select("company", R(one(c("s").isNotNull(), 0.3) + one(c("a").isNotNull(), 0.2) + one(~c("f_skatt"), 0.2) + one(c("employees") < 3, 0.15)).alias("score"))


@query("sc_10_z_scores", "WITH n AS (SELECT c_nationkey AS address, count(*) AS d, avg(c_acctbal) AS b FROM customer GROUP BY c_nationkey), s AS (SELECT avg(d) AS md, stddev_samp(d) AS sd, avg(b) AS mb, stddev_samp(b) AS sb FROM n) SELECT address, round((d - md) / greatest(sd, 0.1), 6) AS z_density, round((b - mb) / greatest(sb, 0.1), 6) AS z_balance, round(greatest((d - md) / greatest(sd, 0.1), (b - mb) / greatest(sb, 0.1)), 6) AS composite FROM n, s")
def sc_10(t):
    n = t.customer.groupBy(c("c_nationkey").alias("address")).agg(F.count("*").alias("d"), F.avg("c_acctbal").alias("b"))
    s = n.agg(F.avg("d").alias("md"), F.stddev_samp("d").alias("sd"), F.avg("b").alias("mb"), F.stddev_samp("b").alias("sb"))
    zd, zb = op.anomaly(c("d"), c("md"), c("sd")), op.anomaly(c("b"), c("mb"), c("sb"))
    return n.join(F.broadcast(s)).select("address", R(zd).alias("z_density"), R(zb).alias("z_balance"), R(F.greatest(zd, zb)).alias("composite"))


AML = (("country", "id % 11 = 0", "0.9", 1.5), ("offshore", "id % 11 = 1", "0.5", 1.2), ("pep", "id % 13 = 0", "0.7", 1.5), ("sanctioned", "id % 101 = 0", "1.0", 2.0), ("industry", "generic", "0.6", 1.2), ("ownership", "shared > 0", "least(1.0, 0.2 * shared)", 1.0))


@query("sc_11_aml_entity_risk", f"WITH {FEATURES}, s AS (SELECT id, " + " + ".join(term(a, w) for _, a, _, w in AML) + " AS w, " + " + ".join(term(a, f"{s} * {w}") for _, a, s, w in AML) + " AS s FROM f), r AS (SELECT id, CASE WHEN id % 101 = 0 THEN 1.0 WHEN w > 0 THEN s / w ELSE 0 END AS score FROM s) SELECT id, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'very_high' WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM r")
def sc_11(t):
    return op.factor_score(features(t), {n: (F.expr(a), F.expr(s).cast("double"), w) for n, a, s, w in AML}).select("id", R(c("score")).alias("score"), "level")


CHANNEL = picked("kind", {"cash_deposit": "cash", "withdrawal": "check", None: "giro"})


@query("sc_12_transaction_risk", ctes("txn") + f""", h AS (SELECT id, amount, {CHANNEL} AS kind, sender % 10 / 10.0 AS sr, receiver % 8 / 8.0 AS rr,
 avg(amount::DOUBLE) OVER b AS mean, max(amount::DOUBLE) OVER b AS largest FROM txn WINDOW b AS (PARTITION BY sender ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT id, amount, CASE WHEN amount >= 1000000 THEN 1.2 WHEN amount >= 500000 THEN 1.0 WHEN amount >= 150000 THEN 0.8 ELSE 0 END AS aw, CASE WHEN amount >= 1000000 THEN 0.7 WHEN amount >= 500000 THEN 0.5 ELSE 0.3 END AS a,
 CASE WHEN kind = 'cash' THEN 1.1 WHEN kind = 'check' THEN 0.9 ELSE 0 END AS kw, CASE WHEN kind = 'cash' THEN 0.6 ELSE 0.3 END AS k, CASE WHEN sr >= 0.5 THEN 1.0 ELSE 0 END AS sw, sr, CASE WHEN rr >= 0.5 THEN 1.0 ELSE 0 END AS rw, rr,
 CASE WHEN amount > 5 * mean THEN 1.0 ELSE 0 END AS uw, CASE WHEN amount > 1.5 * largest THEN 0.8 ELSE 0 END AS nw FROM h),
s AS (SELECT id, round(coalesce((aw * a + kw * k + sw * sr + rw * rr + uw * 0.6 + nw * 0.4)::DOUBLE / nullif(aw + kw + sw + rw + uw + nw, 0), 0.1), 6) AS score FROM f)
SELECT id, score, CASE WHEN score >= 0.75 THEN 'very_high' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM s""")
def sc_12(t):
    before = Window.partitionBy("sender").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    value = c("amount").cast("double")
    x = t.txn.select("id", value.alias("amount"), F.expr(CHANNEL).alias("kind"), (c("sender") % 10 / 10).alias("sr"), (c("receiver") % 8 / 8).alias("rr"), F.avg(value).over(before).alias("mean"), F.max(value).over(before).alias("largest"))
    x = case.payment_risk(x, case.payment_factors(*[c(k) for k in ("amount", "kind", "sr", "rr", "mean", "largest")]))
    return x.select("id", R(c("score")).alias("score"), "level")


@query("sc_13_construction", f"WITH {FEATURES}, s AS (SELECT id, shared + employees AS n, dormant::INT AS o FROM f) SELECT id, round(n / 11, 6) AS probability, CASE WHEN n >= 4 AND o = 0 THEN 'critical' WHEN n >= 3 AND o = 0 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS level, round(1 - 0.1 * (11 - n), 6) AS confidence FROM s")
def sc_13(t):
    p, level, confidence = op.construction(c("shared") + c("employees"), c("dormant").cast("int"))
    return features(t).select("id", R(p).alias("probability"), level.alias("level"), R(confidence).alias("confidence"))


@query("sc_14_bankruptcy", f"""WITH {FEATURES} SELECT id, round(0.25 * (foreign_share * 0.6 + velocity / 4 * 0.4) + 0.25 * (least(shared * 0.15, 0.6) + least(employees * 0.1, 0.3)) + 0.30 * least(1.0, {term('0.4 - foreign_share < -0.2', 0.2)} + {term('0.5 - velocity / 4 < -0.2', 0.2)} + least(employees * 0.1, 0.3) + least(shared * 0.05, 0.2))
+ 0.20 * (1 - (CASE WHEN velocity < 2 THEN greatest(0.0, 1 - velocity) ELSE 0 END + least(1.0, velocity / 2) + CASE WHEN foreign_share - 1 > -0.5 THEN 0.5 + foreign_share - 1 ELSE 0 END) / 3), 6) AS probability FROM f""")
def sc_14(t):
    f, v = c("foreign_share"), c("velocity")
    return features(t).select("id", R(op.bankruptcy(f, v / 4, c("shared"), c("employees"), 0.4 - f, 0.5 - v / 4, c("employees"), c("shared"), v, v, f - 1)).alias("probability"))


@query("sc_15_evasion", ctes("company", "directs", "transfer") + """, d AS (SELECT DISTINCT person, company FROM directs), r AS (SELECT person, count(*) AS n FROM d GROUP BY person),
b AS (SELECT d.company, count(*) AS directors, count(*) FILTER (WHERE n = 1) AS lonely FROM d JOIN r ON r.person = d.person GROUP BY d.company), a AS (SELECT address, count(*) - 1 AS others FROM company GROUP BY address),
p AS (SELECT dst, count(DISTINCT src) AS partners, count(*) AS n, count(*) FILTER (WHERE amount > 127500 AND amount < 150000) AS below FROM transfer GROUP BY dst), l AS (SELECT l_partkey, count(*) AS filings, count(*) FILTER (WHERE l_linestatus = 'F') AS on_time FROM lineitem WHERE l_quantity >= 40 GROUP BY l_partkey),
s AS (SELECT c.company, (CASE WHEN directors > 0 THEN lonely / directors ELSE 1 END + CASE WHEN others = 0 THEN 0.5 ELSE 0 END + CASE WHEN coalesce(partners, 0) = 0 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(partners, 0) = 0 THEN 1.0 WHEN partners < 3 THEN 0.5 ELSE 0 END)::DOUBLE / 4 AS isolation,
 coalesce(filings > 5 AND on_time = filings AND employees < 10, false) AS compliance, coalesce(p.n > 5 AND below > 0.3 * p.n, false) AS structuring
 FROM company c LEFT JOIN b ON b.company = c.company JOIN a ON a.address = c.address LEFT JOIN p ON p.dst = c.company LEFT JOIN l ON l.l_partkey = c.company),
e AS (SELECT *, round(least(1.0, isolation * 0.4 + CASE WHEN compliance THEN 0.3 ELSE 0 END + CASE WHEN structuring THEN 0.3 ELSE 0 END), 6) AS probability FROM s)
SELECT company, round(isolation, 6) AS isolation, compliance, structuring, probability, CASE WHEN probability > 0.7 THEN 'high' WHEN probability > 0.4 THEN 'medium' ELSE 'low' END AS level FROM e""")
def sc_15(t):
    d = t.directs.select("person", "company").distinct()
    boards = d.join(d.groupBy("person").agg(F.count("*").alias("n")), "person").groupBy("company").agg(F.count("*").alias("directors"), F.count_if(c("n") == 1).alias("lonely"))
    at = t.company.groupBy("address").agg((F.count("*") - 1).alias("others"))
    paid = t.transfer.groupBy(c("dst").alias("company")).agg(F.countDistinct("src").alias("partners"), F.count("*").alias("n"), F.count_if((c("amount") > 127500) & (c("amount") < 150000)).alias("below"))
    filed = t.lineitem.where("l_quantity >= 40").groupBy(c("l_partkey").alias("company")).agg(F.count("*").alias("filings"), F.count_if(c("l_linestatus") == "F").alias("on_time"))
    x = t.company.join(boards, "company", "left").join(at, "address").join(paid, "company", "left").join(filed, "company", "left")
    partners = F.coalesce("partners", F.lit(0))
    alone, kept, split = case.isolation(c("directors"), c("lonely"), c("others"), partners, partners), case.synthetic_compliance(c("filings"), c("on_time"), c("employees") < 10), case.below_threshold(c("n"), c("below"))
    p, level = case.evasion(alone, kept, split)
    return x.select("company", R(alone).alias("isolation"), kept.alias("compliance"), split.alias("structuring"), R(p).alias("probability"), level.alias("level"))


@query("sc_16_cross_domain", ctes("event") + ", d AS (SELECT entity, type, avg(value) / 100 AS s FROM event GROUP BY entity, type) SELECT a.entity, a.type AS d1, b.type AS d2, round((a.s + b.s) / 2, 6) AS strength FROM d a JOIN d b ON a.entity = b.entity AND a.type < b.type WHERE (a.s + b.s) / 2 >= 0.15")
def sc_16(t):
    d = t.event.groupBy("entity", "type").agg((F.avg("value") / 100).alias("s"))
    per = d.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("type", "s"))).alias("v"))  # five domains at most
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["type"] > a["type"]), lambda b: F.struct(a["type"].alias("d1"), b["type"].alias("d2"), ((a["s"] + b["s"]) / 2).alias("s")))))
    x = per.select("entity", F.explode(pairs).alias("p")).where("p.s >= 0.15")
    return x.select("entity", "p.d1", "p.d2", R(c("p.s")).alias("strength"))


@query("sc_17_network_risk", ctes("directs") + ", s AS (SELECT person, count(DISTINCT company) AS n, avg(company % 10 / 10) AS m FROM directs GROUP BY person) SELECT person, round(least(1.0, m + 0.1 * n), 6) AS network, round(least(1.0, 0.3 + 0.05 * n + 0.1 * (n % 3)), 6) AS mill FROM s")
def sc_17(t):
    s = t.directs.groupBy("person").agg(F.countDistinct("company").alias("n"), F.avg(c("company") % 10 / 10).alias("m"))
    return s.select("person", R(F.least(F.lit(1.0), c("m") + 0.1 * c("n"))).alias("network"), R(F.least(F.lit(1.0), 0.3 + 0.05 * c("n") + 0.1 * (c("n") % 3))).alias("mill"))


@query("sc_18_alert_severity", ctes("company", "directs") + """, p AS (SELECT person, count(DISTINCT company) AS n, avg(company % 20 / 20.0) AS score FROM directs GROUP BY person), a AS (SELECT address, count(*) AS n, avg(employees / 50.0) AS score FROM company GROUP BY address)
SELECT 'shell_network' AS kind, person AS id, CASE WHEN score >= 0.85 OR n >= 10 THEN 'critical' WHEN score >= 0.7 OR n >= 5 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM p
UNION ALL SELECT 'registration_mill', address, CASE WHEN score >= 0.8 OR n >= 20 THEN 'critical' WHEN score >= 0.6 OR n >= 10 THEN 'high' ELSE 'medium' END FROM a
UNION ALL SELECT 'formation', company, CASE WHEN employees >= 40 THEN 'high' WHEN employees >= 30 THEN 'medium' ELSE 'low' END FROM company WHERE employees >= 25""")
def sc_18(t):
    p = t.directs.groupBy(c("person").alias("id")).agg(F.countDistinct("company").alias("n"), F.avg(c("company") % 20 / 20).alias("score"))
    a = t.company.groupBy(c("address").alias("id")).agg(F.count("*").alias("n"), F.avg(c("employees") / 50).alias("score"))
    f = t.company.select(c("company").alias("id"), (c("employees") / 50).alias("score"))
    alert = lambda df, kind, n=None: df.select(F.lit(kind).alias("kind"), c("id").cast("long").alias("id"), case.alert_severity(kind, c("score"), n).alias("severity")).where("severity IS NOT NULL")
    return alert(p, "shell_network", c("n")).unionByName(alert(a, "registration_mill", c("n"))).unionByName(alert(f, "formation"))


REVIEWED = "id, foreign_share AS score, id % 4 <> 0 AS person, CASE WHEN dormant THEN 'ann' END AS who, CASE WHEN vat THEN CASE WHEN f_skatt THEN 'approved' ELSE 'rejected' END END AS decision"


@query("sc_19_review_tier", f"""WITH {FEATURES}, r AS (SELECT {REVIEWED} FROM f), t AS (SELECT *, {TIER.format('score', 'person')} AS tier FROM r)
SELECT id, tier, CASE tier WHEN 1 THEN true WHEN 2 THEN who IS NOT NULL ELSE coalesce(decision = 'approved', false) END AS exportable,
 CASE tier WHEN 1 THEN 'no_review_needed' WHEN 2 THEN CASE WHEN who IS NULL THEN 'pending_acknowledgment' ELSE 'acknowledged' END ELSE coalesce('decision_' || decision, 'pending_approval') END AS status FROM t""")
def sc_19(t):
    x = features(t).selectExpr(*REVIEWED.split(", ")).withColumn("tier", case.review_tier(c("score"), c("person")))
    state = [c(k) for k in ("tier", "who", "decision")]
    return x.select("id", "tier", case.may_export(*state).alias("exportable"), case.review_status(*state).alias("status"))


@query("sc_20_report_priority", ctes("txn") + """, m AS (SELECT sender, sum(amount) AS total, list(CASE channel WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END) FILTER (WHERE amount >= 490000) AS k, bool_or(id % 997 = 0) AS terror FROM txn GROUP BY sender)
SELECT sender, CASE WHEN list_contains(coalesce(k, []), 'critical') OR total >= 5000000 THEN 'urgent' WHEN list_contains(coalesce(k, []), 'high') OR total >= 1000000 THEN 'high' WHEN list_contains(coalesce(k, []), 'medium') OR total >= 500000 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN terror THEN 'tfar' ELSE 'sar' END AS kind FROM m""")
def sc_20(t):
    severity = F.when(c("channel") == "1-URGENT", "critical").when(c("channel") == "2-HIGH", "high").when(c("channel") == "3-MEDIUM", "medium").otherwise("low")
    m = t.txn.groupBy("sender").agg(F.sum("amount").alias("total"), F.collect_set(F.when(c("amount") >= 490000, severity)).alias("k"), F.collect_set(F.when(c("id") % 997 == 0, "terrorist_financing").otherwise("structuring")).alias("p"))
    return m.select("sender", case.report_priority(c("k"), c("total")).alias("priority"), case.report_type(c("p")).alias("kind"))


CRIME = "CASE WHEN kind = 'cash_deposit' THEN 'money_laundering' WHEN receiver % 5 = 0 THEN 'tax_fraud' WHEN receiver % 5 = 1 THEN 'vat_fraud' WHEN receiver % 5 = 2 THEN 'violence' WHEN receiver % 5 = 3 THEN 'care_home_fraud' ELSE 'arson' END"


@query("sc_21_referral_routing", ctes("txn") + f""", q AS (SELECT id, {CRIME} AS crime, amount, 0.45 + (id % 50) / 100.0 AS sure FROM txn),
r AS (SELECT * FROM (VALUES ('EBM', 0, 500000, 0.7, 'economic_crime'), ('EBM', 0, 500000, 0.7, 'corporate_fraud'), ('EBM', 0, 500000, 0.7, 'tax_fraud'), ('SKV', 1, 50000, 0.6, 'tax_fraud'), ('SKV', 1, 50000, 0.6, 'vat_fraud'), ('SKV', 1, 50000, 0.6, 'undeclared_income'),
 ('FIU', 3, 150000, 0.5, 'money_laundering'), ('FIU', 3, 150000, 0.5, 'suspicious_transaction'), ('IVO', 4, 10000, 0.6, 'care_home_fraud'), ('POL', 5, 0, 0.7, 'violence')) v(authority, place, least, need, crime)),
m AS (SELECT q.id, q.crime, amount, authority, amount >= least AS met, row_number() OVER (PARTITION BY q.id ORDER BY least(1.0, round(sure + CASE WHEN amount >= least THEN 0.2 ELSE 0 END + CASE WHEN authority = 'EBM' AND amount >= 1000000 THEN 0.1 ELSE 0 END, 9)) DESC, place) AS k FROM q JOIN r ON r.crime = q.crime AND round(sure, 6) >= need),
g AS (SELECT id, any_value(authority) FILTER (WHERE k = 1) AS authority, bool_or(met) FILTER (WHERE k = 1) AS met, string_agg(authority, ',' ORDER BY k) FILTER (WHERE k IN (2, 3)) AS second, any_value(crime) AS crime FROM m GROUP BY id)
SELECT q.id, coalesce(authority, 'POL') AS authority, coalesce(second, '') AS secondary, coalesce(met, false) AS value_met, coalesce(amount >= 150000 AND g.crime = 'money_laundering', false) AS fiu_report FROM q LEFT JOIN g ON g.id = q.id""")
def sc_21(t):
    return case.route(t.txn.select("id", F.expr(CRIME).alias("crime_type"), "amount", F.round(0.45 + (c("id") % 50) / 100, 6).alias("confidence")))


@query("sc_22_contagion", ctes("paid") + ", n AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM paid GROUP BY least(src, dst), greatest(src, dst)) SELECT a, b, round(least(1.0, 0.2 * n), 6) AS exposure, round(0.3 * least(1.0, 0.2 * n), 6) AS impact FROM n")
def sc_22(t):
    n = t.paid.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    e = F.least(F.lit(1.0), 0.2 * c("n"))
    return n.select("a", "b", R(e).alias("exposure"), R(0.3 * e).alias("impact"))


KIND = picked("type", {"error": "layering", "purchase": "fraud", "signup": "pep", None: "other"})


@query("sc_23_case_type", ctes("event") + f""", s AS (SELECT entity, CAST(ts AS DATE) AS day, list(DISTINCT CASE WHEN id % 89 = 0 THEN 'ctf' WHEN id % 97 = 0 THEN 'sanctioned' ELSE {KIND} END) AS k FROM event GROUP BY entity, CAST(ts AS DATE))
SELECT entity, day, CASE WHEN list_has_any(k, ['sanctions', 'sanctioned']) THEN 'sanctions' WHEN list_contains(k, 'pep') THEN 'pep' WHEN list_has_any(k, ['terrorism', 'ctf']) THEN 'ctf' WHEN list_has_any(k, ['structuring', 'layering', 'smurfing', 'round_trip']) THEN 'aml' WHEN list_contains(k, 'fraud') THEN 'fraud' ELSE 'aml' END AS kind FROM s""")
def sc_23(t):
    kind = F.when(c("id") % 89 == 0, "ctf").when(c("id") % 97 == 0, "sanctioned").otherwise(F.expr(KIND))
    s = t.event.groupBy("entity", F.to_date("ts").alias("day")).agg(F.collect_set(kind).alias("k"))
    return s.select("entity", "day", case.case_type(c("k")).alias("kind"))


@query("sc_25_proxy_labels", ctes("directs") + "SELECT DISTINCT person, company FROM directs WHERE to_date IS NOT NULL AND from_date >= DATE '1996-01-01' AND to_date - DATE '1996-01-01' < 730")
def sc_25(t):
    return t.directs.where("to_date IS NOT NULL AND from_date >= DATE '1996-01-01' AND datediff(to_date, DATE '1996-01-01') < 730").select("person", "company").distinct()


ALERTED = picked("type", {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", None: "unknown"})


@query("sc_26_timeline_severity", ctes("txn", "event", "directs") + f"""SELECT id, 'payment' AS source, CASE WHEN amount >= 1000000 THEN 'significant' WHEN amount >= 100000 THEN 'moderate' WHEN amount >= 10000 THEN 'minor' ELSE 'info' END AS severity FROM txn
UNION ALL SELECT id, 'alert', CASE {ALERTED} WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'significant' WHEN 'medium' THEN 'moderate' WHEN 'low' THEN 'minor' ELSE 'info' END FROM event
UNION ALL SELECT company, 'change', CASE WHEN to_date IS NULL THEN 'minor' ELSE 'moderate' END FROM directs""")
def sc_26(t):
    row = lambda df, key, source, severity: df.select(c(key).alias("id"), F.lit(source).alias("source"), severity.alias("severity"))
    change = F.when(c("to_date").isNull(), "update").otherwise("board_change")
    return row(t.txn, "id", "payment", case.payment_event(c("amount"))).unionByName(row(t.event, "id", "alert", case.alert_event(F.expr(ALERTED)))).unionByName(row(t.directs, "company", "change", case.change_event(change)))


@query("sc_27_cash_report", ctes("txn") + "SELECT id, sender, CAST(ts AS DATE) AS day, CAST(amount AS DOUBLE) AS amount FROM txn WHERE kind = 'cash_deposit' AND amount >= 150000")
def sc_27(t):
    return t.txn.where("kind = 'cash_deposit' AND amount >= 150000").select("id", "sender", F.to_date("ts").alias("day"), c("amount").cast("double").alias("amount"))


@query("sf_46_failure_rate", "SELECT p_partkey, CASE WHEN CAST(40 + p_size AS VARCHAR) IN ('55','56','47','43') THEN 0.08 WHEN CAST(40 + p_size AS VARCHAR) IN ('70','82','64') THEN 0.05 ELSE 0.03 END AS rate FROM part")
def sf_46(t):
    return t.part.select("p_partkey", op.failure_rate((40 + c("p_size")).cast("string")).alias("rate"))
