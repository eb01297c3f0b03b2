"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from tarn.functions import identifiers, names
from tarn.operators import scores
from tarn.plans.catalog import QUERIES
from tarn.session import session

HEADLINE = [
    "agg_w2_structuring", "agg_w4_smurfing", "agg_w6_bursts", "jn_06_shared_directors", "jn_09_rapid_in_out", "jn_10_rapid_movement", "ag_05_distribution", "ag_10_flow_nodes",
    "flt_01_rules_engine", "sc_03_company_risk", "sc_05_shell_indicators", "sf_11_organisation_number", "sf_12_personal_number", "sf_20_company_name", "er_05_decisions", "er_11_watchlist",
    "gr_02_expand", "gr_23_clustering", "gr_25_components", "tx_01_extract", "tx_04_sentiment", "tx_05_vocabulary",
]


def throughput(spark) -> dict[str, object]:
    """Row functions over a million rows, for the published per-10,000 limits."""
    n = F.col("id")
    rows = spark.range(1_000_000)
    body = F.concat(F.lpad((n % 90 + 10).cast("string"), 2, "0"), F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lpad((n % 1000).cast("string"), 3, "0"))
    name = F.concat(F.lit("Den Bolaget "), n.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (" AB", " Handelsbolag", ", aktiebolag (i likvidation)")]), (n % 3 + 1).cast("int")))
    risk = scores.company_risk(n % 5, n % 200_000, n % 4 == 0, n % 900, n % 9 == 0, n % 40 / 10, n % 3 != 0, n % 10 / 10, n % 50 == 0)
    return {
        "rows_1m_personal_number": rows.select(identifiers.personal_number(F.concat(body, (n % 10).cast("string")), F.to_date(F.lit("2026-01-01"))).alias("x")),
        "rows_1m_organisation_number": rows.select(identifiers.organisation_number(F.lpad((n * 7919).cast("string"), 10, "5")).alias("x")),
        "rows_1m_company_name": rows.select(names.company_name(name).alias("x")),
        "rows_1m_company_risk": rows.select(risk.alias("x")),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="8g")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        made = million[name] if name in million else QUERIES[name](spark, folder)
        made.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    million = throughput(spark)
    run(HEADLINE[0])  # starts the workers and compiles the common code
    seconds = {name: round(run(name), 3) for name in [*HEADLINE, *million]}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
