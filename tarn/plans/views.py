"""The tables of a scale-factor folder, and the domain roles that they play in the queries.

Each role is a SELECT that Spark and DuckDB both run, so queries and their SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payments: sender, receiver, amount, time and kind.
TXN = """SELECT o_orderkey AS id, o_custkey AS sender, (o_orderkey * 7 + o_custkey) % 150 AS receiver, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS ts,
 CASE o_orderstatus WHEN 'F' THEN 'cash_deposit' WHEN 'O' THEN 'withdrawal' ELSE 'transfer' END AS kind, o_orderpriority AS channel FROM orders"""
#: Person to company edges (directorships), with a begin and an end date.
DIRECTS = """SELECT DISTINCT l_suppkey AS person, l_partkey AS company, CAST(l_shipdate AS DATE) AS from_date, CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS to_date
 FROM lineitem WHERE l_quantity >= 46 AND l_returnflag = 'R'"""
#: Companies with the attributes that scores need.
COMPANY = """SELECT p_partkey AS company, p_name AS name, p_size AS employees, p_retailprice AS revenue, p_type AS industry, p_brand AS agent, p_partkey % 25 AS address,
 p_partkey % 7 <> 0 AS f_skatt, p_partkey % 5 <> 0 AS vat, p_size % 12 AS age_years FROM part"""
#: A directed graph of all payments between entities. Nodes and edges grow with the tables.
PAID = """SELECT DISTINCT o_custkey AS src, l_partkey AS dst, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey <> l_partkey"""
#: The same for the largest lines: some two edges a node at any scale, so that simple paths can be listed.
PAY = PAID + " AND l_quantity >= 48"
#: Each of these payments by itself, with its time.
TRANSFER = """SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS src, l_partkey AS dst, o_orderdate AS ts, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, l_quantity AS lots
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey <> l_partkey"""
#: Ownership: who owns which share of whom.
OWNS = """SELECT DISTINCT o_custkey AS owner, l_partkey AS owned, CAST(40 + l_linenumber * 10 AS INT) AS share
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 48 AND o_custkey <> l_partkey"""
#: Events of entities.
EVENT = "SELECT event_id AS id, user_id AS entity, event_type AS type, ts, value FROM events"

ROLES = {"txn": TXN, "directs": DIRECTS, "company": COMPANY, "paid": PAID, "pay": PAY, "transfer": TRANSFER, "owns": OWNS, "event": EVENT}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark", "conversations")


def ctes(*roles: str, more: str = "") -> str:
    """WITH clause that names the given roles."""
    return "WITH " + ", ".join([f"{r} AS ({ROLES[r]})" for r in roles] + ([more] if more else [])) + " "


class Tables:
    """Tables and roles of a folder as DataFrames, read when asked for; naive timestamps become UTC ones."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])

    def sql(self, text: str) -> DataFrame:
        """A SELECT over the tables that it names."""
        used = {t: self.table(t) for t in TABLES if f" {t}" in text}
        for name in used:
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            return self.sql(ROLES[name])
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


REGISTRY: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query over Tables, with its SQL for DuckDB."""

    def put(f):
        REGISTRY[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put
