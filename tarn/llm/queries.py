"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align
from .decontaminate import contaminated
from .fingerprints import fingerprints
from .forest import near_duplicates
from .jaccard import jaccard_components
from .lm import lm_scores
from .mixing import mix
from .quality import quality_scores
from .records import read_records, write_records
from .shards import shard_documents
from .sortmeans import cluster, with_inertia
from .urls import filter_urls
from .warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Path of the public vocabulary that the token-ID query uses."""
    return public_vocabulary("word_bpe_49k.json")


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "similarity")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_records(_table(spark, sf_dir, "documents"), word_tokenizer()))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model"))


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_decontaminate, op3_quality, op4_jaccard_join, op5_fingerprints, op6_url_filters, op7_shards, op8_token_records, op9_warc, op10_lm_scores)
    + (op11_align_tokenizers, op12_minhash_forest, op13_sort_means)
}

#: Words of DuckDB's column `text`: A-Z lower-cased, split as the contract says.
WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def near_duplicates_sql(size: int, percent: int, more: str = "") -> str:
    """Components of documents whose sets of `size`-word shingles have a Jaccard similarity of at least `percent` in a hundred."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
found AS (SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id))
SELECT *{more} FROM found
"""


#: Every window that holds a shingle of the item, at every offset, compared as multisets; the best of each item and document, the first of
#: equals. A document shorter than the item is one window. Items of fewer than five words are left out, as the table has none.
OP2 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
ds AS (SELECT doc_id, len(ws) AS n, i AS pos, array_to_string(ws[i + 1:i + 5], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)),
bs AS (SELECT item_id, len(ws) AS n, i AS off, array_to_string(ws[i + 1:i + 5], ' ') AS sh FROM (SELECT item_id, ws, unnest(range(0, len(ws) - 4)) AS i FROM b WHERE len(ws) >= 5)),
ci AS (SELECT item_id, n - 4 AS m, sh, count(*) AS c FROM bs GROUP BY ALL),
hit AS (SELECT doc_id, item_id, m, least(m, ds.n - 4) AS w, ds.n, pos, sh, c FROM ds JOIN ci USING (sh)),
st AS (SELECT doc_id, item_id, m, w, sh, c, unnest(range(greatest(0, pos - w + 1), least(pos, n - 4 - w) + 1)) AS s FROM hit),
cw AS (SELECT doc_id, item_id, m, w, s, least(count(*), any_value(c)) AS k FROM st GROUP BY doc_id, item_id, m, w, s, sh),
sim AS (SELECT doc_id, item_id, s, CAST(sum(k) AS DOUBLE) / CAST(any_value(m) + any_value(w) - sum(k) AS DOUBLE) AS similarity FROM cw GROUP BY doc_id, item_id, s),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM sim)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS start, similarity FROM top WHERE r = 1 AND similarity >= 0.75
"""

#: Base32 by groups of five hexadecimal digits, which are four letters each.
OP9 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 5 * (j // 4) + 1, 5))::INT >> (15 - 5 * (j % 4))) % 32 + 1, 1) for j in range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM m
"""


def sort_means_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """Lloyd's rounds written out; every vector is compared with every centroid, component by component."""
    parts = [f"""
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS INT) AS cluster, v AS c FROM v QUALIFY cluster < {k})"""]
    distance = f"list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, {dims + 1})])"
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := cluster)) AS x
      FROM (SELECT vec_id, v, cluster, CAST({distance} AS BIGINT) AS d FROM v CROSS JOIN c{r}) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (SELECT cluster, list(mean ORDER BY i) AS c FROM
      (SELECT x.c AS cluster, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, x.c AS cluster, x.d AS distance, CAST(sum(x.d) OVER (PARTITION BY x.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(x.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = x.c
"""


ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2,
    "op4_jaccard_join": near_duplicates_sql(5, 75),
    "op9_warc": OP9,
    "op12_minhash_forest": near_duplicates_sql(2, 80, ", doc_id = component_id AS kept"),
    "op13_sort_means": sort_means_sql(),
}
