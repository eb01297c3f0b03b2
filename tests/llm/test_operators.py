"""Each operator against brute force, round trips or held-out accuracy, and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarn.llm import queries
from tarn.llm._files import opened
from tarn.llm.components import connected_components
from tarn.llm.decontaminate import contaminated, drop_contaminated
from tarn.llm.fingerprints import delete, fingerprints, insert, with_vector
from tarn.llm.jaccard import jaccard_components, keep_one
from tarn.llm.lm import lm_scores
from tarn.llm.mixing import mix, take_mix
from tarn.llm.quality import keep_good, quality_scores
from tarn.llm.records import CorruptRecord, iterate_records, read_at, read_index, read_records, write_records
from tarn.llm.shards import shard_documents
from tarn.llm.urls import filter_urls
from tarn.llm.warc import read_warc, write_warc

from ..conftest import DATA, DATA_001, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, hashes string, part int, block long, n long, size int, p double, node long, word string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))


def odd_rows(spark):
    texts = [None, "", " \t\n ", "one", "One two three", "a b c d e f g h", "a b c d e f g h", "a b c d e f g h i", LONG, LONG + " tail", "ÅÄÖ ñ 中文\u00a0x", "x. y! z?\nnew line\n"]
    rows = [(k if k != 5 else None, x, None, None if k % 3 == 0 else f"s{k % 2}", None, 1, "h", 2, 3, 4, 5, 0.5, 6, "w") for k, x in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[6], rows[6]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, path=DATA_001):
    return spark.read.parquet(f"{path}/documents.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", lower(text))


def held(doc_id, folds, rest):
    return zlib.crc32(str(doc_id).encode()) % folds == rest


# mixing


def check_mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    sizes = {s: sum(r["size"] for r in by[s]) for s in order}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    mass, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weights.items() if s not in capped)
        left = mass - sum(2 * sizes[s] for s in capped)
        over = {s for s in order if s not in capped and left * weights[s] / free > 2 * sizes[s] + 1e-9} if free else set()
        if not over:
            break
        capped |= over
    for s in order:
        want = 2 * sizes[s] if s in capped else left * weights[s] / free
        taken = sum(r.taken for r in by[s])
        assert all(r.target == pytest.approx(want) and r.source_size == sizes[s] for r in by[s])
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in by[s])
        assert abs(taken - want) <= max(0.02 * want, max(r["size"] for r in by[s]))


def test_mix(spark):
    rows = mix(documents(spark)).collect()
    assert len(rows) == 1000
    assert {r.doc_id: r["size"] for r in rows} == {r.doc_id: len(words(r.text)) for r in documents(spark).collect()}
    check_mix(rows)
    assert sorted(rows) == sorted(mix(documents(spark)).collect())


def test_mix_in_many_blocks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"), F.expr("repeat('w ', 1 + id % 50)").alias("text"))
    rows = mix(docs, block=64).collect()
    check_mix(rows)
    a = [r for r in rows if r.source == "a"]
    assert sum(r.taken for r in a) == pytest.approx(a[0].target, rel=0.002)


def test_mix_odd_rows(spark):
    rows = mix(odd_rows(spark)).collect()
    assert len(rows) == 14
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mix(empty(spark)).count() == 0
    docs = odd_rows(spark)
    out = take_mix(docs, mix(docs))
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in rows)


# decontamination


def brute_hits(docs, items, least=0.75):
    out = set()
    lists = {i: words(t) for i, t in items if words(t)}
    for d, text in docs:
        ws = words(text)
        for i, own in lists.items():
            k = min(5, len(own))
            grams = Counter(tuple(own[a : a + k]) for a in range(len(own) - k + 1))
            for s in range(max(0, len(ws) - len(own)) + 1):
                part = ws[s : s + len(own)]
                mine = Counter(tuple(part[a : a + k]) for a in range(len(part) - k + 1))
                both = sum((mine & grams).values())
                if both and both / (sum(grams.values()) + sum(mine.values()) - both) >= least:
                    out.add((d, i))
                    break
    return out


def test_decontaminate_against_brute_force(spark):
    docs, bench = documents(spark, DATA), spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got


def test_decontaminate_edits_and_odd_rows(spark):
    item = [f"q{k}" for k in range(40)]
    edited = item.copy()
    edited[20] = "other"
    far = [x if k % 6 else "other" for k, x in enumerate(item)]
    rows = [(1, "pre " + " ".join(item) + " post"), (2, " ".join(edited).upper()), (3, " ".join(far)), (4, " ".join(item[:20])), (None, " ".join(item)), (6, None), (7, "the end"), (8, ""), (9, "say a b c now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("words", F.lit(1))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "A b c")], "item_id long, text string")
    hits = contaminated(docs, bench)
    assert {(r.doc_id, r.item_id) for r in hits.collect()} == {(1, 1), (2, 1), (None, 1), (9, 4)}
    assert {r.doc_id for r in drop_contaminated(docs, hits).collect()} == {3, 4, 6, 7, 8}
    assert contaminated(empty(spark), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert {r.item_id for r in contaminated(odd_rows(spark), bench, broadcast_rows=0).collect()} == {4}


def test_decontaminate_truncated_passages(spark):
    item = [f"q{k}" for k in range(40)]
    other = [f"z{k}" for k in range(60)]
    texts = {1: item[2:] + other, 2: other + item[:-3], 3: item[:-1], 4: item[:20] + item[21:], 5: item[1:], 6: item[:28], 7: item[20:] + other, 8: other + item[:20], 9: item[2:] + other[:1]}
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in texts.items()], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").coalesce(1)
    for rows in (1_000_000, 0):
        hits = {r.doc_id: (r.start, round(r.similarity, 6)) for r in contaminated(docs, bench, broadcast_rows=rows).collect()}
        assert hits == {1: (0, round(34 / 38, 6)), 2: (57, round(33 / 39, 6)), 3: (0, round(35 / 36, 6)), 4: (0, 0.775), 5: (0, round(35 / 36, 6)), 9: (0, round(34 / 37, 6))}


@pytest.mark.parametrize("seed", [1, 2])
def test_decontaminate_moved_blocks(spark, seed):
    """Items whose blocks are moved, repeated, cut and mixed, at all offsets; items of equal text; repeated words."""
    import random

    dice = random.Random(seed)
    items = [(k, " ".join(f"i{k}w{dice.randrange(40)}" for _ in range(dice.randrange(3, 70)))) for k in range(12)]
    items += [(100, items[5][1]), (101, "a a a a a a a a a a a a"), (102, "a b a b a b a b a b a b")]
    docs = [(0, None), (1, "a " * 300), (2, "b a " * 40)]
    for d in range(3, 400):
        ws = dice.choice(items)[1].split()
        cuts = sorted(dice.randrange(len(ws) + 1) for _ in range(dice.randrange(3)))
        parts = [ws[a:b] for a, b in zip([0, *cuts], [*cuts, len(ws)], strict=True)]
        dice.shuffle(parts)
        body = [w for p in parts for w in p]
        for _ in range(dice.randrange(3)):
            body[dice.randrange(len(body))] = "other"
        docs.append((d, " ".join([*["x"] * dice.randrange(9), *body[dice.randrange(4) :], *(body if d % 5 == 0 else []), *["y"] * dice.randrange(9)])))
    docs.append((900, "A" + items[0][1][1:] + " " + items[0][1][len(items[0][1]) // 2 :] + " " + items[0][1][: len(items[0][1]) // 2]))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    for rows in (200_000, 0):
        got = [(r.doc_id, r.item_id) for r in contaminated(table, bench, broadcast_rows=rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 100


def test_decontaminate_halves_in_the_other_order(spark):
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(b + a)), (2, " ".join(["z"] * 50 + b + a + ["y"] * 50))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(a + b))], "item_id long, text string")
    assert {(r.doc_id, r.start, round(r.similarity, 9)) for r in contaminated(docs, bench).collect()} == {(1, 0, round(52 / 60, 9)), (2, 50, round(52 / 60, 9))}


def test_drop_contaminated_keeps_columns(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)), 5), (1, "other", 6), (None, None, 7)], "doc_id long, text string, __tarn0_ int").withColumn("text_key", F.lit(1)).withColumn("__key", F.lit(1))
    bench = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    kept = drop_contaminated(docs, contaminated(docs, bench))
    assert kept.columns == docs.columns and sorted(r["__tarn0_"] for r in kept.collect()) == [6, 7]


# quality


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA_001}/labels.parquet")
    rows = quality_scores(documents(spark), labels).collect()
    assert len(rows) == 1000
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    known = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    assert sum(a == b for a, b in tested) / len(tested) >= 0.93
    assert sum(b for a, b in tested if a == 1) / sum(a == 1 for a, _ in tested) >= 0.97


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(6, 1, 0), (8, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(odd_rows(spark), labels).collect()
    assert len(rows) == 14 and len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert {r.score for r in quality_scores(odd_rows(spark), labels.limit(0)).collect()} == {0.5}
    assert quality_scores(empty(spark), labels).count() == 0
    assert keep_good(odd_rows(spark), labels.limit(0)).columns == odd_rows(spark).columns


# similarity join


def brute_components(rows):
    sets = {}
    for d, t in rows:
        ws = words(t)
        sets[d] = frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in places[s])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            places[s].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("least", "small"), [(17, 32), (2, 2)])
def test_jaccard_against_brute_force(spark, least, small):
    docs = documents(spark, DATA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, least=least, small_group=small).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_families_of_copies(spark, seed):
    """Families whose members are near the threshold to each other and to their source; every token is frequent."""
    import random

    dice = random.Random(seed)
    rows, n = [], 0
    for _ in range(3):
        base = [f"v{dice.randrange(5000)}" for _ in range(dice.choice([12, 70, 150]))]
        for _ in range(60):
            own = base.copy()
            for _ in range(dice.randrange(max(2, len(base) // 18))):
                own[dice.randrange(len(own))] = f"e{dice.randrange(12)}"
            rows.append((n, " ".join(own[: len(own) - dice.randrange(4)])))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, least=4, small_group=5).collect()}
    assert got == brute_components(rows)


def test_jaccard_odd_rows(spark):
    rows = jaccard_components(odd_rows(spark)).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert got[(0, 0, 0)] == got[(1, 0, 1)] == got[(2, 0, 2)] == 1
    assert got[(6, 4, 6)] == 3 and got[(None, 4, 6)] == 1 and got[(7, 5, 6)] == 1
    assert {r.component_id for r in rows if r.doc_id in (8, 9)} == {8}
    assert jaccard_components(empty(spark)).count() == 0
    kept = keep_one(odd_rows(spark), jaccard_components(odd_rows(spark)))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 8, 10, 11]


def test_keep_one_by_row(spark):
    """Repeated ids with other texts, null ids, repeated rows, clashing columns."""
    text = "a b c d e f g h"
    rows = [(7, "one two three"), (7, "four five six"), (3, text), (5, text), (5, "new words here"), (None, text), (None, "only here"), (None, "only here"), (9, "twice"), (9, "twice"), (2, ""), (2, ""), (None, None)]
    docs = spark.createDataFrame([(*r, k, "x", 1) for k, r in enumerate(rows)], "doc_id long, text string, __kept int, component string, __tarn0_ int")
    kept = keep_one(docs, jaccard_components(docs))
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == {(7, "one two three"): 1, (7, "four five six"): 1, (3, text): 1, (5, "new words here"): 1, (None, "only here"): 1, (9, "twice"): 1, (2, ""): 2, (None, None): 1}
    assert keep_one(docs.limit(0), jaccard_components(docs.limit(0))).count() == 0


def test_jaccard_large_hubs(spark, monkeypatch):
    """A family of near copies whose hub is dealt to several tasks."""
    from tarn.llm import jaccard

    monkeypatch.setattr(jaccard, "HUB_ROWS", 20)
    base = [f"v{k}" for k in range(90)]
    rows = [(k, " ".join(base[: k % 89] + [f"e{k}"] + base[k % 89 :])) for k in range(150)] + [(1000 + k, f"other text number {k} of some words") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute_components(rows)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# fingerprints


def check_fingerprints(docs, rows):
    order = sorted(docs, key=lambda r: -r[0])
    n = len(order)
    by = {r.doc_id: r for r in rows}
    for k, (d, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % n][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = by[d]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == by[order[(k + 1) % n][0]].fingerprint) <= (r.near_next == 1)
    prints = defaultdict(set)
    for d, text in docs:
        prints[text or ""].add(by[d].fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_fingerprints(spark):
    docs = documents(spark)
    rows = fingerprints(docs, each=90).collect()
    check_fingerprints([(r.doc_id, r.text) for r in docs.collect()], rows)
    assert sum(r.near_edited for r in rows) / len(rows) > 3 * sum(r.near_next for r in rows) / len(rows)


def pieces(text):
    return [p for p in re.split("(?<=\\n)|(?<=[.!?…][ \\t])|(?<=[。！？।။。])", text) if p]


def test_fingerprint_likeness(spark):
    """The likeness is within its error of the cosine of the multisets of pieces, in mean and singly."""
    docs = documents(spark)
    rows = {r.doc_id: r for r in fingerprints(docs).collect()}
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    off = []
    for k, (d, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        for got, other in ((rows[d].near_edited, text[: len(text) - half] + following[:half]), (rows[d].near_next, following)):
            x, y = Counter(pieces(text)), Counter(pieces(other))
            size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            cosine = sum(v * y[p] for p, v in x.items()) / size if size else float(x == y)
            off.append(got - cosine)
    assert sum(map(abs, off)) / len(off) < 0.08 and max(map(abs, off)) < 0.5


def test_fingerprints_in_many_ranges(spark):
    """Ranges of a few rows; a third of all rows of one id or without; repeated rows are one in the order."""
    rows = [(k if k % 3 else None if k % 2 else 7000, f"text {k}. And {k * 7} more.") for k in range(400)]
    key = lambda r: (r[0] is None, -(r[0] or 0))
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), each=20).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [t for d, t in rows if d == r.doc_id and len(t) == r.n_chars]
        half = r.n_chars // 2
        found = [(a, b) for a in own for d, b in rows if hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest() == r.edited_sha256]
        assert found
    unique = sorted((r for r in rows if r[0] is not None and r[0] < 7000), key=key)
    by = {r.doc_id: r for r in got}
    for a, b in zip(unique, unique[1:], strict=False):
        half = len(a[1]) // 2
        assert by[a[0]].edited_sha256 == hashlib.sha256((a[1][: len(a[1]) - half] + b[1][:half]).encode()).hexdigest()
    twice = fingerprints(spark.createDataFrame([(3, "a b. c d"), (2, "e f. g h"), (2, "e f. g h"), (1, "i. j")], "doc_id long, text string")).collect()
    assert len(twice) == 4
    for r in twice:
        n = r.n_chars
        text = {3: "a b. c d", 2: "e f. g h", 1: "i. j"}[r.doc_id]
        nxt = {3: "e f. g h", 2: "i. j", 1: "a b. c d"}[r.doc_id]
        assert r.edited_sha256 == hashlib.sha256((text[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()


def test_fingerprints_are_homomorphic(spark):
    t = spark.createDataFrame([("b.\na.\n", "c.\n", "a.\nb.\n", "c.\nb.\na.\n", "a. ")], "x string, y string, r string, all string, other string")
    for c in ("x", "y", "r", "all", "other"):
        t = with_vector(t, c, f"v_{c}")
    r = t.select("v_x", "v_r", "v_all", "v_other", insert(F.col("v_x"), F.col("v_y")).alias("more"), delete(F.col("v_all"), F.col("v_y")).alias("less")).first()
    assert r.v_x == r.v_r and r.more == r.v_all and r.less == r.v_x and r.v_x != r.v_other


def test_fingerprints_odd_rows(spark):
    rows = fingerprints(odd_rows(spark)).collect()
    assert len(rows) == 14 and sum(r.doc_id is None for r in rows) == 1
    assert len({r.fingerprint for r in rows if r.doc_id in (0, 1)}) == 1
    assert fingerprints(empty(spark)).count() == 0
    single = fingerprints(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).collect()[0]
    assert single.edited_sha256 == hashlib.sha256(b"aa").hexdigest()


# url filters


def test_urls(spark):
    pages = spark.read.parquet(f"{DATA_001}/pages.parquet")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for r, u in [(r, u.url) for r, u in zip(filter_urls(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True)]:
        m = re.match(r"[^/?#]*", u.split("://", 1)[1])
        host, path = lower(m.group()), re.match(r"[^?#]*", u.split("://", 1)[1][m.end() :]).group()
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fits)[2] if fits else None)
        assert not fits or r.verdict == max(fits)[1]


def test_url_templates(spark):
    urls = [f"http://a.org/shop/{k}" for k in range(40)] + [f"http://a.org/news/{k}" for k in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, 1) for k in range(20)] + [(k, 0) for k in range(40, 60)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in filter_urls(pages, labels=labels).collect()}
    assert {got[k] for k in range(40)} == {"block"} and {got[k] for k in range(40, 80)} == {"allow"}
    many = spark.createDataFrame([(k, f"http://h.org/u{chr(97 + k % 26)}{k}x/p") for k in range(60)], "page_id long, url string")
    assert {r.template for r in filter_urls(many).collect()} == {"/*/p"}


def brute_templates(paths, share=0.02, most=24, z=1.96, purity=0.8):
    """paths: {(host, segments with $): (pages, n, bad)}; returns {(host, segments): (template, rejected)}, by recursion."""
    leaf = {}

    def grow(host, prefix, inside):
        kids = defaultdict(list)
        for rest, full in inside:
            if rest:
                kids[rest[0]].append((rest[1:], full))
            else:
                leaf[host, full] = prefix
        count = {k: [sum(paths[host, f][j] for _, f in v) for j in range(3)] for k, v in kids.items()}
        whole = sum(c[0] for c in count.values())
        rare = {k for k, c in count.items() if len(kids) > most and c[0] < share * whole and k[0] != "{" and k != "$"}
        joint = (sum(count[k][2] for k in rare) + 1) / (sum(count[k][1] for k in rare) + 2)
        apart = {k for k in rare if count[k][1] >= 5 and abs(count[k][2] - count[k][1] * joint) > z * math.sqrt(count[k][1] * joint * (1 - joint)) + 0.5}
        joined = defaultdict(list)
        for k, v in kids.items():
            joined["*" if k in rare - apart else k] += v
        for k, v in joined.items():
            grow(host, (*prefix, k), v)

    for host in {h for h, _ in paths}:
        grow(host, (), [(f, f) for h, f in paths if h == host])
    counts = defaultdict(lambda: [0, 0])
    for (host, f), t in leaf.items():
        for k in range(len(t) + 1):
            counts[host, t[:k]][0] += paths[host, f][1]
            counts[host, t[:k]][1] += paths[host, f][2]
    every, near, score = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), {}
    for (host, t), c in counts.items():
        for d in (every[t], near[".".join(host.split(".")[-2:]), t]):
            d[0] += c[0]
            d[1] += c[1]
    toward = lambda prior, c: (c[1] + 2 * prior) / (c[0] + 2)
    for host, t in sorted(counts, key=lambda x: len(x[1])):
        if not t:
            score[host, t] = toward(0.5, counts[host, t])
            continue
        line = sorted((c[1] / c[0], "/".join(u), u) for (h, u), c in counts.items() if h == host and u[:-1] == t[:-1] and c[0])
        groups = []
        for x in line:
            if groups:
                (n, b), (m, c) = counts[host, groups[-1][-1]], counts[host, x[2]]
                q = (b + c) / (n + m)
            if groups and c / m - b / n <= z * math.sqrt(q * (1 - q) * (1 / n + 1 / m)) + 1e-12:
                groups[-1].append(x[2])
            else:
                groups.append([x[2]])
        own = next((g for g in groups if t in g), [])
        joint = [sum(counts[host, u][j] for u in own) for j in range(2)]
        prior = toward(toward(score[host, t[:-1]], every[t]), near[".".join(host.split(".")[-2:]), t])
        score[host, t] = toward(prior, joint)
    return {k: ("/" + "/".join(t[:-1]) if len(t) > 1 else "", score[k[0], t] >= purity) for k, t in leaf.items()}


def check_templates(spark, pages, rules, labels=None):
    table = spark.createDataFrame(pages, "page_id long, url string")
    known = None if labels is None else spark.createDataFrame(labels, "page_id long, bad int")
    got = filter_urls(table, rules=rules, labels=known).collect()
    bad = dict(labels or [])
    rows, paths = [], defaultdict(lambda: [0, 0, 0])
    for r in got:
        segs = tuple("{n}" if x.isdigit() else x for x in r.path.split("/") if x)
        segs = (*segs[:16], *["{more}"] * (len(segs) > 16), "$")
        ruled = r.rule and next(v for v, x in rules if x == r.rule)
        label = bad.get(r.page_id) if labels is not None else None if ruled is None else int(ruled == "block")
        c = paths[r.host, segs]
        c[0] += 1
        c[1] += label is not None
        c[2] += label or 0
        rows.append((r, segs, ruled))
    want = brute_templates(paths)
    for r, segs, ruled in rows:
        template, reject = want[r.host, segs]
        assert (r.template, r.verdict) == (template, ruled or ("block" if reject else "allow"))
    return got


def test_url_templates_against_brute_force(spark):
    import random

    dice = random.Random(5)
    hosts = ["a.site.org", "b.site.org", "c.other.org", "x.net"]
    pages = []
    for k in range(2500):
        section = dice.choice(["news", "shop", "u", "u", "tag"])
        tail = {"news": f"/{dice.randrange(9999)}", "shop": f"/{dice.choice('pqr')}/{dice.randrange(99)}", "u": f"/name{dice.choice('ghjklm')}{dice.randrange(70)}/{dice.choice(['posts', 'pics'])}", "tag": f"/t{dice.randrange(9)}z" + "/deep" * dice.randrange(20)}[section]
        pages.append((k, f"https://{dice.choice(hosts)}/{section}{tail}?q"))
    risk = lambda u: 0.97 if "/p/" in u or "pics" in u or "x.net" in u or "nameg1/" in u else 0.03
    labels = [(k, int(dice.random() < risk(u))) for k, u in pages if dice.random() < 0.4 and "b.site" not in u]
    got = check_templates(spark, pages, (), labels)
    assert any("*" in r.template for r in got)
    assert {r.verdict for r in got if r.host == "b.site.org"} == {"block", "allow"}
    check_templates(spark, pages, (("block", "site.org/shop/"), ("allow", "org/news/")))


def test_url_templates_of_the_table(spark):
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{DATA_001}/pages.parquet").collect()]
    got = check_templates(spark, [(k, re.sub(r"(\d+)\.html", r"\1", u)) for k, u in pages], rules)
    free = Counter(r.verdict for r in got if r.rule is None)
    assert free["block"] > 20 and free["allow"] > 20


def test_urls_odd_rows(spark):
    rows = [(1, None), (2, "no scheme"), (None, "HTTP://A.NET/x"), (4, "x://"), (5, "http://EXAMPLE.net?q=/en/"), (5, "http://EXAMPLE.net?q=/en/"), (6, "http://a.b/c://d")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("h", F.lit(1)).withColumn("t", F.lit(1))
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in filter_urls(pages).collect()), key=str)
    assert got == sorted([(1, "", "", None), (2, "", "", None), (None, "a.net", "/x", "net/"), (4, "", "", None), (5, "example.net", "", None), (5, "example.net", "", None), (6, "a.b", "/c://d", None)], key=str)
    assert filter_urls(pages.limit(0)).count() == 0


# shards


def check_shards(docs, rows, shards=8, tolerance=1 / 16):
    assert len(rows) == len(docs)
    total = sum(r["size"] for r in rows)
    sums, slots = Counter(), defaultdict(list)
    for r in rows:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max((r["size"] for r in rows), default=0)
    assert all(abs(sums[k] - total / shards) <= 2 * max(largest, tolerance * total / shards) for k in range(shards))
    return sums


def test_shards(spark):
    docs = documents(spark).collect()
    rows = shard_documents(documents(spark)).collect()
    check_shards(docs, rows)
    by = {r.doc_id: r for r in rows}
    groups = defaultdict(set)
    for d in docs:
        r = by[d.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(d.text.encode()) + 1, zlib.crc32(d.text.encode()), "bytes", None)
        groups[d.text].add(r.shard)
    assert sum(len(x) > 1 for x in groups.values()) == 0


def test_shards_with_a_group_of_a_third(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    check_shards(range(3000), shard_documents(docs).collect())


def test_shards_odd_rows(spark):
    rows = shard_documents(odd_rows(spark)).collect()
    assert len(rows) == 14 and {(r["size"], r.text_crc32) for r in rows if r.doc_id == 0} == {(1, 0)}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shard_documents(empty(spark)).count() == 0


# token records


def test_token_records(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    docs = documents(spark)
    got = {r.doc_id: r for r in read_records(write_records(docs, queries.word_tokenizer())).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_token_records_odd_rows(spark, tmp_path):
    files = write_records(odd_rows(spark), queries.word_tokenizer(), folder=f"file://{tmp_path}/r")
    rows = read_records(files, with_ids=True).orderBy("start").collect()
    assert len(rows) == 14 and rows[0].doc_id is None
    assert {tuple(r.ids) for r in rows if r.doc_id in (0, 1, 2)} == {(1,)}
    uri = files.orderBy("part").first()["path"]
    offsets = read_index(uri)
    ahead = [(d, x.tolist()) for d, x in iterate_records(uri)]
    back = [(d, x.tolist()) for d, x in read_at(uri, offsets[::-1].tolist())]
    assert ahead == back[::-1]
    system, path = opened(uri)
    data = bytearray(system.open_input_stream(path).read())
    data[-6] ^= 1
    with system.open_output_stream(path + "x") as out:
        out.write(bytes(data))
    with pytest.raises(CorruptRecord):
        list(iterate_records(uri + "x"))
    assert read_records(write_records(empty(spark), queries.word_tokenizer())).count() == 0


def test_token_records_of_whole_texts(spark):
    path = queries.word_tokenizer()
    x = read_records(write_records(odd_rows(spark), path, by_word=False)).orderBy("start").collect()
    assert x == read_records(write_records(odd_rows(spark), path)).orderBy("start").collect()


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_words_that_collide_in_polynomials(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, word), (2, other), (3, f"{other} {word}"), (4, word[:-1]), (5, "x" * 3000 + word)]
    got = {r.doc_id: r.ids for r in read_records(write_records(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), queries.word_tokenizer()), with_ids=True).collect()}
    assert got == {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in docs}


def test_words_in_steps(monkeypatch):
    """Words, their ends and hashes do not depend on the steps, nor on where a text stands."""
    import numpy as np
    import pyarrow as pa

    from tarn.llm import _words

    texts = ["", " a bc\td ", None, "word", "Ab", "", "x" * 50 + " y", "  ", "é\u00a0z q\r\n1", thue_morse(300)]
    want = [(re.findall(r"[^\x20\x09-\x0d]+", x or "")) for x in texts]
    seen = {}
    for size in (7, 16, 40, 1 << 20):
        monkeypatch.setattr(_words, "STEP_BYTES", size)
        for at, to, w in _words.steps(pa.array(texts), lower=False):
            for k in range(at, to):
                spots = range(w.first[k - at], w.first[k - at + 1])
                assert [w.data[w.starts[i] : w.ends[i]].tobytes().decode() for i in spots] == want[k]
                for i, x in zip(spots, want[k], strict=True):
                    assert seen.setdefault(x, w.hashes[i]) == w.hashes[i]
    assert len(set(seen.values())) == len(seen)
    assert np.uint64 is _words.U


def test_one_very_long_text():
    """A text of 30 MB is hashed and encoded with memory of some eight times its size."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from tarn.llm import queries
from tarn.llm.records import Encoder
e = Encoder(queries.word_tokenizer())
text = pa.array(["some words of no great meaning " * 1_000_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = next(e.encode(text))
assert len(ids) % 1_000_000 == 0
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout)
    assert used < 400


# warc


def brute_warc(pages):
    best = {}
    for d, html in pages:
        best[html or ""] = max(best.get(html or "", -1), -1 if d is None else d)
    out = []
    for d, html in pages:
        data = (html or "").encode()
        is_best = d is not None and d == best[html or ""]
        out.append((d, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if is_best else "revisit", None if is_best else best[html or ""]))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [200, 5000, 1 << 23])
def test_warc(spark, split):
    rows = [(k, f"http://h/{k}", ("same" * 50 if k % 3 == 0 else f"<p>page {k}</p>" * 40) if k % 7 else None) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("best", F.lit(2))
    got = read_warc(write_warc(pages.repartition(3)), split=split, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_warc([(r[0], r[2]) for r in rows])
    assert all(r.payload == (rows[r.page_id][2] or "").encode() for r in got if r.record_type == "response")


def test_warc_passes_over_false_members(spark, tmp_path):
    files = write_warc(spark.createDataFrame([(1, "u", "x" * 100), (2, None, "\x1f\x8b\x08 odd ✓\r\n\r\n")], "page_id long, url string, html string").coalesce(1), folder=f"file://{tmp_path}/w")
    path = files.first()["path"]
    system, name = opened(path)
    data = system.open_input_stream(name, compression=None).read()
    noise = b"\x1f\x8b\x08\x00junk" * 3 + zlib.compress(b"no") + b"\x1f\x8b\x08"
    with system.open_output_stream(name + ".2", compression=None) as out:
        out.write(noise + data + noise)
    other = spark.createDataFrame([(path + ".2", len(data) + 2 * len(noise))], "path string, size long")
    assert sorted(r.page_id for r in read_warc(other, split=64).collect()) == [1, 2]
    assert read_warc(write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# language model


def brute_lm(docs):
    train = [d for d in docs if not held(d[0], 7, 2)]
    counts = Counter()
    for _, text in train:
        counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, text in docs:
        tokens = [*words(text), None]
        out[d] = (held(d, 7, 2), len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
    return out


def test_lm(spark):
    docs = documents(spark)
    want = brute_lm([(r.doc_id, r.text) for r in docs.collect()])
    rows = lm_scores(docs, chunk_chars=200_000).collect()
    assert len(rows) == len(want)
    for r in rows:
        h, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0
    fresh = [r for r in rows if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_lm_odd_rows(spark):
    rows = lm_scores(odd_rows(spark)).collect()
    assert len(rows) == 14 and all(r.n_tokens == 1 for r in rows if r.doc_id in (0, 1, 2))
    assert lm_scores(empty(spark)).count() == 0
    none = spark.createDataFrame([(k, "a") for k in range(100) if held(k, 7, 2)], "doc_id long, text string")
    assert all(r.base_score == 0 and r.n_known == 0 for r in lm_scores(none).collect())


def test_lm_keeps_all_bigrams(spark):
    """Scores by exact bigram counts, rounded as the filter's levels are; seen once or more, in one block or many."""
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    streams = {d: [*words(text), None] for d, text in docs}
    single, double = Counter(), Counter()
    for d, tokens in streams.items():
        if not held(d, 7, 2):
            single.update(tokens)
            double.update(zip(tokens, tokens[1:], strict=False))
    n, v, k = sum(single.values()), len(single), 1 - len(double) / sum(double.values())
    mean = [0, 1, 2.4, *(1.4 * 2.0**j for j in range(2, 40))]
    want = {}
    for d, tokens in streams.items():
        p = [(single[t] + 1) / (n + v + 1) for t in tokens]
        for at in range(1, len(tokens)):
            found = min(mean[double[tokens[at - 1], tokens[at]].bit_length()], single[tokens[at - 1]], single[tokens[at]])
            p[at] = k * found / max(single[tokens[at - 1]], 1) + (1 - k) * p[at]
        want[d] = sum(math.log10(x) for x in p)
    for size in (6_000_000, 50_000):
        rows = lm_scores(documents(spark), chunk_chars=size).collect()
        assert sum(abs(r.score - want[r.doc_id]) for r in rows) <= 0.01 * -sum(want.values())
        assert all(abs(r.score - want[r.doc_id]) <= 0.05 * -want[r.doc_id] + 2 for r in rows)


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA_001)
    q = duck.sql(queries.ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(q.columns, q.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs, sizes = documents(spark), [1000]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, DATA_001)
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns
    junk = {r.doc_id for r in spark.read.parquet(f"{DATA_001}/labels.parquet").where("quality = 1").collect()}
    good = {r.doc_id for r in corpus_pipeline.quality_stage(spark, documents(spark), DATA_001).collect()}
    assert len(junk - good) <= 0.03 * len(junk)
    assert sizes[1] < 1000 and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[5]


def test_pipeline_odd_rows_and_empty_tables(spark, tmp_path):
    """All stages on odd rows, on nothing, and with columns of the names that operators use inside."""
    import corpus_pipeline

    names = ["__copies", "__key", "__kept", "__tarn0_", "component", "copies", "size", "key", "hashes"]
    docs = odd_rows(spark).select("doc_id", "text", "lang", "source", F.lit(1).alias("n_chars"), *[F.lit(k).alias(c) for k, c in enumerate(names)])
    labels = spark.createDataFrame([(6, 1, 0), (8, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    for case, (d, x, b) in {"odd": (docs, labels, bench), "none": (docs.limit(0), labels.limit(0), bench.limit(0)), "bare": (docs, labels.limit(0), bench.limit(0)), "item": (docs, labels.limit(0), bench)}.items():
        folder = f"{tmp_path}/{case}"
        for name, table in (("documents", d), ("labels", x), ("benchmark", b)):
            table.write.parquet(f"{folder}/{name}.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, now = now, stage(spark, now, folder)
            if k < 4:
                assert now.columns == before.columns
                now.write.parquet(f"{folder}/stage{k}")
                now = spark.read.parquet(f"{folder}/stage{k}")
            if case == "bare" and k in (0, 2):
                assert now.count() == before.count()
            if case == "item" and k == 2:
                assert {r.doc_id for r in before.collect()} - {r.doc_id for r in now.collect()} == {4}
        if case != "odd":
            assert (now.count() > 0) == (case != "none")
        assert corpus_pipeline.run(spark, folder).count() == now.count()
