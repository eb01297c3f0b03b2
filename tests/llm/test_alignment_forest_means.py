"""Token alignment, the MinHash forest and sort-means against brute force, and on odd and skewed rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import alignment, forest
from tarn.llm.alignment import align
from tarn.llm.forest import near_duplicates
from tarn.llm.queries import public_vocabulary
from tarn.llm.sortmeans import assign, cluster, orders, with_inertia

from ..conftest import DATA_001
from .test_operators import LONG, documents, empty, odd_rows, words

PATHS = [public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model")]

# alignment


def tokens_of(text):
    """(bytes, id) of both tokenizers' tokens of a space and the whole text; None where they do not give it back."""
    pair = alignment._loaded(*PATHS)
    if not text:
        return None
    a = [(pair.bytes_a[k], k) for k in pair.a.encode(" " + text, add_special_tokens=False).ids]
    b = [(pair.bytes_b[k], k) for k in pair.b.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(x for x, _ in side) == whole for side in (a, b)) else None


def brute_alignment(texts):
    found, links = [], []
    for text in texts:
        both = tokens_of(text)
        if both is None:
            found.append(None)
            links.append([])
            continue
        ends = []
        for side in both:
            at, out = 0, {}
            for x, k in side:
                at += len(x)
                out[at] = k
            ends.append(out)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, rest = [], [iter(side.items()) for side in ends]
        for top in common:
            own = []
            for side in rest:
                ids = []
                for end, k in side:
                    ids.append(str(k))
                    if end == top:
                        break
                own.append(",".join(ids))
            groups.append("|".join(own))
        found.append((len(both[0]), len(both[1]), len(common), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append([(ends[0][x], ends[1][x]) for x in common])
    counts = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for x, own in zip(found, links, strict=True):
        n_a, n_b, n_groups, digest = x or (0, 0, 0, "")
        out.append((n_a, n_b, n_groups, len(own), sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), digest))
    return out


def aligned(df, **how):
    return [tuple(r) for r in align(df, *PATHS, **how).collect()]


@pytest.mark.parametrize("how", [{}, {"stripes": 7, "part_bytes": 4000}])
def test_align_against_whole_texts(spark, how):
    rows = documents(spark).collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, brute_alignment([r.text for r in rows]), strict=True))
    assert sorted(aligned(documents(spark), **how)) == want
    assert any(x[5] < x[4] for x in want)


def test_align_odd_rows(spark):
    texts = [r.text for r in odd_rows(spark).collect()]
    want = Counter(brute_alignment(texts))
    assert Counter(x[1:] for x in aligned(odd_rows(spark))) == want
    assert aligned(empty(spark)) == []
    assert sorted(aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_align_many_copies_and_portions(spark, monkeypatch):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the cat, the cat; 12 mice").otherwise(F.concat(F.lit("the dog "), F.col("id").cast("string"))).alias("text")).repartition(7)
    rows = docs.collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, brute_alignment([r.text for r in rows]), strict=True))
    assert sorted(aligned(docs, stripes=3, part_bytes=300)) == want


ALPHABET = st.text(alphabet=st.one_of(st.sampled_from(list("ab é\n\t  　▁ﬁ́中😀<s>/'l1.,\x1c\x85\x00")), st.characters(exclude_categories=["Cs"])), max_size=40)


@given(ALPHABET)
@settings(max_examples=150, deadline=None)
def test_texts_of_a_step_are_aligned_like_single_ones(text):
    pair = alignment._loaded(*PATHS)
    assert pair.ranks is not None
    n_a, n_b, n_groups, n_links, _, _, digest = brute_alignment([text])[0]
    got = [x for x, _ in pair.documents(["", text, "other words", None, text])]
    assert got == [[0, 0, 0, 0, ""], [n_a, n_b, n_groups, n_links, digest], pair.document("other words")[0], [0, 0, 0, 0, ""], [n_a, n_b, n_groups, n_links, digest]]


def test_long_texts_are_cut_at_edges(monkeypatch):
    pair = alignment._loaded(*PATHS)
    text = LONG[:200_000] + " <|endoftext|> " + "x" * 5000 + "  end \n"
    whole = pair.document(text)
    monkeypatch.setattr(alignment, "STEP_CHARS", 1000)
    cut = pair.document(text)
    assert cut[0] == whole[0] and (cut[1] == whole[1]).all()
    assert whole[0] == [*brute_alignment([text])[0][:4], brute_alignment([text])[0][6]]


# MinHash forest


def pairs_set(text):
    ws = words(text)
    return {tuple(ws[k : k + 2]) for k in range(len(ws) - 1)} if len(ws) > 1 else {tuple(ws)} if ws else set()


def brute_components(rows, percent=80):
    """Smallest id of each row's component, over rows (id, text)."""
    by_set = defaultdict(list)
    for k, (_, text) in enumerate(rows):
        by_set[frozenset(pairs_set(text))].append(k)
    sets = [s for s in by_set if s]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for token in s for j in holders[token])
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
        for token in s:
            holders[token].append(i)
    ids = defaultdict(list)
    for i, s in enumerate(sets):
        ids[find(i)] += [rows[k][0] for k in by_set[s] if rows[k][0] is not None]
    out = []
    place = {s: i for i, s in enumerate(sets)}
    for doc_id, text in rows:
        s = frozenset(pairs_set(text))
        own = ids[find(place[s])] if s else []
        out.append((doc_id, len(s), min(own, default=doc_id) if s else doc_id))
    return out


def shown_rows(rows):
    return sorted(rows, key=repr)


def check_forest(df, **how):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near_duplicates(df, **how).collect()
    assert shown_rows((r.doc_id, r.n_shingles, r.component_id) for r in got) == shown_rows(brute_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return got


def test_forest_against_brute_force(spark):
    got = check_forest(documents(spark))
    assert sum(not r.kept for r in got) > 20


def test_forest_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(forest, "RANGE_ROWS", 900)
    check_forest(documents(spark))


def test_forest_odd_rows(spark):
    got = check_forest(odd_rows(spark))
    assert len(got) == 14
    assert near_duplicates(empty(spark)).count() == 0


def near_copies(n, length=60, seed=5):
    """A third copies of one text with up to some words changed, a third with a boilerplate half, a third of their own."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(length)]
    out = []
    for k in range(n):
        own = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        if k % 3 == 0:
            ws = list(base)
            for _ in range(rng.randrange(6)):
                ws[rng.randrange(length)] = f"x{rng.randrange(40)}"
        elif k % 3 == 1:
            ws = base[: length // 2] + own[: length // 2]
        else:
            ws = own
        out.append((k, " ".join(ws)))
    return out


def test_forest_with_a_crowd(spark):
    df = spark.createDataFrame(near_copies(900), "doc_id long, text string").repartition(5)
    got = check_forest(df)
    assert max(Counter(r.component_id for r in got).values()) > 200


def test_neighbours_meet_in_small_regions_and_crowds_are_named():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2, (4000, 17)).astype(np.uint8)
    keys[:, 0] %= 2
    keys = keys[np.lexsort(keys.T[::-1])]
    i, j, crowd = forest.neighbours(keys, 4, 32)
    met = set(zip(i.tolist(), j.tolist(), strict=True))
    for a in range(0, 4000, 37):
        region = [b for b in range(4000) if (keys[b, :9] == keys[a, :9]).all()]
        if len(region) <= 32:
            assert all((min(a, b), max(a, b)) in met for b in region if b != a)
    same = Counter(map(bytes, keys))
    assert all(c == (same[bytes(k)] > 32) for k, c in zip(keys, crowd, strict=True))


# sort-means


def brute_means(points, k=40, rounds=5):
    """points: (id, components), as the contract has it."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in points if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    start = sorted(kept, key=lambda p: (p[0] is None, hashlib.sha256(f"2:{p[0]}".encode()).hexdigest(), p[1]))[:k]
    centroids = [v for _, v in start]
    x = np.array([v for _, v in kept], dtype=object)
    for step in range(rounds + 1):
        gaps = np.stack([((x - np.array(c, dtype=object)) ** 2).sum(axis=1) for c in centroids], axis=1)
        best = gaps.argmin(axis=1)
        if step < rounds:
            centroids = [[sum(col) // int((best == c).sum()) for col in x[best == c].T] if (best == c).any() else centroids[c] for c in range(len(centroids))]
    own = [int(gaps[r, c]) for r, c in enumerate(best)]
    inertia = Counter()
    for c, d in zip(best.tolist(), own, strict=True):
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, int(c), d, inertia[int(c)], sum(own), digest[c]) for (i, _), c, d in zip(kept, best, own, strict=True)]


def means(df):
    return [tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in with_inertia(*cluster(df)).collect()]


def test_sort_means_against_brute_force(spark):
    df = spark.read.parquet(f"{DATA_001}/embeddings.parquet")
    want = brute_means([(r.vec_id, r.embedding) for r in df.collect()])
    assert sorted(means(df)) == sorted(want)
    assert len({x[1] for x in want}) > 10


def test_sort_means_odd_rows(spark):
    rng = random.Random(4)
    own = lambda: [rng.uniform(-2, 2) for _ in range(64)]
    same, zero = own(), [0.0] * 64
    rows = [(k, own()) for k in range(60)] + [(100 + k, same) for k in range(40)] + [(7, same), (7, same), (None, own()), (None, zero), (5, zero), (6, [-1.0] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [math.nan] + [1.0] * 63), (206, [-math.inf] + [1.0] * 63)]
    df = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, sums string, n int")
    assert shown_rows(means(df)) == shown_rows(brute_means(rows))
    assert means(df.limit(0)) == []
    few = df.where("vec_id in (5, 6)")
    assert shown_rows(means(few)) == shown_rows(brute_means([r for r in rows if r[0] in (5, 6)]))


def test_sort_means_refuses_what_it_cannot_hold(spark):
    with pytest.raises(Exception, match="too large"):
        means(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


@given(st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_scans_stop_only_where_nothing_nearer_or_equal_follows(seed):
    rng = np.random.default_rng(seed)
    k, d = int(rng.integers(1, 12)), int(rng.integers(1, 4))
    centroids, x = rng.integers(-6, 7, (k, d)), rng.integers(-8, 9, (50, d))
    best, dist = assign(x, rng.integers(0, k, 50), centroids, *orders(centroids))
    gaps = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == gaps.argmin(axis=1)).all() and (dist == gaps.min(axis=1)).all()
