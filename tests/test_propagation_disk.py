"""Label propagation keeps no shuffle files of earlier rounds."""

from __future__ import annotations

import random
import time

from tarn.operators import graph


def test_rounds_leave_no_shuffles(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(300)], "src long, dst long")
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    spark._jvm.System.gc()
    time.sleep(1)
    before = held.size()
    labels = graph.communities(edges, rounds=12)
    # what a round or two have, however many there were; files go a moment after they are let go
    for _ in range(50):
        if held.size() - before <= 12:
            break
        time.sleep(0.1)
    assert held.size() - before <= 12
    near: dict[int, set] = {}
    for a, b in ((r.src, r.dst) for r in edges.collect()):
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    wanted = {k: k for k in near}
    for _ in range(12):
        votes = {k: [wanted[x] for x in v] for k, v in near.items()}
        wanted = {k: min(set(v), key=lambda c: (-v.count(c), c)) for k, v in votes.items()}
    assert {r.node: r.community for r in labels.collect()} == wanted
