"""The SQL of merged windows, where windows of equal ends are ties."""

from __future__ import annotations

from tarn.plans import sequences
from tarn.plans.catalog import ORACLES


def test_sql_numbers_equal_windows_alike(duck):
    """Each of two equal windows may be the one that opens a span; neither may join the span before."""
    assert sequences.ISLANDS_TIED in ORACLES["agg_w4_smurfing_spans"]
    # f as the SQL has it, with either of the two equal windows (5, 6) fresh
    _, rest = sequences.ISLANDS_TIED.split("g AS", 1)
    for first, second in ((1, 0), (0, 1)):
        f = f"f AS (SELECT * FROM (VALUES (1, 1, 2, 1), (1, 5, 6, {first}), (1, 5, 6, {second}), (1, 6, 7, 0)) x (key, a, b, fresh))"
        assert sorted(duck.sql(f"WITH {f}, g AS{rest} SELECT a, b, anchors FROM s").fetchall()) == [(1, 2, 1), (5, 7, 3)]


def test_sql_spans_equal_windows_merged_one_by_one(duck):
    sql = ORACLES["agg_w4_smurfing_spans"]
    windows = duck.sql(sql.partition(sequences.ISLANDS_TIED)[0].rstrip().rstrip(",") + " SELECT key, a, b FROM w ORDER BY key, a, b").fetchall()
    spans: list[list] = []
    for key, a, b in windows:
        if spans and spans[-1][0] == key and a <= spans[-1][2]:
            spans[-1][2:] = [max(b, spans[-1][2]), spans[-1][3] + 1]
        else:
            spans.append([key, a, b, 1])
    got = duck.sql(f'SELECT receiver, "start", "end", anchors FROM ({sql}) x').fetchall()
    assert spans and sorted((k, a.date(), b.date(), n) for k, a, b, n in spans) == sorted(got)
