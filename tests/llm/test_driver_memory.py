"""What the driver gives back after a step."""

from __future__ import annotations

import pytest

from tarn.llm import _cluster


def test_each_step_returns_the_drivers_native_memory(spark, monkeypatch):
    assert _cluster.trim_jvm(spark).startswith("Trim native heap")
    said, trim = [], _cluster.trim_jvm
    monkeypatch.setattr(_cluster, "trim_jvm", lambda s: said.append(trim(s)))
    assert _cluster.durable(spark.range(5)).count() == 5
    _cluster.release(spark)
    assert len(said) == 2 and all(said)


@pytest.mark.parametrize(("share", "times"), [(0.0, 1), (1.0, 0)])
def test_a_heap_that_has_grown_is_collected_after_a_step(spark, monkeypatch, share, times):
    calls, release = [], _cluster.release
    monkeypatch.setattr(_cluster, "FULL_HEAP", share)
    monkeypatch.setattr(_cluster, "release", lambda s: calls.append(1) or release(s))
    assert _cluster.durable(spark.range(5)).count() == 5
    assert len(calls) == times
