import ctypes

import pytest

from tandem import tables


def test_driver_gives_freed_memory_back(spark, monkeypatch):
    """A written table ends with a trim, but not each one of many."""
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("another C library")
    assert tables.trim(spark)
    calls = []
    monkeypatch.setattr(tables, "trim", lambda s: calls.append(s))
    monkeypatch.setattr(tables, "_last", float("-inf"))
    for _ in range(3):
        assert tables.written(spark.range(5)).count() == 5
    assert calls == [spark]
