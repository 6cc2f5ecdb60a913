from __future__ import annotations

import pytest

from lumbra.llm import components


def test_unfinished_components_are_an_error(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    monkeypatch.setattr(components, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        components.components(edges)
