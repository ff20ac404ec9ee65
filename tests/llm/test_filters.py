"""Filters grow with their keys."""

import numpy as np

from quillspark.llm import arrays as A
from quillspark.llm import filters


def test_a_filter_of_many_keys_is_not_full(spark):
    keys = lambda n, seed: A.mix(np.arange(n, dtype=A.U) + A.U(seed << 40))
    docs = spark.range(2, numPartitions=2).selectExpr("id", "'x' as text")

    def both(batch):
        yield from (keys(40_000, 1) for _ in range(batch.num_rows))  # each key twice in all
        yield keys(100, 2 + batch.column("id")[0].as_py())

    found, hot = filters.built(filters.counted(docs, both), 1 << 62, bits=1 << 12)
    assert hot is None and found.held == 80_000
    assert found.test(keys(40_000, 1)).all()
    assert found.test(keys(40_000, 9)).mean() < 0.15
    assert len(found.bits) <= 2 * filters.KEY_SPACE * 40_000 / 8
