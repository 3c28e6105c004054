"""Query rows that come several times in one block."""

import numpy as np
import pytest

from encoscope.llm import topk
from test_llm_tables import plain_top


@pytest.mark.parametrize("copies", [2, 6, 10])
def test_repeated_query_row_is_answered_in_full(spark, copies):
    rng = np.random.default_rng(3)
    rows = [(i, [round(float(x), 1) for x in rng.normal(size=4)]) for i in range(1, 150) if i != 50]
    rows += [(50, [9.0, 9.0, 9.0, 9.0])] * copies  # the largest inner products are its own
    want = sorted(set(plain_top(rows, 5, 50)))
    assert sum(r[0] == 50 for r in want) == 5
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(table).collect()) == want
