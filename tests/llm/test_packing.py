import random

import numpy as np
import pytest

from flowgrain.llm import packing


def check(rows, sizes, capacity):
    used, parts = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.part_no, r.start_token, r.n_tokens))
    assert max(used.values(), default=0) <= capacity
    for doc, size in sizes.items():
        own = sorted(parts[doc])
        assert sum(n for *_, n in own) == size
        assert [s for _, s, _ in own] == [i * capacity for i in range(len(own))]
        assert len(own) == max(1, -(-size // capacity))
    assert set(parts) == set(sizes)
    return len(used)


@pytest.mark.parametrize("seed", range(3))
def test_all_fit(spark, seed):
    r = random.Random(seed)
    capacity = [64, 100, 2048][seed]
    sizes = {i: r.choice([0, r.randint(1, capacity), r.randint(1, 1 + capacity // 8), r.randint(1, capacity * 3)]) for i in range(600)}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], "doc_id long, n_tokens long, container_id string")
    n = check(packing.pack(df, capacity=capacity).collect(), sizes, capacity)
    assert n <= 1.02 * -(-sum(sizes.values()) // capacity) + 1


def test_plan_keeps_every_text():
    r = np.random.default_rng(1)
    for _ in range(20):
        histogram = r.integers(0, 40, 101) * (r.random(101) < 0.3)
        groups = packing.plan(histogram, 100)
        made = np.zeros(101, dtype=int)
        for content, n in groups:
            assert n > 0 and sum(k * m for k, m in content.items()) <= 100
            for k, m in content.items():
                made[k] += m * n
        assert (made[1:] == histogram[1:]).all()


def test_odd_tables(spark):
    schema = "doc_id long, n_tokens long"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    zero = packing.pack(spark.createDataFrame([(1, 0), (2, 0), (2, 0)], schema)).collect()
    assert [(r.container_id, r.n_tokens) for r in zero] == [(0, 0)] * 3
    hot = packing.pack(spark.createDataFrame([(i, 7) for i in range(3000)], schema), capacity=20).collect()
    assert len({r.container_id for r in hot}) == 1500
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "word " * 5000)], "doc_id long, text string")
    assert sum(r.n_tokens for r in packing.pack_documents(docs).collect() if r.doc_id == 4) == 5001
