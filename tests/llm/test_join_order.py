"""First codes of the join: their one exchange against a plain count, and passages that very many documents share."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm import jaccard_join

WORDS = [f"w{i}" for i in range(20_000)]


@pytest.mark.parametrize("part_codes", [50, 2_000_000])
def test_shared_codes_are_those_of_two_classes(spark, monkeypatch, part_codes):
    monkeypatch.setattr(jaccard_join, "PART_CODES", part_codes)
    rng = np.random.default_rng(3)
    rows = [(i, int(n := rng.integers(5, 300)), sorted({7, *rng.integers(-(1 << 40), 1 << 40, 4).tolist(), *rng.integers(0, 90, 3).tolist()})) for i in range(400)]
    rows += [(1000 + i, 9, []) for i in range(3)]
    scale = 0.2
    count = collections.Counter(c for _, _, p in rows for c in p)
    want = sorted((fp, math.floor(math.log(n) / scale), c) for fp, n, p in rows for c in p if count[c] > 1)
    df = spark.createDataFrame(rows, "fp long, n long, prefix array<long>").repartition(3)
    assert sorted(map(tuple, jaccard_join.shared_codes(spark, df, scale).collect())) == want


def test_a_common_heading_makes_no_cell(spark, monkeypatch):
    """Cells follow what documents have of their own: the largest does not grow with the documents under a heading."""
    largest, seen = [], jaccard_join.shared_codes

    def watched(*args):
        cells = seen(*args)
        largest.append(cells.groupBy("code").count().agg(F.max("count")).first()[0] or 0)
        return cells

    monkeypatch.setattr(jaccard_join, "shared_codes", watched)
    rng = np.random.default_rng(4)
    heading = " ".join(f"{'long' * 5}heading{i}" for i in range(20))  # its words are the longest
    for many in (500, 1000):
        texts = [f"{heading} " + " ".join(rng.choice(WORDS, 120)) for _ in range(many)] + [heading]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        out = jaccard_join.groups(spark, df, 3, 90, 100, block=100).collect()
        assert all(r.component_id == r.doc_id for r in out) and len(out) == many + 1
    assert max(largest) < 20, largest
