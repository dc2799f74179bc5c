"""Hard negatives against all pairs by definition, limits, and edge cases."""

import math
import random

import numpy as np
import pytest

from cadenza.llm import hard_negatives as hn

INF, NAN = math.inf, math.nan


def by_definition(rows, positives=5, negatives=5, share=80, scale=256):
    """rows: (id, vector, label), asking: id % 100 == 0."""
    e = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, lab in e:
        if a % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, w, m in e if len(w) == len(v))
        for ps, p, _ in [x for x in s if x[2] == lab and x[1] != a][:positives]:
            fit = [x for x in s if x[2] != lab and share * -ps <= 100 * -x[0] <= 100 * -ps][:negatives]
            out += [(a, p, r, i, -ps, -ns) for r, (ns, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, schema="vec_id long, embedding array<double>, label int", **more):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(tuple(r) for r in hn.mine(df, df["vec_id"] % 100 == 0, **more).collect())


def table(n, dims, seed, spread=1.0):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0.2, spread) for _ in range(dims)], rnd.choice([0, 0, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("most, asking", [(8192, 256), (37, 2)])
def test_equals_definition(spark, monkeypatch, most, asking):
    monkeypatch.setattr(hn, "ROWS", most)
    monkeypatch.setattr(hn, "ANCHORS", asking)
    rows = table(640, 8, 4)
    rows += [(i, [round(x) / 4 for x in v], lab) for i, v, lab in table(60, 8, 5)]  # few different scores, repeated ids
    assert len(want := by_definition(rows)) > 50 and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=9, share=30, scale=8) == by_definition(rows, 2, 9, 30, 8)


def test_nothing_is_broadcast(spark, monkeypatch):
    """Copies of blocks are as many as blocks times shards: however small their files look, the driver does not collect them for a join."""
    monkeypatch.setattr(hn, "ROWS", 50)
    monkeypatch.setattr(hn, "ANCHORS", 2)
    plans, real = [], hn.written
    monkeypatch.setattr(hn, "written", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, label))[1])
    df = spark.createDataFrame(table(600, 4, 3), "vec_id long, embedding array<double>, label int")
    out = hn.mine(df, df["vec_id"] % 100 == 0)
    assert len(out.collect()) > 0
    assert not [p for p in (*plans, out._jdf.queryExecution().executedPlan().toString()) if "Broadcast" in p]


def test_edges(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, None, 1), (4, [None, 1.0], 2), (5, [NAN, 1.0], 2), (6, [1.0, INF], 2), (7, [1.0, 2.0], None), (None, [1.0, 2.0], 2),
        (8, [1.0], 2), (100, [], 3), (9, [], 3), (10, [], 1), (200, [3.0], 7), (300, [-1.0, -2.0], 1), (2, [1.0, 1.9], 2), (400, [1e306, 1.0], 2), (500, [1.0, 2.0], None),
    ]
    want = by_definition([r for r in rows if r[0] != 400])
    assert [r[:4] for r in want] == [(0, 1, 1, 2), (0, 1, 2, 2), (100, 9, 1, 10)]
    assert mined(spark, rows) == want
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == []
    more = [(i, v, lab, "x", 3) for i, v, lab in rows]
    assert mined(spark, more, "vec_id long, embedding array<double>, label int, part string, score int") == want
    assert mined(spark, rows[:3], "vec_id int, embedding array<float>, label long") == by_definition([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows[:3]])


@pytest.mark.parametrize("size", [1e4, 1e6, 3e6])
def test_large_components_are_exact(spark, size):
    rows = [(i, [x * size + 1 / 3 for x in v], lab) for i, v, lab in table(210, 5, 8)]
    assert mined(spark, rows) == by_definition(rows) != []


def test_score_beyond_long_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        mined(spark, [(0, [1e9], 1), (1, [1e9], 1)])


def test_limits():
    s = np.array([9, 8, 8, 5, 4, 0, -3])
    assert hn.within(s, 8, 5, 80) == slice(1, 3) and hn.within(s, 5, 5, 80) == slice(3, 5) and hn.within(s, 10, 1, 80) == slice(0, 1)
    assert hn.within(s, -1, 5, 80) == slice(6, 6) and hn.within(s, 0, 5, 80) == slice(5, 6) and hn.within(s[:0], 3, 5, 80) == slice(0, 0)
