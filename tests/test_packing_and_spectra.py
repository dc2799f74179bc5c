"""Packing by composed maps against one sample after the other; butterflies against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import batching, features, slices


def one_by_one(lengths, budget, most, heads):
    size, batch, out = 0, -1, []
    for f in lengths:
        if size and size < most and (size + 1) * heads * f * f <= budget:
            size += 1
        else:
            size, batch = 1, batch + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("budget, most, heads", [(9000, 7, 2), (9000, 1, 2), (0, 5, 1), (10**9, 40, 8), (300_000, 64, 3)])
def test_packing_in_slices(spark, monkeypatch, budget, most, heads):
    monkeypatch.setattr(batching, "LENGTHS", 12)
    monkeypatch.setattr(slices, "CUTS", 7)
    rnd = random.Random(budget + most)
    lengths = sorted(rnd.choice([rnd.randint(0, 30), rnd.randint(0, 400)]) for _ in range(900))
    df = spark.createDataFrame(list(enumerate(lengths)), "i int, n int").repartition(5)
    got = [r.batch for r in batching.attention_budget_batches(df, "n", "i", budget, most, heads).orderBy("n", "i").collect()]
    assert got == one_by_one(lengths, budget, most, heads)
    assert batching.attention_budget_batches(df.limit(0), "n", "i", budget, most, heads).count() == 0


def test_maps_compose():
    pack, rnd = batching.Packing(5000, 9, 2), random.Random(4)
    lengths = sorted(rnd.sample(range(1, 90), 40))
    counts = [rnd.randint(1, 30) for _ in lengths]
    whole = pack.composed(lengths, counts, 9)
    for cut in (0, 7, 40):
        a, b = pack.composed(lengths[:cut], counts[:cut], 9), pack.composed(lengths[cut:], counts[cut:], 9)
        assert (b[0][a[0]] == whole[0]).all() and (a[1] + b[1][a[0]] == whole[1]).all()


@pytest.mark.parametrize("n", [1, 2, 8, 64, 512])
def test_power_spectrum(spark, n):
    x = np.random.default_rng(n).normal(size=(3, n))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    got = {r.i: r.p for r in df.select("i", features.power_spectrum(F.col("x")).alias("p")).collect()}
    for i, v in enumerate(x):
        assert np.allclose(got[i], np.abs(np.fft.rfft(v)) ** 2, rtol=1e-9, atol=1e-9)


def test_padded_spectrum_and_odd_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate((400, 512, 3))]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    for r in df.select("i", features.power_spectrum(F.col("x"), 512).alias("p")).collect():
        assert np.allclose(r.p, np.abs(np.fft.rfft(rows[r.i][1], 512)) ** 2, rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError, match="no power of two"):
        features.power_spectrum(F.col("x"), 400)
    odd = spark.createDataFrame([(0, [1.0, 2.0, 4.0]), (1, rows[0][1][:12]), (2, []), (3, None), (4, [5.0])], "i int, x array<double>")
    got = {}
    for r in features.dft_power(odd, "i", "x").collect():
        got.setdefault(r.i, {})[r.bin] = r.power
    assert set(got) == {0, 1, 4} and got[4] == {0: 25.0}
    assert np.allclose([got[0][k] for k in range(2)], np.abs(np.fft.rfft([1, 2, 4])) ** 2) and np.allclose([got[1][k] for k in range(7)], np.abs(np.fft.rfft(rows[0][1][:12])) ** 2)
