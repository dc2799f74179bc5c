"""Bootstrap with both sides sliced, against resampled rows ranked by numpy."""

import hashlib

import numpy as np
import pytest

from cadenza.functions import digests
from cadenza.operators import common, resampling, stats
from tests.test_evaluation import brute_rho


def by_rows(rows, replicates, seed):
    keys = sorted({c for c, _, _ in rows})
    of = {k: [(x, y) for c, x, y in rows if c == k] for k in keys}
    draw = lambda b, j: int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:8], 16) % len(keys)
    return [brute_rho(*map(np.array, zip(*[r for j in range(len(keys)) for r in of[keys[draw(b, j)]]]))) for b in range(replicates)]


@pytest.fixture(scope="module")
def table():
    """Two methods; one cluster and one value of y hold a third of the rows, x has many values."""
    rng = np.random.default_rng(6)
    out = []
    for m, n in (("a", 900), ("b", 200)):
        for i in range(n):
            y = 2.0 if rng.random() < 0.35 else float(rng.integers(0, 9))
            out.append((m, 7 if rng.random() < 0.35 else int(rng.integers(0, n // 6)), round(float(rng.normal() + y / 9), 3), y))
    return out


@pytest.mark.parametrize("values, many", [(50_000, 200_000), (40, 60)])
def test_equals_resampled_rows(spark, monkeypatch, table, values, many):
    monkeypatch.setattr(resampling, "BLOCK", 5)
    monkeypatch.setattr(resampling, "VALUES", values)
    monkeypatch.setattr(common, "MANY", many)
    df = spark.createDataFrame(table, "m string, c int, x double, y double").repartition(4)
    ranks = stats.WeightedRanks(stats._clean(df, "x", "y", "c", ["m"]), ["m"])
    if values == 40:
        assert resampling.sliced(ranks.counts, "x").select("key", "x_slice").distinct().count() > 20
    found = resampling.rhos(ranks.counts, ranks.numbers, lambda first, many: stats._times(ranks.numbers, first, many, 42, ["key"]), 12)
    got = {}
    for r in found.collect():
        got.setdefault("a" if '"a"' in r.key else "b", {})[r.b] = r.rho
    for m in "ab":
        want = by_rows([r[1:] for r in table if r[0] == m], 12, 42)
        assert np.allclose([got[m][b] for b in range(12)], want, atol=1e-10) and len(got[m]) == 12


def test_weights_are_as_many_as_rows(spark, monkeypatch, table):
    """However many replicates draw a row, it stands once in the tables of a block."""
    monkeypatch.setattr(resampling, "BLOCK", 6)
    df = spark.createDataFrame(table, "m string, c int, x double, y double")
    ranks = stats.WeightedRanks(stats._clean(df, "x", "y", "c", []), [])
    seen = []
    real = resampling.settled
    monkeypatch.setattr(resampling, "settled", lambda d: (out := real(d), seen.append((out.columns, out.count())))[0])
    resampling.rhos(ranks.counts, ranks.numbers, lambda first, many: stats._times(ranks.numbers, first, many, 1, ["key"]), 6).collect()
    assert max(n for _, n in seen) <= ranks.counts.count() and any("w" in c for c, _ in seen)


def test_no_replicates_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 1.0)], "m string, c int, x double, y double")
    ranks = stats.WeightedRanks(stats._clean(df, "x", "y", "c", ["m"]), ["m"])
    assert resampling.rhos(ranks.counts, ranks.numbers, None, 0).count() == 0
    ranks = stats.WeightedRanks(stats._clean(df.limit(0), "x", "y", "c", ["m"]), ["m"])
    assert resampling.rhos(ranks.counts, ranks.numbers, lambda first, many: stats._times(ranks.numbers, first, many, 1, ["key"]), 3).count() == 0


def test_draws_are_those_of_the_join(spark):
    """Clusters by replicates counted in tasks agree with the draws of the SQL form; passes are few, as most counts take a byte."""
    rows = [(u, float(u % 7), float(u % 5)) for u in range(400)]
    ranks = stats.WeightedRanks(stats._clean(spark.createDataFrame(rows, "u long, x double, y double"), "x", "y", "u", []), [])
    got = ranks._draws(3, 4, 42)[""]
    want = np.zeros((400, 4))
    for r in stats._times(ranks.numbers, 3, 4, 42, ["key"]).collect():
        want[r["g"], r["b"] - 3] = r["times"]
    assert (got == want).all() and got.dtype == np.uint8


def test_leading_digits_of_digests(monkeypatch):
    monkeypatch.setattr(digests, "BATCH", 700)
    for prefix in (b"42:0:", b"42:1999:", b"-12345:7:", b"", b"x" * 45):
        got = digests.leading(prefix, 10_050)
        assert all(int(got[j]) == int(hashlib.md5(prefix + b"%d" % j).hexdigest()[:8], 16) for j in [*range(0, 10_050, 7), 9, 10, 99, 100, 999, 1000, 9999, 10_000])
    assert len(digests.leading(b"1:", 0)) == 0
    with pytest.raises(ValueError):
        digests.leading(b"x" * 46, 3)


@pytest.mark.parametrize("returned", [4_000_000, 0])
@pytest.mark.parametrize("rows, piece", [(500_000, 65_536), (130, 40), (130, 500)])
def test_parts_and_pieces_equal_resampled_rows(spark, monkeypatch, table, returned, rows, piece):
    """Weights by value from the parts, and the side with few values ranked first; one piece, parts of pieces; rows that stand twice; long runs."""
    monkeypatch.setattr(stats.WeightedRanks, "RETURNED", returned)
    monkeypatch.setattr(stats.WeightedRanks, "ROWS", rows)
    monkeypatch.setattr(stats.WeightedRanks, "PIECE", piece)
    monkeypatch.setattr(stats.WeightedRanks, "COLUMNS", 5)
    monkeypatch.setattr(stats.WeightedRanks, "CELLS", 2 * 24 * 21)  # two values a third too many for all replicates at once
    twice = [(m, c, round(x, 1), y) for m, c, x, y in table] + [r for r in table if r[1] == 7][:40] * 2 + [("a", 8, -0.0, 1.0), ("a", 8, 0.0, 1.0)]
    df = spark.createDataFrame(twice, "m string, c int, x double, y double").repartition(4)
    ranks = stats.WeightedRanks(stats._clean(df, "x", "y", "c", ["m"]), ["m"])
    assert ranks.fits()
    got = ranks.rhos(45, 42)
    assert ranks.ranked_first == (returned == 0) and set(ranks.parts.values()) == ({1} if rows == 500_000 else set(ranks.parts.values()) - {1})
    for m in "ab":
        want = by_rows([r[1:] for r in twice if r[0] == m], 45, 42)
        assert np.allclose(got[f'{{"c0":"{m}"}}'], want, atol=1e-12)


def test_passes_move_no_rows(spark, monkeypatch, table):
    """Rows are dealt into parts once: no pass of replicates shuffles them again."""
    monkeypatch.setattr(stats.WeightedRanks, "ROWS", 130)
    df = spark.createDataFrame(table, "m string, c int, x double, y double")
    ranks = stats.WeightedRanks(stats._clean(df, "x", "y", "c", ["m"]), ["m"])
    plans, inside, kind, real = [], [], type(df), stats.WeightedRanks._pass
    monkeypatch.setattr(stats.WeightedRanks, "_pass", lambda self, *a: (inside.append(1), real(self, *a), inside.pop())[1])
    for name in ("collect", "toArrow"):
        f = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, f=f: (inside and plans.append(self._jdf.queryExecution().executedPlan().toString()), f(self))[1])
    ranks.rhos(4, 42)
    assert plans and not [p for p in plans if "hashpartitioning" in p]
