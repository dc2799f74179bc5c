"""Sequences cut into slices, and spans that meet through bins, against loops over rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.operators import common, intervals, sequence, slices

LONGEST = 60


@pytest.fixture(scope="module")
def rows():
    """Half of all rows under one key; keys and values with nulls, orders of two columns with ties in the first."""
    rnd = random.Random(5)
    out = [("hot", i // 7, i, round(rnd.uniform(-9, 9), 3) if rnd.random() > 0.05 else None, rnd.choice("aaab") if i % 400 > 150 else "a") for i in range(3000)]
    out += [(k, i // 3, i, float(i), rnd.choice(["a", "b", None])) for k in ["x", "y", None, "z"] for i in range({"x": 61, "y": 60}.get(k, 300))]
    out += [(f"s{i % 300}", i, -i, float(i), "b") for i in range(1500)]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key string, t int, i int, v double, label string").repartition(7)


@pytest.fixture(autouse=True)
def short(monkeypatch):
    monkeypatch.setattr(slices, "ROWS", LONGEST)
    monkeypatch.setattr(slices, "CUTS", 7)


def sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    return {k: sorted(v, key=lambda r: r[:2]) for k, v in by.items()}


def test_no_slice_is_long(df, rows):
    rest, hot = slices.split(df, ["key"], ["t", "i"])
    assert rest.groupBy("key").count().where(f"count > {LONGEST}").count() == 0 and rest.count() + hot.count() == len(rows)
    got = hot.groupBy("key", "__slice").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "i")).alias("a"), F.max(F.struct("t", "i")).alias("b")).collect()
    assert max(r.n for r in got) <= LONGEST and len([r for r in got if r.key == "hot"]) >= 50
    for key in {r.key for r in got}:
        mine = sorted((r for r in got if r.key == key), key=lambda r: r["__slice"])
        assert all(tuple(x.b) < tuple(y.a) for x, y in zip(mine, mine[1:]))  # slices follow each other in the order
    again = slices.split(df.repartition(3), ["key"], ["t", "i"])[1]
    assert sorted(map(tuple, again.select("key", "t", "i", "__slice").fillna("-").collect())) == sorted(map(tuple, hot.select("key", "t", "i", "__slice").fillna("-").collect()))


def test_short_sequences_are_not_cut(spark, df):
    assert slices.split(df, ["key"], ["t", "i"], rows=10_000)[1] is None
    assert slices.split(df.limit(0), ["key"], ["t", "i"])[1] is None


def test_rows_of_one_place_end(spark):
    same = spark.range(200).select(F.lit("k").alias("key"), F.lit(1).alias("t"))
    rest, hot = slices.split(same, ["key"], ["t"])
    assert rest.count() == 0 and hot.count() == 200 and hot.select("__slice").distinct().count() == 1


def test_places(df, rows):
    want = {(k, *r[:2]): (p, len(s)) for k, s in sequences(rows).items() for p, r in enumerate(s)}
    assert {(r.key, r.t, r.i): (r["__t"], r["__n"]) for r in slices.placed(df, ["key"], ["t", "i"]).collect()} == want


def test_neighbours_repeat_ends(df, rows):
    got = {(r.key, r.t, r.i): (r["__b1"], r["__b2"], r["__b3"], r["__a1"], r["__a2"]) for r in slices.neighbours(df, ["key"], ["t", "i"], "v", 3, 2).collect()}
    want = {}
    for k, s in sequences(rows).items():
        for p, r in enumerate(s):
            want[(k, *r[:2])] = tuple(s[min(max(p + d, 0), len(s) - 1)][2] for d in (-1, -2, -3, 1, 2))
    assert got == want


def test_slices_shorter_than_the_reach(df, rows, monkeypatch):
    monkeypatch.setattr(slices, "ROWS", 2)
    small = df.where("key = 'x' OR key = 's1'")
    got = {(r.key, r.t, r.i): [r[f"__b{d}"] for d in range(1, 6)] + [r[f"__a{d}"] for d in range(1, 6)] for r in slices.neighbours(small, ["key"], ["t", "i"], "v", 5, 5, repeat=False).collect()}
    for k in ("x", "s1"):
        s = sequences(rows)[k]
        for p, r in enumerate(s):
            assert got[(k, *r[:2])] == [s[q][2] if 0 <= (q := p + d) < len(s) else None for d in (-1, -2, -3, -4, -5, 1, 2, 3, 4, 5)]


def test_operators_on_long_sequences(df, rows):
    want_y, want_d, want_runs, want_frames = {}, {}, [], {}
    for k, s in sequences(rows).items():
        v = [r[2] for r in s]
        at = lambda p: v[min(max(p, 0), len(v) - 1)]  # noqa: B023, E731
        for p, r in enumerate(s):
            want_y[(k, *r[:2])] = v[p] if p == 0 or v[p] is None or v[p - 1] is None else v[p] - 0.97 * v[p - 1]
            near = [at(p + d) for d in (-2, -1, 1, 2)]
            want_d[(k, *r[:2])] = None if None in near else (near[2] - near[1] + 2 * (near[3] - near[0])) / 10
        start = 0
        for p in range(1, len(s) + 1):
            if p == len(s) or s[p][3] != s[start][3]:
                want_runs.append((k, s[start][3], start, p))
                start = p
        for f in range((len(s) - 20) // 8 + 1 if len(s) >= 20 else 0):
            for t in range(20):
                want_frames[(k, f, t)] = v[f * 8 + t]
    key, order = ["key"], ["t", "i"]
    close = lambda got, want: got.keys() == want.keys() and all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) < 1e-9) for k, a in got.items())
    assert close({(r.key, r.t, r.i): r.y for r in sequence.pre_emphasis(df, key, order, "v", "y").collect()}, want_y)
    assert close({(r.key, r.t, r.i): r.d for r in sequence.regression_delta(df, key, order, "v", "d").collect()}, want_d)
    assert {(r.key, r.frame, r.t): r.v for r in sequence.framed(df, key, order, "v", 20, 8).collect()} == want_frames
    asc = lambda x: (str(x[0]), x[2])
    assert sorted((tuple(r) for r in sequence.runs(df, key, order, "label").collect()), key=asc) == sorted(want_runs, key=asc)
    assert sorted((tuple(r) for r in sequence.runs(df, key, order, "label", "a").collect()), key=asc) == sorted((r for r in want_runs if r[1] not in ("a", None)), key=asc)
    needed = {r.key: (r.targets, r.min_frames) for r in sequence.ctc_frames_needed(df, key, order, "label").collect()}
    assert needed == {k: (len(s), len(s) + sum(x[3] == y[3] for x, y in zip(s, s[1:]))) for k, s in sequences(rows).items()}


def test_tables_too_large_to_broadcast(df, rows, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 0)
    want = {(k, *r[:2]): p for k, s in sequences(rows).items() for p, r in enumerate(s)}
    assert {(r.key, r.t, r.i): r["__t"] for r in slices.placed(df, ["key"], ["t", "i"]).collect()} == want


def spans(seed, n, label=False):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = rnd.randrange(-30, 900)
        out.append((i, rnd.choice(["k", "k", "k", "m", None]), a if i % 17 else None, a + rnd.choice([0, -3, 1, 5, 40, 400]), rnd.choice("ab")))
    return out


def test_points_meet_the_spans_that_cover_them(spark):
    s = spans(1, 150)
    points = [(k, p, p * 0.5) for k in ("k", "m", None) for p in range(-10, 700)] + [("k", None, 1.0), ("k", 5, 9.0)]
    got = intervals.points_in(spark.createDataFrame(s, "id int, key string, a int, b int, label string"), spark.createDataFrame(points, "key string, p int, x double"), ["key"], "a", "b", "p")
    assert got.columns == ["id", "key", "a", "b", "label", "p", "x"]
    want = sorted((i, p, x) for i, k, a, b, _ in s for k2, p, x in points if k is not None and k == k2 and a is not None and p is not None and a <= p < b)
    assert sorted((r.id, r.p, r.x) for r in got.collect()) == want


def test_overlaps_once(spark):
    left, right = spans(2, 120), [(i + 1000, k, a, b, lab) for i, k, a, b, lab in spans(3, 120)]
    df1 = spark.createDataFrame(left, "id int, key string, a int, b int, label string")
    df2 = spark.createDataFrame(right, "rid int, key string, c int, d int, label string")
    got = intervals.overlapping(df1, df2, ["key", "label"], ("a", "b"), ("c", "d"))
    want = sorted((i, j) for i, k, a, b, m in left for j, k2, c, d, m2 in right if k is not None and (k, m) == (k2, m2) and a is not None and c is not None and a < b and c < d and a < d and c < b)
    assert sorted((r.id, r.rid) for r in got.collect()) == want
    all_left = {r.id for r in intervals.overlapping(df1, df2, ["key", "label"], ("a", "b"), ("c", "d"), "left").collect()}
    assert all_left == {x[0] for x in left}


def test_joined_rows_follow_the_hits(spark):
    """One key with 20,000 frames and 2,000 words of ten: no row meets the whole key."""
    words = spark.range(2000).select(F.lit("u").alias("key"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 10).alias("b"))
    frames = spark.range(20_000).select(F.lit("u").alias("key"), F.col("id").alias("t"))
    copies = words.withColumn("bin", F.explode(intervals._bins("a", "b", intervals.WIDTH))).join(frames.withColumn("at", intervals._bin("t", intervals.WIDTH)), F.col("bin") == F.col("at"))
    assert copies.count() < 10 * intervals.points_in(words, frames, ["key"], "a", "b", "t").count() == 200_000


def test_first_overlapping(spark):
    targets = [("u", 0, 0, "a", 0, 50), ("u", 0, 1, "b", 0, 50), ("u", 1, 0, "a", 300, 900), ("u", 2, 0, "a", 7, 7), ("w", 0, 0, "a", 0, 50), ("u", 3, 0, None, 0, 9)]
    segments = [("u", "a", 40, 60), ("u", "a", 10, 20), ("u", "b", 60, 70), ("u", "a", 0, 0), ("u", "a", 200, 1000), ("v", "a", 0, 90)]
    got = sequence.first_overlapping(spark.createDataFrame(targets, "key string, position int, ord int, label string, from int, to int"), spark.createDataFrame(segments, "key string, label string, start int, stop int"), ["key"], "label")
    assert {(r.key, r.position, r.ord): (r.seg_start, r.seg_stop) for r in got.collect()} == {
        ("u", 0, 0): (10, 20), ("u", 0, 1): (None, None), ("u", 1, 0): (200, 1000), ("u", 2, 0): (None, None), ("w", 0, 0): (None, None), ("u", 3, 0): (None, None),
    }
