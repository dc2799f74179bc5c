"""Reports, teacher features, checkpoints, settings, resampling: worked examples and brute-force versions."""

import numpy as np
import pytest

from cadenza.operators import batching, common, evaluate, lifecycle, losses, stats, teacher
from cadenza.sources import config, text


def brute_rho(x, y):
    rank = lambda v: (np.searchsorted(np.sort(v), v) + np.searchsorted(np.sort(v), v, "right") + 1) / 2
    dx, dy = rank(x) - (len(x) + 1) / 2, rank(y) - (len(y) + 1) / 2
    spread = np.sqrt((dx * dx).sum() * (dy * dy).sum())
    return 0.0 if spread < 1e-15 else (dx * dy).sum() / spread


@pytest.mark.parametrize("cells", [4_000_000, 1200, 1])
def test_bootstrap_ways_agree(spark, monkeypatch, cells):
    """All replicates at once, several passes and slices, and row by row."""
    monkeypatch.setattr(stats.WeightedRanks, "CELLS", cells)
    monkeypatch.setattr(stats.WeightedRanks, "ROWS", 50)
    monkeypatch.setattr(stats.WeightedRanks, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    rows = [(None if g == 2 else f"g{g}", int(rng.integers(0, 9 + g)), round(float(rng.normal()), 1), float(rng.integers(0, 4))) for g in range(3) for _ in range(120)]
    df = spark.createDataFrame([*rows, ("g0", 1, None, 2.0), ("g0", 1, float("nan"), 2.0)], "method string, c int, x double, y double").repartition(3)
    got = {r.method: (r.lo, r.hi) for r in stats.cluster_bootstrap(df, "x", "y", "c", 30, 42, ["method"]).collect()}
    import hashlib

    for m, ends in got.items():
        keys = sorted({c for g, c, _, _ in rows if g == m})
        of = {k: [(x, y) for g, c, x, y in rows if g == m and c == k] for k in keys}
        rhos = []
        for b in range(30):
            drawn = [r for j in range(len(keys)) for r in of[keys[int(hashlib.md5(f"42:{b}:{j}".encode()).hexdigest()[:8], 16) % len(keys)]]]
            rhos.append(brute_rho(*map(np.array, zip(*drawn))))
        rhos.sort()
        assert abs(ends[0] - rhos[int(0.025 * 29 + 0.5)]) < 1e-9 and abs(ends[1] - rhos[int(0.975 * 29 + 0.5)]) < 1e-9


def test_report_counts_and_lines(spark):
    wide = spark.createDataFrame([(i, i / 12, None if i < 2 else float(i % 5), i % 7 / 6) for i in range(12)] + [(99, None, None, 0.5)], "key int, log_prob double, margin double, human double")
    counts = evaluate.word_counts(wide, ["log_prob", "margin"])
    assert tuple(counts.first()) == (12, 1)
    with pytest.raises(Exception, match="only 9 words could be scored; need at least 10"):
        evaluate.word_counts(wide.where("key < 9"), ["log_prob", "margin"]).collect()
    results = evaluate.report(evaluate.tall(wide, "key", ["log_prob", "margin"], "human"), "key", 50)
    lines = [r.line for r in evaluate.markdown(results, counts, facts={"Features": "x"}).orderBy("ord").collect()]
    assert lines[0] == "# Evaluation" and "- Words: 12 scored, 1 skipped" in lines and lines[-2].startswith("| GOP-LogProb | 12 | ") and lines[-1].startswith("| GOP-Margin | 10 | ") and lines[-1].endswith(" | target logit minus the best other logit (blank included) |")


def test_decimals_are_those_of_the_binary_value(spark):
    """Five decimals ending in 5 are above or below the middle in binary; exact middles go to even."""
    numbers = [-0.45685, 0.45685, 0.00015, 0.12345, 0.03125, 0.09375, -0.03125, 1.0, -0.00001, 0.99995, 2.5e-5, 123456.78905]
    rows = [(f"m{i}", 12, x, -x, x / 2, x * 2) for i, x in enumerate(numbers)] + [("odd", 12, None, float("nan"), float("inf"), 0.5)]
    results = spark.createDataFrame(rows, "method string, n long, rho double, lo double, hi double, pearson double")
    got = {r.method: r.line for r in evaluate.report_lines(results).collect()}
    for m, n, rho, lo, hi, pearson in rows[:-1]:
        assert got[m] == "| %s | %d | %.4f | [%.4f, %.4f] | %.4f |" % (m, n, rho, lo, hi, pearson)
    assert got["m0"].startswith("| m0 | 12 | -0.4568 | [0.4568, ") and got["odd"] == "| odd | 12 | null | [NaN, Infinity] | 0.5000 |"


def frames(spark, rows):
    return spark.createDataFrame(rows, "key string, t long, v array<double>")


def test_teacher(spark):
    student = frames(spark, [("a", t, [float(t), 1.0]) for t in range(5)] + [("b", 0, [1.0, 1.0])])
    other = frames(spark, [("a", t, [10.0 * t, 1.0]) for t in range(9)] + [("b", 0, [0.0, 0.0]), ("c", 0, [0.0, 0.0])])
    m = sorted((r.key, r.t, r.student[0], r.teacher[0]) for r in teacher.matched_frames(student, other, "key").collect())
    assert m == [("a", 0, 0.0, 0.0), ("a", 1, 2.0, 10.0)]  # five frames are two pairs, one frame is none
    loss = teacher.distillation_loss(student, other, "key", lambda v: v).collect()
    assert [(r.key, r.frames, r.loss) for r in loss] == [("a", 2, 16.0)]
    u = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3)], "key string, n int")
    assert {r.key for r in teacher.retained(u, other, "key").collect()} == {"a", "b"}
    assert {r.key: r.t for r in teacher.with_teacher(u, other.where("t = 0"), "key").collect()} == {"a": 0, "b": 0, "x": None}
    with pytest.raises(ValueError, match="no training utterance has teacher features"):
        teacher.retained(u.where("key = 'x'"), other, "key")
    words = spark.createDataFrame([("a", p, 9, p / 10) for p in range(9)], "key string, position int, num_words int, human double")
    with pytest.raises(Exception, match="only 9 words matched"):
        teacher.evaluate_head(words, other, "key", "human", lambda v: v[0]).collect()
    r = teacher.evaluate_head(words, other, "key", "human", lambda v: v[0], least=9).first()
    assert r.n == 9 and abs(r.rho - 1) < 1e-12


def test_score_words(spark):
    f = frames(spark, [("a", t, [float(t), float(t == 3)]) for t in range(4)])
    words = spark.createDataFrame([("a", 0, 2, "x"), ("a", 1, 2, "y"), ("a", 2, 2, "beyond"), ("none", 0, 1, "z"), ("a", 0, 2, "again")], "key string, position int, num_words int, tag string")
    got = {r.tag: r.score for r in evaluate.score_words(words, f, "key", lambda v: v[0] + 10 * v[1]).collect()}
    assert got == {"x": 0.5, "again": 0.5, "y": 2.5 + 5, "beyond": None, "z": None}
    got = {r.tag: r.score for r in evaluate.score_words(words, f, "key", lambda v: v[0], lambda v: 50.0 * v[1]).collect()}
    assert abs(got["y"] - 3) < 1e-9 and got["x"] == 0.5


def test_checkpoints(spark):
    e = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, float("nan")), (4, 0.2), (5, None), (6, 0.4), (7, 0.1)], "epoch int, rho double")
    got = {r.epoch: (r.regular, r.best, r.final) for r in lifecycle.checkpoints(e, "epoch", "rho", 3).collect()}
    assert got == {1: (False, True, False), 2: (False, True, False), 3: (True, False, False), 6: (True, True, False), 7: (False, False, True)}
    assert {r.epoch for r in lifecycle.checkpoints(e, "epoch", "rho", 0, 4).collect()} == {4, 7}


def test_settings(spark, tmp_path):
    path = f"file://{tmp_path}/model-config.json"
    assert config.read_config(spark, path, {"epochs": 3}) == {"epochs": 3}
    config.write_config(spark, {"epochs": 20, "name": "ä"}, path)
    assert config.read_config(spark, path, {}) == {"epochs": 20, "name": "ä"}
    good = {"epochs": 1, "batch_size": 16, "learning_rate": 3e-4, "ctc_weight": 0.5, "holdout": "x", "eval_interval": 1, "feature_dim": 39, "input_dim": 39}
    assert config.validated(good) is good
    for key, value in (("epochs", 0), ("batch_size", 0), ("learning_rate", float("nan")), ("learning_rate", 0.0), ("ctc_weight", 1.5), ("eval_interval", 0), ("input_dim", 80)):
        with pytest.raises(ValueError):
            config.validated(good | {key: value})


def test_epoch_order_is_a_permutation(spark):
    b = spark.range(3000).withColumnRenamed("id", "batch")
    one, two = ({r.batch: r.place for r in batching.epoch_order(b.repartition(5), "batch", e).collect()} for e in (1, 2))
    assert sorted(one.values()) == list(range(3000)) and one != two


def test_mixup_stays_in_its_batch(spark):
    v = spark.createDataFrame([(i // 8, i, [float(i // 8)] * 3, i % 11 / 10, i % 11, 1.0) for i in range(160)], "batch int, id int, v array<double>, y double, raw int, w double")
    m = losses.mixup(v, "batch", "id", "v", "y", "raw", "w", 0.4, 4).collect()
    assert len(m) == sum(i % 11 <= 4 for i in range(160)) and all(abs(r.v[0] - r.batch) < 1e-9 and 0 <= r.raw <= 10 for r in m)


def test_join_without_keys_needs_one_row(spark):
    one = spark.range(1).withColumnRenamed("id", "x")
    assert common.join_on(spark.range(3), one, []).count() == 3
    with pytest.raises(Exception, match="needs one row"):
        common.join_on(spark.range(3), spark.range(2).withColumnRenamed("id", "x"), []).collect()


def test_scan_of_a_split(spark, tmp_path):
    for chapter, lines in (("b/2", "b-2-0001 SECOND LINE\nb-2-0000 FIRST LINE\n"), ("a/1", "a-1-0000 THE CAT SAT\n\nnoblank\n")):
        folder = tmp_path / "dev" / "dev" / chapter
        folder.mkdir(parents=True)
        (folder / f"{chapter.replace('/', '-')}.trans.txt").write_text(lines)
    (tmp_path / "none").mkdir()
    got = [(r.utt_id, r.transcript) for r in text.scan_split(spark, f"file://{tmp_path}", "dev").collect()]
    assert got == [("a-1-0000", "THE CAT SAT"), ("b-2-0001", "SECOND LINE"), ("b-2-0000", "FIRST LINE")]
    for split, message in (("missing", "not found"), ("none", "no utterances found")):
        with pytest.raises(ValueError, match=message):
            text.scan_split(spark, f"file://{tmp_path}", split)


def test_long_pronunciations_stay_whole(spark, tmp_path):
    (tmp_path / "d.txt").write_text("LONG " + " ".join(["AA"] * 1500) + "\n")
    assert len(text.read_dictionary(spark, f"file://{tmp_path}/d.txt").first().phones) == 1500


def test_frames_of_rows_like_frames_of_arrays(spark):
    from cadenza.operators import sequence

    sizes = {"short": 19, "one": 20, "some": 61, "none": 1}
    rows = [(k, i, float(i)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    got = {}
    for r in sequence.framed(df, ["k"], ["i"], "v", 20, 8).collect():
        got.setdefault((r.k, r.frame), {})[r.t] = r.v
    want = {(k, f): {t: float(f * 8 + t) for t in range(20)} for k, n in sizes.items() if n >= 20 for f in range((n - 20) // 8 + 1)}
    assert got == want
    labels = spark.createDataFrame([(k, i, x) for k, xs in (("a", [1, 1, 2, 2, 2]), ("b", [1, 2, 3]), ("n", [None, None])) for i, x in enumerate(xs)], "k string, i int, x int")
    assert {r.k: (r.targets, r.min_frames) for r in sequence.ctc_frames_needed(labels, ["k"], ["i"], "x").collect()} == {"a": (5, 8), "b": (3, 3), "n": (2, 3)}


def test_spans_are_exact_beyond_doubles(spark):
    from cadenza.operators import sequence

    n = 2**53 + 1
    df = spark.createDataFrame([(0, 1, n), (1, 3, n), (0, 0, 5), (5, 3, 9), (0, 9, 0)], "p long, w long, f long")
    F = __import__("pyspark").sql.functions
    got = [r.s and tuple(r.s) for r in df.select(sequence.word_span(F.col("p"), F.col("w"), F.col("f")).alias("s")).collect()]
    assert got == [(0, n), (n // 3, 2 * n // 3), None, None, None]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_batches_of_one_common_length(spark, kind):
    rows = [(i, 7 if i % 3 else i % 20) for i in range(2000)]
    df = spark.createDataFrame([(i if kind == "long" else f"{i:05}", n) for i, n in rows], f"id {kind}, n int").repartition(5)
    got = {int(r.id): r.batch for r in batching.fixed_batches(df, "n", "id", 16).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {i: k // 16 for k, (i, _) in enumerate(order)}
