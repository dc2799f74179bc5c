"""CTC losses, the objective, skips, the cache's data source and the commands, against plain Python."""

import itertools
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza import commands
from cadenza.functions import phonemes as ph
from cadenza.operators import corpus, ctc, losses
from cadenza.sources import binary, cache, text


def by_paths(log_probs, targets, blank=0):
    """Minus log of the summed probability of every path of classes that collapses to the targets."""
    total = 0.0
    for path in itertools.product(range(len(log_probs[0]) if log_probs else 0), repeat=len(log_probs)):
        if [c for c, _ in itertools.groupby(path) if c != blank] == targets:
            total += math.exp(sum(row[c] for row, c in zip(log_probs, path)))
    return -math.log(total) if total else math.inf


def test_ctc_equals_all_paths(spark):
    rnd = random.Random(1)
    rows, wanted = [], {}
    for u, (t, targets) in enumerate([(4, [1, 2]), (5, [1, 1]), (3, [1, 1]), (2, [1, 1]), (4, []), (0, []), (0, [1]), (5, [2, 1, 2]), (1, [2]), (5, [2, 2, 1])]):
        raw = [[rnd.gauss(0, 2) for _ in range(3)] for _ in range(t)]
        lp = [[x - math.log(sum(map(math.exp, r))) for x in r] for r in raw]
        rows += [(u, i, r) for i, r in enumerate(lp)]
        wanted[u] = (targets, t, by_paths(lp, targets) if t else (0.0 if not targets else math.inf))
    frames = spark.createDataFrame(rows, "u int, t int, log_probs array<double>").repartition(3)
    targets = spark.createDataFrame([(u, w[0]) for u, w in wanted.items()], "u int, targets array<int>")
    for zero in (True, False):
        got = {r.u: r for r in ctc.losses(frames, targets, "u", zero_infinity=zero).collect()}
        for u, (_, t, loss) in wanted.items():
            want = 0.0 if zero and loss == math.inf else loss
            assert got[u].frames == t and (got[u].loss == want or abs(got[u].loss - want) < 1e-9), u
    bad = spark.createDataFrame([(0, [1, 77]), (99, [1])], "u int, targets array<int>")
    assert {r.u: r.loss for r in ctc.losses(frames, bad, "u").collect()} == {0: None, 99: 0.0}


def test_worked_frames(spark):
    """Two frames of three classes: class 1, then the blank; class 1 has two paths."""
    frames = spark.createDataFrame([("a", 0, [-5.0, -0.1, -3.0]), ("a", 1, [-0.2, -4.0, -2.0])], "k string, t int, log_probs array<double>")
    loss = ctc.losses(frames, spark.createDataFrame([("a", [1])], "k string, targets array<int>"), "k").first().loss
    assert abs(loss + math.log(math.exp(-0.1 - 0.2) + math.exp(-0.1 - 4) + math.exp(-5 - 4))) < 1e-12


def test_objective(spark):
    c = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, float("nan")), (9, 1.0)], "b int, loss double")
    w = spark.createDataFrame([(1, 0.5, 0.0, 2.0), (1, 1.0, 1.0, 1.0), (2, 0.0, 1.0, 1.0), (3, 1.0, 0.0, 1.0)], "b int, predicted double, target double, weight double")
    got = {r.b: (r.ctc_loss, r.score_loss, r.total, r.used) for r in ctc.objective(c, w, "b", 0.5).collect()}
    assert got[1] == (3.0, 0.25, 1.625, True) and not got[2][3] and got[3] == (None, 1.0, None, False) and set(got) == {1, 2, 3}
    assert {r.b: r.total for r in ctc.objective(c, w, "b", 0.0).collect()} == {1: 0.25, 2: 1.0, 3: 1.0}


def test_gate(spark):
    rows = [("a", 1, [1.0, 2.0, 0.0, 4.0], True), ("a", 2, [3.0, 2.0, 0.0, 0.0], True), ("a", 3, [9.0, 9.0, 9.0, 9.0], False), ("b", 4, [1.0, 1.0, 1.0, 1.0], False)]
    df = spark.createDataFrame(rows, "k string, i int, v array<double>, keep boolean")
    got = {r.i: r.gated for r in losses.squeeze_excite(df, ["k"], "v", "keep", 2, lambda h, d: (h - d).cast("double") / 4, lambda d, h: (d - 2 * h).cast("double")).collect()}
    for k, mean in (("a", np.array([2.0, 2.0, 0.0, 2.0])), ("b", np.zeros(4))):
        h = np.maximum(0, np.array([[(i - d) / 4 for d in range(4)] for i in range(2)]) @ mean)
        gate = 1 / (1 + np.exp(-(np.array([[d - 2 * i for i in range(2)] for d in range(4)]) @ h)))
        for r in rows:
            if r[0] == k:
                assert np.allclose(got[r[1]], np.array(r[2]) * gate)


def test_reasons(spark):
    rows = [(0, 0.4, 9, [1], None, None), (1, 16.0, 9, [1], None, None), (2, 1.0, 1, [1, 2], None, None), (3, 1.0, 3, [1, 1], None, None), (4, 1.0, 2, [1, 1], None, None), (5, 1.0, 9, [], None, None), (6, 1.0, None, None, "bad", None), (7, 0.1, None, None, "bad", "no file"), (8, 0.1, None, None, "bad", None)]
    df = spark.createDataFrame(rows, "i int, s double, f int, t array<int>, error string, audio string")
    df = df.withColumn("reason", corpus.skip_reason(F.col("s"), F.col("f"), F.col("t"), F.col("error"), audio_error=F.col("audio")))
    assert {r.i: r.reason for r in df.collect()} == {0: "too_short", 1: "too_long", 2: "too_few_frames", 3: None, 4: "too_few_frames", 5: "too_few_frames", 6: "failed", 7: "failed", 8: "too_short"}
    report = corpus.skip_report(df, "i")
    assert tuple(report.first()) == (1, 2, 1, 3, 2, "bad")
    assert [r.line for r in corpus.report_lines(report).orderBy("ord").collect()] == ["kept 1 utterances; skipped 2 too short, 1 too long, 3 with fewer frames than CTC targets, 2 failed", "2 utterances failed to load, first error: bad"]
    assert corpus.report_lines(corpus.skip_report(df.where("i = 3"), "i")).count() == 1


def samples(n):
    return [(i * 2, f"a/{i}.wav", [0.5 * v + i for v in range(39 * (i % 3 + 1))], [5, i % 41], i % 2) for i in range(n)]


COLUMNS = "index long, audio_path string, features array<float>, targets array<int>, oov_count int"


def test_cache_with_gaps_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "BYTES", 2000)
    path, rows = f"file://{tmp_path}/c", samples(60)
    cache.write_cache(spark.createDataFrame(rows, COLUMNS).repartition(7), path, "mfcc39", "data", "dev", 15.0)
    m = json.loads((tmp_path / "c" / "manifest.json").read_text())
    assert [e["index"] for e in m["samples"]] == [r[0] for r in rows] and (m["num_samples"], m["total_frames"], m["total_oov"]) == (60, sum(len(r[2]) // 39 for r in rows), 30)
    assert (m["feature_dim"], m["feature_mode"], m["data_dir"], m["split"], m["max_duration_secs"]) == (39, "mfcc39", "data", "dev", 15.0)
    assert m["samples"][1] == {"index": 2, "num_frames": 2, "num_targets": 2, "oov_count": 1, "audio_path": "a/1.wav"}
    got = cache.read_cache(spark, path)
    assert sorted(map(tuple, got.select("index", "audio_path", "features", "targets", "oov_count").collect())) == rows and got.where("error IS NOT NULL").count() == 0
    assert spark.read.format("feature_cache").load(path).count() == 60 and len(cache.Reader({"path": path}).partitions()) > 5
    with pytest.raises(Exception, match="is not empty"):
        cache.write_cache(spark.createDataFrame(rows, COLUMNS), path, "mfcc39")
    cache.write_cache(spark.createDataFrame(rows[:5], COLUMNS), path, "mfcc39", overwrite=True)
    assert cache.read_cache(spark, path).count() == 5
    (tmp_path / "c" / "sample_000002.bin").unlink()
    (tmp_path / "c" / "sample_000004.bin").write_bytes(b"MFCC")
    (tmp_path / "c" / "sample_000006.bin").write_bytes(binary.encode_record(np.zeros(39 * 5), 39, [1]))
    assert {r["index"]: r.error for r in cache.read_cache(spark, path).collect()} == {0: None, 2: "no file", 4: "truncated header", 6: "counts differ from the manifest", 8: None}


def test_a_task_that_runs_twice_leaves_one_copy(tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "PIECE", 37)
    path = str(tmp_path / "c")
    writer = cache.Writer({"path": path, "mode": "mfcc39"}, ["index", "audio_path", "features", "targets", "oov_count"], False)
    batches = lambda rows: iter([pa.RecordBatch.from_pylist([dict(zip(("index", "audio_path", "features", "targets", "oov_count"), r)) for r in rows])])

    class Task:
        def __init__(self, number):
            self.number = number

        def partitionId(self):
            return self.number

    rows, said = samples(9), []
    for number, some in ((1, rows[5:]), (0, rows[:5]), (0, rows[:5]), (2, [])):
        monkeypatch.setattr(cache.TaskContext, "get", classmethod(lambda cls, n=number: Task(n)))
        said.append(writer.write(batches(some) if some else iter([])))
    writer.commit([said[0], said[2], said[3]])  # the first try of task 0 was lost
    m = json.loads((tmp_path / "c" / "manifest.json").read_text())
    assert [e["index"] for e in m["samples"]] == [r[0] for r in rows] and m["num_samples"] == 9
    assert len(list((tmp_path / "c").glob("sample_*.bin"))) == 9 and len(list((tmp_path / "c" / "_entries").iterdir())) == 2 and not list((tmp_path / "c").glob("*.part"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = samples(20)
    rows[13] = (26, "a", [1.0] * 40, [1], 0)  # no whole frame
    with pytest.raises(Exception, match="are no rows of 39"):
        cache.write_cache(spark.createDataFrame(rows, COLUMNS).repartition(4), f"{tmp_path}/c", "mfcc39")
    assert list((tmp_path / "c").iterdir()) == []
    with pytest.raises(Exception, match="no usable utterances"):
        cache.write_cache(spark.createDataFrame([], COLUMNS), f"{tmp_path}/c", "mfcc39")
    assert list((tmp_path / "c").iterdir()) == []


def test_caches_of_others(spark, tmp_path):
    """A manifest without fragments and mode, and one whose mode does not fit."""
    (tmp_path / "sample_000007.bin").write_bytes(binary.encode_record(np.zeros(160), 80, [3]))
    m = {"feature_dim": 80, "num_samples": 1, "total_frames": 2, "total_oov": 0, "data_dir": "", "split": "", "samples": [{"index": 7, "num_frames": 2, "num_targets": 1, "oov_count": 0, "audio_path": "x"}]}
    (tmp_path / "manifest.json").write_text(json.dumps(m))
    assert cache.read_manifest(spark, str(tmp_path)).first().feature_mode == "logmel80"
    assert [(r["index"], r.num_frames, r.error) for r in cache.read_cache(spark, str(tmp_path)).collect()] == [(7, 2, None)]
    (tmp_path / "manifest.json").write_text(json.dumps(m | {"feature_mode": "mfcc39"}))
    with pytest.raises(Exception, match="dimension 80 does not fit mode mfcc39"):
        cache.read_manifest(spark, str(tmp_path)).collect()


def test_precompute_from_scan_to_cache(spark, tmp_path):
    d = tmp_path / "data" / "dev" / "103" / "1240"
    d.mkdir(parents=True)
    said = ["THE CAT", "A CAT", "THE CAT", "1984", "THE CAT", "THE THE THE THE THE CAT THE CAT THE CAT THE CAT THE CAT THE CAT", "CAT"]
    (d / "103-1240.trans.txt").write_text("".join(f"u{i} {t}\n" for i, t in enumerate(said)) + "nowhere THE CAT\n")
    tone = lambda s: binary.encode_wave(np.sin(np.arange(int(16000 * s)) * 0.17) * 0.5)
    for i, data in enumerate([tone(1), tone(0.3), tone(3), tone(1), b"RIFF no wave", tone(0.5), tone(0.8)]):
        (d / f"u{i}.wav").write_bytes(data)
    words = spark.createDataFrame([("the", [10, 3]), ("cat", [20, 4, 31]), ("a", [3])], "word string, phones array<int>")
    out = f"file://{tmp_path}/cache"
    report = commands.precompute(spark, f"file://{tmp_path}/data", "dev", words, out, "mfcc39", 2.0).first()
    assert (report.kept, report.too_short, report.too_long, report.too_few_frames, report.failed) == (2, 1, 1, 1, 2) and report.first_error == "no word of the transcript could be resolved"
    got = {r["index"]: r for r in cache.read_cache(spark, out).collect()}
    assert set(got) == {0, 6} and got[0].num_frames == 98 and got[0].targets == [10, 3, ph.SILENCE, 20, 4, 31] and len(got[6].features) == 39 * got[6].num_frames and got[0].error is None
    with pytest.raises(Exception, match="no usable utterances"):
        commands.precompute(spark, f"file://{tmp_path}/data", "dev", words, f"{tmp_path}/none", "mfcc39", 0.2)
    listed = text.with_audio(text.scan_split(spark, f"file://{tmp_path}/data", "dev"), spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}/data").select("path"))
    assert tuple(text.missing_audio(listed).first()) == (8, 1, "nowhere")


def test_evaluate_words(spark):
    rnd = random.Random(3)
    frames = [(f"u{u}", t, [rnd.gauss(0, 1) for _ in range(5)]) for u in range(6) for t in range(12)]
    f = spark.createDataFrame(frames, "u string, t int, logits array<double>").withColumn("log_probs", losses.log_softmax(F.col("logits")))
    words = [(f"u{u}", p, 3 * p, 3 * p + 3, [1 + p % 4, 2], rnd.random()) for u in range(7) for p in range(4)]
    w = spark.createDataFrame(words, "u string, position int, from int, to int, targets array<int>, human double")
    failed = spark.createDataFrame([("u1",)], "u string")
    lines = [r.line for r in commands.evaluate_words(w, f, failed, "u", 5, ["log_prob", "max_logit", "margin", "self_aligned"], replicates=20, facts={"Frames": "72"}).orderBy("ord").collect()]
    assert "- Words: 20 scored, 8 skipped" in lines and "- Frames: 72" in lines and sum(x.startswith("| GOP-") for x in lines) == 4


def test_head_fit_equals_numpy(spark):
    from cadenza.operators import head_fit

    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(300, 6)), rng.random(300), rng.integers(1, 4, 300).astype(float)
    rows = [(v.tolist(), float(a), float(b), i % 2) for i, (v, a, b) in enumerate(zip(x, y, w))] + [(None, 0.5, 1.0, 0), ([1.0], 0.5, 1.0, 0), ([None] * 6, 0.5, 1.0, 1)]
    df = spark.createDataFrame(rows, "vector array<double>, target double, weight double, part int").repartition(9)
    start = head_fit.Head(rng.normal(size=(5, 6)), rng.normal(size=5), rng.normal(size=5), 0.1)
    theta, m, v = start.flat(), np.zeros(41), np.zeros(41)
    losses_ = []
    for t in range(3):
        at = np.arange(300) % 2 == t % 2

        def loss(flat):
            h = head_fit.Head.of(flat, 6, 5)
            return (w[at] * (h.predict(x[at]) - y[at]) ** 2).mean()  # noqa: B023

        g = np.array([(loss(theta + e) - loss(theta - e)) / 2e-6 for e in np.eye(41) * 1e-6])  # by differences, not by the chain rule
        losses_.append(loss(theta))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + head_fit.GUARD)
    head, lines = head_fit.fit(df, start, 3, lambda t: 0.05, "part", 2)
    assert np.allclose(head.flat(), theta, atol=1e-5) and np.allclose([r.loss for r in lines.orderBy("step").collect()], losses_, atol=1e-12) and [r.words for r in lines.collect()] == [150, 150, 150]
    same, none = head_fit.fit(df.limit(0), start, 2, lambda t: 0.05)
    assert (same.flat() == start.flat()).all() and [r.words for r in none.collect()] == [0, 0]


def test_epoch_lines(spark):
    from cadenza.operators import lifecycle

    df = spark.createDataFrame([(1, 2.0, 3e-4, 1.26), (2, 0.12345, 1.0, 10.0), (3, 1.0, 2.5e-11, 0.0), (4, 1.0, 1234.5, 0.0)], "epoch int, loss double, rate double, seconds double")
    assert [r.line for r in lifecycle.epoch_lines(df).orderBy("epoch").collect()] == ["epoch 1: loss 2.0000, lr 3.00e-4, 1.3s", "epoch 2: loss 0.1235, lr 1.00e0, 10.0s", "epoch 3: loss 1.0000, lr 2.50e-11, 0.0s", "epoch 4: loss 1.0000, lr 1.23e3, 0.0s"]


def test_records_are_encoded_a_few_rows_at_a_time():
    """A large batch of wide rows is not all Python objects at once."""
    import pyarrow as pa

    from cadenza.sources import binary

    made = []
    batch = pa.RecordBatch.from_arrays([pa.array([[1.0, 2.0]] * 300, pa.list_(pa.float32()))], names=["x"])
    parts = binary.encoded_batches(iter([batch]), lambda x: made.append(x) or b"r", [0], ["x", "content"])
    first = next(parts)
    assert len(made) == first.num_rows == binary.PART and first.num_rows + sum(p.num_rows for p in parts) == 300
