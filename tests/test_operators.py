"""Worked examples of the operators outside the training-data subpackage."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import phonemes as ph
from cadenza.operators import batching, evaluate, features, g2p, lifecycle, losses, sequence, stats
from cadenza.sources import binary, cache, text


def one(df):
    return df.first()[0]


def test_table_sizes():
    assert (len(ph.PHONEMES), len(ph.POSSESSIVES), len(ph.SUFFIXES), len(ph.PREFIXES)) == (40, 7, 21, 8)
    assert ph.classes("F AA DH ER") == [15, 1, 11, 13]


@pytest.mark.parametrize(
    ("word", "want", "method"),
    [
        ("FATHER", "F AA DH ER", "dictionary"), ("KETTLE'S", "K EH T AH L Z", "possessive"), ("SEA-CAPTAIN", "S IY SIL K AE P T AH N", "hyphen_split"), ("GLIDING", "G L AY D IH NG", "affix_strip"),
        ("TIDINESS", "T AY D IY N AH S", "affix_strip"), ("SHIPMASTERS", "SH IH P SIL M AE S T ER Z", "compound_split"), ("UNTIDINESS", "AH N T AY D IY N AH S", "chained_affix"), ("THINK", "TH IH N K", "rules"),
        ("BOX", "B AA K S", "rules"), ("PHONE", "F AA N EH", "rules"), ("NIGHT", "N IH T", "rules"), ("BOX'S", "B AA K S Z", "possessive_rules"), ("GH", "", None), ("", "", None),
    ],
)
def test_readings(spark, word, want, method):
    r = g2p.resolve(spark.createDataFrame([(word,), (None,)], "word string"), g2p.seed_dictionary(spark)).collect()
    assert len(r) == 1 and r[0].method == method
    assert r[0].phones == [41 if s == "SIL" else ph.classes(s)[0] for s in want.split()]


def test_transcripts(spark):
    d = spark.createDataFrame([(1, "hello 42 world"), (2, "The cat"), (3, "  -- "), (4, "1984")], "doc_id long, text string")
    r = {x.doc_id: x for x in g2p.transcript_targets(d, g2p.seed_dictionary(spark)).collect()}
    assert r[1].targets == [*ph.classes("HH AH L OW"), 41, *ph.classes("W ER L D")] and (r[1].unresolved, r[1].dict_hits) == (1, 2)
    assert r[2].targets == [11, 3, 41, 21, 2, 32] and 3 not in r and r[4].targets == []


def test_ranks_and_correlation(spark):
    df = spark.createDataFrame([(g, float(v), float(i)) for g, vs in (("a", [3, 1, 4, 1, 5]), ("b", [7, 7, 7])) for i, v in enumerate(vs)], "g string, x double, y double")
    r = sorted((x.g, x.y, x.rank) for x in stats.with_ranks(df, ["g"], "x", "rank").collect())
    assert [k for _, _, k in r] == [3, 1.5, 4, 1.5, 5, 2, 2, 2]
    assert {x.g: x.rho for x in stats.spearman(df, ["g"], "x", "y").collect()}["b"] == 0.0
    up = spark.createDataFrame([(float(i), float(i**3)) for i in range(500)], "x double, y double")
    assert abs(one(stats.spearman(up, [], "x", "y").select("rho")) - 1) < 1e-12
    rng = np.random.default_rng(0)
    v = rng.normal(size=3000).round(2)
    got = {x.x: x.rank for x in stats.average_ranks(spark.createDataFrame([(float(i),) for i in v], "x double"), [], "x").collect()}
    order = np.sort(v)
    assert all(abs(k - (np.searchsorted(order, x) + np.searchsorted(order, x, "right") + 1) / 2) < 1e-9 for x, k in got.items())
    assert tuple(stats.cluster_bootstrap(df, "x", "y", "g", 5).first()) == (0.0, 0.0)


def test_report_has_intervals_of_2000_replicates(spark):
    rng = np.random.default_rng(5)
    rows = [(m, f"c{i % n}", float(rng.integers(0, 6)), float(rng.integers(0, 6))) for m, n, k in (("a", 4, 24), ("b", 7, 21), ("few", 3, 9)) for i in range(k)]
    scored = spark.createDataFrame(rows, "method string, key string, predicted double, human double")
    r = evaluate.report(scored, "key")
    got = {x.method: (x.lo, x.hi) for x in r.collect()}
    assert got.pop("few") == (0.0, 0.0) and sorted(got) == ["a", "b"] and len(evaluate.report_lines(r).where("line LIKE '| a | 24 | % | [%, %] | % |'").collect()) == 1

    def rho(x, y):
        rank = lambda v: (np.searchsorted(np.sort(v), v) + np.searchsorted(np.sort(v), v, "right") + 1) / 2
        dx, dy = rank(x) - (len(x) + 1) / 2, rank(y) - (len(y) + 1) / 2
        spread = np.sqrt((dx * dx).sum() * (dy * dy).sum())
        return 0.0 if spread < 1e-15 else (dx * dy).sum() / spread

    for m, ends in got.items():
        keys = sorted({k for n, k, _, _ in rows if n == m})
        of = [np.array([(x, y) for n, k, x, y in rows if n == m and k == c]) for c in keys]
        draw = lambda b, g: int(hashlib.md5(f"42:{b}:{g}".encode()).hexdigest()[:8], 16) % len(keys)  # noqa: E731, B023
        rhos = sorted(rho(*np.concatenate([of[draw(b, g)] for g in range(len(keys))]).T) for b in range(2000))
        assert np.allclose(ends, (rhos[50], rhos[1949]), atol=1e-9)


def test_sequences(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    row = spark.range(1).select(sequence.ctc_min_frames(a()), sequence.ctc_min_frames(a(1, 2, 3)), sequence.ctc_min_frames(a(1, 1, 2, 2, 2)), sequence.ctc_feasible(a(1, 1), F.lit(2))).first()
    assert tuple(row) == (0, 3, 8, False)
    spans = [spark.range(1).select(sequence.word_span(F.lit(p), F.lit(3), F.lit(10))).first()[0] for p in range(4)]
    assert [tuple(s) if s else None for s in spans] == [(0, 3), (3, 6), (6, 10), None]
    path = spark.createDataFrame([("u", t, [1.0 if c == k else 0.0 for c in range(3)]) for t, k in enumerate([0, 1, 1, 0, 2, 2, 1])], "u string, t int, p array<double>")
    assert sorted((r["class"], r.start, r.stop) for r in sequence.greedy_path(path, ["u"], ["t"], "p").collect()) == [(1, 1, 3), (1, 6, 7), (2, 4, 6)]
    assert spark.range(1).select(sequence.frame_argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))).first()[0] == 2
    em = spark.createDataFrame([("u", t, float(t + 1)) for t in range(4)], "u string, t int, x double")
    assert np.allclose([r.y for r in sequence.pre_emphasis(em, ["u"], ["t"], "x", "y").orderBy("t").collect()], [1, 1.03, 1.06, 1.09])
    assert len(spark.range(1).select(sequence.hopping_frames(F.array_repeat(F.lit(0.0), 16000), 400, 160)).first()[0]) == 98


@pytest.mark.parametrize(
    ("frames", "plan", "sizes"),
    [
        ([10, 10, 20], (1600, 16, 2), [2, 1]), ([8] * 4, (10**6, 2, 1), [2, 2]), ([100] * 2, (1, 16, 8), [1, 1]), ([50] * 4, (10_000, 16, 1), [4]), ([50] * 4, (10_000, 16, 2), [2, 2]),
    ],
)
def test_attention_budget(spark, frames, plan, sizes):
    df = spark.createDataFrame(list(enumerate(frames)), "i int, n long")
    r = batching.attention_budget_batches(df, "n", "i", *plan).groupBy("batch").count().orderBy("batch").collect()
    assert [x["count"] for x in r] == sizes


def test_attention_budget_like_one_by_one(spark):
    rng = np.random.default_rng(1)
    n = sorted(int(x) for x in rng.integers(0, 40, 400))
    df = spark.createDataFrame(list(enumerate(n)), "i int, n long")
    got = [r.batch for r in batching.attention_budget_batches(df, "n", "i", 9000, 7, 2).orderBy("n", "i").collect()]
    want, size, b = [], 0, -1
    for f in n:
        if size and size < 7 and (size + 1) * 2 * f * f <= 9000:
            size += 1
        else:
            size, b = 1, b + 1
        want.append(b)
    assert got == want


def test_losses_and_weights(spark):
    bins = spark.range(11).select(losses.ordinal_bin(F.col("id"))).collect()
    assert [b[0] for b in bins] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4]
    counts = spark.createDataFrame([(10, 90), (9, 8), (2, 2)], "raw int, n long")
    for w in (losses.inverse_frequency(counts, "n"), losses.effective_number(counts, "n", 0.99)):
        v = [r.weight for r in w.orderBy(F.desc("raw")).collect()]
        assert v == sorted(v) and max(v) <= 100
    assert abs(spark.range(1).select(losses.softmax_score(F.array_repeat(F.lit(0.0), 5))).first()[0] - 0.6) < 1e-12
    df = spark.createDataFrame([(0, 1, 0.9, 10), (0, 2, 0.2, 3)], "batch int, i int, p double, raw int")
    assert losses.pairwise_hinge(losses.batch_pairs(df, "batch", "i", ["p", "raw"]), "p", "raw", 0.1).first().loss == 0.0
    v = spark.createDataFrame([(0, i, [float(i == j) for j in range(4)], 0.1 * i, i, 1.0) for i in range(4)], "batch int, i int, v array<double>, y double, raw int, w double")
    m = losses.mixup(v, "batch", "i", "v", "y", "raw", "w", 0.4, 2).collect()
    assert len(m) == 3 and all(abs(sum(r.v) - 1) < 1e-9 and max(r.v) < 1 for r in m)


def test_scores(spark):
    lp = [[-5.0, -0.1, -3.0], [-0.2, -4.0, -2.0]]
    frames = spark.createDataFrame([("u", t, x, x) for t, x in enumerate(lp)], "u string, t int, log_probs array<double>, logits array<double>")
    words = spark.createDataFrame([("u", 0, 0, 2, [1]), ("u", 1, 0, 2, [2]), ("u", 2, 0, 2, [9])], "u string, position int, from int, to int, targets array<int>")
    g = {r.position: r for r in evaluate.gop_scores(words, frames, "u", 3).collect()}
    assert set(g) == {0, 1} and g[0].log_prob == -0.1 and g[0].log_prob > g[1].log_prob
    assert {r.position: r.self_aligned for r in evaluate.gop_self_aligned(words, frames, "u", 3).collect()} == {0: -0.1, 1: -20.0}


def test_features(spark):
    tones = features.acoustic_frames(features.test_tones(spark, 2, 1.0), "mfcc39").collect()
    assert all((r.num_frames, r.feature_dim, len(r.features)) == (98, 39, 98 * 39) and np.isfinite(r.features).all() for r in tones)
    short = spark.createDataFrame([(1, [0.0] * 10), (2, None)], "tone long, samples array<double>")
    assert all("less than a frame" in r.error for r in features.acoustic_frames(short, "logmel80").collect())
    with pytest.raises(ValueError):
        features.Extractor("mfcc13")
    bank = features.Extractor("mfcc39").bank
    sql = features.mel_filterbank(spark, 40).collect()
    assert len(sql) == (bank > 0).sum() and all(abs(bank[r.bin, r["filter"]] - r.weight) < 1e-9 for r in sql)


def test_cache(spark, tmp_path):
    samples = spark.createDataFrame([(3, "a.wav", [0.5 * v for v in range(117)], [5, 10, 41], 1)], "index long, audio_path string, features array<float>, targets array<int>, oov_count int")
    cache.write_cache(samples, str(tmp_path), "mfcc39")
    r = cache.read_cache(spark, str(tmp_path)).first()
    assert (r.error, r.targets, r.num_frames, r.features[2]) == (None, [5, 10, 41], 3, 1.0)
    good = binary.encode_record(np.arange(39), 39, [1])
    for bad in (b"XXXX" + good[4:], good[:-1], good + b"\0", good[:10], good[:4] + b"\x09" + good[5:]):
        with pytest.raises(ValueError):
            binary.decode_record(bad, 39)
    with pytest.raises(ValueError):
        binary.decode_record(good, 80)
    old = good[:4] + b"\x01\0\0\0" + good[8:16] + good[20:]
    assert binary.decode_record(old, 39)["targets"].tolist() == [1]


def test_waves(spark, tmp_path):
    tone = np.sin(np.arange(16000) * 0.17) * 0.5
    (tmp_path / "a.wav").write_bytes(binary.encode_wave(tone))
    (tmp_path / "b.wav").write_bytes(binary.encode_wave(tone, 44100))
    r = {x.file: x for x in binary.read_waves(spark, str(tmp_path)).collect()}
    assert np.allclose(r["a.wav"].samples, tone, atol=1e-4) and "44100" in r["b.wav"].error


def test_text_sources(spark, tmp_path):
    d = tmp_path / "s" / "103" / "1240"
    d.mkdir(parents=True)
    (d / "103-1240.trans.txt").write_text("103-1240-0000 THE CAT SAT\n103-1240-0001 A DOG\nbroken\n")
    t = text.read_transcripts(spark, str(tmp_path / "s"))
    assert sorted((r.utt_id, r.transcript) for r in t.collect()) == [("103-1240-0000", "THE CAT SAT"), ("103-1240-0001", "A DOG")]
    files = t.select(F.concat("folder", F.lit("/103-1240-0000.wav")).alias("path")).distinct()
    files = files.union(files.select(F.regexp_replace("path", "wav$", "flac")))
    assert [r.audio_path[-5:] for r in text.with_audio(t, files).orderBy("utt_id").collect() if r.audio_path] == [".flac"]
    (tmp_path / "w.json").write_text('{"metadata":{"ignored":"x"},"samples":[{"audio_file":"b.wav","sentence_text":"A B","word_position":1,"human_score":0.5,"human_score_raw":5,"word_id":"i"},{"audio_file":"a.wav","sentence_text":"X","word_position":0,"human_score":1.0},{"audio_file":"b.wav","sentence_text":"A B","word_position":0,"human_score":0.9},{"audio_file":"b.wav","sentence_text":"A B","word_position":7,"human_score":0.9}]}')
    w = text.read_word_scores(spark, str(tmp_path / "w.json"))
    assert [r.raw_score for r in w.orderBy("ord").collect()] == [5, 10, 9, 9] and text.read_word_scores(spark, str(tmp_path / "w.json"), 2).count() == 2
    g = text.group_words(w).orderBy("audio_file").collect()
    assert [(r.audio_file, [x.word_position for x in r.words]) for r in g] == [("a.wav", [0]), ("b.wav", [0, 1])]
    (tmp_path / "d.txt").write_text("cat K AE1 T # note\ncat(2) K AH0 T\n\ncat K AA T\nempty # none\n")
    assert [(r.word, r.phones) for r in text.read_dictionary(spark, str(tmp_path / "d.txt")).collect()] == [("cat", [21, 2, 32])]


def test_resume(spark, tmp_path):
    m = text.MetricsWriter(str(tmp_path / "m.jsonl"))
    m.log("note", 3)
    (tmp_path / "m.jsonl").write_text('{"event":"epoch","epoch":2,"elapsed_secs":18.0}\n{"event":"batch","epoch":2,"elapsed_secs":20.0}\nnot json\n{"event":"epoch","epoch":3,"elapsed_secs":30.0}\n')
    lines = text.read_metrics(spark, str(tmp_path / "m.jsonl"))
    assert tuple(lifecycle.resume_state(lines, 2).first()) == (2, 20.0) and tuple(lifecycle.resume_state(lines, None).first()) == (3, 30.0)
    names = ["x/speech-aligner-epoch-7.npz", "speech-aligner-epoch-12", "speech-aligner-final"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(lifecycle.checkpoint_epoch(F.col("p"))).collect()] == [7, 12, None]


def test_long_words_are_cut_only_where_both_parts_can_be_entries(spark):
    """A word of thousands of letters is not copied for each place in it; compounds are found as before."""
    words = spark.createDataFrame([("SHIPSHIP",), ("CATKETTLE",), ("SEACAT",), ("X" * 5000,)], "word string")
    cut = g2p.candidates(words, 7).where("prio = 5")
    assert cut.where("word LIKE 'XX%'").count() == 0 and cut.where("word = 'CATKETTLE'").count() == 4
    got = {r.word: r.method for r in g2p.resolve(words, g2p.seed_dictionary(spark)).collect()}
    assert got["SHIPSHIP"] == got["CATKETTLE"] == got["SEACAT"] == "compound_split" and got["X" * 5000] == "rules"


def test_frequent_words_are_broadcast_and_others_joined(spark, monkeypatch):
    """Targets are the same whichever way a word takes; counts of words are those of the tokens."""
    monkeypatch.setattr(g2p, "OFTEN", 2)
    d = spark.createDataFrame([(1, "The cat, the zyx!"), (2, "the cat the sea -- the"), (3, None), (4, "...")], "doc_id long, text string")
    got = {r.doc_id: r for r in g2p.transcript_targets(d, g2p.seed_dictionary(spark)).collect()}
    monkeypatch.setattr(g2p, "OFTEN", 1000)
    want = {r.doc_id: r for r in g2p.transcript_targets(d, g2p.seed_dictionary(spark)).collect()}
    assert got == want and set(got) == {1, 2} and (got[1].words, got[1].dict_hits, got[1].oov_words) == (4, 3, 1)
    assert {r.word: r.n for r in g2p.word_counts(d, "text").collect()} == {"THE": 5, "CAT": 2, "ZYX": 1, "SEA": 1}
