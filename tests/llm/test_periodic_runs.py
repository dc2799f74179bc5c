"""Runs of words against a search by definition, the mask, and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cadenza.llm import periodic_runs as pr


def by_definition(words, shortest=6, exponent=4):
    """(start, length, smallest period) of every run, over all periods and places."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(shortest, exponent * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n_, p) for (s, n_), p in found.items()), key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        out = []
        while len(out) < rnd.choice([0, 5, 6, 30, 120]):
            if rnd.random() < 0.5:
                period = [rnd.choice("abc") for _ in range(rnd.randint(1, 7))]
                out += (period * 12)[: rnd.randint(1, 40)]
            else:
                out += [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))]
        yield out


@pytest.mark.parametrize("shortest, exponent", [(6, 4), (2, 2), (9, 3), (1, 5)])
def test_runs_equal_definition(shortest, exponent):
    some = [[w.encode() for w in t] for t in texts(shortest, 300)]
    runs, out = pr.collapse(some, shortest, exponent)
    for doc, words in enumerate(some):
        want = by_definition(words, shortest, exponent)
        assert [tuple(r[1:]) for r in runs.tolist() if r[0] == doc] == want, words
        assert out[doc] == b" ".join(left(words, want))


def test_long_windows_without_names(monkeypatch):
    monkeypatch.setattr(pr, "NAMED", 2)
    some = [[b"w"] * 700, [str(i % 61).encode() for i in range(1000)], [str(i).encode() for i in range(300)]]
    assert [tuple(r) for r in pr.collapse(some)[0].tolist()] == [(0, 0, 700, 1), (1, 0, 1000, 61)]


def test_mask_keeps_all_runs_and_little_else():
    assert pr.shortest_overlap(6, 4) == 5 and pr.shortest_overlap(2, 2) == 1 and pr.shortest_overlap(10, 2) == 5
    rnd = random.Random(3)
    words = [rnd.randrange(10**6) for _ in range(5000)]
    words[1000:1040] = [1, 2, 3, 4] * 10
    kept = pr.surviving(np.array(words), np.zeros(5000, int), 5)
    assert kept[1000:1040].all() and kept.sum() == 40
    assert not pr.surviving(np.array([1, 2, 3, 4, 5] * 2), np.repeat([0, 1], 5), 5).any()  # the same words of two documents


SCHEMA = "doc_id long, text string, runs string, __other int"
TEXTS = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a\xa0a a\xa0a \x0ba\xa0a\ta\xa0a a\xa0a\ra\xa0a", "x y " * 8, "w " * 30_000, "q" * 100_000, "é é é é é é\x1cé"]


def test_edges(spark):
    rows = [(i, t, "kept?", 1) for i, t in enumerate(TEXTS)] + [(None, "b b b b b b b", "r", 2), (7, TEXTS[7], "r", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in pr.periodic_runs(docs.repartition(3)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got[0][0].asDict()) == {"doc_id", "__other", "n_words", "runs", "collapsed"}
    runs = {k: [tuple(x) for x in v[0].runs] for k, v in got.items()}
    assert runs == {0: [], 1: [], 2: [], 3: [], 4: [], 5: [(0, 6, 1)], 6: [(0, 6, 1)], 7: [(0, 16, 2)], 8: [(0, 30_000, 1)], 9: [], 10: [], None: [(0, 7, 1)]}
    assert len(got[7]) == 2 and got[7][0].collapsed == "x y" and got[0][0].collapsed == "" and got[6][0].collapsed == "a\xa0a" and got[4][0].collapsed == "a a a a a"
    assert pr.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_definition(spark, tmp_path):
    rnd = random.Random(9)
    some = [" ".join(t) for t in texts(5, 120)] + [None, "", "  ", "one two three " * 9]
    some += [" ".join(str(rnd.randrange(9)) for _ in range(rnd.randint(1, 90))) for _ in range(200)]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    changed = 0
    for r in pr.op11_periodic_runs(spark, str(tmp_path)).collect():
        words = (some[r.doc_id] or "").split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        want = by_definition(words)
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(left(words, want)).encode()).hexdigest()
    assert changed > 10
