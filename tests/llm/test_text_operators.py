"""Edge cases and brute-force versions of the operators on documents."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from cadenza.llm import line_dedup, media_png, mixing, near_dedup, sentencepiece_codec, token_counts, toxicity

SCHEMA = "doc_id long, text string, source string, size string, score string, ids string, png string, n_lines string, label string, node string, target int"
MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "\n\n\n", "a", "a b c", "one two three four five six seven", "one two three four five six seven", "x\ny\nz\nx\ny\nz", "é中😀 \t ▁▁ x  y", "word " * 30_000, "q" * 5000, "don't we'll  they've\n 123 !?", "<|endoftext|> a <s> b"]


def rows():
    out = [(i, t, f"s{i % 3}" if i % 4 else None, "7", "x", "y", "z", "w", None, "n", 3) for i, t in enumerate(TEXTS)]
    return [*out, (None, "no id", None, *out[0][3:]), out[6], (6, "another text", "s0", *out[0][3:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sentencepiece_equals_library(docs, empty):
    codec = sentencepiece_codec.MergeCodec(MODEL)
    got = sentencepiece_codec.encode_documents(docs.repartition(2), MODEL).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        if i != 6:
            want = codec.sp.encode(t or "")
            assert by[i][0].ids == want and by[i][0].decoded == codec.sp.decode(want)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \n▁é中😀\t\0<s>  \xa0") for _ in range(rnd.randint(0, 16))) for _ in range(3000)]
    flat, bounds = codec.encode_batch(texts)
    assert [flat[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == codec.sp.encode(texts)
    d = sentencepiece_codec.digest_documents(docs, MODEL).where("doc_id = 5").first()
    ids = codec.sp.encode("a b c")
    assert (d.n_tokens, d.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert sentencepiece_codec.encode_documents(empty, MODEL).count() == 0


def test_token_counts_equal_library(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    for r in token_counts.count_tokens(docs.where("doc_id IS NOT NULL AND doc_id != 6"), BPE).collect():
        t = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)), t
        assert r.over_limit == (r.n_tokens > 512)
    counter, rnd = token_counts.TokenCounter(BPE), random.Random(2)
    for _ in range(3000):
        t = "".join(rnd.choice("ab 'strevmld\n\t1２é中😀!?-　\xa0 ") for _ in range(rnd.randint(0, 90)))
        assert counter.count(t) == len(lib.encode(t).ids), t
    assert token_counts.count_tokens(empty, BPE).count() == 0


def test_state_maps_compose():
    s = token_counts.Splitter()
    maps = np.random.default_rng(0).integers(0, len(s.maps), 37).astype(np.uint16)
    state, want = s.START, []
    for m in maps:
        want.append(state)
        state = s.maps[m, state]
    assert s.scan(maps).tolist() == want


def brute_lines(docs):
    """doc_id, text pairs with unique ids."""
    first, cut = {}, {d: set() for d, _ in docs}
    for d, t in sorted(docs):
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if not "".join(w).strip(" "):
                continue
            if w not in first:
                first[w] = (d, p)
            else:
                start = max(p, first[w][1] + 3) if first[w][0] == d else p
                cut[d].update(range(start, p + 3))
    return {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut[d]), len(cut[d])) for d, t in docs}


def test_line_dedup(spark, docs, empty):
    rnd = random.Random(4)
    small = [(i, "\n".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 12)))) for i in range(120)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(small, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_lines(small)
    r = line_dedup.dedup_lines(docs).collect()
    assert len(r) == len(rows()) and set(docs.columns) <= set(r[0].asDict())
    texts = {x.doc_id: x.text for x in r if x.doc_id != 6}
    assert texts[0] is None and texts[1] == "" and texts[3] == "\n\n\n" and texts[8] == "x\ny\nz"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_apportion_is_sainte_lague(spark):
    rnd = random.Random(3)
    groups = {g: ([rnd.randint(0, 60) for _ in range(rnd.randint(1, 9))], rnd.randint(0, 40)) for g in range(60)}
    df = spark.createDataFrame([(g, p, v, n) for g, (vs, n) in groups.items() for p, v in enumerate(vs)], "g int, p int, v long, n long")
    got = {(r.g, r.p): r.won for r in mixing.apportion(df, ["g"], ["p"], "v", "n", "won").collect()}
    for g, (vs, n) in groups.items():
        want = [0] * len(vs)
        for _ in range(n if sum(vs) else 0):
            best = max(range(len(vs)), key=lambda p: (vs[p] / (2 * want[p] + 1), -p))
            want[best] += 1
        assert [got[g, p] for p in range(len(vs))] == want, (g, vs, n)


def test_mixing(spark, docs, empty):
    big = spark.createDataFrame([(i, "w " * (i % 37), f"src{i % 7 if i % 2 else 0}") for i in range(3000)], "doc_id long, text string, source string")
    r = mixing.mix(big).collect()
    assert r == mixing.mix(big).collect() or sorted(map(str, r)) == sorted(map(str, mixing.mix(big).collect()))
    by = {}
    for x in r:
        assert 0 <= x.taken <= 2 * x.size and x.size == x.doc_id % 37
        by.setdefault(x.source, []).append(x)
    for xs in by.values():
        assert xs[0].source_size == sum(x.size for x in xs) and abs(sum(x.taken for x in xs) - xs[0].target) <= 0.01 * xs[0].target + 32
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * sum(x.size for x in r)) < 1e-3
    r = mixing.mix(docs).collect()
    assert len(r) == len(rows()) and all(x.taken <= 2 * x.size for x in r) and [x.size for x in r if x.doc_id == 0] == [0]
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.where("text = ''")).first().taken == 0


def test_toxicity(spark, docs, empty):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    made = [(i, " ".join(rnd.choice(words) + ("" if i % 5 else rnd.choice(["", " vilegit", " vilegon"])) for _ in range(60))) for i in range(600)]
    d, labels = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame([(i, int("vileg" in t)) for i, t in made] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [(i, t) for i, t in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.5) == ("vileg" in t) for i, t in held) >= 0.98 * len(held)
    again = toxicity.train(d.repartition(7), labels)
    assert again[1] == model[1] and (again[0] == model[0]).all()
    r = toxicity.score(docs, model).collect()
    assert len(r) == len(rows()) and all(0 <= x.score <= 1 for x in r)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(d, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).first().score < 0.5 and toxicity.train(empty, labels)[1] < 0
    n = [x for x in toxicity.buckets("Ab ab") if x is not None]
    assert len(n) == len(set(map(int, n))) == len(toxicity.buckets("ab"))


def test_media(docs, empty):
    rnd = np.random.default_rng(1)
    for step in (1, 3):
        image = rnd.integers(0, 256, (40, 30 * step)).astype(np.uint8)
        kinds = rnd.integers(0, 5, 40).astype(np.uint8)
        filtered = np.zeros((40, 30 * step + 1), np.uint8)
        x = image.astype(int)
        for i in range(40):
            for j in range(30 * step):
                a, b, c = (x[i, j - step] if j >= step else 0), (x[i - 1, j] if i else 0), (x[i - 1, j - step] if i and j >= step else 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                filtered[i, j + 1] = (x[i, j] - (0, a, b, (a + b) // 2, near)[kinds[i]]) & 255
        filtered[:, 0] = kinds
        assert (media_png.unfilter(filtered, step) == image).all()
    got = media_png.decode_media(media_png.encode_media(docs)).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None and r.doc_id != 6:
            p = media_png.payload_of(TEXTS[r.doc_id])
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), None)
            assert len(r.cosine_hash) == 8
    assert media_png.decode_media(media_png.encode_media(empty)).count() == 0
    png = bytearray(media_png.write_png(b"x" * 384))
    png[-20] ^= 1
    with pytest.raises(media_png.MediaError):
        media_png.read_png(bytes(png))


def brute_classes(texts):
    """Components over exact probability Jaccard of all pairs."""
    sh = {i: near_dedup.shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sh[i][0]) and near_dedup.probability_jaccard(sh[i], sh[j]) >= 0.8:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in ids}


def test_near_dedup(spark, docs, empty):
    rnd = random.Random(6)
    texts = {}
    for g in range(12):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([6, 40, 120]))]
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = f"e{rnd.random()}"
            texts[len(texts)] = " ".join(w)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_classes(texts)
    r = near_dedup.near_duplicates(docs).collect()
    by = {x.doc_id: x for x in r if x.doc_id != 6}
    assert len(r) == len(rows()) and by[0].class_id == 0 and by[1].class_id == 1 and by[7].class_id == 6 and by[None].class_id is None
    assert near_dedup.near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity():
    rnd, gaps = random.Random(7), []
    base = [str(rnd.random()) for _ in range(200)]
    for k in range(30):
        w = [x if rnd.random() > 0.01 * (k % 4) else str(rnd.random()) for x in base] + base[: 10 * (k % 3)]
        a, b = near_dedup.shingles(" ".join(base)), near_dedup.shingles(" ".join(w))
        s = near_dedup.signatures([a, b], 1024)
        gaps.append((s[0] == s[1]).mean() - near_dedup.probability_jaccard(a, b))
    assert abs(np.mean(gaps)) < 0.01 and np.abs(gaps).max() < 0.07


def test_probability_jaccard_by_its_definition():
    a, b = near_dedup.shingles("a b c d e a b c d e f g"), near_dedup.shingles("a b c d e f g h")
    x, y = dict(zip(*a)), dict(zip(*b))
    every = {*x, *y}
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())
    assert abs(near_dedup.probability_jaccard(a, b) - want) < 1e-12


def test_near_dedup_keeps_links_in_crowded_buckets(spark, monkeypatch):
    """With one register a band, unlike texts share buckets: every pair of a bucket must still be compared."""
    monkeypatch.setattr(near_dedup, "signatures", lambda docs, registers=192: np.zeros((len(docs), 192), np.uint32))
    rnd, texts = random.Random(8), {}
    for g in range(5):
        base = [f"{g}-{i}" for i in range(40)]
        for k in range(6):
            w = list(base)
            w[(7 * k) % 40] = f"e{rnd.random()}"
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(near_dedup, "_signed", lambda d: d.selectExpr("doc_id", "unhex(md5(text)) node", "false blank", "array(1L, 2L) bands", "length(text) chars"))
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == brute_classes(texts)
    # the same with several blocks a bucket, and shingles counted in several pieces
    monkeypatch.setattr(near_dedup, "PAIRWISE", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(near_dedup, "PIECE", 16)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == brute_classes(texts)


def test_texts_with_a_common_passage_meet_only_by_what_is_rare(spark, monkeypatch):
    """All texts share a bucket and two thirds of their words; the links among the rest must all be found."""
    monkeypatch.setattr(near_dedup, "_signed", lambda d: d.selectExpr("doc_id", "unhex(md5(text)) node", "false blank", "array(1L, 2L) bands", "length(text) chars"))
    rnd, texts = random.Random(10), {}
    passage = [f"p{i}" for i in range(60)]
    for g in range(40):
        own = [f"{g}-{i}" for i in range(30)]
        for k in range(1 + g % 3):
            w = passage + own + ([f"e{rnd.random()}"] * k)
            texts[len(texts)] = " ".join(w * (1 + g % 2))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == brute_classes(texts)
    big = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").selectExpr("unhex(md5(text)) node", "unhex(md5(text)) label", "length(text) chars", "text")
    groups = near_dedup._rare_groups(big.select("node", "label", "chars"), big.select("node", "text"), 0.8)
    assert groups.agg({"n": "max"}).first()[0] <= 3  # the passage's shingles bring nobody together


def test_cell_links_join_what_brute_force_joins():
    rng = random.Random(5)
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(w if rng.random() > 0.03 else f"x{rng.randrange(9)}" for w in base) * (1 + (i % 5 == 0)) for i in range(30)]
    sh = [near_dedup.shingles(t) for t in texts]
    links = {(i, j) for i in range(30) for j in range(i + 1, 30) if near_dedup.probability_jaccard(sh[i], sh[j]) >= 0.8}
    got = near_dedup.cell_links(True, np.arange(30), np.ones(30, bool), texts, 0.8)
    assert links and set(got) <= links

    def classes(pairs):
        of = list(range(30))
        for i, j in pairs:
            of = [of[i] if x == of[j] else x for x in of]
        return [of.index(x) for x in of]

    assert classes(got) == classes(links)


def test_state_table_stays_bounded_inside_a_text(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "STATES", 400)
    counter, lib, rnd = token_counts.TokenCounter(BPE), Tokenizer.from_file(BPE), random.Random(3)
    for n in (5, 3000, 6000):
        t = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé中") for _ in range(n))
        assert counter.count(t) == len(lib.encode(t).ids)
        assert len(counter.known.counter.states) <= 402


def test_buckets_are_the_distinct_ngrams():
    rnd = random.Random(11)
    for _ in range(200):
        text = "".join(rnd.choice("abc äÖ.\n") for _ in range(rnd.randint(0, 60)))
        grams = set()
        for w in text.lower().split():
            w = f" {w} "
            grams |= {w[i : i + n] for n in toxicity.SIZES for i in range(len(w) - n + 1) if n == 2 or " " not in w[i + 1 : i + n - 1]}
        padded = f" {' '.join(text.lower().split())} "
        grams |= {padded[i : i + 2] for i in range(len(padded) - 1)} if text.split() else set()
        grams = {g for g in grams if len(g) == 2 or " " not in g[1:-1]}
        own = toxicity.buckets(text)
        assert len(own) == len(set(own.tolist())) and len(own) <= len(grams) and len(own) >= len(grams) - 2  # hashes may meet


def test_fit_by_its_definition(monkeypatch):
    """Ratios, scaling and the fitted logistic model once more, with plain loops over sets."""
    import math

    monkeypatch.setattr(toxicity, "ROUNDS", 25)
    rnd = random.Random(12)
    docs = [sorted(rnd.sample(range(30), 8)) + ([31] if i % 3 == 0 and rnd.random() < 0.9 else []) for i in range(60)]
    y = [int(i % 3 == 0) for i in range(60)]
    size = 1 << toxicity.BITS
    p, q = [1.0] * 32, [1.0] * 32
    for d, label in zip(docs, y):
        for b in d:
            (p if label else q)[b] += 1
    rest = size - 32  # buckets that no text has count one on either side
    ratio = [math.log(p[b] / (sum(p) + rest)) - math.log(q[b] / (sum(q) + rest)) for b in range(32)]
    ratio = [r if abs(r) >= toxicity.LEAST_RATIO else 0.0 for r in ratio]
    norm = math.sqrt(sum(ratio[b] ** 2 for d in docs for b in d) / len(docs))
    x = [[ratio[b] / norm if b in d else 0.0 for b in range(32)] for d in docs]
    w, c, m, v, mc, vc = [0.0] * 32, 0.0, [0.0] * 32, [0.0] * 32, 0.0, 0.0
    for t in range(1, 26):
        g = [(1 / (1 + math.exp(-sum(a * b for a, b in zip(w, row)) - c)) - label) * (toxicity.POSITIVE_WEIGHT if label else 1.0) / 60 for row, label in zip(x, y)]
        for b in range(32):
            d = sum(row[b] * e for row, e in zip(x, g)) + toxicity.RIDGE * w[b]
            m[b], v[b] = 0.9 * m[b] + 0.1 * d, 0.999 * v[b] + 0.001 * d * d
            w[b] -= toxicity.RATE * (m[b] / (1 - 0.9**t)) / (math.sqrt(v[b] / (1 - 0.999**t)) + 1e-9)
        mc, vc = 0.9 * mc + 0.1 * sum(g), 0.999 * vc + 0.001 * sum(g) ** 2
        c -= toxicity.RATE * (mc / (1 - 0.9**t)) / (math.sqrt(vc / (1 - 0.999**t)) + 1e-9)
    pos, neg = (np.bincount([b for d, label in zip(docs, y) if label == which for b in d], minlength=size).astype(float) for which in (1, 0))
    found = toxicity.log_count_ratios(pos, neg)
    assert np.allclose(found[:32], ratio) and not found[32:].any()
    rows = [(np.array([b for b in d if found[b]], np.int32).tobytes(), label) for d, label in zip(docs, y)]
    for block in (1_000_000, 40):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        weights, intercept = toxicity.fit(lambda: toxicity._blocks(rows), found, 60)
        assert abs(intercept - c) < 1e-4 and max(abs(weights[b] - w[b] * ratio[b] / norm) for b in range(32)) < 1e-4


def test_training_in_blocks_read_again(spark, monkeypatch):
    """Rows too large to be held are read for each round: the same model, and very long texts count."""
    monkeypatch.setattr(toxicity, "ROUNDS", 6)
    rows = [(i, ("vilegit rotter " if i % 3 == 1 else "kind gentle ") * (30_000 if i == 1 else 3) + str(i)) for i in range(30)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 1)) for i in range(40)], "doc_id long, toxic int")
    one = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "HELD", 10)
    monkeypatch.setattr(toxicity, "BLOCK", 30)
    two = toxicity.train(docs, labels)
    assert np.allclose(one[0], two[0], atol=1e-6) and abs(one[1] - two[1]) < 1e-9
    some = toxicity.train(docs.where("doc_id > 20"), labels, rows=5)  # labels without a document take none of the places
    used = sorted((i for i, _ in rows if i > 20 and __import__("zlib").crc32(str(i).encode()) % 5), key=lambda i: spark.sql(f"SELECT xxhash64({i}L, 11)").first()[0])[:5]
    same = toxicity.train(docs.where(f"doc_id IN ({', '.join(map(str, used))})"), labels)
    assert some[1] == same[1] and (some[0] == same[0]).all()


def test_training_takes_one_row_for_each_id(spark):
    text = ["good words here", "vile vilegit words", "other good text"]
    labels = spark.createDataFrame([(i, int(i % 3 == 1)) for i in range(30)], "doc_id long, toxic int")
    rows = [(i, text[i % 3]) for i in range(30)]
    one = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = toxicity.train(spark.createDataFrame(rows + [rows[1]] * 50 + [(2, text[2])] * 9, "doc_id long, text string"), labels)
    assert one[1] == many[1] and (one[0] == many[0]).all()
    long = spark.createDataFrame([*rows, (31, "vilegit " * 100_000)], "doc_id long, text string")
    assert toxicity.train(long, labels)[1] == one[1]  # it has no label


def test_media_by_its_definition(spark):
    """Stored form, payload and hash once more, from the format's definition."""
    import struct

    def payload(text):
        raw = (text or "").encode()
        n = max(192, (len(raw) + 191) // 192 * 192)
        return raw + b" " * (n - len(raw))

    def pixels(png):
        assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
        at, data, head = 8, b"", None
        while at < len(png):
            n, kind = struct.unpack(">I4s", png[at : at + 8])
            body = png[at + 8 : at + 8 + n]
            assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
            head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
            data += body if kind == b"IDAT" else b""
            at += 12 + n
        width, height = head[:2]
        assert head[2:] == (8, 0, 0, 0, 0)
        flat, rows = zlib.decompress(data), []
        for y in range(height):
            line, above = flat[y * (width + 1) : (y + 1) * (width + 1)], rows[-1] if rows else [0] * width
            row = []
            for x in range(width):
                row.append((line[x + 1] + {0: 0, 1: row[x - 1] if x else 0, 2: above[x]}[line[0]]) % 256)
            rows.append(row)
        return rows

    def shrink(rows):
        n = len(rows)
        out = []
        for k in range(32):
            lo, hi = (k * n // 32, (k + 1) * n // 32) if n >= 32 else (k * n // 32, k * n // 32 + 1)
            out.append([sum(r[x] for r in rows[lo:hi]) / (hi - lo) for x in range(len(rows[0]))])
        return out

    def cosine_hash(rows):
        small = list(zip(*shrink(list(zip(*shrink(rows))))))
        cos = [[np.cos(np.pi * k * (2 * i + 1) / 64) for i in range(32)] for k in range(8)]
        low = [round(float(sum(cos[a][i] * sum(cos[b][j] * small[i][j] for j in range(32)) for i in range(32))), 6) for a in range(8) for b in range(8)]
        middle = sorted(low[1:])[31]
        bits = "0" + "".join("1" if x > middle else "0" for x in low[1:])
        return int(bits, 2).to_bytes(8)

    rnd = random.Random(13)
    texts = [None, "", "a", "é" * 96, "x" * 193, "".join(rnd.choice("abc \n") for _ in range(9000)), " ".join(str(rnd.random()) for _ in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media_png.decode_media(media_png.encode_media(df).withColumn("copy", __import__("pyspark").sql.functions.col("png"))).collect():
        want, png = payload(texts[r.doc_id]), bytes(r.copy)
        rows = pixels(png)
        assert bytes(x for row in rows for x in row) == want
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert bytes(r.cosine_hash) == cosine_hash(rows)


def test_blank_windows_of_any_white_space(spark):
    df = spark.createDataFrame([(1, "a\r\n\r\n\r\n\r\nb\r"), (2, "c\r\n\t\r\n\r\n\r\nd\r"), (3, "e\r\n\r\n\r\n\r\nf\r")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 0, 3: 0}


def test_damaged_image_fails_the_query(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert media_png.op9_media_png(spark, str(tmp_path)).count() == 2
    real = media_png.encode_media
    monkeypatch.setattr(media_png, "encode_media", lambda d: real(d).selectExpr("doc_id", "n_bytes", "if(doc_id = 2, substring(png, 1, 40), png) AS png"))
    with pytest.raises(Exception, match="stored image: the file ends inside"):
        media_png.op9_media_png(spark, str(tmp_path)).collect()
