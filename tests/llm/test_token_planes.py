"""Files of bit planes: exact round trips, damage, random access, order; ids equal to the library's."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from cadenza.llm import token_planes as tp

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("of_bits", [True, False])
@pytest.mark.parametrize("top", [1, 2, 255, 256, 49_407, 2**32])
def test_round_trip_and_ranges(of_bits, top):
    rnd = np.random.default_rng(top)
    for n in (0, 1, 7, 8, 9, 100, 257):
        ids = rnd.integers(0, top, n, dtype=np.uint32)
        sizes = [n // 3, 0, n - n // 3]
        f = tp.TokenFile(tp.write_file(ids, [5, None, 7], np.array(sizes), 11, block=32, of_bits=of_bits))
        assert (f.read() == ids).all() and f.start == 11 and f.keys == [5, None, 7]
        for low, high in ((0, n), (n // 2, n), (31, 33), (n, n + 5), (3, 3)):
            assert (f.read(low, high) == ids[low:high]).all()
        assert [(k, a, i.tolist()) for k, a, i in f.documents()] == [(5, 0, ids[: n // 3].tolist()), (None, n // 3, []), (7, n // 3, ids[n // 3 :].tolist())]


def test_range_reads_only_its_blocks(monkeypatch):
    f, read = tp.TokenFile(tp.write_file(np.arange(1000), [1], np.array([1000]), block=64)), []
    whole = tp.TokenFile.read_block
    monkeypatch.setattr(tp.TokenFile, "read_block", lambda self, b: read.append(b) or whole(self, b))
    assert f.read(130, 200).tolist() == list(range(130, 200)) and read == [2, 3]


def test_damage_is_an_error():
    good = tp.write_file(np.arange(500) * 7, [1, 2], np.array([200, 300]), block=128)
    for at in range(0, len(good), 11):
        bad = bytearray(good)
        bad[at] ^= 1
        try:
            f = tp.TokenFile(bytes(bad))
            got = f.read(), f.keys, f.sizes.tolist(), f.start
        except tp.PlaneError:
            continue
        raise AssertionError(f"byte {at} changed and {got} came back")
    for n in (0, 5, len(good) - 1):
        with pytest.raises(tp.PlaneError):
            tp.TokenFile(good[:n])


def test_ids_equal_library():
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    alphabet = ["a", "B", "'s", "'LL", "é", "É", "é", "Σ", "ς", "İ", "ß", "ŉ", "ſ", "ª", "²", "½", "×", "\xa0", " ", "\x1c", "\x85", "\0", "9", "42", "中", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "́", "가", "ǅ", "!", "&&&", "-", " ", "\n", "\t", "\xad", "ŁÓDŹ", "the", "ing"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(6000)] + ["", "x" * 3000, " ́a", "don't WE'LL"]
    for path, split in ((WORD, True), (BYTE, False)):
        lib, enc = Tokenizer.from_file(path), tp.Encoder(path)
        assert enc.by_words == split
        got = enc.encode([t.encode() for t in texts])
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        for t, g, w in zip(texts, got, want):
            assert np.frombuffer(g, enc.kind).tolist() == w, t


def test_small_table_of_words(monkeypatch):
    enc = tp.Encoder(WORD)
    texts = [f"w{i} x{i % 7} long{'g' * 50}{i} w{i - 1}".encode() for i in range(200)]
    want = enc.encode(texts)
    monkeypatch.setattr(tp, "WORDS", 10)
    monkeypatch.setattr(tp, "pieces", lambda t, most=0: ([x] for x in t))
    small = tp.Encoder(WORD)
    assert small.encode(texts) == want and len(small.words) <= 10


TEXTS = [None, "", " \n", "a b", "one two", "one two", "w " * 20_000, "z" * 4000, "<|endoftext|> é中", "t"]


def expected(rows):
    """By the library, one row after the other."""
    from tokenizers import Tokenizer

    lib, start, out = Tokenizer.from_file(WORD), 0, []
    for i, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def order(r):
    return (r[0] is not None, r[0] or 0, r[1])


def test_files_in_order_of_ids(spark, tmp_path, monkeypatch):
    rows = [(i * 3 - 9, t, "extra", 1) for i, t in enumerate(TEXTS)] + [(500 - i, f"text {i}", "e", 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(tp, "LEAST_RANGE", 500)
    monkeypatch.setattr(tp, "FILE", 300)
    got = sorted((tuple(r) for r in tp.op12_token_planes(spark, str(tmp_path)).collect()), key=order)
    assert got == expected(sorted((r[:2] for r in rows), key=lambda r: r[0]))


def test_one_hot_id_and_nulls_in_several_ranges(spark):
    rows = [(7, "the same text")] * 600 + [(None, "no id")] * 2 + [(i, f"t{i}") for i in range(20)]
    enc = tp.written(tp.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), WORD), "enc")
    total = tp.n_ids_of(enc)
    from unittest import mock

    with mock.patch.object(tp, "LEAST_RANGE", 100):
        files = tp.written(tp.write_planes(enc, total, of_bits=False, file=64), "files")
    assert files.groupBy("part").count().count() >= 3  # the hot id is dealt to several tasks
    got = sorted((tuple(r) for r in tp.read_planes(files, total).collect()), key=order)
    assert got == expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    for broken in (files.where("NOT (part = 1 AND file = 1)"), files.where("part != 1"), files.union(files.where("part = 1 AND file = 1"))):
        with pytest.raises(Exception, match="missing or stands twice"):
            tp.read_planes(broken, total).collect()
    none = tp.encode_documents(spark.createDataFrame([], "doc_id long, text string"), WORD)
    assert tp.read_planes(tp.write_planes(none, 0), 0).count() == 0
