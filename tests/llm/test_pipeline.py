"""The pipeline against a brute-force version on a small corpus."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_text_operators import brute_classes, brute_lines

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, docs, labels = random.Random(9), [], []
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(5)) for _ in range(400)]
    shared = "\n".join(" ".join(rnd.choice(words) for _ in range(20)) for _ in range(3))
    for i in range(300):
        lines = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(rnd.randint(3, 8))]
        if i % 5 == 0:
            lines[1] += " vilegit vilegon vilegam"
        if i % 7 == 1:
            lines.append(shared)
        text = "\n".join(lines)
        if i % 11 == 10:
            w = docs[-2][1].replace("\n", "  ").split(" ")
            w[3] = f"edit{i}"
            text = " ".join(w)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int("vileg" in text)))
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, NAMES).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), docs


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = corpus_pipeline.drop_toxic(spark, docs, d)
    assert one.columns == docs.columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert kept == {i: t for i, t, *_ in rows if "vileg" not in t}
    two = corpus_pipeline.drop_repeated_lines(spark, one, d)
    want = {i: t for i, (t, n) in brute_lines(list(kept.items())).items() if n < len(kept[i].split("\n"))}
    got = two.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    three = corpus_pipeline.keep_one_of_near_copies(spark, two, d)
    classes = brute_classes(want)
    left = {r.doc_id: r.text for r in three.collect()}
    assert set(left) == set(classes.values()) and len(left) < len(want)
    four = corpus_pipeline.mix_sources(spark, three, d)
    assert four.columns == docs.columns
    mixed, per, used = four.collect(), {}, {}
    for r in mixed:
        assert left[r.doc_id] == r.text  # documents are never cut
        per[r.source] = per.get(r.source, 0) + len(r.text.split())
        used[r.doc_id] = used.get(r.doc_id, 0) + 1
    assert max(used.values()) <= 2
    total = sum(len(t.split()) for t in left.values())
    assert abs(sum(per.values()) - 1.5 * total) < 0.02 * total + 100


def test_run(spark, folder):
    d, _ = folder
    out = corpus_pipeline.run(spark, d)
    rows = out.collect()
    assert rows and all(r.n_tokens == len(r.ids) > 0 for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]


EXTRA = {"score": 5, "n_lines": 7, "n_removed": 3, "size": 9, "source_size": 8, "target": 4, "taken": 9, "node": 1, "label": 2, "class_id": 6, "ids": 11, "n_tokens": 12, "toxic": 13, "f": 14, "host": 15}


def _edge_rows(spark, folder):
    _, rows = folder
    long = " ".join(f"word{i}" for i in range(40_000))
    some = [*rows[:40], (900, None, "en", "s0", None), (901, "", None, None, 0), (902, " \n ", "en", "s1", 3), (None, "no id here at all", "en", "s1", 16), (903, long, "en", None, len(long))]
    some += [rows[3], rows[3], (3, rows[3][1], "fr", "s9", 1), (rows[3][0], "another text under this id", "en", "s2", 26)]
    return some, spark.createDataFrame([(*r, *EXTRA.values()) for r in some], f"{NAMES}, {', '.join(f'{c} int' for c in EXTRA)}")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows(spark, folder, name):
    d, _ = folder
    stage = dict(corpus_pipeline.STAGES)[name]
    rows, docs = _edge_rows(spark, folder)
    out = stage(spark, docs.repartition(3), d)
    got = out.collect()
    again = stage(spark, docs.repartition(5), d).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # whatever the partitions
    assert stage(spark, docs.limit(0), d).collect() == []
    if name == "sentencepiece":
        assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (900, 901)} == {0}
        return
    assert out.columns == docs.columns and all(getattr(r, c) == v for r in got for c, v in EXTRA.items())
    ids = [r.doc_id for r in got]
    if name == "mixing":
        assert not {900, 901, 902} & set(ids) and all(ids.count(i) <= 2 for i in ids if i not in (3, None))
    if name == "near_dedup":
        assert ids.count(3) == 2 and {900, 901, 902, 903, None} <= set(ids)  # two texts of id 3, each once
    if name == "line_dedup":
        texts = {r.doc_id: r.text for r in got}
        assert texts[900] is None and texts[901] == "" and texts[902] == " \n " and ids.count(3) == 5
    if name == "toxicity":
        assert {900, 901, 902, 903, None} <= set(ids) and ids.count(3) == 5


def test_encoding_equals_library(spark, folder):
    import hashlib

    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows, docs = _edge_rows(spark, folder)
    want = sorted((lib.encode(t or ""), hashlib.sha256(lib.decode(lib.encode(t or "")).encode()).hexdigest()) for _, t, *_ in rows)
    got = corpus_pipeline.encode(spark, docs, "").collect()
    assert sorted((r.ids, r.decoded_sha256) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)
