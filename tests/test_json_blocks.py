"""Objects of a JSON array in many tasks, against the json module."""

import json
import random

import pytest

from cadenza.sources import json_blocks, text

SCHEMA = "a int, s string, l array<string>, o struct<x:int,y:struct<z:string>>"


def read(spark, path, field="samples", **more):
    return [(r.ord, r.value and r.value.asDict(True)) for r in json_blocks.array_objects(spark, str(path), field, SCHEMA, **more).orderBy("ord").collect()]


def shaped(o):
    return {"a": o.get("a"), "s": o.get("s"), "l": o.get("l"), "o": o.get("o") and {"x": o["o"].get("x"), "y": o["o"].get("y") and {"z": o["o"]["y"].get("z")}}}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_objects_in_many_splits(spark, tmp_path, small_splits, indent):
    rnd = random.Random(7)
    bits = ["}", "{", "]", "[", '"', "\\", ",", ":", "é", "😀", "\n", "samples", '"samples":[{', "x"]
    word = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
    rows = [{"a": i, "s": word(), "l": [word() for _ in range(rnd.randint(0, 3))]} | ({"o": {"x": i, "y": {"z": word()}}} if i % 3 == 0 else {}) for i in range(300)]
    document = {"note": 'a { "samples": [{', "meta}data": {"deep": {"samples": [{"a": -1}]}, "k": "}"}, "list": [{"a": -2}], "samples": rows, "after": [{"a": -3}], "n": 1}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document, indent=indent, ensure_ascii=bool(indent)) + "\n" * bool(indent))
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 10
    assert read(spark, path) == [(i, shaped(r)) for i, r in enumerate(rows)]
    assert [v["a"] for _, v in read(spark, path, "after")] == [-3] and read(spark, path, "nothing") == []


def test_short_and_broken_documents(spark, tmp_path):
    path = tmp_path / "d.json"
    for body, want in (('{"samples": []}', []), ("{}", []), ('{"samples":[{"a":1}]}', [1]), (' {"samples" : [ {"a" : 1} , {} ] } \n', [1, None]), ('{"m":{},"samples":[{"a":1},{"a":2}]}', [1, 2])):
        path.write_text(body)
        assert [v["a"] for _, v in read(spark, path)] == want
    for body in ('{"samples":[{"a":1},{"a":2}', '{"samples":[{"a":1}, {"s": "x'):
        path.write_text(body)
        with pytest.raises(ValueError, match="whole JSON object"):
            read(spark, path)
        assert [v["a"] for _, v in read(spark, path, whole=False)][:1] == [1]


def test_word_scores_keep_file_order_and_limit(spark, tmp_path, small_splits):
    words = [{"audio_file": f"{i % 7}.wav", "sentence_text": "A B", "word_position": i % 3, "human_score": i % 11 / 10} | ({"human_score_raw": i % 11, "phonemes": ["K"]} if i % 2 else {}) for i in range(120)]
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"metadata": {"ignored": True}, "samples": words}))
    got = text.read_word_scores(spark, str(path)).orderBy("ord").collect()
    assert [(r.ord, r.audio_file, r.word_position, r.human_score) for r in got] == [(i, w["audio_file"], w["word_position"], w["human_score"]) for i, w in enumerate(words)]
    assert all(r.raw_score == i % 11 and r.phonemes == (["K"] if i % 2 else []) and r.valid == (i % 3 < 2) for i, r in enumerate(got))
    assert [r.ord for r in text.read_word_scores(spark, str(path), 50).orderBy("ord").collect()] == list(range(50))
