"""Settings as JSON beside a checkpoint and checkpoints as tables of named arrays, in any store that Spark reads, and their validation."""

from __future__ import annotations

import json
from math import prod

from pyspark.sql import DataFrame, SparkSession


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """Write the settings as one JSON file; an existing one is replaced."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(config, indent=2).encode()))
    finally:
        out.close()


def read_config(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """Settings of a JSON file, or the default if there is no such file. A broken file is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if default is not None and not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return dict(default)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def problems(config: dict) -> list[str]:
    """What is wrong with training or fine-tuning settings; keys that are missing are not looked at."""
    found = []

    def need(ok: bool, message: str) -> None:
        if not ok:
            found.append(message)

    for key in ("epochs", "batch_size", "head_hidden_dim", "max_attn_elements", "max_samples"):
        if key in config:
            need(config[key] > 0, f"{key} must be > 0")
    if "learning_rate" in config:
        need(config["learning_rate"] > 0, "learning_rate must be > 0")  # NaN is not
    if "ctc_weight" in config:
        need(0 <= config["ctc_weight"] <= 1, "ctc_weight must be within [0, 1]")
    if config.get("holdout") is not None:
        need(config.get("eval_interval", 1) > 0, "eval_interval must be > 0 when holdout is set")
    if "feature_dim" in config and "input_dim" in config:
        need(config["feature_dim"] == config["input_dim"], f"samples have feature_dim {config['feature_dim']} but the model expects input_dim {config['input_dim']}")
    return found


def validated(config: dict) -> dict:
    """The settings, or a ValueError that names the first problem."""
    found = problems(config)
    if found:
        raise ValueError(found[0])
    return config


def write_weights(weights: DataFrame, path: str) -> None:
    """A checkpoint: rows (name, dims array<int>, values array<float>); one that is there is replaced."""
    weights.selectExpr("name", "cast(dims AS array<int>) dims", "cast(values AS array<float>) values").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str, layers: dict[str, tuple[int, ...]]) -> DataFrame:
    """The rows of a checkpoint; a ValueError unless its names and dimensions are the given ones and its arrays are full."""
    found = spark.read.parquet(path)
    rows = found.selectExpr("name", "dims", "size(values) n").collect()  # a row for each layer
    if {r.name: tuple(r.dims) for r in rows} != layers or any(r.n != prod(r.dims) for r in rows):
        raise ValueError(f"{path}: the checkpoint's architecture is another one")
    return found
