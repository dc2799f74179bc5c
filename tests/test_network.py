"""Sizes of the network, checkpoints."""

import pytest

from cadenza.operators import network
from cadenza.sources import config


def test_sizes():
    assert network.Shape().size() == 1_709_837
    with pytest.raises(ValueError):
        network.Shape(heads=7)


def test_checkpoint(spark, tmp_path):
    tiny, path = network.Shape(input_dim=4, classes=6, heads=2, channels=(8, 8, 16, 16)), f"file://{tmp_path}/model"
    rows = [(name, list(dims), [0.5] * network.prod(dims)) for name, dims in tiny.layers().items()]
    config.write_weights(spark.createDataFrame(rows, "name string, dims array<int>, values array<double>"), path)
    assert config.read_weights(spark, path, tiny.layers()).selectExpr("sum(size(values))").first()[0] == tiny.size()
    with pytest.raises(ValueError, match="another one"):
        config.read_weights(spark, path, network.Shape().layers())
