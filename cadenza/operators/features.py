"""Acoustic features: filter banks as dimension tables, a SQL path and a numpy path.

The SQL path (dft_power, mel_energies, cepstra) states every step as a join with a
dimension table and an aggregate. The numpy path (acoustic_frames) does the same for
whole signals inside Arrow batches with a real FFT, and is the one for bulk work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.arrays import once

# Analysis parameters.
RATE, FRAME, HOP, FFT, CEPSTRA, EMPHASIS, TOP_HZ, FLOOR = 16_000, 400, 160, 512, 13, 0.97, 8000.0, 1e-10
MODES = {"mfcc39": 40, "logmel80": 80}
DIMS = {"mfcc39": 39, "logmel80": 80}


def to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def from_mel(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)


def hann_window(spark: SparkSession, length: int = FRAME) -> DataFrame:
    return spark.range(length).select(F.col("id").cast("int").alias("n"), (0.5 * (1 - F.cos(2 * F.pi() * F.col("id") / (length - 1)))).alias("w"))


def mel_filterbank(spark: SparkSession, filters: int, fft: int = FFT, rate: int = RATE, top: float = TOP_HZ) -> DataFrame:
    """Triangles with fractional edges: filter, bin, weight (positive ones only)."""
    mel = F.col("id") / (filters + 1) * to_mel(F.lit(top))
    edges = spark.range(filters + 2).select(F.col("id"), (from_mel(mel) * fft / rate).alias("left"))
    w = W.orderBy("id")  # as many rows as filters
    tri = edges.select("id", "left", F.lead("left", 1).over(w).alias("mid"), F.lead("left", 2).over(w).alias("right")).where("right IS NOT NULL")
    k = F.col("bin")
    up, down = (k > F.col("left")) & (k <= F.col("mid")), (k > F.col("mid")) & (k < F.col("right"))
    weight = F.when(up, (k - F.col("left")) / (F.col("mid") - F.col("left"))).when(down, (F.col("right") - k) / (F.col("right") - F.col("mid"))).otherwise(0.0)
    t = tri.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(fft // 2)))).select(F.col("id").cast("int").alias("filter"), "bin", weight.alias("weight"))
    return t.where("weight > 0")


def dct_matrix(spark: SparkSession, filters: int, rows: int = CEPSTRA) -> DataFrame:
    j = spark.range(filters).select(F.col("id").cast("int").alias("filter")).withColumn("coef", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return j.select("coef", "filter", F.cos(F.pi() * F.col("coef") * (F.col("filter") + 0.5) / filters).alias("weight"))


def power_spectrum(signal: Column, size: int | None = None) -> Column:
    """Squared magnitudes of the bins 0 to half of an array's discrete Fourier transform: radix-2 butterflies, the array stays one value.

    size: a power of two, up to which the signal is padded with zeros (or cut). None: the signal's length, which must be one.
    Each stage takes half-transforms, re and im by turns, to those of twice the width, always from neighbours to the two halves.
    """
    n = F.lit(size) if size is not None else F.size(signal)
    if size is not None and (size < 1 or size & (size - 1)):
        raise ValueError(f"{size} is no power of two")

    def transformed(width: Column) -> Column:
        bits = F.round(F.log2(width)).cast("int")
        twice = lambda more: (lambda r: 2 * r + more)
        mirrored = F.aggregate(F.when(bits > 0, F.sequence(F.lit(1), bits)).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), lambda r, _: F.concat(F.transform(r, twice(0)), F.transform(r, twice(1))))  # places with their bits turned round

        def stage(z: Column, half: Column) -> Column:
            """z: re and im by turns. Neighbours (a, b) become a + w b in the first half and a - w b in the second, w the root for their place."""
            angle = lambda k: -F.pi() * F.floor(k * half / (width / 2)) / half
            turned = F.transform(F.sequence(F.lit(0), F.floor(width / 2).cast("int") - 1), lambda k: F.struct(
                F.get(z, 4 * k).alias("a"), F.get(z, 4 * k + 1).alias("b"), F.get(z, 4 * k + 2).alias("c"), F.get(z, 4 * k + 3).alias("d"), F.cos(angle(k)).alias("u"), F.sin(angle(k)).alias("v")))
            re, im = lambda p: p["c"] * p["u"] - p["d"] * p["v"], lambda p: p["c"] * p["v"] + p["d"] * p["u"]
            halves = lambda t: F.concat(F.flatten(F.transform(t, lambda p: F.array(p["a"] + re(p), p["b"] + im(p)))), F.flatten(F.transform(t, lambda p: F.array(p["a"] - re(p), p["b"] - im(p)))))
            return once(turned, halves)

        def run(x: Column) -> Column:
            start = F.flatten(F.transform(mirrored, lambda i: F.array(F.coalesce(F.get(x, i), F.lit(0.0)).cast("double"), F.lit(0.0))))
            halves = F.when(bits > 0, F.transform(F.sequence(F.lit(0), F.greatest(bits, F.lit(1)) - 1), lambda k: F.pow(F.lit(2), k).cast("int"))).otherwise(F.array().cast("array<int>"))
            spectrum = F.aggregate(halves, start, stage)
            return once(spectrum, lambda z: F.transform(F.sequence(F.lit(0), F.floor(width / 2).cast("int")), lambda k: F.pow(F.get(z, 2 * k), F.lit(2)) + F.pow(F.get(z, 2 * k + 1), F.lit(2))))

        return once(signal, run)

    return once(n, transformed)


def dft_power(df: DataFrame, key: str, signal: str) -> DataFrame:
    """key, bin, power: squared magnitude of the discrete Fourier transform of each row's array, bins 0 to half.

    Arrays whose length is a power of two are transformed in place; the others by a matrix of turns, one pass over the array for each bin.
    """
    n = F.size(signal)
    turn = lambda k, f: F.aggregate(F.transform(signal, lambda x, t: x * f(2 * F.pi() * ((k * t) % n) / n)), F.lit(0.0), lambda a, b: a + b)
    by_turns = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), lambda k: F.pow(turn(k, F.cos), F.lit(2)) + F.pow(turn(k, F.sin), F.lit(2)))
    exact = F.pow(F.lit(2), F.round(F.log2(n))).cast("int") == n
    power = F.when(n > 0, F.when(exact, power_spectrum(F.col(signal))).otherwise(by_turns))
    return df.select(key, F.posexplode(power).alias("bin", "power"))


def mel_energies(power: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """key, filter, log_energy. The filter bank is a few thousand rows by construction."""
    return power.join(F.broadcast(bank), "bin").groupBy(key, "filter").agg(F.log(F.sum(F.col("power") * F.col("weight")) + FLOOR).alias("log_energy"))


def cepstra(energies: DataFrame, dct: DataFrame, key: str) -> DataFrame:
    """key, coef, value. The matrix is a few hundred rows by construction."""
    return energies.join(F.broadcast(dct), "filter").groupBy(key, "coef").agg(F.sum(F.col("log_energy") * F.col("weight")).alias("value"))


class Extractor:
    """Frames of one signal in numpy, in float32 as the features are stored."""

    def __init__(self, mode: str, kind: type = np.float32) -> None:
        if mode not in MODES:
            raise ValueError(f"unknown feature mode {mode!r}: {', '.join(MODES)}")
        filters = MODES[mode]
        mel = lambda hz: 2595 * np.log10(1 + hz / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(TOP_HZ), filters + 2) / 2595) - 1) * FFT / RATE
        k = np.arange(FFT // 2 + 1)[:, None]
        left, mid, right = edges[:-2], edges[1:-1], edges[2:]
        self.bank = np.where((k > left) & (k <= mid), (k - left) / (mid - left), np.where((k > mid) & (k < right), (right - k) / (right - mid), 0.0))
        self.dct = np.cos(np.pi * np.outer(np.arange(filters) + 0.5, np.arange(CEPSTRA)) / filters)
        self.window, self.mode, self.dim, self.kind = np.hanning(FRAME), mode, DIMS[mode], kind

    def __call__(self, samples: np.ndarray) -> np.ndarray:
        """(frames, dim) features; ValueError for signals shorter than a frame."""
        x = np.asarray(samples, np.float64)
        if len(x) < FRAME:
            raise ValueError(f"{len(x)} samples are less than a frame of {FRAME}")
        y = np.append(x[:1], x[1:] - EMPHASIS * x[:-1])
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * self.window, FFT)) ** 2
        log_mel = np.log(power @ self.bank + FLOOR)
        if self.mode == "logmel80":
            return log_mel.astype(self.kind)
        static = log_mel @ self.dct
        first = self.delta(static)
        return np.hstack([static, first, self.delta(first)]).astype(self.kind)

    @staticmethod
    def delta(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, ((2, 2), (0, 0)), mode="edge")
        n = len(x)
        return (p[3 : 3 + n] - p[1 : 1 + n] + 2 * (p[4 : 4 + n] - p[:n])) / 10


def acoustic_frames(signals: DataFrame, mode: str, samples: str = "samples", keep: list[str] | None = None, double: bool = False) -> DataFrame:
    """keep plus features array<float> (or double; row-major), feature_dim, num_frames and error (short signals)."""
    kind, arrow = ("double", pa.float64()) if double else ("float", pa.float32())
    keep = [c for c in signals.columns if c != samples] if keep is None else keep
    source = signals.select(*keep, F.col(samples).alias("__samples"))
    extra = f"features array<{kind}>, feature_dim int, num_frames int, error string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), extra])
    names = [*keep, "features", "feature_dim", "num_frames", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(mode, np.float64 if double else np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                flat, frames, errors = [], [], []
                for s in part.column(len(keep)):
                    try:
                        f = extract(s.values.to_numpy(zero_copy_only=False) if s.is_valid else np.zeros(0))
                        flat.append(f.ravel())
                        frames.append(len(f))
                        errors.append(None)
                    except ValueError as e:
                        flat.append(None)
                        frames.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(flat, pa.list_(arrow)), pa.array([extract.dim] * len(frames), pa.int32()), pa.array(frames, pa.int32()), pa.array(errors, pa.string())], names=names)

    return source.mapInArrow(run, schema)


def test_tones(spark: SparkSession, tones: int, seconds: float = 0.25) -> DataFrame:
    """tone, samples: half-amplitude sines from 220 Hz up, at the analysis rate."""
    n = int(RATE * seconds)
    hz = 220.0 + 55.0 * F.col("id")
    return spark.range(tones).select(F.col("id").alias("tone"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.5 * F.sin(2 * F.pi() * hz * i / RATE)).alias("samples"))


def synthetic_sample(spark: SparkSession, samples: int, dim: int = 13) -> DataFrame:
    """seed, features, targets by rule: six targets, and frames that rise with the target of their sixth."""
    s = spark.range(samples).select(F.col("id").alias("seed"), (30 + 4 * F.col("id")).cast("int").alias("frames"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col("id") + i) % 40 + 1).cast("int")).alias("targets"))
    level = lambda f: F.get("targets", F.floor(f * 6 / F.col("frames")).cast("int")) * 0.05
    feats = F.flatten(F.transform(F.sequence(F.lit(0), F.col("frames") - 1), lambda f: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: level(f) + d * 0.005 + ((f + d) % 7) * 0.01)))
    return s.select("seed", "frames", "targets", feats.alias("features"))
