"""Training bookkeeping: epoch losses, best epoch, resumed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def weighted_epoch_loss(steps: DataFrame, epoch: str, loss: str, samples: str) -> DataFrame:
    """Sample-weighted mean loss of each epoch; steps without a finite loss are skipped, NaN if none is left."""
    ok = finite(F.col(loss))
    total = F.sum(F.when(ok, F.col(samples)))
    return steps.groupBy(epoch).agg(F.when(total > 0, F.sum(F.when(ok, F.col(loss) * F.col(samples))) / total).otherwise(float("nan")).alias("loss"), F.count_if(~ok).alias("skipped"))


def step_mean_loss(steps: DataFrame, epoch: str, loss: str) -> DataFrame:
    """Unweighted mean loss of each epoch's steps."""
    return steps.groupBy(epoch).agg(F.avg(F.when(finite(F.col(loss)), F.col(loss))).alias("loss"))


def scientific(x: Column, digits: int = 2) -> Column:
    """A number with one digit before the point and its exponent without sign and zeros: 3.00e-4."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}e", x), r"e\+0*", "e"), r"e-0*", "e-").cast("string")


def epoch_lines(epochs: DataFrame) -> DataFrame:
    """(epoch, line) of epochs (epoch, loss, rate, seconds) as a run tells them."""
    rate = F.regexp_replace(scientific(F.col("rate")), "e$", "e0")
    return epochs.select("epoch", F.concat(F.format_string("epoch %d: loss %.4f, lr ", "epoch", "loss"), F.regexp_replace(rate, "e-$", "e0"), F.format_string(", %.1fs", "seconds")).alias("line"))


def best_epoch(epochs: DataFrame, epoch: str, rho: str) -> DataFrame:
    """Epoch with the highest rho; of equal ones the earliest."""
    return epochs.agg(F.max(F.struct(F.col(rho).alias("rho"), (-F.col(epoch)).alias("e"))).alias("b")).select((-F.col("b.e")).alias("epoch"), "b.rho")


def checkpoints(epochs: DataFrame, epoch: str, rho: str, interval: int = 0, eval_interval: int = 1) -> DataFrame:
    """Epochs (one row each) with the checkpoints that a run leaves: regular (every interval-th), best (rho over all before), final.

    rho counts at every eval_interval-th epoch; a null or NaN one is never the best.
    """
    looked = F.when((F.col(epoch) % max(eval_interval, 1) == 0) & finite(F.col(rho)), F.col(rho))
    w = W.orderBy(epoch)  # as many rows as a run has epochs
    before = F.max(looked).over(w.rowsBetween(W.unboundedPreceding, -1))
    best = looked.isNotNull() & (before.isNull() | (looked > before))
    last = F.col(epoch) == F.max(epoch).over(W.partitionBy())
    return epochs.withColumns({"regular": (F.col(epoch) % interval == 0) if interval > 0 else F.lit(False), "best": best, "final": last}).where("regular OR best OR final")


def checkpoint_epoch(path: Column) -> Column:
    """N of .../speech-aligner-epoch-N[.ext], null for other names."""
    n = F.regexp_extract(path, r"(?:^|/)speech-aligner-epoch-(\d+)(?:\.[^./]*)?$", 1)
    return F.when(n != "", n.cast("int"))


def resume_state(lines: DataFrame, resumed_epoch: int | None, checkpoint_epochs: DataFrame | None = None) -> DataFrame:
    """One row (completed, elapsed) from metric lines (epoch, epochs, elapsed_secs, in order of ord).

    A checkpoint named after its epoch decides; else the newest epoch of checkpoints and lines. Elapsed is the
    largest over lines up to that epoch or without one; without a named checkpoint that is every line.
    """
    line_epoch = F.coalesce("epoch", "epochs")
    if resumed_epoch is not None:
        usable = line_epoch.isNull() | (line_epoch <= resumed_epoch)
        return lines.agg(F.lit(resumed_epoch).cast("int").alias("completed"), F.coalesce(F.max(F.when(usable, F.col("elapsed_secs"))), F.lit(0.0)).alias("elapsed"))
    out = lines.agg(F.coalesce(F.max(line_epoch), F.lit(0)).cast("int").alias("completed"), F.coalesce(F.max("elapsed_secs"), F.lit(0.0)).alias("elapsed"))
    if checkpoint_epochs is None:
        return out
    newest = checkpoint_epochs.agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("c"))
    return out.crossJoin(F.broadcast(newest)).select(F.greatest("completed", "c").cast("int").alias("completed"), "elapsed")  # one row each
