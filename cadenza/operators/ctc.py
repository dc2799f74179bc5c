"""CTC loss of utterances from per-frame log-probabilities, and the fine-tuning objective.

The forward recursion runs over 2 L + 1 states (targets with blanks around them) in log space, as a
fold over an utterance's frames in higher-order functions. Frames are first cut down to the states'
own log-probabilities; these are one row an utterance, as the recursion goes through frames in turn: the
duration filter bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.arrays import once
from cadenza.operators.common import join_on
from cadenza.operators.lifecycle import finite

NEVER = float("-inf")


def states(targets: Column, blank: int = 0) -> Column:
    """Targets with a blank before each and at the end."""
    b = F.lit(blank).cast("int")
    return F.concat(F.flatten(F.transform(targets, lambda t: F.array(b, t.cast("int")))), F.array(b))


def _log_add(*terms: Column) -> Column:
    top = F.greatest(*terms)
    return F.when(top == NEVER, F.lit(NEVER)).otherwise(top + F.log(sum((F.exp(t - top) for t in terms), F.lit(0.0))))


def forward_loss(emissions: Column, labels: Column, blank: int = 0) -> Column:
    """Minus the log-probability of all alignments. emissions: for each frame the log-probability of each of the states; infinite if there is none."""

    def from_labels(ls: Column) -> Column:
        skips = F.transform(ls, lambda x, s: (s >= 2) & (x != blank) & ~x.eqNullSafe(F.get(ls, s - 2)))
        start = F.transform(ls, lambda _, s: F.when(s == 0, F.lit(0.0)).otherwise(F.lit(NEVER)))  # before the first frame

        def fold(may_skip: Column) -> Column:
            def frame(alpha: Column, e: Column) -> Column:
                back = lambda s, d: F.coalesce(F.get(alpha, s - d), F.lit(NEVER))
                return F.transform(alpha, lambda a, s: _log_add(a, back(s, 1), F.when(F.get(may_skip, s), back(s, 2)).otherwise(F.lit(NEVER))) + F.get(e, s))

            return F.aggregate(emissions, start, frame, lambda a: -_log_add(F.get(a, F.size(a) - 1), F.coalesce(F.get(a, F.size(a) - 2), F.lit(NEVER))))

        return once(skips, fold)

    return once(labels, from_labels)


def losses(frames: DataFrame, targets: DataFrame, key: str, blank: int = 0, zero_infinity: bool = True) -> DataFrame:
    """key, frames, loss of each row of targets(key, targets). frames: key, t, log_probs.

    A loss without any alignment is 0 with zero_infinity, else infinite; null where a target is no class or a log-probability is null.
    """
    asked = targets.select(F.col(key).alias("__key"), states(F.col("targets"), blank).alias("__labels"))
    own = frames.join(asked, F.col(key) == F.col("__key")).select(key, "t", F.transform("__labels", lambda c: F.get("log_probs", c).cast("double")).alias("e"))
    held = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "e"))).alias("__frames"))
    joined = join_on(targets.select(key, states(F.col("targets"), blank).alias("__labels")), held, [key], "left")
    emissions = F.coalesce(F.transform("__frames", lambda f: f["e"]), F.array().cast("array<array<double>>"))
    whole = F.forall(emissions, lambda e: F.forall(e, lambda x: x.isNotNull()))
    loss = joined.select(key, F.size(emissions).alias("frames"), F.when(whole, forward_loss(emissions, F.col("__labels"), blank)).alias("loss"))
    return loss.withColumn("loss", F.when(F.col("loss") == float("inf"), 0.0).otherwise(F.col("loss"))) if zero_infinity else loss


def objective(ctc: DataFrame, words: DataFrame, batch: str, ctc_weight: float) -> DataFrame:
    """batch, ctc_loss, score_loss, total, used: ctc_weight times the mean CTC loss of a batch's utterances and the rest of the mean weighted squared error of its words.

    ctc: batch, loss; words: batch, predicted, target, weight. Batches without words have no row; one whose total is not finite is not used. Without a weight the CTC losses are not looked at.
    """
    error = F.col("predicted") - F.col("target")
    score = words.groupBy(batch).agg(F.avg(F.col("weight") * error * error).alias("score_loss"))
    if ctc_weight > 0:
        both = join_on(score, ctc.groupBy(batch).agg(F.avg("loss").alias("ctc_loss")), [batch], "left")
    else:
        both = score.withColumn("ctc_loss", F.lit(0.0))
    total = both.withColumn("total", F.col("ctc_loss") * ctc_weight + F.col("score_loss") * (1 - ctc_weight))
    return total.select(batch, "ctc_loss", "score_loss", "total", finite(F.col("total")).alias("used"))
