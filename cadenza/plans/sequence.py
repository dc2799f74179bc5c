"""Queries over sequences and batches, and the SQL that checks them.

Roles of the driver's tables: a user's events in time order are a sequence of frames, the
event type is a frame's class (view: the blank), n_chars of a document is a length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import batching, intervals, sequence, slices
from cadenza.plans.stats import EV, events

KEY, ORDER = ["user_id"], ["ts", "event_id"]
TYPES = "array('view', 'click', 'cart', 'purchase', 'search', 'login', 'logout')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").alias("frames"))


def pre_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pre_emphasis(events(spark, sf_dir), KEY, ORDER, "value", "y").select("event_id", F.round("y", 6).alias("y"))


def regression_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.regression_delta(events(spark, sf_dir), KEY, ORDER, "value", "d").select("event_id", F.round("d", 6).alias("d"))


def delta_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = sequence.regression_delta(events(spark, sf_dir), KEY, ORDER, "value", "d")
    return sequence.regression_delta(once, KEY, ORDER, "d", "dd").select("event_id", F.round("dd", 6).alias("dd"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return events(spark, sf_dir).groupBy("user_id").agg(ordered.alias("s")).select("user_id", F.transform("s", lambda x: x["value"]).alias("signal"))


def hopping_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.framed(events(spark, sf_dir), KEY, ORDER, "value", 20, 8)
    return rows.groupBy("user_id", "frame").agg(F.count(F.lit(1)).cast("int").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def greedy_decode_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.runs(events(spark, sf_dir), KEY, ORDER, "event_type", "view").select("user_id", "event_type", "start", "stop")


def ctc_min_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that each user's classes need, and whether half as many frames again as classes are enough."""
    t = sequence.ctc_frames_needed(events(spark, sf_dir), KEY, ORDER, "event_type")
    return t.select("user_id", "min_frames", (F.floor(F.col("targets") * 6 / 5) >= F.col("min_frames")).alias("feasible"))


def word_frame_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "frames", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("position"))
    span = d.select("doc_id", "position", sequence.word_span(F.col("position"), F.lit(7), F.col("frames")).alias("s"))
    return span.select("doc_id", "position", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words for each user, each with the targets click and purchase."""
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))
    words = n.select("user_id", "frames", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position"))
    words = words.withColumn("s", sequence.word_span(F.col("position"), F.lit(3), F.col("frames"))).where("s IS NOT NULL")
    return words.select("user_id", "position", F.col("s.start").alias("from"), F.col("s.stop").alias("to"), F.posexplode(F.array(F.lit("click"), F.lit("purchase"))).alias("ord", "event_type"))


def first_overlapping_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = sequence.runs(events(spark, sf_dir), KEY, ORDER, "event_type", "view")
    found = sequence.first_overlapping(_targets(spark, sf_dir), segments, KEY, "event_type")
    return found.select("user_id", "position", "ord", "seg_start", "seg_stop")


def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.fixed_batches(docs(spark, sf_dir), "frames", "doc_id", 16).select("doc_id", "batch")


def attention_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.attention_budget_batches(docs(spark, sf_dir), "frames", "doc_id", 40_000_000, 32, 4).select("doc_id", "batch")


def pad_to_batch_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' signals in batches of eight, padded: length, padding and sum of each."""
    s = _signals(spark, sf_dir).withColumn("n", F.size("signal"))
    p = batching.padded(batching.fixed_batches(s, "n", "user_id", 8), "batch", "signal")
    return p.select("user_id", "batch", F.size("padded").alias("width"), F.size(F.filter("mask", lambda x: x)).alias("padding"), F.round(F.aggregate("padded", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = batching.fixed_batches(docs(spark, sf_dir), "frames", "doc_id", 16).select("batch").distinct()
    return batching.epoch_order(batches, "batch", 3)


def duration_filter_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as signals at 100 characters a second: counts and first document by reason."""
    secs = F.col("frames") / 100.0
    reason = F.when(secs < 0.5, "too_short").when(secs > 60.0, "too_long").otherwise("kept")
    return docs(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def frames_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of the events inside each of three word spans of a user."""
    w = _targets(spark, sf_dir).where("ord = 0").select("user_id", "position", "from", "to")
    e = slices.placed(events(spark, sf_dir), KEY, ORDER).select("user_id", F.col("__t").alias("t"), "value")
    inside = intervals.points_in(w, e, KEY, "from", "to", "t")
    return inside.groupBy("user_id", "position").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_W = "partition by user_id order by ts, event_id"


def _delta(x: str, source: str, out: str) -> str:
    ends = ", ".join(f"{k}_value({x}) over ({_W} rows between unbounded preceding and unbounded following) as {n}" for k, n in (("first", "f0"), ("last", "l0")))
    lags = ", ".join(f"{k}({x}, {d}) over ({_W}) as {k}{d}" for k in ("lag", "lead") for d in (1, 2))
    total = "(coalesce(lead1, l0) - coalesce(lag1, f0) + 2 * (coalesce(lead2, l0) - coalesce(lag2, f0))) / 10"
    return f"select *, {total} as {out} from (select *, {lags}, {ends} from {source})"


_RUNS = f"""t as (select *, row_number() over ({_W}) - 1 as t, case when event_type = lag(event_type) over ({_W}) then 0 else 1 end as fresh from ev),
r as (select *, sum(fresh) over ({_W}) as run from t),
seg as (select user_id, event_type, min(t)::bigint as start, (max(t) + 1)::bigint as stop from r group by user_id, event_type, run having event_type <> 'view')"""
_TG = """n as (select user_id, count(*) as frames from ev group by user_id),
tg as (select user_id, p as position, p * frames // 3 as f, (p + 1) * frames // 3 as e, o as ord, case o when 0 then 'click' else 'purchase' end as event_type
  from n, range(3) a(p), range(2) b(o) where (p + 1) * frames // 3 > p * frames // 3)"""

QUERIES = {
    f.__name__: f
    for f in (pre_emphasis, regression_delta, delta_delta, hopping_frames, greedy_decode_segments, ctc_min_frames, word_frame_spans, first_overlapping_segment, frames_in_span, fixed_batches, attention_budget_batches, pad_to_batch_max, epoch_shuffle, duration_filter_skips)
}
ORACLE = {
    "pre_emphasis": f"with {EV} select event_id, round(coalesce(value - 0.97::double * lag(value) over ({_W}), value), 6) as y from ev",
    "regression_delta": f"with {EV} select event_id, round(d, 6) as d from ({_delta('value', 'ev', 'd')})",
    "delta_delta": f"with {EV}, a as (select event_id, user_id, ts, d from ({_delta('value', 'ev', 'd')})) select event_id, round(dd, 6) as dd from ({_delta('d', 'a', 'dd')})",
    "hopping_frames": f"""with {EV}, s as (select user_id, list(value order by ts, event_id) as l from ev group by user_id),
f as (select user_id, l, unnest(range((len(l) - 20) // 8 + 1))::integer as frame from s where len(l) >= 20)
select user_id, frame, 20 as n, round(list_sum(l[frame * 8 + 1 : frame * 8 + 20]), 6) as total from f""",
    "greedy_decode_segments": f"with {EV}, {_RUNS} select * from seg",
    "ctc_min_frames": f"""with {EV}, x as (select user_id, case when event_type = lag(event_type) over ({_W}) then 1 else 0 end as same from ev)
select user_id, (count(*) + sum(same))::bigint as min_frames, count(*) * 6 // 5 >= count(*) + sum(same) as feasible from x group by user_id""",
    "word_frame_spans": """select doc_id, p::integer as position, case when p < 7 and (p + 1) * n_chars // 7 > p * n_chars // 7 then p * n_chars // 7 end as start,
case when p < 7 and (p + 1) * n_chars // 7 > p * n_chars // 7 then (p + 1) * n_chars // 7 end as stop from documents, range(8) t(p)""",
    "first_overlapping_segment": f"""with {EV}, {_RUNS}, {_TG}
select tg.user_id, position::integer as position, ord::integer as ord, min(seg.start) as seg_start, arg_min(seg.stop, seg.start) as seg_stop
from tg left join seg on tg.user_id = seg.user_id and tg.event_type = seg.event_type and seg.start < tg.e and seg.stop > tg.f group by tg.user_id, position, ord""",
    "frames_in_span": f"""with {EV}, {_TG}, t as (select user_id, value, row_number() over ({_W}) - 1 as t from ev)
select tg.user_id, position::integer as position, count(*) as n, round(avg(value), 6) as mean from tg join t on tg.user_id = t.user_id and t >= f and t < e where ord = 0 group by tg.user_id, position""",
    "fixed_batches": "select doc_id, (row_number() over (order by n_chars, doc_id) - 1) // 16 as batch from documents",
    "attention_budget_batches": """with recursive s as (select doc_id, n_chars as f, row_number() over (order by n_chars, doc_id) as i from documents),
g(i, size, batch) as (select 1::bigint, 1::bigint, 0::bigint union all
  select g.i + 1, case when g.size < 32 and (g.size + 1) * 4 * s.f * s.f <= 40000000 then g.size + 1 else 1 end,
    case when g.size < 32 and (g.size + 1) * 4 * s.f * s.f <= 40000000 then g.batch else g.batch + 1 end from g join s on s.i = g.i + 1)
select doc_id, batch from g join s using (i)""",
    "pad_to_batch_max": f"""with {EV}, s as (select user_id, count(*) as n, sum(value) as total from ev group by user_id),
b as (select *, (row_number() over (order by n, user_id) - 1) // 8 as batch from s)
select user_id, batch, (max(n) over (partition by batch))::integer as width, (max(n) over (partition by batch) - n)::integer as padding, round(total, 6) as total from b""",
    "epoch_shuffle": "with b as (select distinct (row_number() over (order by n_chars, doc_id) - 1) // 16 as batch from documents) select batch, row_number() over (order by md5('45:' || batch), batch) - 1 as place from b",
    "duration_filter_skips": """select case when n_chars / 100.0 < 0.5 then 'too_short' when n_chars / 100.0 > 60 then 'too_long' else 'kept' end as reason, count(*) as n, min(doc_id) as first_doc from documents group by 1""",
}
