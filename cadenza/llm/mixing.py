"""Mixing sources to target weights with Sainte-Lague apportionment, in DataFrame functions only.

1. Size of a document: its words, a word being a run of characters other than
   white space (blank, tab, line feed, vertical tab, form feed, carriage return).
2. Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating. They
   share `share` times all words; a target stops at `max_repeat` times its source's
   words and the excess goes to the others by weight (one water level, found by a
   running sum over sources in order of cap / weight).
3. Equal-token blocks of `block_words` words are seats. Sources get them by the
   highest quotients target / (2k - 1); a source's seats go to its super-shards
   and then to their shards the same way, with words as votes. So every shard has an
   integer quota of blocks.
4. A shard lays its documents end to end in seeded order (an md5 of seed and
   doc_id), as often as `max_repeat` says, and takes blocks from the front until its
   quota is met. taken is the number of a document's words in those blocks.

Only a window of quotients that can be the last ones to win is ranked, about three
rows for each party, and shards stay small for hot sources: a source of s words has
about s / `shard_words` shards, in as many super-shards as each of these has shards.
Words are counted once into a narrow table; texts are shuffled once, by shard.

Defined results: null and empty texts have size 0 and take 0; texts of any length are
counted whole; null sources form one source, the last; rows with equal doc_id are separate
documents that share a place in the order (ties by size, then by a hash of the text; rows
equal in all of these are alike, and which of them takes what is not told); a table
without words takes nothing, an empty one gives no rows. Other columns are carried along,
but for those with the names of results (`prefix` gives the results other names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import carried, table, written

SHARE, MAX_REPEAT = 1.5, 2
BLOCK_WORDS = 8
SHARD_WORDS = 4096
SEED = 7
#: Most sources whose targets (a few numbers each) are broadcast; more of them are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, max_repeat: int) -> DataFrame:
    """sizes(skey, source, s) with target (double): weights 3, 1, 2 by source order under the caps."""
    in_order = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy("ratio", "skey")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    t = sizes.withColumn("rn", F.row_number().over(in_order))
    t = t.withColumn("w", F.when(F.col("rn") % 3 == 1, 3.0).when(F.col("rn") % 3 == 2, 1.0).otherwise(2.0))
    t = t.withColumn("cap", F.col("s").cast("double") * max_repeat).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("total", F.sum("s").over(whole) * share).withColumn("w_all", F.sum("w").over(whole))
    t = t.withColumn("place", F.row_number().over(by_ratio)).withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    water = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(whole)
    t = t.withColumn("water", water["level"])
    return t.withColumn("target", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("water"))))


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: `seats` (one value per group) go to parties by the highest votes / (2k - 1); ties by party.

    A party whose exact share is q wins between round(q (1 - n/N)) and round(q (1 + n/N)) of N seats
    when there are n parties, so only quotients in that range are ranked.
    """
    g = W.partitionBy(*group)
    p = parties.withColumns({"__v": F.sum(votes).over(g), "__cnt": F.count(F.lit(1)).over(g).cast("double"), "__seats": F.col(seats).cast("double")})
    live = (F.col("__seats") > 0) & (F.col("__v") > 0)
    q = F.col("__seats") * F.col(votes) / F.col("__v")
    slack = F.col("__cnt") / F.col("__seats")
    p = p.withColumns(
        {
            "__lo": F.when(live, F.greatest(F.lit(0.0), F.floor(q * (1 - slack) + F.lit(0.4999)))).otherwise(0.0).cast("long"),
            "__hi": F.when(live, F.floor(q * (1 + slack) + F.lit(0.5001))).otherwise(0.0).cast("long"),
        }
    )
    p = p.withColumn("__open", F.col(seats) - F.sum("__lo").over(g))
    ranks = W.partitionBy(*group).orderBy(F.desc("__quot"), *party)
    won = (
        p.withColumn("__k", F.explode_outer(F.when(F.col("__hi") > F.col("__lo"), F.sequence(F.col("__lo") + 1, F.col("__hi")))))
        .withColumn("__quot", F.col(votes) / (2 * F.col("__k") - 1))
        .withColumn("__rank", F.row_number().over(ranks))
    )
    keep = [c for c in parties.columns if c not in [*group, *party]]
    return won.groupBy(*group, *party).agg(
        *[F.first(c).alias(c) for c in keep],
        (F.first("__lo") + F.sum(F.when(F.col("__k").isNotNull() & (F.col("__rank") <= F.col("__open")), 1).otherwise(0))).alias(out),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = SHARE,
    max_repeat: int = MAX_REPEAT,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    prefix: str = "",
) -> DataFrame:
    """docs plus size, source_size (long), target (double) and taken (long); prefix goes before these names."""
    names = [prefix + n for n in ("size", "source_size", "target", "taken")]
    docs = docs.select(*carried(docs, tuple(names)))
    d = sized(docs, doc_id, text, source, seed)
    n = written(d.select(F.col("__size").alias("size"), F.col("__skey").alias("skey"), F.col(source).alias("source"), F.col("__h").alias("h")), "sizes")
    placed = place(d, n, doc_id, share, max_repeat, block_words, shard_words)
    return placed.select(*docs.columns, *[F.col(f"__{r}").alias(name) for r, name in zip(("size", "source_size", "target", "taken"), names)])


def sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """docs with __size, __skey (source), __h (seeded hash of the id) and __t (hash of the text)."""
    return docs.withColumns(
        {
            "__size": word_count(F.col(text)),
            "__skey": F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))),
            "__h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))),
            "__t": F.md5(F.coalesce(F.col(text), F.lit(""))),
        }
    )


def place(d: DataFrame, n: DataFrame, doc_id: str, share: float, max_repeat: int, block_words: int, shard_words: int) -> DataFrame:
    """d, as sized() makes it, with __source_size, __target and __taken; n: its sizes (size, skey, source, h)."""
    sizes = n.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("s"))
    targets = source_targets(sizes, share, max_repeat).select("skey", "s", "target", F.round(F.sum("target").over(W.partitionBy()) / block_words).cast("long").alias("blocks"), F.lit(0).alias("all"))
    targets = apportion(targets, ["all"], ["skey"], "target", "blocks", "quota")
    side = F.greatest(F.lit(1.0), F.ceil(F.sqrt(F.col("s") / shard_words))).cast("long")
    targets = written(targets.select("skey", "s", "target", "quota", side.alias("side")), "targets")
    one = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    h = lambda c, i: F.conv(F.substring(c, i, 7), 16, 10).cast("long")
    where = {"super": h("h", 1) % F.col("side"), "shard": h("h", 9) % F.col("side")}
    # dealt out by shard, not by source alone, before they are added up
    shards = n.join(one, "skey").withColumns(where).repartition("skey", "super", "shard").groupBy("skey", "super", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    supers = shards.groupBy("skey", "super").agg(F.sum("words").alias("super_words"), F.first("quota").alias("quota"))
    supers = apportion(supers, ["skey"], ["super"], "super_words", "quota", "super_quota").select("skey", "super", "super_quota")
    shards = apportion(shards.select("skey", "super", "shard", "words").join(supers, ["skey", "super"]), ["skey", "super"], ["shard"], "words", "super_quota", "shard_quota")

    placed = d.join(one.select(F.col("skey").alias("__skey"), F.col("s").alias("__source_size"), F.col("target").alias("__target"), F.col("side").alias("__side")), "__skey")
    placed = placed.withColumns({"__super": h("__h", 1) % F.col("__side"), "__shard": h("__h", 9) % F.col("__side")})
    placed = placed.repartition("__skey", "__super", "__shard")
    ahead = F.coalesce(F.sum("__size").over(W.partitionBy("__skey", "__super", "__shard").orderBy("__h", doc_id, "__size", "__t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("__ahead", ahead)
    quotas = shards.select(F.col("skey").alias("__skey"), F.col("super").alias("__super"), F.col("shard").alias("__shard"), F.col("words").alias("__words"), (F.col("shard_quota") * block_words).alias("__goal"))
    placed = placed.join(quotas, ["__skey", "__super", "__shard"])
    taken = F.lit(0).cast("long")
    for turn in range(max_repeat):
        taken = taken + F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__goal") - turn * F.col("__words") - F.col("__ahead")))
    return placed.withColumn("__taken", taken)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix at 150 % of the corpus takes from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    d = written(sized(docs, "doc_id", "text", "source", SEED).drop("text"), "sizes")  # texts are read once
    n = d.select(F.col("__size").alias("size"), F.col("__skey").alias("skey"), "source", F.col("__h").alias("h"))
    return place(d, n, "doc_id", SHARE, MAX_REPEAT, BLOCK_WORDS, SHARD_WORDS).select("doc_id", *[F.col(f"__{r}").alias(r) for r in ("size", "source_size", "target", "taken")])


def _apportion_sql(parties: str, group: str, party: str, votes: str, seats: str, out: str, extra: str = "") -> str:
    """The highest-quotient rule once more for DuckDB: every quotient up to the generous bound is ranked."""
    over = f"over (partition by {group})"
    return f"""(
  select {group}, {party}{extra}, count(*) filter (where rk <= {seats} and k is not null)::bigint as {out} from (
    select *, row_number() over (partition by {group} order by {votes} / (2 * k - 1)::double desc nulls last, {party}) as rk from (
      select *, unnest(case when hi >= 1 then range(1, hi + 1) else [null] end) as k from (
        select *, case when {seats} > 0 and sum({votes}) {over} > 0 then
          floor({seats} * {votes}::double / sum({votes}) {over} * (1 + count(*) {over} / {seats}::double) + 1.5)::bigint else 0 end as hi
        from {parties})))
  group by {group}, {party}{extra})"""


def _oracle() -> str:
    one = _apportion_sql("t2", '"all"', "skey", "target", "blocks", "quota", ", s, target, side")
    two = _apportion_sql("sup", "skey", "sp", "words", "quota", "super_quota")
    three = _apportion_sql("shq", "skey, sp", "sh", "words", "super_quota", "shard_quota", ", words")
    return f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    case when source is null then 'n' else 's' || source end as skey,
    md5('{SEED}:' || coalesce(doc_id::varchar, '')) as h, md5(coalesce(text, '')) as t from documents),
s as (select skey, any_value(source) as source, sum(size)::bigint as s from d group by skey),
t0 as (select *, row_number() over (order by source is null, source) as rn from s),
t1 as (select *, case rn % 3 when 1 then 3.0::double when 2 then 1.0::double else 2.0::double end as w, s::double * 2 as cap from t0),
lv as (select *, row_number() over (order by cap / w, skey) as place,
    (sum(s) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, skey rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, skey rows between unbounded preceding and 1 preceding), 0)) as level from t1),
wl as (select arg_min(level, place) as water from lv where cap / w > level),
t2 as (select skey, s, 0 as "all", tg as target, round(sum(tg) over () / {BLOCK_WORDS})::bigint as blocks,
    greatest(1, ceil(sqrt(s::double / {SHARD_WORDS})))::bigint as side
  from (select *, case when water is null then cap else least(cap, w * water) end as tg from lv cross join wl)),
tq as {one},
dp as (select d.doc_id, d.size, d.h, d.t, d.skey, tq.s, tq.target, tq.quota,
    ('0x' || substr(h, 1, 7))::bigint % side as sp, ('0x' || substr(h, 9, 7))::bigint % side as sh
  from d join tq using (skey)),
sup as (select skey, sp, sum(size)::bigint as words, any_value(quota) as quota from dp group by skey, sp),
spq as {two},
shq as (select dp.skey, dp.sp, dp.sh, sum(size)::bigint as words, any_value(super_quota) as super_quota
  from dp join spq on dp.skey = spq.skey and dp.sp = spq.sp group by dp.skey, dp.sp, dp.sh),
sq as {three},
o as (select *, coalesce(sum(size) over (partition by skey, sp, sh order by h, doc_id, size, t rows between unbounded preceding and 1 preceding), 0)::bigint as ahead from dp)
select o.doc_id, o.size, o.s as source_size, o.target,
  (greatest(0, least(o.size, shard_quota * {BLOCK_WORDS} - ahead)) + greatest(0, least(o.size, shard_quota * {BLOCK_WORDS} - sq.words - ahead)))::bigint as taken
from o join sq on o.skey = sq.skey and o.sp = sq.sp and o.sh = sq.sh
"""


ORACLE = {"op4_mixing": _oracle()}
QUERIES = {"op4_mixing": op4_mixing}
