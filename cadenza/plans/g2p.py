"""Queries over transcripts and pronunciations, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import phonemes as ph
from cadenza.operators import g2p, sequence
from cadenza.operators.common import settled


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", ph.word_total(F.col("text")).alias("words"), F.size(ph.tokens(F.col("text"))).alias("tokens"), F.size(F.filter(F.transform(ph.tokens(F.col("text")), ph.clean_token), lambda w: w != "")).alias("spelt"))


def letter_to_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = g2p.transcript_words(docs(spark, sf_dir), "doc_id", "text").select("word").distinct()
    return w.select("word", F.concat_ws(" ", ph.letter_to_sound(F.col("word")).cast("array<string>")).alias("phones"))


def arpabet_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all phonemes with every stress mark, and of a symbol that is none."""
    symbols = spark.createDataFrame([(s + d,) for s in [*ph.PHONEMES, "XX", "aa"] for d in ("", "0", "1", "2")], "symbol string")
    return symbols.select("symbol", ph.phoneme_class(F.col("symbol")).alias("class"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words, and each with endings and beginnings, so that every way of reading is taken."""
    w = g2p.word_counts(docs(spark, sf_dir), "text").select("word")
    more = [F.col("word"), F.concat(F.col("word"), F.lit("'S")), F.concat(F.col("word"), F.lit("NESS")), F.concat(F.lit("UN"), F.col("word")), F.concat(F.lit("UN"), F.col("word"), F.lit("ING")), F.concat(F.col("word"), F.lit("-CAT")), F.concat(F.col("word"), F.lit("MASTERS"))]
    return w.select(F.explode(F.array(*more)).alias("word"))


def g2p_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = g2p.resolve(_words(spark, sf_dir), g2p.seed_dictionary(spark))
    return r.select("word", "method", F.concat_ws(" ", F.col("phones").cast("array<string>")).alias("phones"))


def g2p_method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word occurrences by way of reading."""
    words = settled(g2p.word_counts(docs(spark, sf_dir), "text"))
    known = g2p.resolve(words, g2p.seed_dictionary(spark)).withColumnRenamed("word", "w")
    return words.join(known, F.col("word") == F.col("w")).groupBy(F.coalesce("method", F.lit("unresolved")).alias("method")).agg(F.sum("n").alias("n"))


def transcript_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of every document, with the share of dictionary words and the frames an alignment needs."""
    t = g2p.transcript_targets(docs(spark, sf_dir), g2p.seed_dictionary(spark))
    rate = F.when(F.col("words") > 0, F.col("dict_hits") / F.col("words")).otherwise(0.0)
    return t.select("doc_id", F.md5(F.concat_ws(" ", F.col("targets").cast("array<string>"))).alias("targets_md5"), F.size("targets").alias("n_targets"), "words", "dict_hits", "oov_words", "unresolved", F.round(rate, 6).alias("dict_rate"), sequence.ctc_min_frames(F.col("targets")).alias("min_frames"))


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"({i}, '{a.replace(chr(39), chr(39) * 2)}', {ph.classes(p)}::int[])" for i, (a, p) in enumerate(table.items()))


_UNITS = "|".join(ph.PAIRS) + "|[A-Z]"
_MAP = "map {" + ", ".join(f"'{k}': {ph.classes(v)}::int[]" for k, v in (ph.PAIRS | ph.LETTERS).items()) + "}"


def _rules(word: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(regexp_replace(upper({word}), '[^A-Z]', '', 'g'), '{_UNITS}'), lambda u: {_MAP}[u]))"


_TOK = """tok as (select doc_id, row_number() over (partition by doc_id order by i) as pos, upper(regexp_replace(t, '[^A-Za-z''-]', '', 'g')) as word
  from (select doc_id, unnest(l) as t, unnest(range(len(l))) as i from (select doc_id, string_split_regex(text, '\\s+') as l from documents)) where regexp_matches(t, '[\\p{L}\\p{N}]'))"""
_STEM = "select * from (select *, b as stem, 0 as v from {x} union all select *, b || 'E', 1 from {x} union all select *, left(b, len(b) - 1) || 'Y', 2 from {x} where ends_with(b, 'I'))"
_RESOLVE = f"""dict as (select upper(w) as w, p from (values {", ".join(f"('{w}', {ph.classes(p)}::int[])" for w, p in ph.SEED_DICTIONARY.items())}) t(w, p)),
pos as (select * from (values {_values(ph.POSSESSIVES)}) t(o, a, p)), suf as (select * from (values {_values(ph.SUFFIXES)}) t(o, a, p)), pre as (select * from (values {_values(ph.PREFIXES)}) t(o, a, p)),
sx as (select word, o, p, left(word, len(word) - len(a)) as b from ws, suf where ends_with(word, a) and len(word) >= len(a) + 2),
px as (select word, o, p, substr(word, len(a) + 1) as rest from ws, pre where starts_with(word, a) and len(word) >= len(a) + 2),
cx as (select word, px.o as po, suf.o as so, px.p as pp, suf.p as sp, left(rest, len(rest) - len(a)) as b from px, suf where len(rest) >= 4 and ends_with(rest, a) and len(rest) >= len(a) + 2),
hx as (select word, len(l) as n, unnest(l) as part, unnest(range(len(l))) as i from (select word, list_filter(string_split(word, '-'), lambda x: x <> '') as l from ws) where len(l) >= 2),
hy as (select word, flatten(list(case when i = 0 then d.p else [41] || d.p end order by i)) as phones from hx join dict d on d.w = part group by word, n having count(*) = n),
cand as (
  select word, 1 as r1, 0 as r2, 0 as r3, d.p as phones from ws join dict d on d.w = word
  union all select word, 2, o, 0, d.p || pos.p from ws, pos, dict d where ends_with(word, a) and len(word) > len(a) and d.w = left(word, len(word) - len(a))
  union all select word, 3, 0, 0, phones from hy
  union all select word, 4, o, v, d.p || s.p from ({_STEM.format(x="sx")}) s join dict d on d.w = stem
  union all select word, 4, 100 + o, 0, px.p || d.p from px join dict d on d.w = rest
  union all select word, 5, k, 0, l.p || [41] || r.p from (select word, unnest(range(3, len(word) - 2)) as k from ws where len(word) >= 6) s join dict l on l.w = left(word, k) join dict r on r.w = substr(word, k + 1)
  union all select word, 6, po, so * 3 + v, pp || d.p || sp from ({_STEM.format(x="cx")}) s join dict d on d.w = stem
  union all select word, 7, 0, 0, ph || [39] from (select word, {_rules("left(word, len(word) - 2)")} as ph from ws where ends_with(word, '''S') and len(word) >= 4) where len(ph) > 0
  union all select word, 8, 0, 0, ph from (select word, {_rules("word")} as ph from ws) where len(ph) > 0),
best as (select word, min(r1) as r1, arg_min(phones, [r1, r2, r3]) as phones from cand group by word),
res as (select ws.word, case r1 {" ".join(f"when {k} then '{v}'" for k, v in g2p.METHODS.items())} end as method, coalesce(phones, []::int[]) as phones from ws left join best on ws.word = best.word)"""

QUERIES = {f.__name__: f for f in (word_totals, letter_to_sound, arpabet_class, g2p_resolve, g2p_method_counts, transcript_targets)}
ORACLE = {
    "word_totals": f"""with {_TOK.replace("upper(", "(")}, c as (select doc_id, count(*) as tokens, count(*) filter (where word <> '') as spelt from tok group by doc_id)
select d.doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::integer as words, coalesce(tokens, 0)::integer as tokens, coalesce(spelt, 0)::integer as spelt from documents d left join c on d.doc_id = c.doc_id""",
    "letter_to_sound": f"with {_TOK}, ws as (select distinct word from tok) select word, coalesce(array_to_string({_rules('word')}, ' '), '') as phones from ws",
    "arpabet_class": f"""select s || d as symbol, case when list_position({ph.PHONEMES}, s) > 0 then list_position({ph.PHONEMES}, s)::integer end as class from (select unnest({[*ph.PHONEMES, "XX", "aa"]}) as s), (select unnest(['', '0', '1', '2']) as d)""",
    "g2p_resolve": f"""with {_TOK}, w0 as (select distinct word from tok),
ws as (select distinct unnest([word, word || '''S', word || 'NESS', 'UN' || word, 'UN' || word || 'ING', word || '-CAT', word || 'MASTERS']) as word from w0), {_RESOLVE}
select word, method, coalesce(array_to_string(phones, ' '), '') as phones from res""",
    "g2p_method_counts": f"with {_TOK}, ws as (select distinct word from tok), {_RESOLVE} select coalesce(method, 'unresolved') as method, count(*) as n from tok join res on tok.word = res.word group by 1",
    "transcript_targets": f"""with {_TOK}, ws as (select distinct word from tok), {_RESOLVE},
p as (select doc_id, pos, method, phones, row_number() over (partition by doc_id, len(phones) > 0 order by pos) as k from tok join res on tok.word = res.word),
t as (select doc_id, coalesce(flatten(list(case when k = 1 then phones else [41] || phones end order by pos) filter (where len(phones) > 0)), []::int[]) as targets, count(*) as words, count(*) filter (where method = 'dictionary') as dict_hits,
  count(*) filter (where method in ('possessive_rules', 'rules')) as oov_words, count(*) filter (where method is null) as unresolved from p group by doc_id)
select doc_id, md5(coalesce(array_to_string(targets, ' '), '')) as targets_md5, len(targets)::integer as n_targets, words, dict_hits, oov_words, unresolved, round(dict_hits / words, 6) as dict_rate,
  (len(targets) + len(list_filter(range(2, len(targets) + 1), lambda i: targets[i] = targets[i - 1])))::integer as min_frames from t""",
}
