"""Words to phoneme classes as a relational plan.

A word's readings are tried in order: in the dictionary; base and possessive ending;
hyphen-separated parts; stem and suffix, else prefix and base; two words run together;
prefix, stem and suffix; spelling rules for the base of a possessive; spelling rules.
Instead of trying one after the other, a word's last and first letters meet the tables of
endings and beginnings (a few rows each, broadcast), the stems that come out meet the
dictionary in equi-joins, and the match of least rank wins; words without any are spelt by
rule. Only different words go through this, so text size does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import phonemes as ph
from cadenza.operators.common import settled

METHODS = {1: "dictionary", 2: "possessive", 3: "hyphen_split", 4: "affix_strip", 5: "compound_split", 6: "chained_affix", 7: "possessive_rules", 8: "rules"}


#: Occurrences from which a word's reading is broadcast, how many such words there can be, and their letters at most.
OFTEN, HOT_WORDS, HOT_LETTERS = 200, 10_000, 64
#: Different words of a task.
TASK_WORDS = 20_000


def seed_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, ph.classes(p)) for w, p in ph.SEED_DICTIONARY.items()], "word string, phones array<int>")


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def _affixes(spark: SparkSession, table: dict[str, str]) -> DataFrame:
    """affix, ord, phones: a few rows by construction."""
    return F.broadcast(spark.createDataFrame([(a, i, ph.classes(p)) for i, (a, p) in enumerate(table.items())], "affix string, ord int, phones array<int>"))


def _ended(words: DataFrame, text: str, table: dict[str, str], least: int, ord_: str, phones: str, base: str) -> DataFrame:
    """words whose text ends in an affix with at least `least` letters before it: its number, its phonemes, what is before it."""
    sizes = sorted({len(a) for a in table})
    ends = F.explode(F.filter(F.array(*[F.when(F.length(text) >= k + least, F.right(F.col(text), F.lit(k))) for k in sizes]), lambda e: e.isNotNull()))
    found = words.withColumn("__end", ends).join(_affixes(words.sparkSession, table).withColumnsRenamed({"ord": ord_, "phones": phones}), F.col("__end") == F.col("affix"))
    return found.withColumn(base, F.left(F.col(text), F.length(text) - F.length("affix"))).drop("__end", "affix")


def _begun(words: DataFrame, text: str, table: dict[str, str], least: int, ord_: str, phones: str, rest: str) -> DataFrame:
    """words whose text begins with an affix with at least `least` letters behind it."""
    sizes = sorted({len(a) for a in table})
    starts = F.explode(F.filter(F.array(*[F.when(F.length(text) >= k + least, F.left(F.col(text), F.lit(k))) for k in sizes]), lambda e: e.isNotNull()))
    found = words.withColumn("__start", starts).join(_affixes(words.sparkSession, table).withColumnsRenamed({"ord": ord_, "phones": phones}), F.col("__start") == F.col("affix"))
    return found.withColumn(rest, F.substring(F.col(text), F.length("affix") + 1, F.length(text))).drop("__start", "affix")


def _stems(base: str) -> Column:
    """The base as it is, with a final E, with a final I as Y: rows (v, stem)."""
    b = F.col(base)
    y = F.when(b.endswith("I"), F.concat(F.left(b, F.length(b) - 1), F.lit("Y")))
    all_ = F.array(F.struct(F.lit(0).alias("v"), b.alias("stem")), F.struct(F.lit(1).alias("v"), F.concat(b, F.lit("E")).alias("stem")), F.struct(F.lit(2).alias("v"), y.alias("stem")))
    return F.inline(F.filter(all_, lambda s: s["stem"].isNotNull()))


def candidates(words: DataFrame, longest: int | None = None) -> DataFrame:
    """word, prio, s1, s2, left, right, pre, post: all candidate readings of upper-case words but hyphen splits and rules.

    longest: letters of the longest entry; a word is cut in two only where both parts can be entries.
    """
    none, zero = _ints([]), F.lit(0)

    def rows(df: DataFrame, prio: int, s1: Column, s2: Column, left: str, right: Column | None = None, pre: Column = none, post: Column = none) -> DataFrame:
        return df.select("word", F.lit(prio).alias("prio"), s1.cast("int").alias("s1"), s2.cast("int").alias("s2"), F.col(left).alias("left"), (F.lit(None).cast("string") if right is None else right).alias("right"), pre.alias("pre"), post.alias("post"))

    plain = rows(words, 1, zero, zero, "word")
    possessive = rows(_ended(words, "word", ph.POSSESSIVES, 1, "o", "p", "base"), 2, F.col("o"), zero, "base", post=F.col("p"))
    suffixed = _ended(words, "word", ph.SUFFIXES, 2, "o", "p", "base").select("word", "o", "p", _stems("base"))
    suffix = rows(suffixed, 4, F.col("o"), F.col("v"), "stem", post=F.col("p"))
    begun = _begun(words, "word", ph.PREFIXES, 2, "po", "pp", "rest")
    prefix = rows(begun, 4, 100 + F.col("po"), zero, "rest", pre=F.col("pp"))
    inner = _ended(begun.where(F.length("rest") >= 4), "rest", ph.SUFFIXES, 2, "o", "p", "base").select("word", "po", "pp", "o", "p", _stems("base"))
    chained = rows(inner, 6, F.col("po"), F.col("o") * 3 + F.col("v"), "stem", pre=F.col("pp"), post=F.col("p"))
    least, most = F.lit(3), F.length("word") - 3
    cut = words.where(F.length("word") >= 6)
    if longest is not None:
        cut = cut.where(F.length("word") <= 2 * longest)
        least, most = F.greatest(least, F.length("word") - longest), F.least(most, F.lit(longest))
    cut = cut.where(least <= most).withColumn("k", F.explode(F.sequence(least, most)))
    cut = cut.select("word", "k", F.left("word", F.col("k")).alias("l"), F.substring("word", F.col("k") + 1, F.length("word")).alias("r"))
    split = rows(cut, 5, F.col("k"), zero, "l", F.col("r"))
    return plain.union(possessive).union(suffix).union(prefix).union(split).union(chained)


def resolve(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """word, method, phones for every different word (upper case); phones is empty and method null if nothing applies."""
    w = settled(words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct())
    w = settled(w.repartition(-(-w.count() // TASK_WORDS) or 1, "word"))  # read by each way of reading; words are short, their readings are work, so bytes do not say how many tasks they need
    longest = dictionary.agg(F.max(F.length(F.upper("word")))).first()[0] or 0
    entries = dictionary.select(F.upper("word").alias("entry"), F.col("phones").alias("entry_phones"))
    c = candidates(w, longest).join(entries.withColumnsRenamed({"entry": "left", "entry_phones": "lp"}), "left").join(entries.withColumnsRenamed({"entry": "right", "entry_phones": "rp"}), "right", "left").where("right IS NULL OR rp IS NOT NULL")
    middle = F.when(F.col("rp").isNotNull(), F.concat(_ints([ph.SILENCE]), F.col("rp"))).otherwise(_ints([]))
    direct = c.select("word", F.struct("prio", "s1", "s2").alias("rank"), F.concat("pre", "lp", middle, "post").alias("phones"))
    parts = w.where(F.instr("word", "-") > 0).select("word", F.filter(F.split("word", "-"), lambda x: x != "").alias("p")).where(F.size("p") >= 2)
    parts = parts.select("word", F.size("p").alias("n"), F.posexplode("p").alias("pos", "entry")).join(entries, "entry")
    hyphen = parts.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "entry_phones"))).alias("got")).where(F.size("got") == F.col("n"))
    joined = F.flatten(F.transform("got", lambda x: F.when(x["pos"] == 0, x["entry_phones"]).otherwise(F.concat(_ints([ph.SILENCE]), x["entry_phones"]))))
    hyphen = hyphen.select("word", F.struct(F.lit(3).alias("prio"), F.lit(0).alias("s1"), F.lit(0).alias("s2")).alias("rank"), joined.alias("phones"))
    best = direct.unionByName(hyphen).groupBy("word").agg(F.min(F.struct("rank", "phones")).alias("b"))
    names = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    found = best.select(F.col("word").alias("w"), F.element_at(names, F.col("b.rank.prio")).alias("m"), F.col("b.phones").alias("ps"))
    base = F.left(F.col("word"), F.length("word") - 2)
    owned = F.when(F.col("word").endswith("'S") & (F.length("word") >= 4), ph.letter_to_sound(base))
    spelt = F.when(F.col("m").isNull(), F.struct(F.coalesce(owned, _ints([])).alias("owned"), ph.letter_to_sound(F.col("word")).alias("spelt")))
    r = w.join(found, F.col("word") == F.col("w"), "left").withColumn("r", spelt)
    by_rule = F.when(F.size("r.owned") > 0, METHODS[7]).when(F.size("r.spelt") > 0, METHODS[8])
    phones = F.when(F.size("r.owned") > 0, F.concat("r.owned", _ints(ph.classes("Z")))).otherwise(F.col("r.spelt"))
    return r.select("word", F.coalesce("m", by_rule).alias("method"), F.coalesce("ps", phones).alias("phones"))


def transcript_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, pos, word: tokens with a letter or digit, cleaned to upper-case letters, apostrophes and hyphens (possibly nothing)."""
    # outer: for an inner one Spark adds a filter that cuts the text into tokens again
    t = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(ph.tokens(F.col(text))).alias("pos", "token")).where(F.col("pos").isNotNull())
    return t.select("doc_id", "pos", ph.clean_token(F.col("token")).alias("word"))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n: how often each word of transcript_words stands; equal tokens are counted before they are cleaned."""
    t = docs.select(F.explode_outer(ph.parts(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return t.where(ph.spoken(F.col("token"))).groupBy(ph.clean_token(F.col("token")).alias("word")).agg(F.sum("n").alias("n"))


def transcript_targets(docs: DataFrame, dictionary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, targets (classes, silence between words), words, dictionary hits, rule-made words and unresolved ones.

    A text where nothing resolves has no targets; the caller decides whether that is an error.
    """
    words = transcript_words(docs, doc_id, text)
    counts = settled(word_counts(docs, text))  # a row for each different word
    # words that stand often have their reading broadcast, HOT_WORDS of them at most, whatever the texts; only the others are shuffled, none with more than that share of all words
    often = max(OFTEN, -(-(counts.agg(F.sum("n")).first()[0] or 0) // HOT_WORDS))
    hot = F.broadcast(counts.where((F.col("n") > often) & (F.length("word") <= HOT_LETTERS)).select(F.col("word").alias("hw")))
    known = settled(resolve(counts, dictionary).withColumnRenamed("word", "w"))
    near = words.join(F.broadcast(known.join(hot, F.col("w") == F.col("hw"), "left_semi")), F.col("word") == F.col("w"))
    rest = words.join(hot, F.col("word") == F.col("hw"), "left_anti")
    joined = near.unionByName(rest.join(known, F.col("word") == F.col("w"), "left"))
    per = joined.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.size("phones") > 0, F.struct("pos", "phones")))).alias("got"),
        F.count(F.lit(1)).alias("words"), F.count_if(F.col("method") == "dictionary").alias("dict_hits"), F.count_if(F.col("method").isin("possessive_rules", "rules")).alias("oov_words"), F.count_if(F.col("method").isNull()).alias("unresolved"),
    )
    targets = F.flatten(F.transform("got", lambda x, i: F.when(i == 0, x["phones"]).otherwise(F.concat(_ints([ph.SILENCE]), x["phones"]))))
    return per.select("doc_id", targets.alias("targets"), "words", "dict_hits", "oov_words", "unresolved")
