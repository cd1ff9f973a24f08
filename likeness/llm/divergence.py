"""How the sources of each language differ in their use of words, by wide term vectors.

1. The terms of every text are counted by (lang, term, source), with the documents that hold them, in
   one aggregation that combines before its shuffle.
2. Each term that enough documents of its language hold becomes one wide row: its counts by source.
3. Each language has one row with its sources and their totals, copied to ``SALTS`` salts that the
   terms are dealt to, so that a language with most of the terms isn't one join key.
4. A term's counts become an array of smoothed shares in the order of the language's sources, and
   higher-order functions emit what it adds to each pair of sources; sums combine before the shuffle.

Everything runs in the JVM, on integers: shares are in billionths, rounded down, by exact division of
decimals. A row of the terms is as wide as its language has sources, and so is what it emits at a time.

Defined results: null texts, languages and sources count as empty strings; a text without terms still
makes its (lang, source) a group; a language none of whose terms is in enough documents has pairs of
value 0 and no terms; each row is a document, repeated ones too; further columns, also of clashing
names, are ignored; an empty table gives an empty result. Ties go to the item that sorts first by its
UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.sources.scratch import Scratch

LEAST_DOCUMENTS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
MOST_TERMS = 50
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates terms: ASCII but for letters.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), documents (that hold it)."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = named.select("lang", "source", F.split(F.translate("text", _UPPER, _LOWER), _BETWEEN).alias("terms"))
    both = terms.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    rows = both.select("lang", "source", "once", F.explode("terms").alias("term")).filter("term <> ''")
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("documents"))


def _share(count: Column, total: Column, kept: Column, unit: int, smoothing: int) -> Column:
    """1 + floor(unit * (count + smoothing) / (total + smoothing * kept))."""
    exact = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", F.lit(unit).cast("decimal(19,0)") * exact(count + smoothing), exact(total + smoothing * kept))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS, smoothing: int = SMOOTHING, unit: int = UNIT, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source) the part ``pair``, how far each
    other source of the language is away, and the part ``term``, the ``most_terms`` terms that it uses
    most above the language's share. The result reads tables of ``scratch``."""
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    groups = scratch.keep(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct())
    by_source = F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts")
    kept = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"), by_source)
    kept = scratch.keep(kept.filter(F.col("documents") >= least).drop("documents"))

    totals = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("whole"))
    langs = sized.join(whole, "lang", "left").select("lang", F.col("sources.source").alias("sources"), F.col("sources.total").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("whole", F.lit(0)).alias("whole"))
    langs = scratch.keep(langs)

    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wide = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    wide = wide.withColumn("own", F.transform("sources", lambda s: F.coalesce(F.try_element_at("counts", s), F.lit(0))))
    share = lambda count, total: _share(count, total, F.col("kept"), unit, smoothing)
    wide = wide.select("lang", "term", "sources", "own", F.zip_with("own", "totals", share).alias("shares"), share(F.col("n"), F.col("whole")).alias("q"))
    wide = scratch.keep(wide)

    # A row of equal shares for each language gives all pairs, also where no term is kept.
    vectors = wide.select("lang", "shares").unionByName(langs.select("lang", F.transform("sources", lambda s: F.lit(0).cast("long")).alias("shares")))
    one = vectors.select("lang", "shares", F.posexplode("shares").alias("i", "share"))
    later = F.transform(F.slice("shares", F.col("i") + 2, F.size("shares")), lambda p, j: F.struct((F.col("i") + 1 + j).alias("j"), F.abs(p - F.col("share")).alias("f")))
    sums = one.select("lang", "i", F.inline(later)).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    names = langs.select("lang", F.posexplode("sources").alias("i", "source"))
    pairs = both.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])

    used = F.filter(F.arrays_zip("sources", "own", "shares"), lambda x: (x["own"] > 0) & (x["shares"] > F.col("q")))
    terms = wide.select("lang", F.col("term").alias("item"), "q", F.explode(used).alias("at"))
    terms = terms.select("lang", F.col("at.sources").alias("source"), "item", (F.col("at.shares") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= most_terms))
