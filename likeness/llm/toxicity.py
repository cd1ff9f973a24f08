"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Counts: every labelled training row is read; its words are counted per class, and all statistics
(grams per class, distinct continuations of both classes together) come from those counts by
DataFrame aggregation. Model: each class has its own highest-order counts with an absolute discount;
what the discount frees goes to one shared distribution, interpolated Kneser-Ney over the counts of
both classes with continuation counts below the highest order. An expression that is rare or unknown
in a class so falls back on what the classes share and tells them little apart.

Score: a word's log-likelihood ratio (toxic over ordinary) sums over its characters; a text is
described by its length-normalised ratio, whole and in its most toxic windows of words, and by how
many words stand out and how far; a logistic curve turns that into a number from 0 to 1. It is
fitted on a quarter of the training rows with a model of the others; the model that scores counts all.
Whole texts are read; a task keeps a bounded table of words.

Nothing that tells the classes apart is left out: only grams that neither class has more often than
its discount go, as they score what their context does, and contexts that tell nothing. A model of up
to ``MODEL_GRAMS`` rows of a kind is broadcast; from a larger one each block of documents gets the
rows of its own grams and contexts by a shuffle join.

Defined results: null and empty texts and texts without letters are scored as such by the curve;
rows without id are scored, never learned from and not held out; several labels of one document count as toxic if
one is; labels that are null are ignored; with no labelled rows of both classes every score is 0; where the
rows for the curve lack a class, the sign of a text's length-normalised ratio decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.llm.common import TaskTable, in_small_batches, unused
from likeness.sources.scratch import Scratch

ORDER = 5
DISCOUNT = 0.75
#: A class's own counts lose more: what it has seen once or twice is left to the shared distribution.
CLASS_DISCOUNT = 2.0
WINDOWS = (1, 6, 24)
#: Grams, and contexts, are broadcast up to this many and joined by a shuffle beyond.
MODEL_GRAMS = 2_000_000
#: Characters and rows of a block of documents for that join, on average at most.
BLOCK_CHARS, BLOCK_ROWS = 4_000_000, 20_000
CALIBRATION_ROWS = 20_000
#: Labels are broadcast up to this many rows and joined by a shuffle beyond.
BROADCAST_LABELS = 2_000_000
#: Words that a counting task holds before it passes their counts on.
COUNTED_WORDS = 1 << 17

_BEGIN, _END = "\x02", "\x03"
_words = re.compile(r"[^\W\d_]+").findall


@dataclass
class Model:
    """Sorted 64-bit keys of grams and of contexts with their log ratios; the curve's weights. A model
    too large for a broadcast has no keys here but a table: key, of_context, ratio."""

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    weights: np.ndarray | None = None
    table: DataFrame | None = None

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Model:
        """The model of rows key, of_context, ratio."""
        rows = rows.sort_values("key")
        parts = []
        for own in (rows[~rows["of_context"].astype(bool)], rows[rows["of_context"].astype(bool)]):
            parts += [own["key"].to_numpy(np.int64), own["ratio"].to_numpy(np.float32)]
        return cls(*parts)


def remainder(by: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(doc_id).cast("string")) % by


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic (0 or 1) of the documents with a label."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(own, "doc_id")


def count_words(rows: DataFrame) -> DataFrame:
    """word, toxic_n, plain_n over all rows (text, toxic, part); toxic_4, plain_4 over those of part 4."""
    names = ["toxic_n", "plain_n", "toxic_4", "plain_4"]

    def run(batches):
        counts = {(toxic, fourth): Counter() for toxic in (1, 0) for fourth in (False, True)}

        def counted():
            words = list(set().union(*counts.values()))
            own = [[counts[toxic, True][w] for w in words] for toxic in (1, 0)]
            both = [[counts[toxic, False][w] + n for w, n in zip(words, held)] for toxic, held in zip((1, 0), own)]
            for c in counts.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(n, pa.int64()) for n in (*both, *own))], ["word", *names])

        for batch in batches:
            for text, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "part"))):
                counts[toxic, part == 4].update(_words((text or "").lower()))
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield counted()
        yield counted()

    parts = in_small_batches(rows).select("text", "toxic", "part").mapInArrow(run, "word string, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("word").agg(*(F.sum(n).alias(n) for n in names))


def _sum_over(value, key: str):
    return F.sum(value).over(Window.partitionBy(key))


def shared_distribution(top: DataFrame, order: int, discount: float) -> DataFrame:
    """gram (of ``order`` - 1), p: interpolated Kneser-Ney over the continuation counts of both classes."""
    levels, grams = {}, top.select("gram")
    for k in range(order - 1, 0, -1):
        grams = grams.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = grams
    p = None
    for k in range(1, order):
        level = levels[k].withColumn("context", F.expr(f"substring(gram, 1, {k - 1})")).withColumn("lower", F.expr("substring(gram, 2)"))
        level = level.withColumn("total", _sum_over("n", "context")).withColumn("kinds", _sum_over(F.lit(1), "context"))
        if p is None:
            below = 1 / (F.col("kinds") + 1)
        else:
            level = level.join(p.withColumnsRenamed({"gram": "lower", "p": "below"}), "lower")
            below = F.col("below")
        p = level.select("gram", ((F.col("n") - discount) / F.col("total") + discount * F.col("kinds") / F.col("total") * below).alias("p"))
    return p


def count_model(words: DataFrame, scratch: Scratch, order: int = ORDER, discount: float = DISCOUNT, own: float = CLASS_DISCOUNT, most: int = MODEL_GRAMS) -> Model:
    """The model of counted words."""
    padded = F.concat(F.lit(_BEGIN * (order - 1)), F.col("word"), F.lit(_END))
    starts = F.sequence(F.lit(1), F.length("word") + 1)
    grams = words.select(F.explode(F.transform(starts, lambda i: F.substring(padded, i, F.lit(order)))).alias("gram"), "toxic_n", "plain_n")
    top = scratch.keep(grams.groupBy("gram").agg(F.sum("toxic_n").alias("t"), F.sum("plain_n").alias("o")))
    shared = shared_distribution(top, order, discount)
    level = top.withColumn("context", F.expr(f"substring(gram, 1, {order - 1})")).withColumn("lower", F.expr("substring(gram, 2)"))
    for c in "to":
        level = level.withColumn(f"{c}_all", _sum_over(c, "context")).withColumn(f"{c}_free", _sum_over(F.least(F.col(c), F.lit(own)), "context"))
    level = level.withColumn("all", F.col("t_all") + F.col("o_all")).withColumn("kinds", _sum_over(F.lit(1), "context"))
    level = level.join(shared.withColumnsRenamed({"gram": "lower", "p": "below"}), "lower")
    both = (F.col("t") + F.col("o") - discount) / F.col("all") + discount * F.col("kinds") / F.col("all") * F.col("below")
    left = {c: F.when(F.col(f"{c}_all") > 0, F.col(f"{c}_free") / F.col(f"{c}_all")).otherwise(1.0) for c in "to"}
    p = {c: F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - own, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(0.0) + left[c] * both for c in "to"}
    level = scratch.keep(level.select(
        F.xxhash64("gram").alias("key"), F.xxhash64("context").alias("context"), (F.greatest("t", "o") <= own).alias("as_context"),
        F.log(p["t"] / p["o"]).cast("float").alias("ratio"), F.log(left["t"] / left["o"]).cast("float").alias("context_ratio"),
    ))
    contexts = level.groupBy(F.col("context").alias("key")).agg(F.max("context_ratio").alias("ratio")).filter("ratio <> 0")
    grams = level.filter("not as_context").select("key", F.lit(False).alias("of_context"), "ratio")
    table = scratch.keep(grams.unionByName(contexts.withColumn("of_context", F.lit(True))))
    scratch.drop(level)
    scratch.drop(top)
    if any(r["count"] > most for r in table.groupBy("of_context").count().collect()):
        empty = np.zeros(0, np.int64), np.zeros(0, np.float32)
        return Model(*empty, *empty, table=table)
    model = Model.of(table.toPandas())
    scratch.drop(table)
    return model


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys and where there are any."""
    if not len(keys):
        return np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], np.float32(0)), found


def _keys(words: Iterable[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words' grams and of their contexts, and where each word's begin and end."""
    key = xxhash.xxh64_intdigest
    grams, contexts, ends = [], [], [0]
    for word in words:
        padded = _BEGIN * (order - 1) + word + _END
        for i in range(len(word) + 1):
            grams.append(key(padded[i : i + order].encode(), 42))
            contexts.append(key(padded[i : i + order - 1].encode(), 42))
        ends.append(len(grams))
    return np.array(grams, np.uint64).view(np.int64), np.array(contexts, np.uint64).view(np.int64), np.array(ends)


class WordTable(TaskTable):
    """Word -> log ratio; filled text by text."""

    def __init__(self, model: Model, order: int = ORDER):
        super().__init__()
        self._model, self._order = model, order

    def _fill(self, words: list[str]) -> None:
        grams, contexts, ends = _keys(words, self._order)
        m = self._model
        ratio, found = _look_up(m.grams, m.gram_ratio, grams)
        backed, _ = _look_up(m.contexts, m.context_ratio, contexts)
        total = np.concatenate([[0.0], np.cumsum(np.where(found, ratio, backed), dtype=np.float64)])
        for word, ratio in zip(words, (total[ends[1:]] - total[ends[:-1]]).tolist()):
            self.put(word, ratio)

    def ratios(self, text: str) -> np.ndarray:
        words = _words(text.lower())
        self.trim()
        new = [w for w in dict.fromkeys(words) if w not in self]
        if new:
            self._fill(new)
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


#: Ratios above these count as a word's excess and as a suspect word.
EXCESS, SUSPECT = 2.0, 3.0
FEATURES = 1 + len(WINDOWS) + 4


def describe(ratios: np.ndarray) -> list[float]:
    """The length-normalised log ratio of the whole text and of its most toxic window of each width;
    then the mean and the logarithm of its words' excess, of its suspect words and of its length."""
    n = len(ratios)
    if not n:
        return [0.0] * FEATURES
    total = np.concatenate([[0.0], np.cumsum(ratios)])
    out = [total[-1] / n]
    for width in WINDOWS:
        width = min(width, n)
        out.append(float((total[width:] - total[:-width]).max()) / width)
    excess = float(np.maximum(ratios - EXCESS, 0).sum())
    return [*out, excess / n, float(np.log1p(excess)), float(np.log1p((ratios > SUSPECT).sum())), float(np.log1p(n))]


def _features(texts, table: WordTable) -> np.ndarray:
    return np.array([describe(table.ratios(t or "")) for t in texts], np.float64).reshape(-1, FEATURES)


def features_by_join(rows: DataFrame, model: DataFrame) -> DataFrame:
    """_row, x: the features of rows (_row, each its own, and text) by a model's table."""
    size = rows.agg(F.sum(F.length("text").cast("long")), F.count("*")).first()
    blocks = 1 + max((size[0] or 0) // BLOCK_CHARS, size[1] // BLOCK_ROWS)
    placed = rows.select("_row", "text", F.pmod(F.xxhash64("_row"), F.lit(blocks)).alias("block"))

    def wanted(of: tuple, table: pa.Table) -> pa.Table:
        words = {w for t in table.column("text").to_pylist() for w in _words((t or "").lower())}
        grams, contexts = map(np.unique, _keys(words)[:2])
        n = len(grams) + len(contexts)
        return pa.table({"block": pa.array(np.full(n, of[0].as_py(), np.int64)), "key": np.concatenate([grams, contexts]), "of_context": np.arange(n) >= len(grams)})

    def describe_block(table: pa.Table, known: pa.Table) -> pa.Table:
        x = _features(table.column("text").to_pylist(), WordTable(Model.of(known.select(["key", "of_context", "ratio"]).to_pandas())))
        return pa.table({"_row": table.column("_row"), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    keys = placed.groupBy("block").applyInArrow(wanted, "block long, key long, of_context boolean")
    known = keys.join(model, ["key", "of_context"]).select("block", "key", "of_context", "ratio")
    return placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(describe_block, "_row long, x array<double>")


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression, by damped Newton steps; a row stands for ``n``."""
    centre = np.average(x, 0, n)
    scale = np.maximum(np.average((x - centre) ** 2, 0, n) ** 0.5, 1e-9)
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    w, ridge = np.zeros(z.shape[1]), penalty * n.sum() ** 0.5 * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * (p * (1 - p) + 1e-6))[:, None]).T @ z + ridge, z.T @ (n * (y - p)) - ridge @ w)
        w = w + np.clip(step, -2, 2)
    out = w[1:] / scale
    return np.concatenate([[w[0] - out @ centre], out])


#: A curve that goes by the sign of the whole text's ratio; no ratio at all is ordinary.
SIGN = np.array([-1e-6, 1.0] + [0.0] * (FEATURES - 1))


def class_rates(sizes: dict[int, int], most: int) -> dict[int, float]:
    """The rate at which to draw rows of each class for ``most`` in all: the rarer class whole up to a half."""
    return {c: min(1.0, max(most // 2, most - sizes.get(1 - c, 0)) / n) for c, n in sizes.items()}


def _described(rows: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """x, toxic of rows (text, toxic)."""
    if model.table is not None:
        numbered = scratch.keep(rows.select(F.monotonically_increasing_id().alias("_row"), "text", "toxic"))
        return features_by_join(numbered, model.table).join(numbered, "_row").select("x", "toxic")
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        table = WordTable(Model(**shared.value))
        for batch in batches:
            x = _features(batch.column("text").to_pylist(), table)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    return rows.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int")


def fit(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """The model, learned only from labelled rows whose id has a remainder of 1 to 4 modulo 5: those
    of 1 to 4 give the counts (all of them), those of 4 also the curve, by the counts of 1 to 3
    (``calibration_rows`` at most, on average, drawn by a hash of the id at each class's own rate,
    which their weights undo)."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = labelled(docs, labels).withColumn("part", remainder(5)).filter("part > 0")
    fourth = rows.filter("part = 4")
    words = scratch.keep(count_words(rows))
    n = words.agg(*map(F.sum, ["toxic_n", "plain_n", "toxic_4", "plain_4"])).first()
    if not n[0] or not n[1]:
        return None
    model = count_model(words, scratch, most=MODEL_GRAMS)
    model.weights = _curve(fourth, words, scratch, calibration_rows) if n[0] > n[2] and n[1] > n[3] else SIGN
    scratch.drop(words)
    return model


def _curve(fourth: DataFrame, words: DataFrame, scratch: Scratch, calibration_rows: int) -> np.ndarray:
    """The weights fitted on the rows of remainder 4 with a model that hasn't counted them."""
    rates = class_rates({r["toxic"]: r["count"] for r in fourth.groupBy("toxic").count().collect()}, calibration_rows)
    if len(rates) < 2:
        return SIGN
    bound = F.when(F.col("toxic") == 1, int(rates[1] * (1 << 30))).otherwise(int(rates[0] * (1 << 30)))
    drawn = fourth.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound)
    others = words.select("word", (F.col("toxic_n") - F.col("toxic_4")).alias("toxic_n"), (F.col("plain_n") - F.col("plain_4")).alias("plain_n")).filter("toxic_n + plain_n > 0")
    model = count_model(others, scratch, most=MODEL_GRAMS)
    found = _described(drawn, model, scratch).toPandas()
    scratch.drop(model.table)
    if found.toxic.nunique() < 2:
        return SIGN
    return fit_curve(np.array(found.x.tolist()), found.toxic.to_numpy(float), 1 / found.toxic.map(rates).to_numpy(float))


def scorer(spark, model: Model | None):
    """A column function: text -> toxicity from 0 to 1."""
    shared = spark.sparkContext.broadcast(model and vars(model))

    @F.pandas_udf("double")
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value and Model(**shared.value)
        table = model and WordTable(model)
        for texts in parts:
            if model is None:
                yield pd.Series(np.zeros(len(texts)))
            else:
                z = _features(texts, table) @ model.weights[1:] + model.weights[0]
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return toxicity


def with_toxicity(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """The documents plus their score in a column of the given name, which none of theirs has."""
    if model is None or model.table is None:
        return docs.withColumn(name, scorer(docs.sparkSession, model)(docs["text"]))
    scratch, row = Scratch(docs.sparkSession, "toxicity-scores"), unused(docs, "_row")
    numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()))
    constant, *weights = map(float, model.weights)
    z = F.aggregate(F.zip_with("x", F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(constant), lambda a, b: a + b)
    scores = features_by_join(numbered.select(F.col(row).alias("_row"), "text"), model.table).select(F.col("_row").alias(row), (1 / (1 + F.exp(-z))).alias(name))
    return numbered.join(scores, row).select(*docs.columns, name)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (remainder 0), score, predicted (1 from 0.5) for every document."""
    found = with_toxicity(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), fit(docs, labels), "_toxicity")
    scored = found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("_toxicity").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is under ``limit``."""
    name = unused(docs, "_toxicity")
    return with_toxicity(docs, fit(docs, labels), name).filter(F.col(name) < limit).drop(name)
