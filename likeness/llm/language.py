"""Language of whole texts by a byte convolutional network in numpy.

Network: bytes are embedded, convolved by filters of several widths, max-pooled over a window of
fixed length and classified by a softmax layer. Training: Adam on windows of a bounded sample
(``SAMPLE_DOCS`` documents of each language on average, drawn by a hash of the id, ``SAMPLE_WINDOWS``
windows each), on the driver. Applying: the embedding and a filter's weights fold into look-up
tables over pairs of bytes, so a batch of windows needs look-ups, sums and maxima alone; a text is
cut into consecutive windows that cover all its bytes, and its probabilities are its windows'
averaged by their bytes.

No shuffle; a task handles ``BATCH`` windows at a time.

Defined results: ``und`` with score 0 for null texts and texts without a letter; with no labelled
rows at all everything is ``und``; every language that has rows to learn from is a class; rows with null language or null id are never learned from;
repeated rows get equal results; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from likeness.llm.common import in_small_batches
from likeness.operators.joins import local_table

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
BATCH = 4096
SAMPLE_DOCS = 500
SAMPLE_WINDOWS = 4
#: A text is kept whose best probability is that share of the way from chance (1 / languages) to certainty.
CERTAINTY = 0.2
UNDETERMINED = "und"


def _letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def remainder(by: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(doc_id).cast("string")) % by


def cut(data: bytes, length: int = LENGTH) -> np.ndarray:
    """Consecutive windows that cover all bytes; the last is padded with zeros."""
    n = max(1, -(-len(data) // length))
    return np.frombuffer(data.ljust(n * length, b"\0"), np.uint8).reshape(n, length)


class Network:
    """Embedding, filters by width, their biases and the softmax layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        pooled = FILTERS * len(WIDTHS)
        self.p = {"e": r.normal(0, 0.5, (256, EMBEDDING)), "v": r.normal(0, pooled**-0.5, (pooled, len(classes))), "c": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.p["e"][0] = 0

    def _forward(self, x: np.ndarray):
        n, rows = len(x), np.arange(len(x))[:, None]
        embedded, kept, pooled = self.p["e"][x], [], []
        for w in WIDTHS:
            patches = np.concatenate([embedded[:, i : x.shape[1] - w + 1 + i] for i in range(w)], axis=2)
            z = patches.reshape(-1, w * EMBEDDING) @ self.p[f"w{w}"]
            z = z.reshape(n, -1, FILTERS)
            at = z.argmax(axis=1)
            kept.append((at, patches[rows, at]))
            pooled.append(z[rows, at, np.arange(FILTERS)] + self.p[f"b{w}"])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        return h, kept, softmax(h @ self.p["v"] + self.p["c"])

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, kept, q = self._forward(x)
        q[np.arange(len(x)), y] -= 1
        q /= len(x)
        g = {"v": h.T @ q, "c": q.sum(0), "e": np.zeros_like(self.p["e"])}
        back = (q @ self.p["v"].T) * (h > 0)
        for k, (w, (at, patches)) in enumerate(zip(WIDTHS, kept)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"w{w}"] = np.einsum("nf,nfd->df", own, patches)
            g[f"b{w}"] = own.sum(0)
            share = (own[:, :, None] * self.p[f"w{w}"].T[None]).reshape(-1, w, EMBEDDING)
            codes = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(g["e"], codes.reshape(-1, w), share)
        g["e"][0] = 0
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 4e-3, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                some = order[i : i + batch]
                windows = x[some].copy()
                shorter = r.random(len(some)) < 0.25  # short texts fill a window in part
                windows[shorter[:, None] & (np.arange(windows.shape[1]) >= r.integers(16, LENGTH, len(some))[:, None])] = 0
                t += 1
                for k, g in self._gradients(windows, y[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    step = rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
                    self.p[k] -= step.astype(np.float32)

    def tables(self) -> dict:
        """The trained network as look-up tables over bytes and pairs of bytes."""
        out = {"classes": self.classes, "v": self.p["v"], "c": self.p["c"], "b": np.concatenate([self.p[f"b{w}"] for w in WIDTHS]), "t": {}}
        for w in WIDTHS:
            one = [self.p["e"] @ self.p[f"w{w}"][i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(w)]
            out["t"][w] = [(one[i][:, None] + one[i + 1][None]).reshape(-1, FILTERS) if i + 1 < w else one[i] for i in range(0, w, 2)]
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def probabilities(tables: dict, windows: np.ndarray) -> np.ndarray:
    """Class probabilities of windows, by look-ups position after position."""
    x = windows.T.astype(np.intp)
    pairs = x[:-1] * 256 + x[1:]
    pooled = []
    for w, parts in tables["t"].items():
        most = None
        for at in range(len(x) - w + 1):
            z = parts[0][pairs[at]]
            for i, part in enumerate(parts[1:], 1):
                z += part[pairs[at + 2 * i] if 2 * i + 1 < w else x[at + 2 * i]]
            most = z if most is None else np.maximum(most, z, out=most)
        pooled.append(most)
    h = np.maximum(np.concatenate(pooled, axis=1) + tables["b"], 0)
    return softmax(h @ tables["v"] + tables["c"])


def predict(tables: dict, texts) -> tuple[list[str], list[float]]:
    """Language and score of each text, from all its windows."""
    names, scores, held, counts = [UNDETERMINED] * len(texts), [0.0] * len(texts), [], 0
    spans: list[tuple[int, int, int]] = []
    sums: dict[int, np.ndarray] = {}

    def flush():
        nonlocal held, spans, counts
        if not held:
            return
        windows = np.concatenate(held)
        q = np.concatenate([probabilities(tables, windows[i : i + BATCH]) for i in range(0, len(windows), BATCH)])
        at = 0
        for k, n, size in spans:
            weights = np.full(n, LENGTH, np.float64)
            weights[-1] = size - LENGTH * (n - 1)
            sums[k] = weights @ q[at : at + n] / size
            at += n
        held, spans, counts = [], [], 0

    for k, text in enumerate(texts):
        if text and tables["classes"] and _letter(text):
            data = text.encode("utf-8")
            windows = cut(data)
            held.append(windows)
            spans.append((k, len(windows), len(data)))
            counts += len(windows)
            if counts >= BATCH:
                flush()
    flush()
    for k, q in sums.items():
        best = int(q.argmax())
        names[k], scores[k] = tables["classes"][best], min(1.0, float(q[best]))
    return names, scores


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Tables of a network that has learned from rows with a language whose id doesn't have the
    remainder 1 modulo 3."""
    known = docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "lang").filter("lang is not null and doc_id is not null").filter(remainder(3) != 1)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # the classes, which the network has to hold
    if not sizes:
        return {"classes": []}
    rates = local_table(docs.sparkSession, {"lang": list(sizes), "rate": [int(min(1.0, sample_docs / n) * (1 << 30)) for n in sizes.values()]}, "lang string, rate long")
    drawn = known.filter("text is not null").join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < F.col("rate"))
    starts = [F.substring(F.col("text"), (1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), F.length("text") - LENGTH // 2))).cast("int"), F.lit(LENGTH)) for k in range(SAMPLE_WINDOWS)]
    found = drawn.select("doc_id", "lang", F.array(*starts).alias("parts")).toPandas().sort_values(["doc_id", "lang"])
    classes = sorted(sizes)
    x, y = [], []
    for lang, parts in zip(found["lang"], found["parts"]):
        for part in parts:
            if part and _letter(part):
                x.append(cut(part.encode("utf-8")[:LENGTH])[0])
                y.append(classes.index(lang))
    network = Network(classes)
    if x:
        network.train(np.stack(x), np.array(y))
    return network.tables()


def identifier(spark, tables: dict):
    """A column function: text -> struct of lang_pred and score."""
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf("lang_pred string, score double")
    def language(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, scores = predict(shared.value, texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return language


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (remainder 1), lang_pred, score for every document."""
    language = identifier(docs.sparkSession, fit(in_small_batches(docs)))
    found = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").select("doc_id", (remainder(3) == 1).alias("held_out"), language("text").alias("found"))
    return found.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "found.lang_pred", "found.score")


def least_score(classes: int, certainty: float = CERTAINTY) -> float:
    """The score that a kept text has at least: the best of so many probabilities is never below chance."""
    return (1 + certainty * (classes - 1)) / classes


def keep_identified(docs: DataFrame, certainty: float = CERTAINTY) -> DataFrame:
    """The documents, with all their columns, that have a language found with enough ``certainty`` (0: any
    score, 1: none but 1); all where no language could be learned."""
    tables = fit(in_small_batches(docs))
    if not tables["classes"]:
        return docs
    found = identifier(docs.sparkSession, tables)(docs["text"])
    return docs.filter((found["lang_pred"] != UNDETERMINED) & (found["score"] >= least_score(len(tables["classes"]), certainty)))
