import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from likeness.llm import language as L, toxicity as T
from likeness.llm.common import table
from likeness.sources.scratch import Scratch
from tests.llm.fixtures import odd_docs


@pytest.fixture(scope="module")
def larger(sf_dir):
    return sf_dir.replace("0.001", "0.1")


def test_language_of_held_out_rows(spark, larger):
    docs = table(spark, larger, "documents")
    got = L.identify(docs).toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    held = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id").query("held_out")
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_odd_texts_have_a_language_or_none(spark):
    docs = odd_docs(spark)
    got = L.identify(docs.withColumnRenamed("n_chars", "score")).toPandas()
    texts = docs.toPandas().text
    assert len(got) == len(texts)
    for text, r in zip(texts, got.itertuples()):
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    none = L.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).toPandas()
    assert set(none.lang_pred) == {"und"}
    assert L.identify(docs.limit(0)).count() == 0
    assert L.keep_identified(docs).columns == docs.columns


def test_look_ups_equal_the_network():
    network = L.Network(["a", "b", "c"])
    windows = np.concatenate([L.cut(b"some text " * 60), L.cut(b"x")])
    direct = network._forward(windows)[2]
    assert np.allclose(L.probabilities(network.tables(), windows), direct, atol=1e-5)


def _plain_probabilities(p, text):
    """A whole text through the network, byte by byte in plain Python: convolution, maximum, softmax; windows by their bytes."""
    data, sums, classes = text.encode(), 0, len(p["c"])
    for begin in range(0, len(data), L.LENGTH):
        window = data[begin : begin + L.LENGTH]
        codes, pooled = list(window) + [0] * (L.LENGTH - len(window)), []
        for w in L.WIDTHS:
            for f in range(L.FILTERS):
                at = [sum(float(p["e"][codes[i + k]][d]) * float(p[f"w{w}"][k * L.EMBEDDING + d][f]) for k in range(w) for d in range(L.EMBEDDING)) for i in range(L.LENGTH - w + 1)]
                pooled.append(max(0.0, max(at) + float(p[f"b{w}"][f])))
        z = [sum(h * float(p["v"][j][c]) for j, h in enumerate(pooled)) + float(p["c"][c]) for c in range(classes)]
        q = np.exp(np.array(z) - max(z))
        sums = sums + q / q.sum() * len(window)
    return sums / len(data)


def test_predictions_equal_a_plain_forward_pass():
    network = L.Network(["a", "b", "c"], seed=3)
    network.p["c"] += np.array([0.1, -0.2, 0.3], np.float32)
    texts = ["Ein Satz, der länger als ein Fenster ist: " + "wörter und noch mehr " * 8, "kurz", "naïve 日本"]
    names, scores = L.predict(network.tables(), texts)
    for text, name, score in zip(texts, names, scores):
        want = _plain_probabilities(network.p, text)
        assert name == "abc"[int(want.argmax())] and score == pytest.approx(want.max(), abs=1e-4)


def test_every_language_is_a_class_and_the_least_score_follows_their_number(spark):
    rows = [(i, f"text number {i}", f"l{i % 1100:04d}") for i in range(2200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit(docs, 1)["classes"] == sorted({lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1})
    assert [round(L.least_score(k), 3) for k in (1, 2, 4, 1000)] == [1.0, 0.6, 0.4, 0.201] and L.least_score(5, 0) == 0.2


def test_gradients():
    network = L.Network(["a", "b"])
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x, y = L.cut(b"a short text to look at, twice and again" * 8)[:3], np.array([0, 1, 1])
    loss = lambda: -np.log(network._forward(x)[2][np.arange(3), y]).mean()
    gradients = network._gradients(x, y)
    for name, at in (("v", (3, 1)), ("w3", (5, 2)), ("b2", (1,)), ("e", (ord("t"), 4))):
        before = network.p[name][at]
        network.p[name][at] = before + 1e-5
        up = loss()
        network.p[name][at] = before - 1e-5
        down = loss()
        network.p[name][at] = before
        assert gradients[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def _planted(spark, n=1500):
    r = np.random.default_rng(4)
    words = ["tree", "house", "river", "cloud", "stone", "light", "water", "green"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = list(r.choice(words, int(r.integers(5, 60)))), int(i % 7 == 0)
        for _ in range(toxic * (1 + len(text) // 20)):
            text[int(r.integers(len(text)))] = "grub" + str(r.choice(["ling", "ish", "os", "ette", "ard"]))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_rows(spark):
    docs, labels = _planted(spark)
    got = T.score_documents(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.98 and (got.predicted == (got.score >= 0.5)).all()


def test_held_out_labels_teach_nothing(spark):
    docs, labels = _planted(spark, 400)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) toxic")
    a, b = (T.score_documents(docs, own).toPandas().set_index("doc_id").score for own in (labels, flipped))
    pd.testing.assert_series_equal(a.sort_index(), b.sort_index())


def test_odd_texts_are_scored(spark):
    docs, labels = _planted(spark, 400)
    odd = odd_docs(spark)
    more = labels.unionByName(spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int"))
    got = T.score_documents(docs.unionByName(odd.select("doc_id", "text")), more).toPandas()
    assert len(got) == docs.count() + odd.count() and got.score.between(0, 1).all() and got.held_out.notna().all()
    assert set(T.score_documents(odd, labels.limit(0)).toPandas().score) == {0.0}
    assert T.score_documents(odd.limit(0), labels).count() == 0
    assert T.keep_ordinary(odd, labels.limit(0)).columns == odd.columns


def test_probabilities_of_a_context_sum_to_one(spark):
    words = spark.createDataFrame([("abc", 3, 5), ("abd", 0, 4), ("ab", 9, 1), ("zz", 1, 1)], "word string, toxic_n long, plain_n long")
    top = words.selectExpr("explode(transform(sequence(1, length(word) + 1), i -> substring(concat('^^', word, '$'), i, 3))) gram", "toxic_n t").groupBy("gram").sum("t")
    shared = T.shared_distribution(top, 3, 0.75).toPandas()
    letters = len(set("".join(shared.gram.str[-1])))
    seen = shared.groupby(shared.gram.str[0]).p.sum()
    assert (seen < 1).all() and (seen > 0.3).all() and letters >= 4


class _PlainKneserNey:
    """The class-conditional models by dictionaries, straight from their definition."""

    def __init__(self, counts, order=5, d=0.75, own=2.0):
        self.order, self.d, self.own, self.top = order, d, own, {}
        for word, toxic, plain in counts:
            for gram in self.grams(word):
                t, o = self.top.get(gram, (0, 0))
                self.top[gram] = t + toxic, o + plain
        self.follow, kept = {}, set(self.top)
        for k in range(order - 1, 0, -1):  # distinct left neighbours of each shorter gram
            shorter = [g[1:] for g in kept]
            self.follow[k] = {g: shorter.count(g) for g in set(shorter)}
            kept = set(shorter)

    def grams(self, word):
        padded = "\x02" * (self.order - 1) + word + "\x03"
        return [padded[i : i + self.order] for i in range(len(word) + 1)]

    def shared(self, gram):
        """Interpolated Kneser-Ney over continuation counts."""
        same = {g: n for g, n in self.follow[len(gram)].items() if g[:-1] == gram[:-1]}
        total, kinds = sum(same.values()), len(same)
        below = self.shared(gram[1:]) if len(gram) > 1 else 1 / (kinds + 1)
        return (same[gram] - self.d + self.d * kinds * below) / total

    def ratio(self, gram):
        same = {g: n for g, n in self.top.items() if g[:-1] == gram[:-1]}
        if not same:
            return 0.0
        sums = [sum(n[c] for n in same.values()) for c in (0, 1)]
        left = [sum(min(n[c], self.own) for n in same.values()) / sums[c] if sums[c] else 1.0 for c in (0, 1)]
        if gram not in same:
            return np.log(left[0] / left[1])
        both = (sum(same[gram]) - self.d + self.d * len(same) * self.shared(gram[1:])) / sum(sums)
        p = [(max(same[gram][c] - self.own, 0) / sums[c] if sums[c] else 0.0) + left[c] * both for c in (0, 1)]
        return np.log(p[0] / p[1])

    def word(self, word):
        return sum(map(self.ratio, self.grams(word)))


def test_word_ratios_equal_plain_kneser_ney(spark):
    r = np.random.default_rng(3)
    words = sorted({"".join(r.choice(list("abcd"), int(r.integers(1, 8)))) for _ in range(120)})
    counts = [(w, int(r.integers(0, 9)), int(r.integers(0, 9)) + 1) for w in words]
    plain = _PlainKneserNey(counts)
    table_ = T.WordTable(T.count_model(spark.createDataFrame(counts, "word string, toxic_n long, plain_n long"), Scratch(spark, "t")))
    asked = [*words, *("".join(r.choice(list("abcde"), int(r.integers(1, 10)))) for _ in range(200)), "日本"]
    assert np.allclose(table_.ratios(" ".join(asked)), [plain.word(w) for w in asked], atol=1e-4)


def test_scores_follow_from_plain_kneser_ney(spark):
    docs, labels = _planted(spark, 400)
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts, counts = dict(docs.collect()), {}
    for i, toxic in known.items():
        for w in texts[i].split():
            counts.setdefault(w, [0, 0])[1 - toxic] += 1
    plain, weights = _PlainKneserNey([(w, *n) for w, n in counts.items()]), T.fit(docs, labels).weights
    ratio = {w: plain.word(w) for w in {w for t in texts.values() for w in t.split()}}
    got = {r.doc_id: r.score for r in T.score_documents(docs, labels).collect()}
    for i, text in texts.items():
        x = [ratio[w] for w in text.split()]
        windows = [max(sum(x[j : j + n]) / n for j in range(len(x) - n + 1)) for n in (min(w, len(x)) for w in T.WINDOWS)]
        excess = sum(max(v - T.EXCESS, 0) for v in x)
        features = [1, sum(x) / len(x), *windows, excess / len(x), np.log1p(excess), np.log1p(sum(v > T.SUSPECT for v in x)), np.log1p(len(x))]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.dot(weights, features))), abs=1e-3)


def test_look_up_of_missing_grams_falls_back(spark):
    words = spark.createDataFrame([("good", 1, 90), ("bad", 80, 1)], "word string, toxic_n long, plain_n long")
    model = T.count_model(words, Scratch(spark, "t"))
    ratios = T.WordTable(model).ratios("bad good 日本 bads goods")
    assert ratios[0] > 2 and ratios[1] < -0.5 and abs(ratios[2]) < abs(ratios[0])


def test_large_models_are_joined_alike(spark, monkeypatch):
    docs, labels = _planted(spark, 400)
    docs = docs.unionByName(odd_docs(spark).select("doc_id", "text"))
    want = T.score_documents(docs, labels).toPandas()
    for name, value in (("MODEL_GRAMS", 20), ("BLOCK_CHARS", 20_000)):
        monkeypatch.setattr(T, name, value)
    got = T.score_documents(docs, labels).toPandas()
    order = ["doc_id", "score"]
    got, want = (x.sort_values(order, ignore_index=True) for x in (got, want))
    assert len(got) == len(want) and (got.doc_id.fillna(-9) == want.doc_id.fillna(-9)).all()
    assert np.allclose(got.score, want.score, atol=1e-6) and want.predicted.sum() > 50
    assert T.keep_ordinary(docs, labels).count() == (want.score < 0.5).sum()
    clashing = docs.select("*", *[F.lit(name).alias(name) for name in ("_row", "_toxicity", "__row", "x")])
    kept = T.keep_ordinary(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == (want.score < 0.5).sum()
    assert {(r["_row"], r["_toxicity"], r["__row"], r.x) for r in kept.collect()} == {("_row", "_toxicity", "__row", "x")}


def test_rare_class_evidence_outlives_the_broadcast_bound(spark, monkeypatch):
    words = [("ordinary" + chr(97 + i) + chr(98 + i), 0, 1000) for i in range(20)] + [("grubling", 3, 0)]
    words = spark.createDataFrame(words, "word string, toxic_n long, plain_n long")
    full = T.count_model(words, Scratch(spark, "t"))
    large = T.count_model(words, Scratch(spark, "t"), most=10)
    assert large.table is not None and T.Model.of(large.table.toPandas()).grams.tolist() == full.grams.tolist()
    assert T.WordTable(full).ratios("grubling")[0] > 1


def test_a_class_missing_from_the_curve_rows_doesnt_switch_off(spark):
    docs, labels = _planted(spark)
    some = labels.filter("not (toxic = 1 and crc32(cast(doc_id as string)) % 5 = 4)")
    got = T.score_documents(docs, some).toPandas().merge(labels.toPandas(), on="doc_id").query("held_out")
    assert (got.predicted == got.toxic).mean() > 0.9 and got.predicted[got.toxic == 1].mean() > 0.9
    assert T.score_documents(docs.selectExpr("doc_id", "'12 34' text"), some).toPandas().predicted.sum() == 0


def test_curve_rows_are_drawn_by_class(spark):
    docs, labels = _planted(spark)
    kept = [i for i in range(0, 1500, 7) if zlib.crc32(str(i).encode()) % 5 == 4][:3]
    rare = labels.filter(f"not (toxic = 1 and crc32(cast(doc_id as string)) % 5 = 4) or doc_id in {tuple(kept)}")
    model = T.fit(docs, rare, calibration_rows=20)
    assert model is not None and not np.array_equal(model.weights, T.SIGN)
    assert T.class_rates({0: 1_000_000, 1: 100}, 20_000) == {0: 0.0199, 1: 1.0}
    assert T.class_rates({0: 40_000, 1: 20_000}, 20_000) == {0: 0.25, 1: 0.5}


def test_weights_stand_for_rows():
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3))
    y = (x[:, 0] + r.normal(size=60) > 0).astype(float)
    n = np.where(y == 1, 1, 3)
    assert np.allclose(T.fit_curve(x, y, n.astype(float)), T.fit_curve(np.repeat(x, n, 0), np.repeat(y, n), np.ones(n.sum())), atol=1e-5)


def test_rows_of_the_curve_are_counted_too(spark):
    docs, labels = _planted(spark)
    fourth = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 4][:30]
    more = docs.withColumn("text", F.when(F.col("doc_id").isin(fourth), F.concat("text", F.lit(" zxqvzxqv zxqvzxqv"))).otherwise(F.col("text")))
    own = labels.withColumn("toxic", F.when(F.col("doc_id").isin(fourth), 1).otherwise(F.col("toxic")))
    assert T.WordTable(T.fit(more, own)).ratios("zxqvzxqv")[0] > T.WordTable(T.fit(docs, labels)).ratios("zxqvzxqv")[0] + 1


def test_nothing_is_dropped_where_no_language_is_known(spark):
    docs = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert L.keep_identified(docs).count() == docs.count()
