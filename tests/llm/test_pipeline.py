import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from likeness.llm.common import table
from likeness.sources.scratch import Scratch
from tests.llm.fixtures import odd_docs


def test_stages_keep_columns_and_shrink(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names, scratch = docs.columns, Scratch(spark, "t")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "MinHash near-dedup", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir))
        assert kept.columns == names and 0 < kept.count() <= docs.count()
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert sorted(corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()) == sorted(packed.select("doc_id", "piece", "ids_crc32").collect())


def test_stages_take_odd_rows_and_clashing_columns(spark):
    odd = odd_docs(spark)
    for n, name in enumerate(("score", "kept", "toxic", "part", "shingles", "length", "_row")):
        odd = odd.withColumn(name, F.lit(n))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    from likeness.llm import language, near_duplicates, packing, toxicity
    from likeness.llm.catalog import BYTE_BPE

    ordinary = toxicity.keep_ordinary(odd, labels.limit(0))
    assert ordinary.columns == odd.columns and ordinary.count() == odd.count()  # nothing is learned, nothing goes
    assert toxicity.keep_ordinary(odd, labels).columns == odd.columns
    named = Scratch(spark, "t").keep(language.keep_identified(odd))
    assert named.columns == odd.columns and all(any(c.isalpha() for c in r.text) for r in named.collect())
    single = near_duplicates.keep_one_of_each(odd)
    assert single.columns == odd.columns
    ids = [r.doc_id for r in single.collect()]
    assert ids.count(5) == 1 and ids.count(None) == 1 and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    packed = packing.pack_documents(odd, BYTE_BPE)
    assert packed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    for stage in (language.keep_identified, near_duplicates.keep_one_of_each, lambda d: toxicity.keep_ordinary(d, labels), lambda d: packing.pack_documents(d, BYTE_BPE)):
        assert stage(odd.limit(0)).count() == 0


def test_queries_are_registered():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_no_stage_sends_rows_through_a_second_set_of_python_processes(spark, sf_dir, monkeypatch):
    """Lists of rows become an RDD of pickles, whose workers stay on the executors beside those of Arrow."""
    from pyspark import SparkContext

    from likeness.llm import language
    from likeness.operators import joins

    def refused(*_, **__):
        raise AssertionError("rows as pickles")

    docs = table(spark, sf_dir, "documents")
    rows = Scratch(spark, "t").keep(spark.range(90).selectExpr("id % 3 k", "id v"))
    names = spark.range(3).selectExpr("id k", "cast(id as string) name")
    monkeypatch.setattr(SparkContext, "parallelize", refused)
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    assert sorted(language.fit(docs)["classes"]) == sorted(r.lang for r in docs.select("lang").distinct().collect() if r.lang is not None)
    assert joins.join_unique(rows, names, "k").groupBy("name").count().count() == 3
    local = joins.local_table(spark, {"lang": ["b", None], "rate": [1, 2]}, "lang string, rate long")
    assert [tuple(r) for r in local.collect()] == [("b", 1), (None, 2)] and joins.local_table(spark, {"k": []}, "k long").count() == 0
