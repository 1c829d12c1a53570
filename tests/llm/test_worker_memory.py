"""What the pipeline's tasks hold besides the rows: no second set of Python workers, narrow symbols, no second copy of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark import SparkContext

from bizfit.llm import decontaminate as D
from bizfit.llm import language_id as L


def test_learning_starts_no_python_workers(spark, monkeypatch):
    rows = [(k, "the cat sat" if k % 2 else "le chat est", "en" if k % 2 else "fr") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = docs.filter("lang = 'xx'")

    def refused(*_, **__):
        raise AssertionError("rows of the driver go through an RDD")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    model = L.learn(docs)
    assert model.langs == ["en", "fr"] and model.predict(["a cat", "un chat", "1"])[0] == ["en", "fr", "und"]
    assert L.learn(none).langs == []


def test_a_slice_of_texts_takes_few_bytes_a_character():
    model = L.Model({"en": ["the cat sat on the mat and the dog ran"], "fr": ["le chat est sur le tapis et le chien court"]})
    texts = ["the dog sat on the cat " * 89] * 500  # a million characters, a lane each
    model.predict(texts[:2])
    tracemalloc.start()
    try:
        model.predict(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15 * sum(map(len, texts))
    assert model.symbols(L.letters("the cat")).dtype == np.int32


def test_clean_rows_leave_in_parts(spark, monkeypatch):
    leak = " ".join(f"item{k}" for k in range(20))
    texts = ["word " * 200_000, None, f"a b {leak} c d", "", "text " * 300_000, "other " * 100_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    runs = []
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    D.keep_clean(docs, bench)
    monkeypatch.undo()
    out = list(runs[0](iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(out).to_pylist() == [r for r in batch.to_pylist() if r["doc_id"] != 2]
    assert max(b.get_total_buffer_size() for b in out) < 3_000_000
