import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridix.llm import common, quality


def test_quality_looks_at_little_text_at_once(spark):
    text = " ".join(f"word{i % 977} A{i % 31}b" for i in range(100))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 4000), pa.array([1] * 4000, pa.int32())], names=["text", "toxic"])
    assert batch.nbytes > 4 << 20
    tracemalloc.start()
    held = sum(b.num_rows for b in quality._counted(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held and peak < 45 << 20
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with common.small_batches(spark):
        seen = spark.range(1000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").agg(F.max("n")).first()[0]
    assert seen == common.BATCH_ROWS and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == had


def test_quality_starts_one_set_of_python_workers(spark, docs, monkeypatch):
    unseen = pd.DataFrame({"source": ["a", None], "lang": ["en", "en"], "bad_odds": [0.5, -1.0], "toxic_odds": [0.0, 1.0], "junk": [1.0, 0.0], "toxic": [0.0, 1.0]})
    rates = spark.createDataFrame([("a", "en", 0.3, 0.2), (None, "en", 0.1, 0.2)], "source string, lang string, site_rate double, global_rate double")
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a, **b: pytest.fail("rows go through a second set of workers"))
    assert len(quality._weights(unseen, rates)) == 2
