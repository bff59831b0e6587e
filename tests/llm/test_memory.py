"""Memory of the Python functions of the pipeline's operators."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marquetry.llm import jaccard, repeats


def test_workers_give_memory_back(spark, monkeypatch, tmp_path):
    def own(batches):
        for _ in batches:  # pages of a worker's own, in MB
            yield pd.DataFrame({"mb": [int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10]})

    monkeypatch.setitem(spark.sparkContext.environment, "MARQUETRY_WORKERS", "fresh")  # other variables, other workers
    probe = spark.range(0, 64, 1, 8).mapInPandas(own, "mb long")
    before = probe.agg(F.max("mb")).first()[0]
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 4000, dtype=np.uint8)).decode() for _ in range(4000)]
    spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts})).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).coalesce(1)
    assert repeats.suffix_dedup(docs).agg(F.sum("n_removed")).first()[0] == 0
    assert jaccard.jaccard_join(docs).agg(F.sum("n_links")).first()[0] == 0
    kept = probe.agg(F.max("mb")).first()[0] - before
    assert kept < 64, kept


def test_rows_are_cut_without_an_index_of_all():
    text = np.random.default_rng(4).integers(0, 256, 1 << 20, dtype=np.uint8)
    left = np.arange(0, (1 << 20) - 84, 8)
    size = 50 + left % 35
    tracemalloc.start()
    rows = repeats._rows_at(text, left, size, 84)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * rows.nbytes, peak
    for k in range(0, len(left), 997):
        assert rows[k].tobytes() == text[left[k] : left[k] + size[k]].tobytes().ljust(84, b"\0")
