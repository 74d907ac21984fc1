"""What tasks hold in Python, beside the rows they return."""

import re
from pathlib import Path

import pandas as pd
import pytest

from envspark.llm.common import TEXTS, lean, modest_batches
from envspark.llm.packing import PIECES, pack

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def held_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_packing_hands_few_rows_at_a_time_to_python(spark):
    """Pieces as long as the batch they were made of; one batch of 2,500 rows before."""

    def batch_sizes(batches):
        for k, pdf in enumerate(batches):
            yield pd.DataFrame({"doc_id": [k], "piece": 0, "start": 0, "length": len(pdf), "ids_crc32": 0})

    before = spark.conf.get(KEY)
    rows = pack(spark.range(0, 2500, 1, 1).mapInPandas(batch_sizes, PIECES), 10_000).collect()
    assert sum(r["length"] for r in rows) == 2500 and max(r["length"] for r in rows) <= TEXTS
    assert spark.conf.get(KEY) == before


def test_modest_batches_keep_smaller_ones_and_end_with_an_error(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "7")
    try:
        with pytest.raises(KeyError), modest_batches(spark):
            assert spark.conf.get(KEY) == "7"
            raise KeyError
        assert spark.conf.get(KEY) == "7"
    finally:
        spark.conf.set(KEY, before)


def test_a_task_gives_back_what_it_freed():
    """Freed memory below a block still in use stays with the process otherwise: some 200 MB here."""
    kept = []

    def work(batches):
        for n in batches:
            blocks = [bytes(2000) for _ in range(n)]
            kept.append(blocks[-1])
            yield len(blocks)

    start = held_mb()
    assert list(lean(work)(iter([100_000]))) == [100_000]
    assert held_mb() - start < 100
