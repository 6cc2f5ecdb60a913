"""What stays in the executors' Python processes between stages."""

import builtins
import os
import re
from pathlib import Path

import pyarrow as pa
import pytest

from lumbra.llm import common, mixing


def own_mb(pid: int) -> float:
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_an_idle_worker_gives_its_memory_back(spark):
    schema = pa.schema([("pid", pa.int64())])

    def fill(part: pa.RecordBatch) -> pa.RecordBatch:
        held = [bytes(100_000) for _ in range(3000)]
        builtins._on_top = bytes(100_000)  # freed memory below this stays with the allocator
        del held
        return common.record(schema, [os.getpid()] * part.num_rows)

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1)
    (row,) = common.map_texts(docs, fill, "pid long").collect()
    assert own_mb(row.pid) < 200


def test_small_tables_start_no_other_python_workers(spark):
    """createDataFrame from rows is a scan of an RDD that goes through Python on the executors."""
    rows = common.written(spark.range(3000).selectExpr("if(id < 2500, 0, id) as k", "id"), "rows")
    table = common.written(rows.select("k").distinct().selectExpr("k", "k * 2 as v"), "table")
    joined = common.join_unique(rows, table, ["k"])
    ranked = mixing.ranked(table, "k")
    for df in (joined, ranked):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    assert joined.count() == 3000 and joined.filter("v <> 2 * k").isEmpty()
    assert [r[0] for r in ranked.orderBy("k").select("__rank").collect()] == list(range(501))
    assert mixing.ranked(table.limit(0), "k").count() == 0
