import re
from pathlib import Path

import pyarrow as pa

from newsloom.llm import mixing as M
from newsloom.llm.common import mapped


def test_a_worker_gives_its_memory_back_after_a_task(spark):
    def memory(batches):
        """Private memory of the worker, in MB."""
        for _ in batches:
            pass
        held = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))
        yield pa.RecordBatch.from_pydict({"mb": [held // 1024]})

    def greedy(batches):
        """Takes 240 MB and leaves a hundredth of them behind, which hold on to their places."""
        import numpy

        for _ in batches:
            pass
        blocks = [bytes([k % 256]) * 60_000 for k in range(4000)]
        numpy.left_behind = blocks[::100]
        yield pa.RecordBatch.from_pydict({"n": [len(blocks)]})

    one = spark.range(10).coalesce(1)
    before = mapped(one, memory, "mb long").collect()[0]["mb"]
    assert mapped(one, greedy, "n long").collect()[0]["n"] == 4000
    assert mapped(one, memory, "mb long").collect()[0]["mb"] < before + 100


def test_the_recipe_needs_no_python_worker(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('w ', int(id % 40)) AS text", "concat('s', id % 3) AS source")
    plan = M.mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
