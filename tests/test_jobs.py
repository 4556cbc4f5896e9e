"""Job states, cancellation and the import stream."""

import threading

import pytest

from tessera.config import JobConflict
from tessera.plans.jobs import JobManager
from tessera.streaming import import_stream


def test_job_states(spark):
    manager, gate, undone = JobManager(spark), threading.Event(), []
    job, thread = manager.start("w", "compare", lambda j: (gate.wait(20), j.tell("end", 1.0)), lambda: undone.append(1))
    with pytest.raises(JobConflict):
        manager.start("w", "compare", lambda j: None)
    manager.cancel(job.job_id)
    gate.set()
    thread.join(30)
    assert job.status == "cancelled" and undone == [1]
    job, thread = manager.start("w", "compare", lambda j: j.tell("work", 0.5))
    thread.join(30)
    assert job.status == "completed" and ("work", 0.5) in job.progress
    job, thread = manager.start("w", "import", lambda j: 1 / 0)
    thread.join(30)
    assert job.status == "failed" and "ZeroDivisionError" in job.error


def test_import_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a line that is long enough\nand one more line of it")
    (tmp_path / "in" / "b.exe").write_text("x")
    for _ in range(2):
        import_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert sorted(r["status"] for r in spark.read.parquet(f"{tmp_path}/out/documents").collect()) == ["failed", "parsed"]
    assert spark.read.parquet(f"{tmp_path}/out/chunks").filter("chunk_level = 'paragraph'").count() == 2
