"""Job control (M2, M3): states, one active job per workspace and type, cancellation, throttled progress."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tessera.config import JobCancelled, JobConflict

ACTIVE, FINISHED = ("pending", "running", "cancelling"), ("completed", "failed", "cancelled")
MIN_SECONDS, MIN_STEP = 0.1, 0.01


@dataclass
class Job:
    """One run. ``progress`` keeps the updates that were told: a stage change, one percent, or a tenth of a second."""

    workspace: str
    kind: str
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "pending"
    error: str | None = None
    progress: list[tuple[str, float]] = field(default_factory=list)
    _told: float = 0.0

    def tell(self, stage: str, share: float) -> None:
        if self.status == "cancelling":
            raise JobCancelled(self.job_id)
        now = time.monotonic()
        last = self.progress[-1] if self.progress else ("", -1.0)
        if stage != last[0] or share - last[1] >= MIN_STEP or now - self._told >= MIN_SECONDS:
            self.progress.append((stage, share))
            self._told = now


class JobManager:
    """Runs functions as jobs in threads; a job's Spark work carries its id as a tag, so it can be cancelled alone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs, self._lock = spark, {}, threading.Lock()

    def start(self, workspace: str, kind: str, work: Callable[[Job], None], undo: Callable[[], None] = lambda: None) -> tuple[Job, threading.Thread]:
        with self._lock:
            if any(j.workspace == workspace and j.kind == kind and j.status in ACTIVE for j in self.jobs.values()):
                raise JobConflict(f"a {kind} job of {workspace} is active")
            job = Job(workspace, kind)
            self.jobs[job.job_id] = job
        thread = threading.Thread(target=self._run, args=(job, work, undo), daemon=True)
        thread.start()
        return job, thread

    def _run(self, job: Job, work: Callable[[Job], None], undo: Callable[[], None]) -> None:
        self.spark.sparkContext.addJobTag(job.job_id)
        try:
            with self._lock:
                if job.status == "pending":
                    job.status = "running"
            job.tell("start", 0.0)
            work(job)
            with self._lock:
                job.status = "cancelled" if job.status == "cancelling" else "completed"
        except Exception as e:  # noqa: BLE001  whatever stops a job is its failure
            with self._lock:
                job.status = "cancelled" if job.status == "cancelling" else "failed"
            job.error = f"{type(e).__name__}: {e}"
        finally:
            self.spark.sparkContext.removeJobTag(job.job_id)
            if job.status != "completed":
                undo()

    def cancel(self, job_id: str) -> None:
        with self._lock:
            job = self.jobs[job_id]
            if job.status not in ACTIVE:
                return
            job.status = "cancelling"
        self.spark.sparkContext.cancelJobsWithTag(job_id)
