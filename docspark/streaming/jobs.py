"""Background jobs: first in, first out, one at a time, with their state."""

from __future__ import annotations

import inspect
import itertools
import queue
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

STATES = ("queued", "running", "succeeded", "failed", "cancelled")


@dataclass
class Job:
    id: int
    kind: str
    state: str = "queued"
    result: object = None
    error: str = ""
    progress: object = None
    done: threading.Event = field(default_factory=threading.Event)


    def report(self, progress: object) -> None:
        self.progress = progress

    def cancelled(self) -> bool:
        return self.state == "cancelled"


class JobQueue:
    """Jobs run under a Spark tag of their own, by which they are cancelled. Work that takes an argument gets its job, to
    report progress to and to ask whether it is cancelled."""

    def __init__(self, spark: SparkSession, keep: int = 20):
        self.spark, self.keep = spark, keep
        self._ids, self._queue, self._jobs = itertools.count(1), queue.Queue(), {}
        threading.Thread(target=self._work, daemon=True).start()

    def submit(self, kind: str, work: Callable[..., object]) -> Job:
        job = Job(next(self._ids), kind)
        self._jobs[job.id] = job
        self._queue.put((job, work))
        return job

    def get(self, job_id: int) -> Job | None:
        return self._jobs.get(job_id)

    def newest(self) -> list[Job]:
        return sorted(self._jobs.values(), key=lambda j: -j.id)[: self.keep]

    def cancel(self, job_id: int) -> None:
        job = self._jobs[job_id]
        if job.state == "queued":
            job.state = "cancelled"
            job.done.set()
        elif job.state == "running":
            job.state = "cancelled"
            self.spark.interruptTag(f"job-{job_id}")

    def wait(self, job_id: int, seconds: float | None = None) -> Job:
        self._jobs[job_id].done.wait(seconds)
        return self._jobs[job_id]

    def _work(self) -> None:
        while True:
            job, work = self._queue.get()
            if job.state == "cancelled":
                continue
            job.state = "running"
            self.spark.addTag(f"job-{job.id}")
            try:
                job.result = work(job) if inspect.signature(work).parameters else work()
                job.state = "succeeded" if job.state == "running" else job.state
            except Exception as e:
                job.error = str(e)
                job.state = "failed" if job.state == "running" else job.state
            finally:
                self.spark.removeTag(f"job-{job.id}")
                job.done.set()
