"""Long work in the background: one job at a time, with a short history."""

from __future__ import annotations

import itertools
import threading
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

HISTORY = 20
RUNNING, DONE, FAILED, CANCELLED = "running", "done", "failed", "cancelled"


@dataclass
class Job:
    id: int
    kind: str
    state: str = RUNNING
    result: Any = None
    error: str | None = None
    message: str = ""
    current: int = 0
    total: int = 0
    cancelled: threading.Event = field(default_factory=threading.Event, repr=False)

    def report(self, current: int, total: int, message: str = "") -> None:
        """Told by the work itself, where it knows its steps; else tasks are counted."""
        self.current, self.total, self.message = current, total, message or self.message or "steps"

    def as_dict(self) -> dict:
        return {"id": self.id, "kind": self.kind, "state": self.state, "message": self.message, "current": self.current, "total": self.total, "result": self.result, "error": self.error}


class JobRunner:
    """Runs one job at a time in a Spark job group, so that cancelling stops its stages."""

    def __init__(self, spark):
        self.spark = spark
        self._lock, self._numbers = threading.Lock(), itertools.count(1)
        self.history: deque[Job] = deque(maxlen=HISTORY)
        self._thread: threading.Thread | None = None

    def submit(self, kind: str, work: Callable[[Job], Any]) -> Job:
        """Start a job; raises while another runs. Results appear only if it isn't cancelled."""
        with self._lock:
            if self._thread is not None and self._thread.is_alive():
                raise RuntimeError("another job is running")
            job = Job(next(self._numbers), kind)
            self.history.append(job)
            self._thread = threading.Thread(target=self._run, args=(job, work), daemon=True)
            self._thread.start()
            return job

    def _run(self, job: Job, work: Callable[[Job], Any]) -> None:
        self.spark.sparkContext.setJobGroup(self._group(job), job.kind, interruptOnCancel=True)
        try:
            result = work(job)
            self.poll(job)
            job.current = job.total if not job.cancelled.is_set() else job.current
            job.state, job.result = (CANCELLED, None) if job.cancelled.is_set() else (DONE, result)
        except Exception as e:  # a job reports its failure and never ends the program
            job.state, job.error = (CANCELLED, None) if job.cancelled.is_set() else (FAILED, str(e))

    def poll(self, job: Job) -> Job:
        """The job with its tasks that are done and in all, so far as Spark has planned them, unless the work
        reports its own steps. Neither number ever falls."""
        if job.state == RUNNING and job.message in ("", "tasks"):
            tracker, done, of = self.spark.sparkContext.statusTracker(), 0, 0
            for number in tracker.getJobIdsForGroup(self._group(job)):
                found = tracker.getJobInfo(number)
                for stage in map(tracker.getStageInfo, found.stageIds if found else ()):
                    if stage is not None:
                        done, of = done + stage.numCompletedTasks, of + stage.numTasks
            if of:
                job.current, job.total, job.message = max(job.current, done), max(job.total, of), "tasks"
        return job

    @staticmethod
    def _group(job: Job) -> str:
        return f"likeness-job-{job.id}"

    def get(self, job_id: int) -> Job | None:
        return next((j for j in self.history if j.id == job_id), None)

    def cancel(self, job_id: int) -> bool:
        job = self.get(job_id)
        if job is None or job.state != RUNNING:
            return False
        job.cancelled.set()
        self.spark.sparkContext.cancelJobGroup(self._group(job))
        return True

    def wait(self) -> None:
        if self._thread is not None:
            self._thread.join()
