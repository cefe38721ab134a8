"""One export at a time, with status and cancellation by Spark job tag."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Busy(RuntimeError):
    pass


class ExportJobs:
    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._jobs = spark, threading.Lock(), {}

    def start(self, export: Callable[[], None]) -> str:
        """Run export in a thread; Busy while another runs."""
        with self._lock:
            if any(j["status"] == "running" for j in self._jobs.values()):
                raise Busy("an export is running")
            job = uuid.uuid4().hex
            self._jobs[job] = {"status": "running", "started": time.time(), "ended": None, "error": None}

        def run():
            self.spark.sparkContext.addJobTag(job)
            try:
                export()
                outcome, error = "completed", None
            except Exception as e:  # noqa: BLE001  the job's state carries it
                outcome, error = "failed", str(e)[:500]
            finally:
                self.spark.sparkContext.removeJobTag(job)
            with self._lock:
                state = self._jobs[job]
                state.update(ended=time.time(), error=error, status="cancelled" if state["status"] == "cancelling" else outcome)

        self._jobs[job]["thread"] = threading.Thread(target=run, daemon=True)
        self._jobs[job]["thread"].start()
        return job

    def status(self, job: str) -> dict:
        return {k: v for k, v in self._jobs[job].items() if k != "thread"}

    def cancel(self, job: str) -> None:
        """Interrupt the export until it ends: what it starts later, after an interrupt that met nothing, is interrupted too."""
        with self._lock:
            if self._jobs[job]["status"] != "running":
                return
            self._jobs[job]["status"] = "cancelling"

        def interrupt():
            while self._jobs[job]["thread"].is_alive():
                self.spark.sparkContext.cancelJobsWithTag(job)
                self._jobs[job]["thread"].join(0.2)

        threading.Thread(target=interrupt, daemon=True).start()

    def wait(self, job: str) -> dict:
        self._jobs[job]["thread"].join()
        return self.status(job)
