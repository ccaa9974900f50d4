"""A worker over a stream of jobs: stages one after another, retries after a delay, dead letters, expiry.

Jobs' states are kept by ``transformWithStateInPandas``, those of a bucket of jobs as one value, as each call of the state
store costs as much as some hundred jobs. A job's document passes the stages in order; a stage that fails is tried again
after a delay, by a timer, until it has failed too often; a job that has not ended in time expires. Time is event time:
timers fire as the watermark passes them, so a replay of the same events gives the same states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The stages of a document, in order.
STAGES = ("quick_parse", "deep_parse", "index")
STATES = "job_id string, stage string, status string, failures int, calls int, at timestamp, error string"
#: What runs a stage: from (job_id, stage, call number) to nothing; an exception is a failure.
Work = Callable[[str, str, int], None]

#: A bucket's jobs as arrays, and the time of its one timer (0: none). ``stage`` is ENDED once nothing more will be done;
#: the state then stays until the job would have expired.
_STATE = "job_id array<string>, stage array<int>, failures array<int>, calls array<int>, since array<long>, due array<long>, wake long"
ENDED = -1
#: Buckets of jobs. One task holds the unexpired jobs of one bucket at a time, so more jobs ask for more of them.
BUCKETS = 1024


class Worker(StatefulProcessor):
    """The state machine of a bucket's jobs: each one's stage, that stage's failures, calls so far, when it came, when it is
    tried again."""

    def __init__(self, work: Work, retry_ms: int, most_failures: int, expire_ms: int):
        self.work, self.retry_ms, self.most, self.expire_ms = work, retry_ms, most_failures, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _STATE)

    def _load(self) -> tuple[dict[str, tuple], int]:
        """The bucket's jobs as (stage, failures, calls, since, due), and when its timer is set."""
        held = self.bucket.get()
        return (dict(zip(held[0], zip(*held[1:6], strict=True), strict=True)), held[6]) if held else ({}, 0)

    def _store(self, jobs: dict[str, tuple], wake: int) -> None:
        """Keeps the jobs, and one timer at the first time at which one of them is tried again or expires."""
        expires = lambda job: job[3] + self.expire_ms
        first = min((job[4] if job[0] != ENDED and 0 < job[4] < expires(job) else expires(job) for job in jobs.values()), default=0)
        if wake and wake != first:
            self.handle.deleteTimer(wake)
        if first and wake != first:
            self.handle.registerTimer(first)
        if jobs:
            self.bucket.update((list(jobs), *map(list, zip(*jobs.values(), strict=True)), first))
        else:
            self.bucket.clear()

    @staticmethod
    def _row(key: str, stage: int, status: str, failures: int, calls: int, at: int, error: str = "") -> dict[str, Any]:
        return {"job_id": key, "stage": STAGES[stage], "status": status, "failures": failures, "calls": calls, "at": pd.Timestamp(at, unit="ms"), "error": error}

    def _run(self, key: str, job: tuple, now: int) -> tuple[tuple, list[dict[str, Any]]]:
        """The job after its stages from the present one on, until one fails or all are done; and the rows that tell."""
        stage, failures, calls, since, _ = job
        out: list[dict[str, Any]] = []
        while stage < len(STAGES):
            calls += 1
            try:
                self.work(key, STAGES[stage], calls)
            except Exception as failed:
                failures += 1
                dead = failures >= self.most
                out.append(self._row(key, stage, "dead_letter" if dead else "retrying", failures, calls, now, str(failed)[:500]))
                return (ENDED if dead else stage, failures, calls, since, 0 if dead else now + self.retry_ms), out
            out.append(self._row(key, stage, "completed" if stage == len(STAGES) - 1 else "running", failures, calls, now))
            stage, failures = stage + 1, 0
        return (ENDED, 0, calls, since, 0), out

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came: dict[str, int] = {}
        for batch in rows:
            for job_id, ts in zip(batch["job_id"], batch["ts"], strict=True):
                at = int(ts.value // 1_000_000)
                came[job_id] = min(came.get(job_id, at), at)
        jobs, wake = self._load()
        new = {job_id: at for job_id, at in came.items() if job_id not in jobs}  # asked for once more: nothing is run twice
        out: list[dict[str, Any]] = []
        for job_id, at in new.items():
            jobs[job_id], more = self._run(str(job_id), (0, 0, 0, at, 0), at)
            out += more
        if new:
            self._store(jobs, wake)
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # All that fell due before the watermark is done at once, each job's retries in order and before it expires.
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now, out = max(fired, timerValues.getCurrentWatermarkInMs() - 1), []
        jobs, wake = self._load()
        for job_id, job in list(jobs.items()):
            expires = job[3] + self.expire_ms
            while job[0] != ENDED and job[4] and job[4] <= now and job[4] < expires:
                job, more = self._run(str(job_id), job, job[4])
                out += more
            jobs[job_id] = job
            if now >= expires:
                if job[0] != ENDED:
                    out.append(self._row(str(job_id), job[0], "expired", job[1], job[2], expires))
                del jobs[job_id]
        self._store(jobs, 0 if wake == fired else wake)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def work_off(jobs: DataFrame, work: Work, retry: str = "10 minutes", most_failures: int = 3, expire: str = "1 day", late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(job_id, stage, status, failures, calls, at, error): a row for each change of a job's state, as a stream.

    ``jobs(job_id, ts)`` is a stream of requests; a job that is asked for again before it expires is not run twice.
    ``status`` is running (a stage is done, the next one begins), completed, retrying, dead_letter or expired. A retry is
    due ``retry`` after the failure and runs when the watermark (``late`` behind the newest request) has passed it. The
    state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``), as timers need it. ``buckets`` is fixed
    with the stream's checkpoint.
    """
    ms = lambda x: int(pd.Timedelta(x).total_seconds() * 1000)
    keyed = jobs.select(F.col("job_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets))).groupBy("bucket")
    schema = StructType.fromDDL(STATES)
    return keyed.transformWithStateInPandas(Worker(work, ms(retry), most_failures, ms(expire)), schema, "Append", "EventTime")


def final_states(changes: DataFrame) -> DataFrame:
    """(job_id, stage, status, failures, calls): the last change of each job."""
    last = F.max_by(F.struct("stage", "status", "failures", "calls"), F.struct("at", "calls", F.col("status") == "expired"))
    return changes.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")
