"""Running a statement with progress, partial results, cancelling and a time limit."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession


@dataclass(frozen=True)
class Statistics:
    """What a statement has taken so far."""

    seconds: float
    jobs: int
    stages: int
    tasks: int
    done_tasks: int
    failed_tasks: int
    #: Stage names with their numbers of tasks, in order.
    by_stage: tuple[tuple[str, int], ...]


def pages(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows in pages, in order; the driver holds one partition of the result at a time."""
    page: list[Row] = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) >= size:
            yield page
            page = []
    if page:
        yield page


class Running:
    """A statement that runs on a thread of its own, in a job group by which Spark tells its jobs and can stop them.

    ``before``: statements over growing parts of the data; ``on_update`` gets the rows of each, and the share of the
    parts, while the whole still runs. ``path``: the rows are written there as Parquet and not handed over.
    """

    def __init__(self, spark: SparkSession, df: DataFrame, timeout: float | None = None, action: Callable[[DataFrame], list[Row]] | None = None, before: Sequence[tuple[float, DataFrame]] = (), on_update: Callable[[list[Row], float], None] | None = None, path: str | None = None):
        self.spark, self.tag = spark, f"lattica-{uuid.uuid4().hex}"
        self._df, self._action = df, action or (self._write if path else lambda d: d.collect())
        self._before, self._on_update, self.path = before, on_update, path
        self._rows: list[Row] | None = None
        self._error: BaseException | None = None
        self.cancelled = self.timed_out = False
        self.began, self.seconds = time.time(), 0.0
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._timer = threading.Timer(timeout, self._too_long) if timeout else None
        self._thread.start()
        if self._timer:
            self._timer.daemon = True
            self._timer.start()

    def _write(self, df: DataFrame) -> list[Row]:
        df.write.parquet(self.path)
        return []

    def _run(self) -> None:
        sc = self.spark.sparkContext
        sc.setJobGroup(self.tag, "statement", True)
        sc.addJobTag(self.tag)
        try:
            for share, part in self._before:
                if self._on_update is not None and not self.cancelled:
                    self._on_update(part.collect(), share)
            if not self.cancelled:
                self._rows = self._action(self._df)
        except BaseException as e:  # noqa: BLE001 - handed to whoever asks for the rows
            self._error = e
        finally:
            self.seconds = time.time() - self.began
            sc.removeJobTag(self.tag)
            if self._timer:
                self._timer.cancel()

    def _too_long(self) -> None:
        self.timed_out = True
        self.cancel()

    def cancel(self) -> None:
        """Stop the statement; jobs that have not begun yet are stopped as they begin."""
        self.cancelled = True
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.1)

    @property
    def done(self) -> bool:
        return not self._thread.is_alive()

    def statistics(self) -> Statistics:
        """Counts over the statement's own jobs."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.tag)]
        ids = sorted({i for j in jobs if j for i in j.stageIds})
        stages = [s for s in map(tracker.getStageInfo, ids) if s]
        seconds = self.seconds if self.done else time.time() - self.began
        return Statistics(seconds, len(jobs), len(stages), sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages), sum(s.numFailedTasks for s in stages), tuple((s.name, s.numTasks) for s in stages))

    def percent(self) -> int:
        """How much of the statement's work that Spark knows of is done."""
        if self.done:
            return 100
        s = self.statistics()
        return min(99, 100 * s.done_tasks // s.tasks) if s.tasks else 0

    def result(self, wait: float | None = None) -> list[Row]:
        self._thread.join(wait)
        if self._thread.is_alive():
            raise TimeoutError("the statement still runs")
        if self.timed_out:
            raise TimeoutError("the statement took too long and was stopped")
        if self.cancelled:
            raise InterruptedError("the statement was cancelled")
        if self._error is not None:
            raise self._error
        assert self._rows is not None
        return self._rows
