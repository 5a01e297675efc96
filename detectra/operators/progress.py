"""Progress of a job while it runs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources import checkpoint

#: Seconds between two looks.
PERIOD = 0.2


def share_done(context, group: str) -> float:
    """Of the tasks of a job group's stages that have been submitted, the share that has ended."""
    tracker = context.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s:
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done / total if total else 0.0


def watched(df: DataFrame, total: int, progress: Callable[[int, int], None] | None) -> DataFrame:
    """The frame; with ``progress``, computed now and cut, while progress(done, total) is called as tasks end.

    ``done`` is the share of ended tasks of ``total``.  It rises from call to call and is ``total`` only
    in the last, after the job.  What progress raises is ignored.
    """
    if progress is None:
        return df
    context, group, over = df.sparkSession.sparkContext, f"watched-{uuid.uuid4().hex}", threading.Event()
    told = [-1]

    def tell(done: int) -> None:
        if done > told[0]:
            told[0] = done
            try:
                progress(done, total)
            except Exception:  # noqa: BLE001 - a callback may not stop the run
                pass

    def look() -> None:
        while not over.wait(PERIOD):
            tell(min(int(total * share_done(context, group)), total - 1))

    watcher = threading.Thread(target=look, daemon=True)
    before = [context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")]
    context.setJobGroup(group, "watched")
    watcher.start()
    try:
        out = checkpoint.cut(df)
    finally:
        over.set()
        watcher.join()
        for k, v in zip(("spark.jobGroup.id", "spark.job.description"), before):
            context.setLocalProperty(k, v)
    tell(total)
    return out
