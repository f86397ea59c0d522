"""Cancellation and timeouts by job tags."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class CancellationToken:
    """Shared flag; cancelling ends the Spark jobs that run under it."""

    def __init__(self):
        self._flag, self._watchers = threading.Event(), []

    @property
    def is_cancelled(self) -> bool:
        return self._flag.is_set()

    def cancel(self) -> None:
        self._flag.set()
        for stop in list(self._watchers):
            stop()


def limited(spark: SparkSession, run: Callable[[], T], timeout: float | None = None, token: CancellationToken | None = None) -> tuple[T | None, str | None]:
    """The result, and None, Timeout or Cancelled."""
    ctx, tag, reason = spark.sparkContext, f"scan-{uuid.uuid4().hex}", []

    def stop(why: str) -> None:
        reason.append(why)
        ctx.cancelJobsWithTag(tag)

    if token and token.is_cancelled:
        return None, "Cancelled"
    watcher = lambda: stop("Cancelled")
    timer = threading.Timer(timeout, stop, ("Timeout",)) if timeout is not None else None
    if token:
        token._watchers.append(watcher)
    if timer:
        timer.start()
    ctx.addJobTag(tag)
    try:
        out = run()
        return (None, reason[0]) if reason else (out, None)
    except Exception:
        if reason:
            return None, reason[0]
        raise
    finally:
        ctx.removeJobTag(tag)
        if timer:
            timer.cancel()
        if token:
            token._watchers.remove(watcher)
