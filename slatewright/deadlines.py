"""Deadlines of queries: jobs that a block of code starts end when its time is over.

Jobs carry a tag of the block; a timer thread cancels by that tag until the block is left,
so a job that starts after the deadline ends too.  The block then raises
``DeadlineExceeded`` in place of Spark's error, after what was to be released is released.
Blocks may be nested: the inner one has its own tag and the outer one's.  Tags belong to the
thread that enters the block, so jobs of other threads go on.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class DeadlineExceeded(TimeoutError):
    """``what`` was not done in ``seconds``."""

    def __init__(self, what: str, seconds: float):
        super().__init__(f"{what} was not done in {seconds:g} s")
        self.what, self.seconds = what, seconds


@contextmanager
def deadline(spark: SparkSession, seconds: float, what: str = "the query", release: Callable[[], None] | None = None) -> Iterator[Callable[[], float]]:
    """Gives a function of the seconds left; driver code between jobs can call it, and it
    raises too when none are.  ``release`` is called when the time was over, once.  An
    error that comes before the deadline is raised as it is."""
    if not 0 < seconds < float("inf"):
        raise ValueError("seconds must be positive and finite")
    context, tag = spark.sparkContext, f"deadline-{uuid.uuid4().hex}"
    ends, left_block = time.monotonic() + seconds, threading.Event()
    fired = threading.Event()

    def watch() -> None:
        if left_block.wait(seconds):
            return
        fired.set()
        while True:
            context.cancelJobsWithTag(tag)
            if left_block.wait(0.2):
                return

    def left() -> float:
        if (rest := ends - time.monotonic()) <= 0:
            raise DeadlineExceeded(what, seconds)
        return rest

    watcher = threading.Thread(target=watch, name=tag, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield left
    except Exception as error:
        # The inner block's own error stays; what else ends after the deadline is its doing.
        late = DeadlineExceeded(what, seconds) if fired.is_set() and not isinstance(error, DeadlineExceeded) else None
        if release and (late or isinstance(error, DeadlineExceeded) and error.what == what):
            release()
        if late:
            raise late from error
        raise
    finally:
        left_block.set()
        watcher.join()
        context.removeJobTag(tag)
