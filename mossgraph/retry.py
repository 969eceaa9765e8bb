"""Calls that may fail for a while: tried again with growing waits; for the driver, around jobs and files."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


class Aborted(RuntimeError):
    """The caller no longer wants the result."""


def retried(
    call: Callable[[], T], passing: Callable[[Exception], bool], attempts: int = 3, base: float = 1.0, most: float = 30.0, aborted: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep,
    chance: Callable[[], float] = random.random,
) -> T:
    """``call()``, again after each error that ``passing`` says may pass, ``attempts`` times at most.

    Before the n-th repetition it waits half to all of ``min(base * 2**n, most)`` seconds, by ``chance``.  Other errors, and the
    error of the last attempt, are raised; ``aborted`` is asked before every attempt."""
    for attempt in range(attempts):
        if aborted():
            raise Aborted
        try:
            return call()
        except Exception as error:
            if attempt + 1 == attempts or not passing(error):
                raise
            sleep(min(base * 2**attempt, most) * (0.5 + chance() / 2))
    raise ValueError("at least one attempt is needed")
