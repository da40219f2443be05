"""A run's log: to standard error, and to a file if one is opened; and the time that steps take."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

LOG = logging.getLogger("gammaweave")


@contextmanager
def log_file(path: str, screen: bool = True) -> Iterator[logging.Logger]:
    """LOG, written to the file (anew) while the context lasts."""
    handlers: list[logging.Handler] = [logging.FileHandler(path, "w"), *([logging.StreamHandler()] if screen else [])]
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        LOG.addHandler(h)
    level = LOG.level
    LOG.setLevel(logging.INFO)
    LOG.info("log opened")
    try:
        yield LOG
    finally:
        LOG.info("log closed")
        LOG.setLevel(level)
        for h in handlers:
            LOG.removeHandler(h)
            h.close()


@contextmanager
def timed(what: str) -> Iterator[None]:
    """Notes what is done, and how many milliseconds it took."""
    LOG.info("%s ...", what)
    began = time.perf_counter()
    yield
    LOG.info("%s: %.2f ms", what, 1000 * (time.perf_counter() - began))
