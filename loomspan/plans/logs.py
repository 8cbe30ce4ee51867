"""Messages: a mixin that names who speaks, and lines with the time that passed."""

from __future__ import annotations

import logging
import logging.handlers
import sys
import time

from loomspan.functions.scalars import pretty, short_time

#: Old files that stay beside a log.
KEPT = 9


class Logger:
    """Messages under a name; ``format`` shows values to a depth."""

    def __init__(self, depth: int = 3, name: str | None = None):
        self.depth, self._name = depth, name or type(self).__name__

    def _log(self) -> logging.Logger:
        return logging.getLogger(self._name)

    def warn(self, text: str) -> None:
        self._log().warning("[%s]: %s", self, text)

    def info(self, text: str) -> None:
        self._log().info("[%s]: %s", self, text)

    def debug(self, text: str) -> None:
        self._log().debug("[%s]: %s", self, text)

    def format(self, value: object) -> str:
        return pretty(value, self.depth)


class PrintTime:
    """``self(text)`` writes the text and the seconds since the last one, or since the begin; to stderr and, if named, a file.

    The file that is there becomes number 1, that one number 2, up to ``KEPT``.
    """

    def __init__(self, file: str | None = None):
        self.begin = self.last = time.time()
        self._out = logging.Logger(f"times-{id(self)}")
        self._out.addHandler(logging.StreamHandler(sys.stderr))
        if file:
            handler = logging.handlers.RotatingFileHandler(file, backupCount=KEPT, delay=True)
            handler.doRollover()
            self._out.addHandler(handler)

    def __call__(self, text: str = "", total: bool = False) -> None:
        now = time.time()
        what = f"{short_time(now - self.begin)} in all" if total else short_time(now - self.last)
        self._out.warning("%s: %s", text, what)
        self.last = now
