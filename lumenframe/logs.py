"""Named loggers with five levels, and a listener that logs streaming progress."""

from __future__ import annotations

import logging

from pyspark.sql.streaming.listener import StreamingQueryListener

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR, "fatal": logging.CRITICAL}


def logger(domain: str) -> logging.Logger:
    """A domain's logger, the same for each call."""
    return logging.getLogger(f"lumenframe.{domain}")


def write(domain: str, level: str, message: str) -> None:
    logger(domain).log(LEVELS[level], "%s", message.translate({13: None, 10: None}))


class ProgressListener(StreamingQueryListener):
    def onQueryStarted(self, event):
        write("stream", "info", f"started {event.id}")

    def onQueryProgress(self, event):
        write("stream", "debug", f"{event.progress.id}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event):
        write("stream", "debug", f"idle {event.id}")

    def onQueryTerminated(self, event):
        write("stream", "warn" if event.exception else "info", f"ended {event.id}: {event.exception or 'done'}")
