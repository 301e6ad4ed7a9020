"""Whole objects that tasks need, such as models: bytes that the driver broadcasts once a version, and that a worker process makes
into an object once, however many tasks and queries ask for it."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Versions that a worker keeps as objects, and the driver as broadcasts; the ones used last stay.
KEPT = 4
_made: OrderedDict[str, object] = OrderedDict()
_sent: OrderedDict[tuple[str, str], object] = OrderedDict()


def _latest(kept: OrderedDict, key, make: Callable):
    if key not in kept:
        kept[key] = make()
        while len(kept) > KEPT:
            kept.popitem(last=False)
    kept.move_to_end(key)
    return kept[key]


def made(version: str, sent, make: Callable[[bytes], object]):
    """In a task: the object of a version. The broadcast is read only where this process hasn't made it yet."""
    return _latest(_made, version, lambda: make(sent.value))


def shipped(spark: SparkSession, data: bytes, make: Callable[[bytes], object]) -> Callable[[], object]:
    """What a task calls to get make(data). The version is a digest of the bytes and the name of `make`, so that changed bytes are
    another version; `make` must be a function with a name of its own. Lost executors' workers read the broadcast again."""
    version = f"{make.__module__}.{make.__qualname__}:{hashlib.sha256(data).hexdigest()}"
    context = spark.sparkContext
    sent = _latest(_sent, (context.applicationId, version), lambda: context.broadcast(data))
    return lambda: made(version, sent, make)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A file of any store that Spark reads, of at most 2 GB."""
    rows = spark.read.format("binaryFile").load(path).select("content").take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} must be one file")
    return bytes(rows[0]["content"])
