"""Large arguments, sent once instead of with every task.

A value is pickled once. Small ones travel as a broadcast variable, whose size is checked; larger
ones are a file in the shared folder that each worker process reads when it first needs it. What
travels with a task is the reference.
"""

from __future__ import annotations

import functools
import io
import weakref
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import SparkSession

from loomspan.functions.scalars import size_bytes
from loomspan.plans.config import setting
from loomspan.plans.scratch import scratch_path

#: Values that a worker process has read, by reference.
_READ: dict[str, object] = {}


class Shared:
    """A reference to a value; ``value`` is the value, wherever this is."""

    def __init__(self, name: str, path: str | None, broadcast):
        self.name, self.path, self.broadcast = name, path, broadcast

    @property
    def value(self) -> object:
        if self.name not in _READ:
            if self.path is None:
                _READ[self.name] = cloudpickle.loads(self.broadcast.value)
            else:
                from pyarrow import fs

                files, at = fs.FileSystem.from_uri(self.path)
                with files.open_input_stream(at) as stream:
                    _READ[self.name] = cloudpickle.loads(stream.read())
        return _READ[self.name]


#: References to values that were shared and still exist, by identity; a dead value's entry is dropped with it.
_SHARED: dict[tuple[str, int], tuple[object, Shared]] = {}


def _remember(spark: SparkSession, value: object, reference: Shared) -> None:
    key = (spark.sparkContext.applicationId, id(value))
    try:
        alive = weakref.ref(value, lambda _: _SHARED.pop(key, None))
    except TypeError:  # what can't be watched is held, so that its identity stays its own
        alive = lambda: value
    _SHARED[key] = (alive, reference)


def is_shared(spark: SparkSession, value: object) -> bool:
    return isinstance(value, Shared) or (spark.sparkContext.applicationId, id(value)) in _SHARED


def share(spark: SparkSession, value: object, data: bytes | None = None) -> Shared:
    """A reference to ``value``; a value shared before gives the same one."""
    if isinstance(value, Shared):
        return value
    known = _SHARED.get((spark.sparkContext.applicationId, id(value)))
    if known and known[0]() is value:
        return known[1]
    data = cloudpickle.dumps(value) if data is None else data
    path = scratch_path(spark, "shared")
    if len(data) <= size_bytes(str(setting("broadcast_bytes"))):
        reference = Shared(path, None, spark.sparkContext.broadcast(data))
    else:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        source = io.BytesIO(data)
        while chunk := source.read(1 << 22):
            stream.write(bytearray(chunk))
        stream.close()
        reference = Shared(path, path, None)
    _remember(spark, value, reference)
    return reference


def scatter(spark: SparkSession, values: list) -> list[Shared]:
    """References to several values, each sent once however often it occurs."""
    return [share(spark, v) for v in values]


def worth_sharing(value: object, limit: int) -> bool:
    """Arrays, texts, tables and the like beyond the limit; arrays of objects aren't, nor is what is shared already."""
    if isinstance(value, np.ndarray):
        return not value.dtype.hasobject and value.nbytes > limit
    if isinstance(value, (bytes, bytearray, str)):
        return len(value) > limit
    return False


def with_shared_arguments(spark: SparkSession, function: Callable, limit: int) -> Callable:
    """``functools.partial`` functions with their large arguments as references; others, and small arguments, as they are."""
    if not isinstance(function, functools.partial):
        return function
    of = lambda v: share(spark, v) if worth_sharing(v, limit) else v
    args, kwargs, inner = [of(v) for v in function.args], {k: of(v) for k, v in function.keywords.items()}, function.func
    if not any(isinstance(v, Shared) for v in [*args, *kwargs.values()]):
        return function
    given = lambda v: v.value if isinstance(v, Shared) else v

    def call(*more, **named):
        return inner(*map(given, args), *more, **{k: given(v) for k, v in kwargs.items()} | named)

    return call
