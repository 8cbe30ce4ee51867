"""Mapping a Python function over rows.

Filters and columns that the function needs are applied below it, since Catalyst can't see into
Python. Results stay a DataFrame, or come as a list, an ordered iterator, or an iterator in order
of completion. What a list or iterator would bring to the driver can be kept as a table instead:
the same batches, run and tuned alike, but written where they are made.

Rows reach a function as Python values made from Arrow, never through floats: a long stays a long
beside nulls, and a null is None. A backend runs the batches: executors' workers, one Spark job a
batch, or the driver, where the function shares the caller's objects. Inside a task, settings are
those of the caller's scope, with the nested backend.
"""

from __future__ import annotations

import bisect
import contextlib
import functools
import itertools
import pickle
import sys
import threading
import time
import traceback
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, wait
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.functions.scalars import arithmetic, is_silent, short_time, size_bytes
from loomspan.operators.batching import BatchTuner, look_ahead
from loomspan.plans.config import UNSET, ArrowBackend, Backend, SequentialBackend, active_backend, carried, effective_n_jobs, make_backend, scope_for_tasks, setting, started
from loomspan.plans.scratch import drop, scratch_path, written
from loomspan.plans.sharing import with_shared_arguments

DELIVERY = ("frame", "list", "generator", "generator_unordered")
_ERROR, _TOOK, _SIZE = "__loomspan_error", "__loomspan_seconds", "__loomspan_bytes"
#: Arrow bytes of results that may wait on the driver where batches are tuned, and most rows that Spark hands to Python at once.
MOST_HELD, ARROW_ROWS = 32 << 20, 10_000


@dataclass(frozen=True)
class Call:
    """A function with its arguments, not called yet."""

    function: Callable
    args: tuple
    kwargs: dict

    def __call__(self):
        return self.function(*self.args, **self.kwargs)


def delayed(function: Callable) -> Callable[..., Call]:
    """``delayed(f)(x)`` records the call ``f(x)``."""

    def record(*args, **kwargs) -> Call:
        return Call(function, args, kwargs)

    return functools.update_wrapper(record, function) if hasattr(function, "__name__") else record


def tasks(spark: SparkSession, values: Iterable, schema: str | T.StructType) -> DataFrame:
    """A table of arguments with ``task_id`` in the order given."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("task_id", T.LongType(), False), *schema.fields]))


def seeded(seed: int, *ids: Column | str) -> Column:
    """A seed of its own for every task, whatever partition it runs in."""
    return F.xxhash64(F.lit(seed), *ids)


def rows_of(batch: pa.RecordBatch) -> list[dict]:
    """Rows as dictionaries of Python values; maps are dictionaries too."""
    return batch.to_pylist(maps_as_pydicts="strict")


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """The reverse; a name that a row lacks is null."""
    plain = lambda v, t: v if v is None else list(v.items()) if pa.types.is_map(t) and isinstance(v, dict) else v
    return pa.RecordBatch.from_arrays([pa.array([plain(r.get(f.name), f.type) for r in rows], f.type) for f in schema], schema=schema)


def whole(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``; the last may be shorter."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, size - n))
            n, b = n + held[-1].num_rows, b.slice(held[-1].num_rows)
            if n == size:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def frame_of(batch: pa.RecordBatch) -> pd.DataFrame:
    """As pandas; whole numbers beside nulls in pandas' nullable types, as floats would change them."""
    nullable = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}
    some = [pa.types.is_integer(f.type) and batch.column(i).null_count > 0 for i, f in enumerate(batch.schema)]
    columns = {f.name: batch.column(i).to_pandas(types_mapper=nullable.get if some[i] else None) for i, f in enumerate(batch.schema)}
    return pd.DataFrame(columns)


#: Initialisers that this process has run.
_READY: set[str] = set()


def _applied(function: Callable, schema: T.StructType, frames: bool, scope: dict, ready: tuple[str, Callable, tuple] | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """``function`` over one batch, in the caller's scope and after the initialiser, once a process."""
    kind, names = to_arrow_schema(schema), schema.names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if ready and ready[0] not in _READY:
            ready[1](*ready[2])
            _READY.add(ready[0])
        with carried(scope):
            if frames:
                return pa.RecordBatch.from_pandas(function(frame_of(batch))[names], kind, preserve_index=False)
            return batch_of([function(r) for r in rows_of(batch)], kind)

    return run


class MapEngine:
    """Runs ``function(row as dict) -> dict`` or, with ``frames=True``, ``function(pandas) -> pandas`` over a table.

    A list or iterator ends all work at the first error, which is raised with its own type; a
    failed call isn't tried again. ``timeout`` is counted from when a result is waited for, and
    ignored with one job. With ``n_jobs=1`` and no backend named, rows are worked on in a plain
    loop on the driver. Arguments of a ``functools.partial`` beyond ``max_bytes`` are sent once.
    ``initializer(*initargs)`` runs once in each worker process. In a ``with`` block the backend
    stays started from call to call. Results of a function that isn't ``deterministic`` are written
    once, so all that is derived from a frame sees the same.
    """

    def __init__(
        self, return_as: str = "frame", batch_size: int | str = "auto", n_jobs: int | None | object = UNSET, timeout: float | None = None, verbose: int | object = UNSET,
        where: Column | str | None = None, columns: list[str] | None = None, frames: bool = False, backend: str | Backend | object = UNSET, pre_dispatch: str | int = "2 * n_jobs",
        prefer: str | None = None, require: str | None = None, max_bytes: str | int | None = "1M", initializer: Callable | None = None, initargs: tuple = (), deterministic: bool = True,
    ):
        if return_as not in DELIVERY:
            raise ValueError(f"return_as must be one of {DELIVERY}, not {return_as!r}")
        if not (batch_size == "auto" or isinstance(batch_size, int) and batch_size > 0):
            raise ValueError(f"batch_size must be 'auto' or a positive number, not {batch_size!r}")
        self.return_as, self.batch_size, self.timeout, self.where, self.columns, self.frames = return_as, batch_size, timeout, where, columns, frames
        jobs = setting("n_jobs", n_jobs)
        self.backend = active_backend(prefer, require) if backend is UNSET else make_backend(backend)
        self.n_jobs, self.verbose, self.pre_dispatch = effective_n_jobs(-1 if jobs is None else jobs), int(setting("verbose", verbose)), pre_dispatch
        if self.n_jobs == 1 and return_as != "frame" and type(self.backend) is ArrowBackend and backend is UNSET:
            self.backend = SequentialBackend()
        self.backend.n_jobs = self.n_jobs if self.backend.n_jobs is None else self.backend.n_jobs
        if return_as.startswith("generator") and not self.backend.streams:
            raise ValueError(f"backend {self.backend.name!r} can't deliver results one by one")
        self.max_bytes = size_bytes(max_bytes) if isinstance(max_bytes, str) else max_bytes
        self._ready = (uuid.uuid4().hex, initializer, initargs) if initializer else None
        self.deterministic, self._running, self._held = deterministic, threading.Lock(), None

    def ahead(self) -> int | None:
        """Batches that may be in work beyond those consumed; None: all."""
        p = self.pre_dispatch
        return None if p == "all" else max(1, int(p if isinstance(p, int) else arithmetic(p.replace("n_jobs", str(self.n_jobs)))))

    def __enter__(self) -> MapEngine:
        self._held = started(self.backend, SparkSession.getActiveSession())
        return self

    def __exit__(self, *_) -> None:
        held, self._held = self._held, None
        held.stop()

    @contextlib.contextmanager
    def _started(self, spark: SparkSession) -> Iterator[Backend]:
        if self._held is not None:
            yield self._held
            return
        backend = started(self.backend, spark)
        try:
            yield backend
        finally:
            backend.stop()

    def _cut(self, df: DataFrame, *needed: str) -> DataFrame:
        if self.where is not None:
            df = df.where(self.where)
        return df if self.columns is None else df.select(*dict.fromkeys([*needed, *self.columns]))

    def frame(self, function: Callable, df: DataFrame, schema: str | T.StructType) -> DataFrame:
        """The lazy result. An action on it fails with Spark's error, which holds the function's traceback."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if self.max_bytes is not None:
            function = with_shared_arguments(df.sparkSession, function, self.max_bytes)
        run = _applied(function, schema, self.frames, scope_for_tasks(self.backend), self._ready)
        out = self._cut(df).mapInArrow(lambda batches: map(run, batches), schema)
        return out if self.deterministic else written(out, "mapped")

    def __call__(self, function: Callable, df: DataFrame, schema: str | T.StructType):
        if self.return_as == "frame":
            return self.frame(function, df, schema)
        if not self._running.acquire(blocking=False):
            raise RuntimeError("this engine is at work; its results must be consumed first")
        found = self._batched(function, df, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
        return list(found) if self.return_as == "list" else found

    def table(self, function: Callable, df: DataFrame, schema: str | T.StructType) -> DataFrame:
        """What a call delivers, as a table: batches, errors and timeout are those of the list or iterator, but each batch is written where it is made.

        The driver holds a count and a duration for each batch at work, and no rows.
        """
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if self.return_as == "frame":
            return written(self.frame(function, df, schema), "mapped")
        if not self._running.acquire(blocking=False):
            raise RuntimeError("this engine is at work; its results must be consumed first")
        spark, path = df.sparkSession, scratch_path(df.sparkSession, "mapped")
        spark.createDataFrame([], schema).write.parquet(f"{path}/none")
        back = spark.read.schema(schema).option("recursiveFileLookup", "true")
        try:
            for _ in self._batched(function, df, schema, path):
                pass
        except BaseException:
            made = back.parquet(f"{path}/none")
            made._scratch = path
            drop(made)
            raise
        made = back.parquet(path)
        made._scratch = path
        return made

    def _sizes(self, n: int, backend: Backend) -> Iterator[tuple[int, int]]:
        """(first place, size) of what is dispatched, as it is asked for; "auto" follows the tuner, and gets finer near the end.

        Batches of a small given size that are kept as a table go several at a time, as many as the
        tuner says; each is still a batch of its own to the function.
        """
        at, piece, given = 0, 0, self.batch_size if isinstance(self.batch_size, int) else None
        grouped = given is not None and self._kept and given < ARROW_ROWS and backend.batches()
        while at < n:
            if given is not None and not grouped:
                size = given
            elif not backend.batches():
                size = max(1, min(ARROW_ROWS, n // (10 * self.n_jobs))) if self._kept else 1
            else:
                size, left = self._tuner.next_size(), -(-(n - at) // given) if grouped else n - at
                if not piece and left < size * self.n_jobs:  # the rest is cut up once: else pieces would shrink to single rows
                    piece = look_ahead(left, self.n_jobs, at > 0)
                size = piece or size
                size = size * given if grouped else min(size, self._most)
            size = min(size, n - at)
            yield at, size
            at += size

    def _batched(self, function: Callable, df: DataFrame, schema: T.StructType, keep: str | None = None) -> Iterator[Row]:
        """Batches of consecutive places in the order of ``task_id``, so many at a time as ``ahead`` says.

        The input is run once: rows are sorted by ``task_id``, nulls first, and written; within a
        partition their ids count up by one, so a file's first id and number of rows tell the
        places in it. A batch reads the files that hold its places. With ``keep``, results are
        written into folders below it, and nothing is delivered.
        """
        spark, tag = df.sparkSession, f"loomspan-{uuid.uuid4().hex}"
        ordered, frames = self.return_as != "generator_unordered", self.frames
        own = self._cut(df, "task_id").select(F.struct("*").alias("row"), F.col("task_id").alias("id")).orderBy(F.asc_nulls_first("id"))
        table = written(own.select("row", F.monotonically_increasing_id().alias("place")), "tasks")
        found = table.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("place").alias("first"), F.count("*").alias("n")).orderBy("first").collect()  # a row a file
        begins = [0, *itertools.accumulate(f["n"] for f in found)]
        n = begins.pop()
        if self.max_bytes is not None and not self.backend.shares:
            function = with_shared_arguments(spark, function, self.max_bytes)
        apply = _applied(function, schema, frames, scope_for_tasks(self.backend), self._ready)
        guarded = T.StructType([T.StructField("result", schema), T.StructField(_ERROR, T.BinaryType()), T.StructField(_TOOK, T.DoubleType()), T.StructField(_SIZE, T.LongType())])
        result_kind = to_arrow_schema(guarded)

        given = self.batch_size if keep and isinstance(self.batch_size, int) and self.batch_size < ARROW_ROWS else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in whole(batches, given) if given else batches:
                t = time.monotonic()
                try:
                    out = apply(batch)
                    once = lambda v, kind: pa.array([v, *[None] * (out.num_rows - 1)][: out.num_rows], kind)  # noqa: B023, E731
                    took, size = once(time.monotonic() - t, pa.float64()), once(out.nbytes, pa.int64())
                    yield pa.RecordBatch.from_arrays([out.to_struct_array().cast(result_kind.field(0).type), pa.nulls(out.num_rows, pa.binary()), took, size], schema=result_kind)
                except Exception as e:  # noqa: BLE001 - raised again by the caller with its own type
                    e.add_note("".join(traceback.format_exception(e)))
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, result_kind.field(0).type), pa.array([_pickled(e)], pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64())], schema=result_kind)
                    return

        def part(start: int, size: int) -> DataFrame:
            i, j = bisect.bisect_right(begins, start) - 1, bisect.bisect_left(begins, start + size) - 1
            least, most = found[i]["first"] + start - begins[i], found[j]["first"] + start + size - 1 - begins[j]
            rows = spark.read.schema(table.schema).parquet(*(f"{table._scratch}/{f['file']}" for f in found[i : j + 1])).where(F.col("place").between(least, most))
            return rows.coalesce(1).sortWithinPartitions("place").select("row.*")

        @contextlib.contextmanager
        def tagged() -> Iterator[None]:
            spark.addTag(tag)
            try:
                yield
            finally:
                spark.removeTag(tag)

        def job(start: int, size: int) -> tuple[list[Row], float, int]:
            """On the executors; the results, the seconds that the function took, without the job's own, and the results' bytes."""
            with tagged():
                rows = part(start, size).mapInArrow(run, guarded).collect()
            for r in rows:
                if r[_ERROR] is not None:
                    raise pickle.loads(r[_ERROR])
            return [r["result"] for r in rows], sum(r[_TOOK] or 0.0 for r in rows), sum(r[_SIZE] or 0 for r in rows)

        def kept(start: int, size: int) -> tuple[list[Row], float, int]:
            """On the executors, where the results stay."""
            seen = Observation()
            with tagged():
                rows = part(start, size).mapInArrow(run, guarded).observe(seen, F.sum(_TOOK).alias("took"), F.max(_ERROR).alias("error"))
                rows.select("result.*").write.option("compression", "zstd").parquet(f"{keep}/{start}")
            if seen.get["error"] is not None:
                raise pickle.loads(seen.get["error"])
            return [], seen.get["took"] or 0.0, 0

        def here(start: int, size: int) -> tuple[list[Row], float, int]:
            """On the driver, sharing its objects."""
            batches, t = part(start, size).toArrow().to_batches(), time.monotonic()
            made = [apply(b) for b in (whole(batches, given) if given else batches)]
            took = time.monotonic() - t
            if keep:
                spark.createDataFrame(pa.Table.from_batches(made, to_arrow_schema(schema)), schema).write.option("compression", "zstd").parquet(f"{keep}/{start}")
                return [], took, 0
            return [Row(**{k: r[k] for k in schema.names}) for b in made for r in rows_of(b)], took, 0

        began, done, unused, finished = time.monotonic(), 0, 0, False
        self._tuner, self._most, self._kept, unit = BatchTuner(), n, keep is not None, given or 1
        waiting: dict = {}
        with self._started(spark) as backend:
            do = here if backend.shares else kept if keep else job
            queue = self._sizes(n, backend)
            out = sys.stdout if self.verbose >= 50 else sys.stderr

            def timed(start: int, size: int) -> tuple[list[Row], float, int, int]:
                return *do(start, size), size

            def dispatch(most: int | None) -> None:
                for start, size in queue if most is None else _take(queue, most):
                    waiting[backend.submit(functools.partial(timed, start, size))] = start

            try:
                one = isinstance(backend, SequentialBackend)
                dispatch(1 if one else self.ahead())
                while waiting:
                    first = min(waiting, key=waiting.get)
                    ready = wait([first] if ordered else list(waiting), timeout=None if one else self.timeout, return_when=FIRST_COMPLETED).done
                    if not ready:
                        raise TimeoutError(f"no result within {self.timeout} s")
                    for f in ready:
                        start = waiting.pop(f)
                        rows, took, n_bytes, size = f.result()
                        self._tuner.completed(-(-size // unit), max(took, 1e-9))
                        if n_bytes and self.ahead():  # so many rows a batch that all those at work aren't more than the driver may hold
                            self._most = max(1, min(self._most, MOST_HELD * size // (n_bytes * self.ahead())))
                        done += size
                        if not is_silent(done, self.verbose):
                            print(f"{done} of {n} tasks, {short_time((time.monotonic() - began) / done * (n - done))} left", file=out)
                        if not one:
                            dispatch(1)
                        unused = len(rows)
                        for r in rows:
                            unused -= 1
                            yield r
                        if one:  # a plain loop: nothing runs that isn't asked for
                            dispatch(1)
                finished = True
            finally:
                if not finished:
                    backend.abort()
                    if waiting or unused:
                        spark.interruptTag(tag)
                        computed = sum(f.done() and not f.cancelled() for f in waiting)
                        warnings.warn(f"results were abandoned: {computed} batches computed for nothing, {len(waiting) - computed} cancelled", stacklevel=2)
                    if self._held is not None:  # an aborted pool takes no more work
                        self._held = started(self.backend, spark)
                else:
                    drop(table)
                self._tuner.reset()
                self._running.release()


def run_calls(calls: Iterable[Call], n_jobs: int | None = -1, backend: str | Backend = "threads", ordered: bool = True, timeout: float | None = None) -> Iterator:
    """Runs recorded calls on the driver, lazily fed; for functions that need the caller's objects."""
    own = make_backend(backend, n_jobs=n_jobs)
    own.start(SparkSession.getActiveSession())
    ahead, source = 2 * own.effective_n_jobs(n_jobs), iter(calls)
    waiting: dict = {}
    try:
        for i, c in enumerate(_take(source, ahead)):
            waiting[own.submit(c)] = i
        n = len(waiting)
        while waiting:
            f = min(waiting, key=waiting.get) if ordered else next(iter(wait(list(waiting), timeout, FIRST_COMPLETED).done), None)
            if f is None:
                raise TimeoutError(f"no result within {timeout} s")
            out = f.result(timeout)
            waiting.pop(f)
            for c in _take(source, 1):
                waiting[own.submit(c)] = n
                n += 1
            yield out
    finally:
        own.stop()


def _take(source: Iterator, n: int) -> list:
    return [x for _, x in zip(range(n), source, strict=False)]


def _pickled(e: Exception) -> bytes:
    try:
        pickle.loads(data := pickle.dumps(e))
        return data
    except Exception:  # noqa: BLE001 - an exception that can't travel goes as its text
        return pickle.dumps(RuntimeError(f"{type(e).__name__}: {e}"))
