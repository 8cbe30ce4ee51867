"""Scoped defaults, backends and their registry."""

from __future__ import annotations

import contextlib
import os
import re
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import Executor, Future, ThreadPoolExecutor
from contextvars import ContextVar

from pyspark.sql import SparkSession

UNSET = object()
DEFAULTS = {"backend": "arrow", "n_jobs": None, "verbose": 0, "scratch": None, "broadcast_bytes": "1M", "prefer": None, "require": None}
PREFER, REQUIRE = ("jvm", "workers", "threads", None), ("shared", None)
_scope: ContextVar[dict] = ContextVar("loomspan_scope", default={})


class Backend:
    """Where tasks run. Functions of the driver's threads see the caller's objects; those of Arrow workers don't."""

    name, streams, shares = "base", True, False

    def __init__(self, n_jobs: int | None = None, **params):
        self.n_jobs, self.params = n_jobs, params

    def start(self, spark: SparkSession) -> None:
        self.spark = spark

    def effective_n_jobs(self, n_jobs: int | None) -> int:
        return effective_n_jobs(n_jobs, cpu_count())

    def submit(self, call: Callable[[], object]) -> Future:
        raise NotImplementedError

    def abort(self) -> None: ...

    def stop(self) -> None: ...

    def batches(self) -> bool:
        """Whether calls are worth batching; where objects are shared a call costs next to nothing."""
        return not self.shares

    def nested(self) -> Backend:
        """What a call inside a task gets: Spark can't start jobs there, so it is done in place."""
        return SequentialBackend()


class SequentialBackend(Backend):
    name, shares = "sequential", True

    def effective_n_jobs(self, n_jobs: int | None) -> int:
        if n_jobs == 0:
            raise ValueError("n_jobs can't be 0")
        return 1

    def submit(self, call):
        f: Future = Future()
        try:
            f.set_result(call())
        except Exception as e:  # noqa: BLE001 - handed on by the future
            f.set_exception(e)
        return f


class ThreadBackend(Backend):
    """Driver threads, for functions that need the caller's objects."""

    name, shares = "threads", True

    def start(self, spark):
        super().start(spark)
        self._pool: Executor = ThreadPoolExecutor(self.effective_n_jobs(self.n_jobs))

    def submit(self, call):
        return self._pool.submit(call)

    def abort(self):
        self._pool.shutdown(wait=False, cancel_futures=True)

    stop = abort


class ArrowBackend(ThreadBackend):
    """Python workers of the executors, fed with Arrow batches; a driver thread waits for each job."""

    name, shares = "arrow", False


class FallbackToBackend(Exception):
    """Raised by a backend's ``start`` where it can't work; names the one to use instead."""

    def __init__(self, backend: Backend):
        super().__init__(f"use the backend {backend.name!r} instead")
        self.backend = backend


_BACKENDS: dict[str, Callable[..., Backend]] = {b.name: b for b in (SequentialBackend, ThreadBackend, ArrowBackend)}


def register_backend(name: str, factory: Callable[..., Backend], make_default: bool = False) -> None:
    if not isinstance(name, str) or not callable(factory):
        raise TypeError("a backend needs a name and a factory")
    _BACKENDS[name] = factory
    if make_default:
        DEFAULTS["backend"] = name


#: Backends of other packages by name: what registers them, called when the name is first asked for.
_EXTERNAL: dict[str, Callable[[], object]] = {}


def register_external(name: str, register: Callable[[], object]) -> None:
    _EXTERNAL[name] = register


def started(backend: Backend, spark: SparkSession | None) -> Backend:
    """The backend after its start, or the one that it falls back to."""
    try:
        backend.start(spark)
        return backend
    except FallbackToBackend as e:
        return started(e.backend, spark)


def make_backend(spec: str | Backend, **params) -> Backend:
    """A backend by name; one that isn't there is replaced by the default with a warning."""
    if isinstance(spec, Backend):
        return spec
    if spec not in _BACKENDS and spec in _EXTERNAL:
        _EXTERNAL.pop(spec)()
    if spec not in _BACKENDS:
        warnings.warn(f"backend {spec!r} isn't registered; using {ArrowBackend.name!r}", stacklevel=3)
        spec = ArrowBackend.name
    return _BACKENDS[spec](**params)


def setting(name: str, explicit: object = UNSET) -> object:
    """An explicit value, else the innermost scope's, else the default."""
    return explicit if explicit is not UNSET else _scope.get().get(name, DEFAULTS[name])


@contextlib.contextmanager
def config(spark: SparkSession | None = None, spark_conf: dict[str, str] | None = None, **values) -> Iterator[dict]:
    """Defaults for the calls within; may also set Spark settings for as long."""
    unknown = set(values) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"no such settings: {sorted(unknown)}")
    if values.get("prefer") not in PREFER or values.get("require") not in REQUIRE:
        raise ValueError(f"prefer is one of {PREFER}, require one of {REQUIRE}")
    if values.get("prefer") == "workers" and values.get("require") == "shared":
        raise ValueError("workers don't share the caller's memory")
    token = _scope.set(_scope.get() | values)
    old = {k: spark.conf.get(k, None) for k in spark_conf} if spark and spark_conf else {}
    for k in old:
        spark.conf.set(k, spark_conf[k])
    try:
        yield _scope.get()
    finally:
        _scope.reset(token)
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextlib.contextmanager
def carried(values: dict) -> Iterator[None]:
    """A caller's scope, installed where its tasks run."""
    token = _scope.set(values)
    try:
        yield
    finally:
        _scope.reset(token)


def scope_for_tasks(backend: Backend) -> dict:
    """The present scope as a task gets it: with the nested backend, by name, as objects don't travel."""
    return {k: v for k, v in _scope.get().items() if isinstance(v, str | int | float | None)} | {"backend": backend.nested().name, "n_jobs": 1, "prefer": None, "require": None}


class legacy_backend:  # noqa: N801 - used like a function
    """Sets the default backend at once, until ``unregister`` or the end of its ``with``, which gives (backend, n_jobs)."""

    def __init__(self, backend: str | Backend, n_jobs: int | None = -1, **params):
        self._made, self._n_jobs = make_backend(backend, n_jobs=n_jobs, **params), n_jobs
        self._token = _scope.set(_scope.get() | {"backend": self._made, "n_jobs": n_jobs})

    def __enter__(self) -> tuple[Backend, int | None]:
        return self._made, self._n_jobs

    def __exit__(self, *_) -> None:
        self.unregister()

    def unregister(self) -> None:
        if self._token is not None:
            _scope.reset(self._token)
            self._token = None


def active_backend(prefer: str | None = None, require: str | None = None) -> Backend:
    """The scope's backend, or driver threads where memory must be shared and the backend can't."""
    prefer, require = prefer or setting("prefer"), require or setting("require")
    if prefer not in PREFER or require not in REQUIRE:
        raise ValueError(f"prefer is one of {PREFER}, require one of {REQUIRE}")
    if prefer == "workers" and require == "shared":
        raise ValueError("workers don't share the caller's memory")
    chosen = make_backend(setting("backend"))
    if require == "shared" and not chosen.shares:
        return ThreadBackend(n_jobs=1)
    if prefer == "threads" and "backend" not in _scope.get():
        return ThreadBackend()
    return chosen


def cpu_count(only_physical: bool = False) -> int:
    """Cores that Spark may use at once; this machine's where there is no session. Physical ones: two hyperthreads count once."""
    spark = SparkSession.getActiveSession()
    n = spark.sparkContext.defaultParallelism if spark else os.cpu_count() or 1
    if not only_physical:
        return n
    try:
        with open("/proc/cpuinfo") as f:
            told = [dict(x.split(":", 1) for x in re.sub(r"[ \t]*:[ \t]*", ":", block).splitlines() if ":" in x) for block in f.read().strip().split("\n\n")]
        physical = len({(c["physical id"], c["core id"]) for c in told})
    except (OSError, KeyError):
        warnings.warn("physical cores can't be told here; all are counted", stacklevel=2)
        return n
    return max(1, round(n * physical / len(told)))


def effective_n_jobs(n_jobs: int | None = -1, cpus: int | None = None) -> int:
    """Number of jobs meant: none is one, negative counts back from all cores."""
    if n_jobs == 0:
        raise ValueError("n_jobs can't be 0")
    if n_jobs is None:
        return 1
    return n_jobs if n_jobs > 0 else max(1, (cpus or cpu_count()) + 1 + n_jobs)


def effective_n_jobs_col(n_jobs, cpus: int):
    from pyspark.sql import functions as F

    return F.when(n_jobs.isNull(), 1).when(n_jobs > 0, n_jobs).when(n_jobs < 0, F.greatest(F.lit(cpus + 1) + n_jobs, F.lit(1)))


def threads_per_worker(n_jobs: int, cpus: int | None = None) -> dict[str, str]:
    """Environment that keeps native libraries in workers from using more cores than their share."""
    n = str(max((cpus or cpu_count()) // n_jobs, 1))
    return {f"{library}_NUM_THREADS": n for library in ("BLIS", "MKL", "NUMBA", "NUMEXPR", "OMP", "OPENBLAS")} | {"VECLIB_MAXIMUM_THREADS": n}
