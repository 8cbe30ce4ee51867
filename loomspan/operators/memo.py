"""Never computing the same thing twice: a memo of row-wise function results.

A call is a row. Its key is the hash of the function's arguments; equal rows are one call. Keys,
without their rows, are counted and looked up by anti join; rows of those that miss are shuffled
once, by ranges of keys, mapped once a key, appended, and all rows get their results by one join. Results and metadata are Parquet below ``location``:

    functions/<func_id>/code.json         source that the results belong to
    functions/<func_id>/runs/<run>.json   a run that is there: its bytes, and runs that it replaces
    items/<func_id>/<run>/                key, result, time, duration, input, size; ranges of keys, sorted
    access/<func_id>/<name>/              key and time of each use, for least-recently-used eviction
    shelves/<func_id>/<name>/             argument rows and keys of a shelved call

A run is there once its small file is, which is written under another name and renamed. So readers
see whole runs only, and the newest result of a key counts. After ``MOST_RUNS`` runs they are merged
into one; the merged ones' files stay for ``GRACE``, as frames may still read them. Eviction and
``clear`` delete at once: frames made before must not be used after.

What can't be read costs a computation, no more: results that a call needs are read once before
they are counted on, damaged runs are dropped with a warning, and their keys computed again.
"""

from __future__ import annotations

import abc
import asyncio
import hashlib
import json
import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.functions.hashing import content_key
from loomspan.functions.inspection import name_of, source_of
from loomspan.operators.eviction import items_to_delete
from loomspan.operators.mapper import batch_of, frame_of, rows_of
from loomspan.plans.scratch import drop, written

KEY = "args_id"
#: Runs of a function that are left apart, seconds that merged ones' files stay, and keys that are looked for by their values.
MOST_RUNS, GRACE, FEW_KEYS = 8, 86_400, 100
#: Bytes of arguments that a worker turns into Python values at once, and equal rows that may meet in a task.
SLICE_BYTES, MOST_COPIES = 4 << 20, 1_000
#: Seconds that writing a call's metadata may take without a warning.
SLOW_WRITE = 5.0


def in_slices(batches: Iterator[pa.RecordBatch], n_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``n_bytes``, at least a row: values, their texts and results take several times that."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            b = waiting.pop()
            if b.num_rows > 1 and b.nbytes > n_bytes:
                half = b.num_rows // 2
                waiting += [b.slice(half), b.slice(0, half)]
            else:
                yield b


class CollisionWarning(UserWarning):
    """Two functions share a name, or a function's code changed."""


def expires_after(**delta) -> Callable[[Column, Column], Column]:
    """Valid while a result is younger than ``timedelta(**delta)``; for ``valid_if``."""
    age = timedelta(**delta)
    return lambda now, metadata: now - metadata["time"] < F.lit(age)


class StoreBase(abc.ABC):
    """What a memo asks of a place for its files; names are relative to the place."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    @abc.abstractmethod
    def exists(self, name: str) -> bool: ...

    @abc.abstractmethod
    def delete(self, name: str) -> None: ...

    @abc.abstractmethod
    def names(self, name: str) -> list[str]:
        """Names just below ``name``; none where it isn't."""

    @abc.abstractmethod
    def read_text(self, name: str) -> str | None: ...

    @abc.abstractmethod
    def write_text(self, name: str, text: str) -> None:
        """Replaces at once: no reader sees half of it, or nothing where there was something."""

    @abc.abstractmethod
    def size(self, name: str) -> int:
        """Bytes of all files below ``name``."""

    @abc.abstractmethod
    def append(self, df: DataFrame, name: str) -> None: ...

    @abc.abstractmethod
    def read(self, names: list[str], schema: T.StructType) -> DataFrame: ...


class Store(StoreBase):
    """A folder on any file system that Spark reads."""

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}" if name else self.location)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def delete(self, name: str, tries: int = 10) -> None:
        for k in range(tries):
            fs, p = self._at(name)
            if not fs.exists(p) or fs.delete(p, True):
                return
            time.sleep(0.1 * (k < tries - 1))

    def names(self, name: str) -> list[str]:
        fs, p = self._at(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _plain(self, name: str):
        """Without the checksum file that a local file system puts beside each file: two files can't be renamed at once."""
        fs, p = self._at(name)
        return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), p

    def read_text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        fs, p = self._plain(name)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        fs, p = self._plain(name)
        own = p.suffix(f".{uuid.uuid4().hex}.tmp")
        stream = fs.create(own)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.getUri().getScheme() == "file":  # renames over a file that is there
            fs.rename(own, p)
            return
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(own, p, options)

    def size(self, name: str) -> int:
        fs, p = self._at(name)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(f"{self.location}/{name}")

    def read(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.location}/{n}" for n in names))


_STORES: dict[str, type[StoreBase]] = {"local": Store}


def register_store(name: str, store: type[StoreBase]) -> None:
    if not isinstance(name, str):
        raise ValueError(f"a store's name must be text, not {name!r}")
    if not (isinstance(store, type) and issubclass(store, StoreBase)):
        raise ValueError(f"a store must be a subclass of {StoreBase.__name__}, not {store!r}")
    _STORES[name] = store


def _runs(store: StoreBase, func_id: str) -> tuple[dict[str, dict], dict[str, dict]]:
    """(runs that count, runs that a merged one replaces), by name."""
    found = {}
    for name in store.names(f"functions/{func_id}/runs"):
        text = store.read_text(f"functions/{func_id}/runs/{name}") if name.endswith(".json") else None
        if text:
            found[name[:-5]] = json.loads(text)
    old = {x for r in found.values() for x in r["replaces"]}
    return {k: r for k, r in found.items() if k not in old}, {k: r for k, r in found.items() if k in old}


class Memo:
    """Memo of functions below one location; without a location nothing is kept and every call computes."""

    def __init__(self, spark: SparkSession, location: str | None = None, backend: str = "local", verbose: int = 0):
        if backend not in _STORES:
            raise TypeError(f"unknown store {backend!r}; known: {sorted(_STORES)}")
        self.spark, self.verbose = spark, verbose
        self.store = _STORES[backend](spark, location) if location else None

    def cache(self, function: Callable | None = None, *, schema: str | T.StructType | None = None, ignore: tuple[str, ...] = (), valid_if: Callable[[Column, Column], Column] | None = None):
        """Wraps ``function(row dict) -> dict`` or, used with arguments only, returns a decorator."""
        if function is None:
            return lambda f: self.cache(f, schema=schema, ignore=ignore, valid_if=valid_if)
        if isinstance(function, Memoised):
            function = function.function
        if schema is None:
            raise ValueError("the result's schema must be given")
        return Memoised(self, function, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema, tuple(ignore), valid_if)

    def eval(self, function: Callable, df: DataFrame, schema: str | T.StructType, **how) -> DataFrame:
        return self.cache(function, schema=schema, **how)(df)

    def clear(self) -> None:
        if self.store:
            self.store.delete("")
            _CHECKED.clear()

    def reduce_size(self, bytes_limit: int | str | None = None, items_limit: int | None = None, age_limit: timedelta | None = None, now: datetime | None = None) -> int:
        """Deletes least recently used results beyond the limits, and their bytes; how many."""
        if not self.store or bytes_limit is None and items_limit is None and age_limit is None:
            return 0
        if age_limit is not None and age_limit < timedelta(0):
            raise ValueError("an age can't be negative")
        gone = items_to_delete(self.items().withColumnRenamed(KEY, "item"), now or datetime.now(UTC), bytes_limit, items_limit, age_limit)
        gone = written(gone.select("func_id", F.col("item").alias(KEY)), "evicted")
        n = 0
        for func_id, some in gone.groupBy("func_id").count().collect():  # a row a function
            _rewrite(self.store, func_id, gone.where(F.col("func_id") == func_id).select(KEY))
            n += some
        drop(gone)
        return n

    def items(self) -> DataFrame:
        """func_id, args_id, size_bytes, last_access of all results that are there; a run's bytes are shared out by its results' sizes."""
        store, spark = self.store, self.spark
        functions = store.names("functions") if store else []
        runs = [(f, name, r["bytes"], r["weight"]) for f in functions for name, r in _runs(store, f)[0].items()]
        if not runs:
            return spark.createDataFrame([], "func_id string, args_id string, size_bytes long, last_access timestamp")
        rows = store.read([f"items/{f}/{name}" for f, name, _, _ in runs], T.StructType().add(KEY, "string").add("time", "double").add("size_bytes", "long").add("run", "string"))
        of = spark.createDataFrame(runs, "func_id string, run string, run_bytes long, weight long")
        share = F.ceil(F.col("size_bytes") / F.greatest(F.col("weight"), F.lit(1)) * F.col("run_bytes"))
        made = rows.join(F.broadcast(of), "run").groupBy("func_id", KEY).agg(F.max("time").alias("made"), F.max_by(share, "time").alias("size_bytes"))
        used = [store.read([f"access/{f}/{x}" for x in store.names(f"access/{f}")], _ACCESS).withColumn("func_id", F.lit(f)) for f in functions]
        seen = used[0]
        for more in used[1:]:
            seen = seen.unionByName(more)
        seen = seen.groupBy("func_id", KEY).agg(F.max("time").alias("used"))
        at = F.timestamp_seconds(F.greatest("made", F.coalesce("used", "made")))
        return made.join(seen, ["func_id", KEY], "left").select("func_id", KEY, "size_bytes", at.alias("last_access"))


_ACCESS = T.StructType().add(KEY, "string").add("time", "double")


def _stored_schema(result: T.StructType) -> T.StructType:
    return T.StructType().add(KEY, "string").add("result", result).add("time", "double").add("duration", "double").add("input", "string").add("size_bytes", "long").add("run", "string")


def _commit(store: StoreBase, func_id: str, run: str, replaces: list[str] = ()) -> None:
    """Makes a written run count."""
    weight = store.read([f"items/{func_id}/{run}"], T.StructType().add("size_bytes", "long")).agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    entry = {"bytes": store.size(f"items/{func_id}/{run}"), "weight": weight, "replaces": list(replaces), "at": time.time()}
    store.write_text(f"functions/{func_id}/runs/{run}.json", json.dumps(entry))


def _newest(rows: DataFrame, n_runs: int) -> DataFrame:
    """One row a key. A single run has each key once."""
    if n_runs < 2:
        return rows
    rest = [c for c in rows.columns if c != KEY]
    return rows.groupBy(KEY).agg(F.max_by(F.struct(*rest), "time").alias("r")).select(KEY, "r.*")


def _by_key(df: DataFrame) -> DataFrame:
    return df.repartitionByRange(KEY).sortWithinPartitions(KEY)


def _rewrite(store: StoreBase, func_id: str, gone: DataFrame | None = None) -> None:
    """All runs of a function as one, without the keys in ``gone``; the old ones' bytes go too, at once where keys do."""
    live, old = _runs(store, func_id)
    if live:
        schema = store.spark.read.parquet(f"{store.location}/items/{func_id}/{next(iter(live))}").schema
        rows = _newest(store.read([f"items/{func_id}/{r}" for r in live], schema), len(live))
        if gone is not None:
            rows = rows.join(gone, KEY, "left_anti")
        run = uuid.uuid4().hex
        store.append(_by_key(rows.select(*schema.names).withColumn("run", F.lit(run))), f"items/{func_id}/{run}")
        _commit(store, func_id, run, list(live))
    for name, r in (old | live).items():
        if gone is not None or time.time() - r["at"] > GRACE:
            store.delete(f"functions/{func_id}/runs/{name}.json")
            store.delete(f"items/{func_id}/{name}")
    used = store.names(f"access/{func_id}")
    if len(used) > 1:
        last = written(store.read([f"access/{func_id}/{x}" for x in used], _ACCESS).groupBy(KEY).agg(F.max("time").alias("time")), "access")
        store.append(last if gone is None else last.join(gone, KEY, "left_anti"), f"access/{func_id}/{uuid.uuid4().hex}")
        for x in used:
            store.delete(f"access/{func_id}/{x}")
        drop(last)


class Shelved:
    """A small handle on results: where they are, not what they are. Its text is an expression that makes it again."""

    def __init__(self, location: str, func_id: str, shelf: str, backend: str = "local"):
        self.location, self.func_id, self.shelf, self.backend = location, func_id, shelf, backend
        self.store = _STORES[backend](SparkSession.getActiveSession(), location)

    def _keys(self) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.location}/shelves/{self.func_id}/{self.shelf}")

    def get(self) -> DataFrame:
        """KeyError where a result is gone or can't be read."""
        live = _runs(self.store, self.func_id)[0]
        try:
            keys = self._keys()
            if not live:
                raise KeyError("results are gone from the store")
            schema = self.store.spark.read.parquet(f"{self.location}/items/{self.func_id}/{next(iter(live))}").schema
            rows = _newest(self.store.read([f"items/{self.func_id}/{r}" for r in live], schema), len(live)).select(KEY, "result")
            lost = keys.select(KEY).distinct().join(rows.where("result is not null"), KEY, "left_anti").count()
        except KeyError:
            raise
        except Exception as e:  # noqa: BLE001 - whatever keeps a result from being read
            raise KeyError(f"results can't be read: {e}") from e
        if lost:
            raise KeyError(f"{lost} results are gone from the store")
        return keys.join(rows, KEY).select("row.*", "result.*")

    def clear(self) -> None:
        _rewrite(self.store, self.func_id, self._keys().select(KEY).distinct())

    def __repr__(self) -> str:
        return f"{type(self).__name__}(location={self.location!r}, func_id={self.func_id!r}, shelf={self.shelf!r}, backend={self.backend!r})"


#: Digests of the sources of functions whose store was checked in this process, by store and function.
_CHECKED: dict[tuple[str, str], str] = {}


class Memoised:
    """A function with a memo; called with a table of argument rows it adds the function's columns."""

    def __init__(self, memo: Memo, function: Callable, schema: T.StructType, ignore: tuple[str, ...], valid_if):
        self.memo, self.function, self.schema, self.ignore, self.valid_if = memo, function, schema, ignore, valid_if
        path, name = name_of(function)
        self.func_id = "-".join("".join(c if c.isalnum() or c in "_" else "-" for c in p) for p in (*path, name))
        self.source, _, self.first_line = source_of(function)
        self._stored = _stored_schema(schema)

    # keys and what is there
    def keyed(self, df: DataFrame) -> DataFrame:
        """``row``, all columns of ``df``, and the key."""
        unknown = set(self.ignore) - set(df.columns)
        if unknown:
            raise ValueError(f"arguments to ignore aren't there: {sorted(unknown)}")
        both = set(df.columns) & set(self.schema.names)
        if both:
            raise ValueError(f"results would stand beside arguments of the same name: {sorted(both)}")
        return df.select(F.struct("*").alias("row"), content_key(df.schema, *sorted(df.columns), ignore=self.ignore).alias(KEY))

    def check_code(self) -> bool:
        """Whether stored results belong to this source; those of another are deleted with a warning."""
        store, digest = self.memo.store, hashlib.sha256(self.source.encode()).hexdigest()
        place = (store.location, self.func_id)
        if _CHECKED.get(place) == digest and store.exists(f"functions/{self.func_id}/code.json"):
            return True
        text = store.read_text(f"functions/{self.func_id}/code.json")
        known = json.loads(text) if text else None
        if known and known["source"] == self.source:
            _CHECKED[place] = digest
            return True
        if known:
            why = "another function of this name" if known["first_line"] != self.first_line and self.first_line >= 0 else "the function's code"
            warnings.warn(f"{self.func_id}: {why} replaces the one whose results are stored; these are deleted", CollisionWarning, stacklevel=4)
            self.clear()
        store.write_text(f"functions/{self.func_id}/code.json", json.dumps({"source": self.source, "first_line": self.first_line}))
        _CHECKED[place] = digest
        return False

    def _stored_rows(self, keys: DataFrame | None = None) -> tuple[DataFrame, int]:
        """Rows of all runs, and how many runs there are; with ``keys``, at least all rows of these. Few keys are looked for by value, so other files' ranges are left out."""
        store, live = self.memo.store, _runs(self.memo.store, self.func_id)[0]
        rows = store.read([f"items/{self.func_id}/{r}" for r in live], self._stored)
        if keys is not None and live:
            some = keys.select(KEY).limit(FEW_KEYS + 1).collect()
            if len(some) <= FEW_KEYS:
                rows = rows.where(F.col(KEY).isin([r[KEY] for r in some]))
        return rows, len(live)

    def stored(self, keys: DataFrame | None = None) -> DataFrame:
        """The newest stored row of each key; with ``keys``, at least all rows of these."""
        return _newest(*self._stored_rows(keys))

    def results(self, keys: DataFrame | None = None) -> DataFrame:
        return self.stored(keys).select(KEY, "result")

    def _valid(self, rows: DataFrame, now: datetime | None = None) -> DataFrame:
        if self.valid_if is None:
            return rows
        metadata = F.struct(F.timestamp_seconds("time").alias("time"), F.col("duration"), F.col("input"))
        return rows.where(F.coalesce(self.valid_if(F.lit(now or datetime.now(UTC)).cast("timestamp"), metadata), F.lit(False)))

    def check(self, df: DataFrame, now: datetime | None = None) -> DataFrame:
        """``df`` with ``is_hit``: whether a valid result is there. Nothing runs or changes."""
        if not self.memo.store:
            return df.withColumn("is_hit", F.lit(False))
        there = self._valid(self.stored(), now).select(F.col(KEY), F.lit(True).alias("there"))
        return self.keyed(df).join(there, KEY, "left").select("row.*", F.coalesce("there", F.lit(False)).alias("is_hit"))

    # computing
    def _computed(self, rows: DataFrame, run: str = "") -> DataFrame:
        """Results of ``rows``; of neighbours with the same key only the first is computed."""
        function, schema, names = self.function, to_arrow_schema(self._stored), self.schema.names

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for batch in in_slices(batches):
                out = []
                for r in rows_of(batch):
                    if r[KEY] == last:
                        continue
                    last, began = r[KEY], time.time()
                    result = function(r["row"])
                    now = time.time()
                    out.append({KEY: r[KEY], "result": {k: result[k] for k in names}, "time": now, "duration": now - began, "input": json.dumps({k: repr(v) for k, v in r["row"].items()}), "size_bytes": len(repr(result)), "run": run})
                yield batch_of(out, schema)

        return rows.select("row", KEY).mapInArrow(compute, self._stored)

    def _readable(self, keys: DataFrame) -> None:
        """Reads the runs that a call needs, without a shuffle; those that can't be read are dropped."""
        try:
            self._stored_rows(keys)[0].write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - a store that can't be read costs a computation, no more
            store, bad = self.memo.store, []
            for name in _runs(store, self.func_id)[0]:
                try:
                    store.read([f"items/{self.func_id}/{name}"], self._stored).write.format("noop").mode("overwrite").save()
                except Exception:  # noqa: BLE001
                    bad.append(name)
                    store.delete(f"functions/{self.func_id}/runs/{name}.json")
                    store.delete(f"items/{self.func_id}/{name}")
            if not bad:
                raise
            warnings.warn(f"{self.func_id}: {len(bad)} runs of stored results can't be read ({str(e)[:200]}); computing them again", stacklevel=4)

    def _fill(self, keyed: DataFrame, force: bool = False) -> DataFrame:
        """Computes what isn't there; the distinct keys and how many rows have each, as a table."""
        store, run = self.memo.store, uuid.uuid4().hex
        self.check_code()
        distinct = written(keyed.groupBy(KEY).agg(F.count("*").alias("copies")), "calls")
        if not force:
            self._readable(distinct)
        known = not force and bool(_runs(store, self.func_id)[0])
        misses = written(distinct.join(self._valid(self.stored(distinct)).select(KEY), KEY, "left_anti"), "misses") if known else distinct
        n, most = misses.agg(F.count("*"), F.max("copies")).first()
        if n:
            # a number of tasks of our own: few bytes may be much work, and tasks of few bytes are merged otherwise
            tasks = min(n, max(int(self.memo.spark.conf.get("spark.sql.shuffle.partitions")), self.memo.spark.sparkContext.defaultParallelism))
            rows = keyed.join(misses.select(KEY), KEY, "left_semi") if known and n < distinct.count() else keyed
            if most > MOST_COPIES:  # else all of them would meet in one task
                rows = rows.dropDuplicates([KEY])
            # keys are digests, so their first 28 bits cut them into even ranges without a look at them
            at = F.floor(F.conv(F.substring(KEY, 1, 7), 16, 10).cast("long") * tasks / F.lit(1 << 28)).cast("int")
            store.append(self._computed(rows.repartitionById(tasks, at).sortWithinPartitions(KEY), run), f"items/{self.func_id}/{run}")
            _commit(store, self.func_id, run)
        if misses is not distinct:
            drop(misses)
        began = time.monotonic()
        try:
            store.append(distinct.select(KEY, F.lit(time.time()).alias("time")), f"access/{self.func_id}/{uuid.uuid4().hex}")
        except Exception as e:  # noqa: BLE001 - only the order of eviction suffers
            warnings.warn(f"{self.func_id}: times of use can't be written: {e}", stacklevel=3)
        if time.monotonic() - began > SLOW_WRITE:
            warnings.warn(f"{self.func_id}: writing a call's metadata took {time.monotonic() - began:.1f} s", stacklevel=3)
        if len(_runs(store, self.func_id)[0]) > MOST_RUNS or len(store.names(f"access/{self.func_id}")) > 4 * MOST_RUNS:
            _rewrite(store, self.func_id)
        return distinct

    def __call__(self, df: DataFrame) -> DataFrame:
        """``df`` with the function's columns. Every distinct row without a valid result is computed once."""
        keyed = self.keyed(df)
        if not self.memo.store:
            return keyed.join(self._computed(keyed.dropDuplicates([KEY])).select(KEY, "result"), KEY).select("row.*", "result.*")
        return keyed.join(self.results(self._fill(keyed)), KEY).select("row.*", "result.*")

    def force(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Computes all rows anew; (``df`` with results, metadata)."""
        if not self.memo.store:
            return self(df), self.memo.spark.createDataFrame([], "time double, duration double, input string")
        keyed = self.keyed(df)
        keys = self._fill(keyed, force=True)
        return keyed.join(self.results(keys), KEY).select("row.*", "result.*"), keys.select(KEY).join(self.stored(keys), KEY).select("time", "duration", "input")

    def shelve(self, df: DataFrame) -> Shelved:
        store = self.memo.store
        if not store:
            raise ValueError("a memo without a location keeps nothing to refer to")
        keyed, shelf = self.keyed(df), uuid.uuid4().hex
        self._fill(keyed)
        store.append(keyed, f"shelves/{self.func_id}/{shelf}")
        return Shelved(store.location, self.func_id, shelf, next(k for k, v in _STORES.items() if type(store) is v))

    async def call_async(self, df: DataFrame) -> DataFrame:
        return await asyncio.to_thread(self, df)

    def clear(self) -> None:
        if self.memo.store:
            for part in ("functions", "items", "access", "shelves"):
                self.memo.store.delete(f"{part}/{self.func_id}")
            _CHECKED.pop((self.memo.store.location, self.func_id), None)


def compute_once(df: DataFrame, key: Column, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: list[str], order: str) -> DataFrame:
    """Within one plan: ``function`` over the distinct rows by key, joined back; ``is_hit`` is false for a key's first row.

    ``function`` gets ``key`` and ``columns`` and returns ``key`` and the columns of ``schema``.
    """
    made_kind = T.StructType.fromDDL(f"key string, {schema}")
    both = set(df.columns) & {*made_kind.names, "is_hit"}
    if both:
        raise ValueError(f"results would stand beside columns of the same name: {sorted(both)}")
    kind, names = to_arrow_schema(made_kind), made_kind.names
    keyed = df.select(F.struct("*").alias("row"), key.alias("key"))
    distinct = keyed.select("key", *(F.col(f"row.`{c}`") for c in columns)).dropDuplicates(["key"])
    made = distinct.mapInArrow(lambda batches: (pa.RecordBatch.from_pandas(function(frame_of(b))[names], kind, preserve_index=False) for b in batches), made_kind)
    first = keyed.groupBy("key").agg(F.min(f"row.`{order}`").alias("first"))
    out = keyed.join(made, "key").join(first, "key")
    return out.select("row.*", *(F.col(c) for c in names), (F.col(f"row.`{order}`") != F.col("first")).alias("is_hit"))
