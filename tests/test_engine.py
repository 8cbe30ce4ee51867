import time
import warnings
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.batching import BatchTuner, look_ahead, smoothed, tuned_size
from loomspan.operators.components import connected_components
from loomspan.operators.eviction import items_to_delete
from loomspan.operators.mapper import MapEngine, delayed, run_calls, seeded, tasks
from loomspan.operators.memo import CollisionWarning, Memo, Store, expires_after, register_store
from loomspan.plans import config as C
from loomspan.plans.numbering import numbered
from loomspan.plans.workloads import slice_means
from loomspan.sources import persist as P

SQUARE = "task_id long, y long"


def square(r):
    return {"task_id": r["task_id"], "y": r["x"] ** 2}


@pytest.mark.parametrize("batch_size", ["auto", 1, 3])
@pytest.mark.parametrize("return_as", ["frame", "list", "generator", "generator_unordered"])
def test_map_is_the_comprehension(spark, return_as, batch_size):
    df = tasks(spark, range(5), "x long")
    out = MapEngine(return_as=return_as, batch_size=batch_size)(square, df, SQUARE)
    rows = out.orderBy("task_id").collect() if return_as == "frame" else list(out)
    got = [r.y for r in rows]
    assert (sorted(got) if return_as == "generator_unordered" else got) == [0, 1, 4, 9, 16]


def test_unordered_delivers_the_slow_one_last(spark):
    def slow(r):
        time.sleep(6 if r["x"] == 1 else 0)
        return {"task_id": r["task_id"], "y": r["x"]}

    got = [r.y for r in MapEngine(return_as="generator_unordered", batch_size=1, n_jobs=4)(slow, tasks(spark, range(5), "x long"), SQUARE)]
    assert got[-1] == 1 and sorted(got) == [0, 1, 2, 3, 4]


def test_first_error_ends_all_with_its_own_type(spark):
    def bad(r):
        if r["x"] == 0:
            raise KeyError("this one")
        time.sleep(30)
        return {"task_id": 0, "y": 0}

    began = time.time()
    with pytest.raises(KeyError, match="this one"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        MapEngine(return_as="list", batch_size=1, n_jobs=4)(bad, tasks(spark, range(4), "x long"), SQUARE)
    assert time.time() - began < 25


def test_timeout_and_abandoned(spark):
    def slow(r):
        time.sleep(5)
        return {"task_id": 0, "y": 0}

    with pytest.raises(TimeoutError), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        MapEngine(return_as="list", timeout=0.5)(slow, tasks(spark, [1], "x long"), SQUARE)
    g = MapEngine(return_as="generator", batch_size=1)(square, tasks(spark, range(6), "x long"), SQUARE)
    next(g)
    with pytest.warns(UserWarning, match="abandoned"):
        g.close()


def test_engine_arguments(spark):
    for bad in ({"return_as": "set"}, {"batch_size": 0}, {"n_jobs": 0}):
        with pytest.raises(ValueError):
            MapEngine(**bad).ahead()
    assert MapEngine(n_jobs=3).ahead() == 6 and MapEngine(pre_dispatch="all").ahead() is None
    e = MapEngine(return_as="generator", batch_size=1)
    g = e(square, tasks(spark, range(3), "x long"), SQUARE)
    with pytest.raises(RuntimeError):
        e(square, tasks(spark, range(3), "x long"), SQUARE)
    list(g)
    assert MapEngine(return_as="list")(square, tasks(spark, [], "x long"), SQUARE) == []


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_id").alias("task_id"), "value", "props")
    out = MapEngine(where="value > 100", columns=["task_id", "value"], frames=True)(lambda p: p, df, "task_id long, value double")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_calls_share_memory_and_feed_lazily(spark):
    seen, made = [], []

    def work(i):
        seen.append(i)
        return i * 2

    def feed():
        for i in range(50):
            made.append(i)
            yield delayed(work)(i)

    g = run_calls(feed(), n_jobs=2)
    assert next(g) == 0 and len(made) < 10
    assert [0, *g] == [2 * i for i in range(50)] and sorted(seen) == list(range(50))
    assert list(run_calls((delayed(work)(i) for i in range(3)), backend="sequential")) == [0, 2, 4]
    with pytest.raises(ZeroDivisionError):
        list(run_calls([delayed(lambda: 1 / 0)()]))


def test_seeds_do_not_depend_on_partitions(spark):
    df = spark.range(50)
    a = df.repartition(1).select("id", seeded(3, "id").alias("s"))
    b = df.repartition(7).select("id", seeded(3, "id").alias("s"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_scopes(spark):
    with C.config(n_jobs=3, verbose=5):
        assert C.setting("n_jobs") == 3 and C.setting("n_jobs", 7) == 7
        with C.config(n_jobs=1):
            assert C.setting("n_jobs") == 1 and C.setting("verbose") == 5
        assert C.setting("n_jobs") == 3
    assert C.setting("n_jobs") is None
    with C.config(spark, {"spark.sql.shuffle.partitions": "2"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    for bad in ({"prefer": "workers", "require": "shared"}, {"prefer": "x"}, {"nothing": 1}):
        with pytest.raises(ValueError), C.config(**bad):
            pass
    assert C.active_backend(require="shared").shares and C.active_backend(prefer="threads").name == "threads"
    with pytest.warns(UserWarning, match="isn't registered"):
        assert C.make_backend("nowhere").name == "arrow"
    C.register_backend("own", C.SequentialBackend)
    assert C.make_backend("own").effective_n_jobs(5) == 1
    assert [C.effective_n_jobs(n, 8) for n in (None, 1, -1, -2, -100)] == [1, 1, 8, 7, 1]
    with pytest.raises(ValueError):
        C.effective_n_jobs(0)
    assert C.cpu_count() == 4 and C.threads_per_worker(4, 8)["OMP_NUM_THREADS"] == "2"


def test_tuner_equals_columns(spark):
    samples = [0.0001, 0.001, 0.01, 0.3, 0.05, 5.0, 4.0, 3.0, 0.1, 2.5, 0.02]
    t = BatchTuner()
    for d in samples:
        t.completed(t.size, d)
        t.next_size()
    row = spark.createDataFrame([(samples,)], "d array<double>").select(tuned_size(F.col("d")).alias("n"), smoothed(F.col("d")).alias("s")).first()
    assert row.n == t.size
    s = samples[0]
    for d in samples[1:]:
        s = 0.8 * s + 0.2 * d
    assert row.s == pytest.approx(s)
    assert look_ahead(100, 4, False) == 25 and look_ahead(100, 4, True) == 2 and look_ahead(1, 8, False) == 1
    t.reset()
    t.completed(99, 1.0)
    assert t.smoothed == 0


def brute_evict(items, now, bytes_limit, items_limit, age):
    rows = sorted(items, key=lambda r: (r[2], r[0]))
    total, n, gone = sum(r[1] for r in rows), len(rows), set()
    for name, size, at in rows:
        if (bytes_limit is not None and total > bytes_limit) or (items_limit is not None and n > items_limit) or (age is not None and at <= now - age):
            gone.add(name)
            total, n = total - size, n - 1
        else:
            break
    return gone


@pytest.mark.parametrize("limits", [(2048, None, None), (3072, None, None), (500, None, None), (None, 2, None), (None, 0, None), (None, 10, None), (None, None, timedelta(minutes=5)), (4000, 6, timedelta(minutes=8)), (10**9, None, None)])
def test_eviction(spark, limits):
    now = datetime(2024, 1, 1, 12)
    items = [(f"i{k}", 1000 + k, now - timedelta(minutes=k % 9)) for k in range(10)]
    df = spark.createDataFrame(items, "item string, size_bytes long, last_access timestamp_ntz")
    got = {r.item for r in items_to_delete(df, now, *limits).collect()}
    assert got == brute_evict(items, now, *limits)
    with pytest.raises(ValueError):
        items_to_delete(df, now, age_limit=timedelta(seconds=-1))


def counted(path):
    def f(r):
        with open(path, "a") as out:
            out.write("x")
        if r["x"] < 0:
            raise ValueError("negative")
        return {"y": r["x"] * 2}

    return f


def runs(path):
    return len(path.read_text()) if path.exists() else 0


def test_memo(spark, tmp_path):
    log = tmp_path / "log"
    memo = Memo(spark, f"file://{tmp_path}/memo")
    f = memo.cache(counted(str(log)), schema="y long")
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x long")
    assert sorted(r.y for r in f(df).collect()) == [2, 4, 4, 6] and runs(log) == 3
    assert sorted(r.y for r in f(df.where("x > 1")).collect()) == [4, 4, 6] and runs(log) == 3
    assert {(r.x, r.is_hit) for r in f.check(spark.createDataFrame([(1,), (9,)], "x long")).collect()} == {(1, True), (9, False)}
    out, metadata = f.force(df.where("x = 1"))
    assert out.first().y == 2 and runs(log) == 4 and "x" in metadata.first().input
    shelf = f.shelve(df)
    assert shelf.get().count() == 4
    shelf.clear()
    with pytest.raises(KeyError):
        shelf.get()
    assert f(df).count() == 4 and runs(log) == 7
    assert memo.items().count() == 3 and memo.reduce_size() == 0
    assert memo.reduce_size(items_limit=1) == 2 and memo.items().count() == 1
    with pytest.raises(Exception, match="negative"):
        f(spark.createDataFrame([(-1,)], "x long")).collect()
    assert not f.check(spark.createDataFrame([(-1,)], "x long")).first().is_hit
    f.clear()
    assert not f.check(df).where("is_hit").count()
    memo.clear()
    assert not memo.store.exists("")


def test_memo_ignores_expires_and_sees_new_code(spark, tmp_path):
    memo, log = Memo(spark, f"file://{tmp_path}/memo"), tmp_path / "log"
    df = spark.createDataFrame([(1, "a"), (1, "b")], "x long, note string")
    f = memo.cache(counted(str(log)), schema="y long", ignore=("note",))
    assert f(df).count() == 2 and runs(log) == 1
    g = memo.cache(f, schema="y long", ignore=("note",), valid_if=expires_after(seconds=0))
    g(df)
    assert runs(log) == 2
    with pytest.raises(ValueError):
        memo.cache(f, schema="y long", ignore=("nothing",))(df)
    f.source = "another source"
    with pytest.warns(CollisionWarning):
        f(df)
    none = Memo(spark).cache(counted(str(log)), schema="y long")
    n = runs(log)
    assert none(df.select("x")).count() == 2 and none(df.select("x")).count() == 2 and runs(log) > n
    with pytest.raises(ValueError):
        register_store("x", dict)
    with pytest.raises(TypeError):
        Memo(spark, "x", backend="nowhere")
    register_store("mine", type("Mine", (Store,), {}))
    assert Memo(spark, f"file://{tmp_path}/m2", backend="mine").store


def echo(r):
    return {"seen": repr(r)}


def test_memo_values_and_keys(spark, tmp_path):
    """Microseconds, longs beside nulls, map order, and columns named like ours."""
    log = tmp_path / "log"

    def f(r):
        with open(log, "a") as out:
            out.write("x")
        return {"us": r["t"].microsecond, "back": r["n"], "m_size": len(r["m"])}

    memo = Memo(spark, f"file://{tmp_path}/memo")
    rows = [(datetime(2024, 1, 1, 0, 0, 0, u), n, {"a": 1, "b": 2}, "KEEP", "KEEP") for u in (1, 2) for n in (2**53 + 1, None)]
    df = spark.createDataFrame(rows, "t timestamp, n long, m map<string,int>, args_id string, row string").coalesce(1)
    g = memo.cache(f, schema="us int, back long, m_size int")
    out = g(df)
    assert out.columns == [*df.columns, "us", "back", "m_size"]
    got = out.collect()
    assert sorted((r.us, r.back or 0) for r in got) == [(u, n) for u in (1, 2) for n in (0, 2**53 + 1)] and all(r.back == r.n and r.args_id == r.row == "KEEP" for r in got)
    assert g(df.withColumn("m", F.map_from_entries(F.reverse(F.map_entries("m"))))).count() == 4 and runs(log) == 4
    with pytest.raises(ValueError, match="same name"):
        g(df.withColumn("us", F.lit(1)))


def test_memo_survives_damage(spark, tmp_path):
    log = tmp_path / "log"
    memo = Memo(spark, f"file://{tmp_path}/memo")
    f = memo.cache(counted(str(log)), schema="y long")
    df = spark.createDataFrame([(i,) for i in range(20)], "x long")
    f(df.where("x < 10")).count()
    f(df).count()
    assert runs(log) == 20
    first = next((tmp_path / "memo" / "items").glob("*/*/*.parquet"))
    first.write_bytes(b"PAR1 damaged" * 20)
    for crc in first.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.warns(UserWarning, match="computing them again"):
        assert sorted(r.y for r in f(df).collect()) == [2 * i for i in range(20)]
    assert 20 < runs(log) <= 40
    n = runs(log)
    assert f(df).count() == 20 and runs(log) == n
    # a run without its commit isn't there
    marker = next((tmp_path / "memo" / "functions").glob("*/runs/*.json"))
    marker.unlink()
    assert f(df).count() == 20 and runs(log) > n


def test_memo_moves_keys_and_computes_in_slices(spark, tmp_path, monkeypatch):
    """Rows with their texts aren't written on the way to the store, nor are many made Python values at once."""
    from loomspan.operators import memo as M

    seen, real = [], M.written
    monkeypatch.setattr(M, "written", lambda df, *a: (seen.append(df.columns), real(df, *a))[1])
    docs = spark.range(40).select("id", F.repeat(F.lit("word "), (F.col("id") % 10 + 1).cast("int")).alias("text"))
    f = Memo(spark, f"file://{tmp_path}/m").cache(lambda r: {"n": len(r["text"])}, schema="n long", ignore=("id",))
    for df, copies in ((docs.where("id % 2 = 0"), 1_000), (docs, 1_000), (docs.selectExpr("id", "text || 'x' as text"), 1)):
        monkeypatch.setattr(M, "MOST_COPIES", copies)
        assert sorted((r.id, r.n) for r in f(df).collect()) == sorted((r.id, len(r.text)) for r in df.collect())
    assert f.stored().count() == 20 and all("row" not in c for c in seen)
    batch = pa.RecordBatch.from_pydict({"row": ["x" * 1000] * 101})
    some = list(M.in_slices(iter([batch]), 10_000))
    assert max(b.nbytes for b in some) <= 10_000 and pa.Table.from_batches(some).equals(pa.Table.from_batches([batch]))


def test_memo_eviction_frees_bytes_and_runs_are_merged(spark, tmp_path):
    memo = Memo(spark, f"file://{tmp_path}/memo")
    f = memo.cache(echo, schema="seen string")
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "memo").rglob("*.parquet"))
    for k in range(11):
        f(spark.createDataFrame([(i, "z" * 50) for i in range(5 * k, 5 * k + 5)], "x long, pad string")).count()
    live, old = __import__("loomspan.operators.memo", fromlist=["_runs"])._runs(memo.store, f.func_id)
    assert len(live) <= 8 and old and memo.items().count() == 55
    assert f(spark.createDataFrame([(i, "z" * 50) for i in range(55)], "x long, pad string")).count() == 55
    before, items = size(), memo.items().agg(F.sum("size_bytes")).first()[0]
    assert 0 < items <= before
    assert memo.reduce_size(items_limit=5) == 50 and memo.items().count() == 5 and size() < before / 2
    assert memo.reduce_size(items_limit=0) == 5 and memo.items().count() == 0
    shelf = f.shelve(spark.createDataFrame([(1, "a")], "x long, pad string"))
    from loomspan.operators.memo import Shelved  # noqa: F401 - what the handle's text names

    assert eval(repr(shelf)).get().first().x == 1


def test_texts_are_replaced_at_once(spark, tmp_path):
    """A reader beside a writer sees the old text or the new one, never none."""
    import threading

    store, seen, stop = Store(spark, f"file://{tmp_path}/s"), set(), threading.Event()
    store.write_text("a/b.json", "0" * 1000)

    def read():
        while not stop.is_set():
            seen.add(store.read_text("a/b.json"))

    t = threading.Thread(target=read)
    t.start()
    for i in range(1, 10):
        store.write_text("a/b.json", str(i) * 1000)
    stop.set()
    t.join()
    assert seen <= {str(i) * 1000 for i in range(10)} and store.names("a") == ["b.json"] and store.names("none") == []


def test_codecs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5, [1, 2]), (2, None, None, [])], "i long, s string, f double, a array<long>")
    want = sorted(map(str, df.collect()))
    for k, compress in enumerate([0, True, 3, "gzip", "bz2", "lzma", "xz", ("xz", 9), "lz4" if False else ("gzip", 5)]):
        path = f"{tmp_path}/t{k}"
        assert P.dump(df, path, compress) == [path]
        back = P.load(spark, path, df.schema)
        assert sorted(map(str, back.collect())) == want, compress
    P.dump(df, f"{tmp_path}/byname.xz")
    assert {r.codec for r in P.detect_codec(spark, f"{tmp_path}/byname.xz").collect()} == {"xz"}
    for bad in ((1, 2, 3), ("gzip", 10), "nothing", 11, ("gzip", "3")):
        with pytest.raises(ValueError):
            P.parse_compress(bad)
    with pytest.raises(ValueError):
        P.dump("path", df)
    assert P.parse_compress(0, "a.gz") == ("gzip", 3) and P.parse_compress(("xz", 1), "a.gz") == ("xz", 1) and P.parse_compress(0, "a") == (None, 0)
    with pytest.raises(ValueError):
        P.register_codec("xz", P._CODECS["xz"])
    with pytest.raises(ValueError):
        P.register_codec(1, P._CODECS["xz"])
    P.register_codec("xz", P._CODECS["xz"], force=True)


def test_levels_torn_files_and_byte_order(spark, tmp_path):
    df = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("s"), "id").coalesce(1)
    for codec in ("gzip", "zlib"):
        size = {}
        for level in (1, 9):
            P.dump(df, f"{tmp_path}/{codec}{level}", (codec, level))
            size[level] = sum(p.stat().st_size for p in (tmp_path / f"{codec}{level}").glob("part*"))
        assert size[9] < size[1], codec
    (part,) = (tmp_path / "gzip9").glob("part*")
    import gzip

    part.write_bytes(gzip.compress(gzip.decompress(part.read_bytes())[:-20]))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        P.load(spark, f"{tmp_path}/gzip9", df.schema).collect()
    with pytest.raises(ValueError, match="byte order"):
        P.load(spark, f"{tmp_path}/gzip1", df.schema, mmap_mode="r", ensure_native_byte_order=True)
    with pytest.warns(UserWarning, match="mapped"):
        assert P.load(spark, f"{tmp_path}/gzip1", df.schema, mmap_mode="r").count() == 60_000
    import struct
    import sys

    other = {"little": ">", "big": "<"}[sys.byteorder]
    row = spark.createDataFrame([(struct.pack(f"{other}3i", 1, -2, 3), b"")], "b binary, e binary")
    big = {"<": "little", ">": "big"}[other]
    got = row.select(P.native_order(F.col("b"), 4, big).alias("b"), P.native_order(F.col("e"), 4, big).alias("e"), P.native_order(F.col("b"), 4, sys.byteorder).alias("s")).first()
    assert struct.unpack("=3i", bytes(got.b)) == (1, -2, 3) and bytes(got.e) == b"" and bytes(got.s) == bytes(row.first().b)


def test_no_machine_local_scratch_on_a_cluster(spark):
    from types import SimpleNamespace

    from loomspan.plans import scratch

    own = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {}, master=master), conf=SimpleNamespace(get=lambda *a: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="share"):
            scratch.shared_dir(own(master))


def test_logs(spark, tmp_path, caplog):
    from loomspan.functions.scalars import disk_used
    from loomspan.plans.logs import Logger, PrintTime

    log = Logger(name="loom")
    log.warn("said")
    assert "said" in caplog.text and "[...]" in log.format([[[[[1]]]]])
    for k in range(3):
        PrintTime(str(tmp_path / "t.log"))(f"step {k}", total=k > 1)
    assert [(tmp_path / n).read_text()[:6] for n in ("t.log", "t.log.1", "t.log.2")] == ["step 2", "step 1", "step 0"]
    assert disk_used(spark, f"file://{tmp_path}") >= 1 and disk_used(spark, f"file://{tmp_path}/none") == 0


def whole_numbers(r):
    return {"task_id": r["task_id"], "y": r["n"]}


def test_list_modes_lose_nothing(spark):
    """Nulls, negative, far apart and repeated ids; longs beside nulls; one scan."""
    rows = [(i, n) for i, n in zip([-1, 0, None, 3, 3, 2**40, None], [2**53 + 1, None, 1, 2, 2, 3, 4], strict=True)]
    df = spark.createDataFrame(rows, "task_id long, n long")
    for mode in ("frame", "list", "generator", "generator_unordered"):
        for batch in (1, 3, "auto"):
            got = MapEngine(return_as=mode, batch_size=batch, n_jobs=3)(whole_numbers, df, "task_id long, y long")
            found = [(r.task_id, r.y) for r in (got.collect() if mode == "frame" else got)]
            assert sorted(map(str, found)) == sorted(map(str, rows)), (mode, batch)
            if mode in ("list", "generator"):
                assert [i for i, _ in found] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    ids = spark.range(100).repartition(6).select(F.monotonically_increasing_id().alias("task_id"), F.col("id").alias("n"))
    assert sorted(r.y for r in MapEngine(return_as="list")(whole_numbers, ids, "task_id long, y long")) == list(range(100))
    frames = MapEngine(frames=True)(lambda p: p.rename(columns={"n": "y"}), df, "task_id long, y long").collect()
    assert sorted(map(str, ((r.task_id, r.y) for r in frames))) == sorted(map(str, rows))


def test_auto_batches_grow(spark):
    """Quick tasks: batches double while they are short, and all places are covered once."""
    e = MapEngine(return_as="list", n_jobs=4)
    sizes = []
    real = e._sizes
    e._sizes = lambda n, b: (sizes.append(x[1]) or x for x in real(n, b))
    assert [r.y for r in e(square, tasks(spark, range(3000), "x long"), SQUARE)] == [i * i for i in range(3000)]
    assert sizes[0] == 1 and max(sizes) >= 8 and sum(sizes) == 3000
    one = MapEngine(return_as="list", backend="threads", n_jobs=2)
    sizes.clear()
    real = one._sizes
    one._sizes = lambda n, b: (sizes.append(x[1]) or x for x in real(n, b))
    assert len(one(square, tasks(spark, range(5), "x long"), SQUARE)) == 5 and sizes == [1] * 5


@pytest.mark.parametrize("name", ["map_list_all_ids", "map_auto_batches"])
def test_queries_of_lists_keep_rows_off_the_driver(spark, monkeypatch, name):
    from loomspan.queries import QUERIES

    most, real = [0], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: (out := real(df), most.append(len(out)))[0])
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 1000 and max(most) < 100


def test_tables_are_the_lists(spark):
    rows = [(i, n) for i, n in zip([-1, 0, None, 3, 3, 2**40, None, *range(50, 80)], [2**53 + 1, None, 1, 2, 2, 3, 4, *range(30)], strict=True)]
    df = spark.createDataFrame(rows, "task_id long, n long").repartition(3)
    for mode, batch in (("frame", "auto"), ("list", 7), ("generator_unordered", "auto")):
        got = MapEngine(return_as=mode, batch_size=batch, n_jobs=2).table(whole_numbers, df, "task_id long, y long")
        assert sorted(map(str, ((r.task_id, r.y) for r in got.collect()))) == sorted(map(str, rows)), (mode, batch)
    here = MapEngine(return_as="list", backend="threads", n_jobs=2).table(whole_numbers, df, "task_id long, y long")
    assert sorted(map(str, ((r.task_id, r.y) for r in here.collect()))) == sorted(map(str, rows))
    of = MapEngine(return_as="list", batch_size=7, frames=True, n_jobs=2).table(lambda p: p.assign(y=len(p))[["task_id", "y"]], df, "task_id long, y long")
    assert {r.y: r.n for r in of.groupBy("y").agg(F.count("*").alias("n")).collect()} == {7: 35, 2: 2}
    assert MapEngine(return_as="list").table(whole_numbers, df.limit(0), "task_id long, y long").collect() == []

    def bad(r):
        raise KeyError("this one")

    with pytest.raises(KeyError, match="this one"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        MapEngine(return_as="list", batch_size=7, n_jobs=2).table(bad, df, SQUARE)


class Counting(C.ThreadBackend):
    name = "counting"
    made: list = []

    def start(self, spark):
        super().start(spark)
        Counting.made.append("start")

    def submit(self, call):
        Counting.made.append("call")
        return super().submit(call)


def test_backends_run_the_batches(spark):
    seen = []

    def here(r):
        seen.append(r["x"])
        return square(r)

    df = tasks(spark, range(6), "x long")
    C.register_backend("counting", Counting)
    with MapEngine(return_as="list", backend="counting", batch_size=2) as e:
        assert len(e(here, df, SQUARE)) == len(e(here, df, SQUARE)) == 6
    assert Counting.made == ["start", *["call"] * 6] and sorted(seen) == sorted([*range(6)] * 2)
    for how in ({"require": "shared"}, {"prefer": "threads"}, {"n_jobs": 1}):
        seen.clear()
        assert [r.y for r in MapEngine(return_as="list", **how)(here, df, SQUARE)] == [i * i for i in range(6)] and sorted(seen) == list(range(6)), how
    seen.clear()
    g = MapEngine(return_as="generator", n_jobs=1, timeout=0.0)(here, df, SQUARE)
    assert next(g).y == 0 and seen == [0] and len(list(g)) == 5
    assert MapEngine(return_as="list")(square, df, SQUARE) and seen == list(range(6))

    class Falls(C.ArrowBackend):
        def start(self, spark):
            raise C.FallbackToBackend(C.SequentialBackend())

    seen.clear()
    assert len(MapEngine(return_as="list", backend=Falls())(here, df, SQUARE)) == 6 == len(seen)
    C.register_external("elsewhere", lambda: C.register_backend("elsewhere", C.ThreadBackend))
    assert C.make_backend("elsewhere").name == "threads"
    with C.legacy_backend("threads", n_jobs=3) as (b, n):
        assert b.name == "threads" and n == 3 and C.active_backend() is b and MapEngine(return_as="list").n_jobs == 3
    assert C.active_backend().name == "arrow" and 1 <= C.cpu_count(only_physical=True) <= 4


def test_scope_initialiser_and_shared_arguments(spark, tmp_path):
    import functools

    import numpy as np

    from loomspan.plans import sharing

    def told(r):
        return {"task_id": r["task_id"], "v": C.setting("verbose"), "b": str(C.setting("backend"))}

    df = tasks(spark, range(4), "x long")
    with C.config(verbose=7):
        rows = MapEngine(verbose=0)(told, df, "task_id long, v int, b string").collect()
    assert {(r.v, r.b) for r in rows} == {(7, "sequential")}
    MapEngine(initializer=lambda p: open(p, "a").write("x"), initargs=(str(tmp_path / "init"),))(square, df.repartition(4), SQUARE).collect()
    assert 1 <= len((tmp_path / "init").read_text()) <= 8
    big, small = np.arange(300_000, dtype=np.int64), np.arange(100)

    def look(big, small, r):
        return {"task_id": r["task_id"], "y": int(big[r["x"]] + small[r["x"]] + len(big))}

    sharing._SHARED.clear()
    for mode in ("frame", "list"):
        out = MapEngine(return_as=mode)(functools.partial(look, big, small), df, SQUARE)
        assert sorted(r.y for r in (out.collect() if mode == "frame" else out)) == [300_000 + 2 * i for i in range(4)]
    assert len(sharing._SHARED) == 1 and sharing.is_shared(spark, big) and not sharing.is_shared(spark, small)
    a, b, c = sharing.scatter(spark, [big, small, big])
    assert a is c and a.path and b.broadcast is not None and (a.value == big).all() and (b.value == small).all()
    assert not sharing.worth_sharing(np.array([None] * 1000, object), 10)
    import random

    once = MapEngine(deterministic=False)(lambda r: {"task_id": r["task_id"], "y": random.getrandbits(60)}, df, SQUARE)
    assert sorted(once.collect()) == sorted(once.collect())


def test_numbers_and_components(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(100)], "k long, v long").repartition(4)
    rows = numbered(df, "k", sum_of="v").orderBy("k").collect()
    assert [r.position for r in rows] == list(range(100))
    assert [r.before for r in rows] == [sum(x.v for x in rows[:i]) for i in range(100)]
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 100), (5, 3), (200, 199), (200, 198)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40)) and got[200] == 198 and 100 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slices(spark):
    n, w, s = 100, 30, 7
    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "i long, v double")
    got = {r.slice: r.mean_value for r in slice_means(df, "i", "v", w, s, n).collect()}
    assert got == {k: sum(range(k * s, k * s + w)) / w for k in range(len(range(0, n - w, s)))}


def test_streaming(spark, tmp_path):
    from loomspan.streaming import first_calls, running_smoothed

    src = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/*events.parquet")
    q = running_smoothed(src.select("user_id", (F.col("value") / 100).alias("d")), "user_id", "d").writeStream.outputMode("update").format("memory").queryName("smoothed").start()
    q.processAllAvailable()
    q.stop()
    users = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
    assert spark.table("smoothed").count() == users
    q = first_calls(src.select("ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "40 days").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == spark.table("firsts").select("user_id", "event_type").distinct().count() > 0


