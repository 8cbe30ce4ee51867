"""One query per operator with a tabular result, over the test tables, and the SQL that states the same.

Names of Spark columns and SQL columns are the same; sums of doubles are rounded or made over
decimals, counts are longs.
"""

from __future__ import annotations

import functools
import math
import warnings
from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import hashing as H
from loomspan.functions import scalars as S
from loomspan.functions.inspection import bound_arguments
from loomspan.operators import batching as B
from loomspan.operators.eviction import items_to_delete
from loomspan.operators.mapper import MapEngine, seeded
from loomspan.operators.memo import Memo, compute_once, expires_after
from loomspan.plans.config import effective_n_jobs_col
from loomspan.plans.numbering import numbered
from loomspan.plans.workloads import grid, shared_by_size, slice_means
from loomspan.plans.scratch import scratch_path
from loomspan.sources.persist import codec_col, detect_codec, dump, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WEEK = datetime(2024, 1, 31)


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- map
@query("select event_id as task_id, value * value as y from events where value > 100")
def map_squares(spark, d):
    events = _t(spark, d, "events").select(F.col("event_id").alias("task_id"), "value")
    engine = MapEngine(where="value > 100", columns=["task_id", "value"], frames=True)
    return engine(lambda df: df.assign(y=df["value"] * df["value"])[["task_id", "y"]], events, "task_id long, y double")


@query("select event_id as task_id, case when event_id % 2 = 0 then value + 1 else value * 2 end as y from events")
def map_mixed_functions(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("task_id"), "value")
    add, double = (MapEngine(where=f"task_id % 2 = {k}", frames=True) for k in (0, 1))
    one = add(lambda df: pd.DataFrame({"task_id": df["task_id"], "y": df["value"] + 1}), e, "task_id long, y double")
    return one.unionByName(double(lambda df: pd.DataFrame({"task_id": df["task_id"], "y": df["value"] * 2}), e, "task_id long, y double"))


@query("select event_id as task_id, floor(value)::bigint as whole, round(value - floor(value), 6) as rest from events")
def map_multi_value(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("task_id"), "value")
    parts = lambda r: {"task_id": r["task_id"], "whole": math.floor(r["value"]), "rest": round(r["value"] - math.floor(r["value"]), 6)}
    return MapEngine()(parts, e, "task_id long, whole long, rest double")


@query("select user_id, count(*) as n_parts from (select user_id, unnest(range(0, (event_id % 3 + 1)::bigint)) as part from events) group by user_id")
def map_one_to_many(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id")
    several = lambda df: df.loc[df.index.repeat(df["event_id"] % 3 + 1), ["user_id"]]
    return MapEngine(frames=True)(several, e, "user_id long").groupBy("user_id").agg(F.count("*").alias("n_parts"))


@query(None)
def map_seeded(spark, d):
    """Each task draws by its own seed; the same in any partitioning."""
    return _t(spark, d, "events").select(F.col("event_id").alias("task_id"), (F.pmod(seeded(7, "event_id"), F.lit(1_000_000)) / 1_000_000).alias("draw"))


# --- workloads
@query("""
with n as (select row_number() over (order by event_id) - 1 as i, value from events),
s as (select unnest(range(0, (select (count(*) - 501) // 100 + 1 from events))) as slice)
select slice, round(avg(value), 6) as mean_value, count(*) as n_values from s join n on i >= slice * 100 and i < slice * 100 + 500 group by slice""")
def slice_mean(spark, d):
    events = _t(spark, d, "events")
    rows = numbered(events.select("event_id", "value"), "event_id", as_="i")
    return slice_means(rows, "i", "value", 500, 100, events.count()).withColumn("mean_value", F.round("mean_value", 6))


@query("select l_returnflag, sum(l_extendedprice::decimal(18,2))::decimal(28,2) as total, count(*) as n from lineitem group by l_returnflag")
def stream_fold(spark, d):
    """Each batch is folded where it is; the folds' sums meet in one shuffle of few rows."""
    df = _t(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        cents = (rows["l_extendedprice"] * 100).round().astype("int64")
        return cents.groupby(rows["l_returnflag"]).agg(cents="sum", n="count").reset_index()

    folds = MapEngine(frames=True)(fold, df, "l_returnflag string, cents long, n long")
    return folds.groupBy("l_returnflag").agg((F.sum(F.col("cents").cast("decimal(26,0)")) / 100).cast("decimal(28,2)").alias("total"), F.sum("n").alias("n"))


@query("select event_id as task_id, value + 1 as y from events")
def map_list_all_ids(spark, d):
    """The list mode's batches over ids that are neither dense nor in order, kept as a table: a list of all rows is more than a driver holds."""
    e = _t(spark, d, "events").select((F.col("event_id") * 1_000_003 - 5_000_000).alias("task_id"), "event_id", "value")
    return MapEngine(return_as="list", batch_size=2500).table(lambda r: {"task_id": r["event_id"], "y": r["value"] + 1}, e, "task_id long, y double")


@query("select l_orderkey * 8 + l_linenumber as task_id, l_quantity::bigint as y from lineitem")
def map_auto_batches(spark, d):
    """The unordered iterator with batches that the tuner makes, kept as a table."""
    e = _t(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("task_id"), F.col("l_quantity").cast("long").alias("y"))
    return MapEngine(return_as="generator_unordered").table(dict, e, "task_id long, y long")


@query("select o_orderkey as task_id, ((o_orderkey % 1000) * (o_orderkey % 1000))::bigint as y from orders")
def map_shared_argument(spark, d):
    """A large argument that is sent once and looked up by every task."""
    table = np.arange(1000, dtype=np.int64) ** 2
    look = lambda table, df: pd.DataFrame({"task_id": df["o_orderkey"], "y": table[df["o_orderkey"] % 1000]})
    return MapEngine(frames=True, max_bytes="1K")(functools.partial(look, table), _t(spark, d, "orders").select("o_orderkey"), "task_id long, y long")


@query("""
select vec_id, 'largest' as parameter, list_max(embedding)::double as result from embeddings
union all select vec_id, 'smallest', list_min(embedding)::double from embeddings""")
def param_grid(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    return grid(e, {"largest": F.array_max("embedding"), "smallest": F.array_min("embedding")}).drop("embedding")


@query("select doc_id, strlen(text) as n_bytes, strlen(text) > 2048 as shared from documents")
def share_by_size(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return docs.withColumn("shared", shared_by_size(F.col("n_bytes"), F.lit(False), 2048))


# --- batches, progress
@query("select event_id, (row_number() over (order by event_id) - 1) // 64 as batch from events")
def batch_fixed(spark, d):
    events = numbered(_t(spark, d, "events").select("event_id"), "event_id")
    return events.select("event_id", B.batch_number(F.col("position") + 1, 64).alias("batch"))


@query("select user_id, n, greatest(1, n // 4) as piece, greatest(1, n // 40) as last_piece from (select user_id, count(*) as n from events group by user_id)")
def batch_lookahead(spark, d):
    n = F.col("n")
    pulled = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return pulled.select("user_id", "n", B.look_ahead_col(n, 4, False).alias("piece"), B.look_ahead_col(n, 4, True).alias("last_piece"))


def _durations(spark, d) -> DataFrame:
    e = _t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("value") / 100).alias("d")))).alias("s"))
    return e.select("user_id", F.transform("s", lambda x: x["d"]).alias("d"))


_FOLD = """
with recursive s as (select user_id, value / 100 as d, row_number() over (partition by user_id order by ts, event_id) as k from events),
"""


@query(_FOLD + """f as (
    select user_id, k, d::double as a from s where k = 1
    union all select s.user_id, s.k, case when f.a = 0 then s.d else 0.8 * f.a + (1 - 0.8::double) * s.d end from f join s on s.user_id = f.user_id and s.k = f.k + 1)
select user_id, round(arg_max(a, k), 6) as smoothed from f group by user_id""")
def batch_smoothed(spark, d):
    return _durations(spark, d).select("user_id", F.round(B.smoothed(F.col("d")), 6).alias("smoothed"))


@query(_FOLD + """g as (
    select user_id, 0::bigint as k, 1::bigint as size, 0::double as a from s where k = 1
    union all
    select user_id, k, new, case when new <> size then 0 else x end from (
        select *, case when x > 0 and x < 0.2 then greatest(1, least(2 * size, 2 * floor(size * 0.2 / x)))::bigint
            when x > 2 and size >= 2 then greatest(1, 2 * floor(size * 0.2 / x))::bigint else size end as new
        from (select s.user_id, s.k, g.size, case when g.a = 0 then s.d else 0.8 * g.a + (1 - 0.8::double) * s.d end as x from g join s on s.user_id = g.user_id and s.k = g.k + 1)))
select user_id, arg_max(size, k) as batch_size from g group by user_id""")
def batch_auto_size(spark, d):
    return _durations(spark, d).select("user_id", B.tuned_size(F.col("d")).alias("batch_size"))


@query("""
with n as (select event_id, row_number() over (order by event_id) - 1 as i from events)
select event_id, i as task_index from n where i <> 0 and floor(sqrt(i / 18.0::double)) = floor(sqrt((i + 1) / 18.0::double)) is not true or i = 0""")
def progress_visible(spark, d):
    n = numbered(_t(spark, d, "events").select("event_id"), "event_id", as_="task_index")
    return n.where(~S.is_silent_col(F.col("task_index"), 5))


@query("select event_id, round(value / greatest(event_id, 1) * ((select count(*) from events) - event_id), 6) as eta from events")
def progress_eta(spark, d):
    events = _t(spark, d, "events")
    return events.select("event_id", F.round(S.remaining_time(F.col("value"), F.col("event_id"), F.lit(events.count())), 6).alias("eta"))


@query("""
select n_nationkey, case when n_nationkey = 12 then 1 when n_nationkey > 12 then n_nationkey - 12 else greatest(n_nationkey - 3, 1) end::int as jobs from nation""")
def effective_jobs(spark, d):
    jobs = F.when(F.col("n_nationkey") != 12, F.col("n_nationkey") - 12)
    return _t(spark, d, "nation").select("n_nationkey", effective_n_jobs_col(jobs, 8).cast("int").alias("jobs"))


@query("""
select p_partkey, (p_size / 2.0 * case p_partkey % 3 when 0 then 1024 when 1 then 1048576 else 1073741824 end)::bigint as n_bytes from part""")
def size_text(spark, d):
    unit = F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("G")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.concat((F.col("p_size") / 2).cast("string"), unit)
    return _t(spark, d, "part").select("p_partkey", S.size_bytes_col(text).alias("n_bytes"))


@query("select p_partkey, row_number() over (order by p_partkey % 7, p_partkey // 7) - 1 as place from part")
def version_order(spark, d):
    df = _t(spark, d, "part").select("p_partkey", F.concat_ws(".", F.col("p_partkey") % 7, F.floor(F.col("p_partkey") / 7)).alias("version"))
    return numbered(df, S.version_key(F.col("version")), as_="place").select("p_partkey", "place")


@query("select doc_id, case when doc_id % 4 = 0 then -1 else doc_id * 3 end::int as line from documents")
def stored_code_line(spark, d):
    code = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat(F.lit("# first line: "), (F.col("doc_id") * 3).cast("string"), F.lit("\n"), F.col("text")))
    return _t(spark, d, "documents").select("doc_id", S.stored_first_line(code).cast("int").alias("line"))


# --- hashes
@query("""
select doc_id, md5(from_hex('800358') || from_hex(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) || encode(text) || from_hex('2E')) as digest
from (select *, printf('%08x', strlen(text)) as h from documents)""")
def hash_str_exact(spark, d):
    return _t(spark, d, "documents").select("doc_id", H.exact_str(F.col("text")).alias("digest"))


@query("""
select o_orderkey, md5(from_hex('8003' || case when o_orderkey < 256 then '4B' || substr(h, 7, 2) when o_orderkey < 65536 then '4D' || substr(h, 7, 2) || substr(h, 5, 2)
    else '4A' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) end || '2E')) as digest
from (select o_orderkey, printf('%08x', o_orderkey) as h from orders)""")
def hash_int_exact(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", H.exact_int(F.col("o_orderkey")).alias("digest"))


@query("select l_orderkey, l_linenumber, md5(from_hex('800347') || l_extendedprice::bit::blob || from_hex('2E')) as digest from lineitem")
def hash_float_exact(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", H.exact_float("l_extendedprice").alias("digest"))


@query("""
with v as (select vec_id, len(embedding) as n, list_transform(embedding, lambda x: hex(x::bit::blob)) as h from embeddings),
r as (select vec_id, n, array_to_string(list_transform(h, lambda x: x[7:8] || x[5:6] || x[3:4] || x[1:2]), '') as raw, printf('%08x', 4 * n) as c from v)
select vec_id, md5(from_hex('80039328' || '5807000000' || hex('float32') || '5D7100' || '4B' || printf('%02X', n) || '61' || '580100000043'
    || case when 4 * n < 256 then '43' || printf('%02X', 4 * n) else '42' || c[7:8] || c[5:6] || c[3:4] || c[1:2] end || raw || '7471012E')) as digest from r""")
def hash_vector(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", H.exact_vector("embedding").alias("digest"))


@query("""
select doc_id, sha1(from_hex('800358') || from_hex(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) || encode(text) || from_hex('2E')) as digest
from (select *, printf('%08x', strlen(text)) as h from documents)""")
def hash_sha1(spark, d):
    return _t(spark, d, "documents").select("doc_id", H.exact_str(F.col("text"), "sha1").alias("digest"))


@query("""
select user_id, md5(string_agg(x, '' order by x)) as digest from (select distinct user_id, 'S' || strlen(event_type) || ':' || event_type as x from events) group by user_id""")
def hash_set_order_free(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(H.set_key(F.collect_list("event_type"), T.StringType()).alias("digest"))


@query("""
select user_id, md5('{' || string_agg(x, '' order by x) || '}') as digest
from (select user_id, 'S' || strlen(event_type) || ':' || event_type || 'I' || count(*) || ';' as x from events group by user_id, event_type) group by user_id""")
def hash_map_order_free(spark, d):
    n = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    made = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return made.select("user_id", H.map_key(F.col("m"), made.schema["m"].dataType).alias("digest"))


# --- memo
@query("""
select doc_id, md5(text) as key, len(string_split(text, ' '))::bigint as n_parts, length(text) as n_signs, row_number() over (partition by text order by doc_id) > 1 as is_hit
from documents""")
def memo_compute_once(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    stats = lambda df: pd.DataFrame({"key": df["key"], "n_parts": df["text"].str.split(" ").str.len(), "n_signs": df["text"].str.len()})
    out = compute_once(docs, F.md5("text"), stats, "n_parts long, n_signs long", ["text"], "doc_id")
    return out.select("doc_id", "key", "n_parts", "n_signs", "is_hit")


@query("select doc_id, md5('S' || strlen(lang) || ':' || lang || 'S' || strlen(source) || ':' || source || 'I' || n_chars || ';') as args_id from documents")
def memo_arg_key(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", H.content_key(docs.schema, "lang", "source", "n_chars").alias("args_id"))


@query("select doc_id, md5('S' || strlen(lang) || ':' || lang || 'I' || n_chars || ';') as args_id from documents")
def memo_ignore_arg(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", H.content_key(docs.schema, "lang", "source", "n_chars", ignore=("source",)).alias("args_id"))


def _memo(spark: SparkSession) -> Memo:
    return Memo(spark, scratch_path(spark, "memo"))


def _text_stats(r: dict) -> dict:
    return {"n_parts": len(r["text"].split(" ")), "n_signs": len(r["text"])}


_STATS = "n_parts long, n_signs long"
_TEXT_KEYS = "select distinct md5('S' || strlen(text) || ':' || text) as args_id from documents"


@query("select doc_id, len(string_split(text, ' '))::bigint as n_parts, length(text) as n_signs from documents")
def memo_store_roundtrip(spark, d):
    """Computed by one call, kept, and read by the next: the function of the second is never run."""
    docs, f = _t(spark, d, "documents").select("doc_id", "text"), _memo(spark).cache(_text_stats, schema=_STATS, ignore=("doc_id",))
    f(docs)
    f.function = None
    return f(docs).select("doc_id", "n_parts", "n_signs")


@query("select event_id, event_id as us from events")
def memo_timestamp_keys(spark, d):
    """Calls that differ by one microsecond are different calls."""
    e = _t(spark, d, "events").select("event_id", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("event_id")).alias("t"))
    f = _memo(spark).cache(lambda r: {"us": r["t"].second * 1_000_000 + r["t"].microsecond}, schema="us long", ignore=("event_id",))
    return f(e).select("event_id", "us")


@query(f"select args_id from ({_TEXT_KEYS}) order by args_id desc limit 100")
def memo_evicted_store(spark, d):
    """What is left after eviction; all were used at once, so ties go by key."""
    memo = _memo(spark)
    memo.cache(_text_stats, schema=_STATS)(_t(spark, d, "documents").select("text"))
    memo.reduce_size(items_limit=100)
    return memo.items().select("args_id")


@query("select doc_id, len(string_split(text, ' '))::bigint as n_parts, length(text) as n_signs from documents")
def memo_damaged_store(spark, d):
    """A call whose stored results can't be read any more."""
    memo, docs = _memo(spark), _t(spark, d, "documents").select("doc_id", "text")
    f = memo.cache(_text_stats, schema=_STATS, ignore=("doc_id",))
    f(docs)
    run = memo.store.names(f"items/{f.func_id}")[0]
    file = next(n for n in memo.store.names(f"items/{f.func_id}/{run}") if n.endswith(".parquet"))
    memo.store.delete(f"items/{f.func_id}/{run}/{file}")
    memo.store.write_text(f"items/{f.func_id}/{run}/{file}", "damaged")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f(docs).select("doc_id", "n_parts", "n_signs")


@query("select doc_id, exists (select 1 from documents e where e.doc_id % 2 = 0 and e.text = d.text) as is_hit from documents d")
def memo_hit_flag(spark, d):
    docs, f = _t(spark, d, "documents").select("doc_id", "text"), _memo(spark).cache(_text_stats, schema=_STATS, ignore=("doc_id",))
    f(docs.where("doc_id % 2 = 0"))
    return f.check(docs).select("doc_id", "is_hit")


_SPLIT = "with c as (select distinct user_id, event_type from events where ts < timestamp '2024-01-03'), r as (select * from events where ts >= timestamp '2024-01-03')\n"


def _requests(spark, d) -> DataFrame:
    """Later events, marked whether an earlier one had the same user and type."""
    e, split = _t(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), F.lit("2024-01-03").cast("timestamp_ntz")
    f = _memo(spark).cache(lambda r: {"name": f"{r['user_id']}-{r['event_type']}"}, schema="name string", ignore=("event_id", "ts"))
    f(e.where(F.col("ts") < split))
    return f.check(e.where(F.col("ts") >= split))


@query(_SPLIT + "select event_id from r where not exists (select 1 from c where c.user_id = r.user_id and c.event_type = r.event_type)")
def memo_miss_anti(spark, d):
    return _requests(spark, d).where("not is_hit").select("event_id")


@query(_SPLIT + "select event_id from r where exists (select 1 from c where c.user_id = r.user_id and c.event_type = r.event_type)")
def memo_hit_semi(spark, d):
    return _requests(spark, d).where("is_hit").select("event_id")


@query("select event_id from events where timestamp '2024-01-31' - ts < interval 3 day")
def memo_expire(spark, d):
    valid = expires_after(days=3)(F.lit(WEEK).cast("timestamp_ntz"), F.struct(F.col("ts").alias("time")))
    return _t(spark, d, "events").where(valid).select("event_id")


@query("select event_id from events where value > 50")
def memo_validate_duration(spark, d):
    """Stored rows that a callback on their metadata lets pass."""
    f = Memo(spark).cache(_text_stats, schema=_STATS, valid_if=lambda now, metadata: metadata["duration"] > 50)
    rows = _t(spark, d, "events").select("event_id", F.col("event_id").cast("double").alias("time"), F.col("value").alias("duration"), F.lit("").alias("input"))
    return f._valid(rows).select("event_id")


def _bound(x, y=7, *, z=1): ...


@query("select n_nationkey as n, n_regionkey as x, case when n_nationkey % 3 = 0 then 7 else n_nationkey end as y, 1 as z from nation")
def bind_defaults(spark, d):
    """Arguments by name, defaults filled in; some rows leave out the second."""

    def bind(r):
        args = (r["n_regionkey"],) if r["n_nationkey"] % 3 == 0 else (r["n_regionkey"], r["n_nationkey"])
        return {"n": r["n_nationkey"], **bound_arguments(_bound, [], args)}

    return MapEngine()(bind, _t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n int, x int, y int, z int")


# --- store
@query(_TEXT_KEYS)
def store_item_listing(spark, d):
    memo = _memo(spark)
    memo.cache(_text_stats, schema=_STATS)(_t(spark, d, "documents").select("text"))
    return memo.items().where("size_bytes > 0").select("args_id")


_ITEMS = """
with i as (select md5(text) as item, min(doc_id) as doc, max(n_chars)::bigint as size_bytes from documents group by text),
a as (select item, size_bytes, timestamp '2024-01-01' + to_minutes(((doc * 7919) % 1000 * 10)::int) as last_access from i),
w as (select *, coalesce(sum(size_bytes) over o, 0) as before, count(*) over o as rank0, sum(size_bytes) over () as total, count(*) over () as n
    from a window o as (order by last_access, item rows between unbounded preceding and 1 preceding))
"""
_AGE = "last_access <= timestamp '2024-01-31' - interval 26 day"


def _items(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").groupBy(F.md5("text").alias("item")).agg(F.min("doc_id").alias("doc"), F.max("n_chars").alias("size_bytes"))
    minutes = ((F.col("doc") * 7919) % 1000 * 10).cast("int")
    return docs.select("item", "size_bytes", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("last_access"))


def _eviction(name: str, condition: str, **limits) -> None:
    def f(spark, d):
        return items_to_delete(_items(spark, d), WEEK, **limits).select("item", "size_bytes")

    f.__name__ = name
    query(f"{_ITEMS} select item, size_bytes from w where {condition}")(f)


_eviction("store_evict_bytes", "before < total - 500 * 1024", bytes_limit="500K")
_eviction("store_evict_items", "rank0 < n - 100", items_limit=100)
_eviction("store_evict_age", _AGE, age_limit=timedelta(days=26))
_eviction("store_evict_lru", f"before < total - 1048576 or rank0 < n - 400 or {_AGE}", bytes_limit="1M", items_limit=400, age_limit=timedelta(days=26))


# --- persistence
_CODECS = ("zlib", "gzip", "bz2", "lzma", "xz")


@query(f"select codec, n_nationkey, n_name from nation, (values {', '.join(f'({c!r})' for c in (*_CODECS, 'none'))}) t(codec)")
def persist_roundtrip(spark, d):
    """A table dumped and loaded by each codec, and by none."""
    nation, out = _t(spark, d, "nation").select("n_nationkey", "n_name"), None
    for codec in (*_CODECS, None):
        (path,) = dump(nation, scratch_path(spark, "dump"), (codec, 6) if codec else 0)
        back = load(spark, path, nation.schema).select(F.lit(codec or "none").alias("codec"), "n_nationkey", "n_name")
        out = back if out is None else out.unionByName(back)
    return out


@query(f"select * from (values {', '.join(f'({c!r}, {c!r})' for c in _CODECS)}, ('none', 'not-compressed')) t(written_as, codec)")
def codec_sniff(spark, d):
    """The codec that the first bytes of files tell, whatever their folder is called."""
    nation, out = _t(spark, d, "nation"), None
    for codec in (*_CODECS, None):
        (path,) = dump(nation, scratch_path(spark, "dump"), codec or 0)
        found = detect_codec(spark, path).select(F.lit(codec or "none").alias("written_as"), "codec").distinct()
        out = found if out is None else out.unionByName(found)
    return out


@query("""
select n_nationkey, case n_nationkey % 7 when 0 then 'zlib' when 1 then 'gzip' when 2 then 'bz2' when 3 then 'lzma' when 4 then 'xz' when 5 then 'lz4' end as codec from nation""")
def codec_by_name(spark, d):
    extension = F.element_at(F.array(*map(F.lit, (".z", ".gz", ".bz2", ".lzma", ".xz", ".lz4", ".parquet"))), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return _t(spark, d, "nation").select("n_nationkey", codec_col(F.concat("n_name", extension)).alias("codec"))


# --- the relational work inside mapped tasks
@query("""
select l_returnflag, l_linestatus, sum(l_quantity::decimal(18,2))::decimal(28,2) as sum_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n_rows
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def base_filter_agg(spark, d):
    df = _t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n_rows"))


@query("""
select n_name, sum((l_extendedprice * (1 - l_discount))::decimal(18,4))::decimal(28,4) as revenue
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01' group by n_name""")
def base_join(spark, d):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    orders = _t(spark, d, "orders").where((F.col("o_orderdate") >= day("1995-01-01")) & (F.col("o_orderdate") < day("1996-01-01")))
    df = _t(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    value = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return df.groupBy("n_name").agg(F.sum(value).cast("decimal(28,4)").alias("revenue"))


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) as place, round(avg(value) over (partition by user_id order by ts, event_id rows 4 preceding), 6) as running from events")
def base_window(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("place"), F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6).alias("running"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def base_topk(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("(select c_nationkey as k from customer intersect select s_nationkey from supplier) except select n_nationkey from nation where n_regionkey = 0")
def base_setops(spark, d):
    a, b = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, d, "supplier").select("s_nationkey")
    return a.intersect(b).subtract(_t(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("select l_returnflag, l_linestatus, count(*) as n_rows from lineitem group by rollup (l_returnflag, l_linestatus)")
def base_rollup(spark, d):
    return _t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_rows"))
