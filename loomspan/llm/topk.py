"""Exact top-k by integer inner product, term at a time.

A term is a dimension; its posting list holds the rows whose weight there isn't zero. Rows are
cut into blocks of bounded size. The blocks of queries are sent to each block of rows, which are
read once and stay in the task while the queries stream by. For a chunk of rows, terms whose
postings are nearly all rows add up in one matrix product; every other term scatters
``weight * posting`` into the dense array of scores. What isn't below a query's k-th best so far is
kept, and these short lists, packed by block of queries, are merged per query.

Nothing is joined, so no setting or estimate can make Spark broadcast or collect the copies of the
queries. They are sent as often as there are blocks of rows, so weights go in the smallest type
that holds them and blocks are large; small tables get more blocks, to employ all cores.

Defined results: vectors that are null, or hold null or non-finite components, take no part.
A vector shorter than another is zero in what it lacks; an empty one scores zero. Ties go to the
smaller id. Rows that repeat an id are ranked each; a query leaves out every row with its own id.
Rows with a null id take no part. Scores beyond 64 bits are clipped to the range of a long.
Components may be of any size: sums that 64 bits can't hold are made with unbounded integers.
Fewer candidates than k give all of them. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.words import table

K, SCALE, EVERY = 5, 256, 50
#: Rows of a block and bytes of its weights at most, about; queries of a block; rows of a block that isn't cut further for the cores' sake.
ROWS, BYTES, QUERIES, LEAST = 1 << 20, 1 << 26, 512, 2048
#: Rows that are scored at once; weights of a record, and of what is scored at once, at most.
CHUNK, PIECE = 8192, 1 << 22
_LONG = 1 << 63
_RECORD = "block int, kind int, ids binary, type string, width int, weights binary"
_FOUND = "part int, query_ids binary, ids binary, scores binary"


def _matrix(vectors: pa.Array) -> np.ndarray:
    """``floor(256 * x)`` of lists, as rows of whole doubles; shorter ones are filled with zeros."""
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    width = int(lengths.max())
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    m = np.zeros((len(lengths), width), np.float64)
    m[np.arange(width) < lengths[:, None]] = flat
    return m


def _type(m: np.ndarray) -> str:
    """The smallest type that holds these whole doubles."""
    lo, hi = (m.min(), m.max()) if m.size else (0, 0)
    return next((t for t in ("<i1", "<i2", "<i4") if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max), "<f8")


def _blocks(vectors: DataFrame, n: int, rows: int, kind: int) -> DataFrame:
    """Records of ``n`` blocks, of at most ``2 * rows`` rows and ``PIECE`` weights unless one row has more; the weights of a record are one matrix."""
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts = None, [], []

        def flush() -> pa.RecordBatch:
            width = max(m.shape[1] for m in parts)
            whole = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in parts])
            as_type = _type(whole)
            one = (now, kind, np.concatenate(ids).tobytes(), as_type, width, whole.astype(as_type).tobytes())
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["block", "kind", "ids", "type", "width", "weights"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block, own, lengths = (x.to_numpy(zero_copy_only=False) for x in (batch["block"], batch["id"], pc.list_value_length(batch["v"])))
            ends = [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for start, end in zip([0, *ends], ends, strict=False):
                step = max(1, min(2 * rows, PIECE // max(1, int(lengths[start:end].max()))))
                for at in range(start, end, step):
                    m = _matrix(batch["v"].slice(at, min(step, end - at)))
                    n_rows, width = sum(map(len, parts)) + len(m), max([m.shape[1], *(x.shape[1] for x in parts)])
                    if parts and (block[at] != now or n_rows > 2 * rows or n_rows * width > PIECE):
                        yield flush()
                    now = int(block[at])
                    ids.append(own[at : at + len(m)].astype("<i8"))
                    parts.append(m)
        if parts:
            yield flush()

    return keyed.repartition("block").sortWithinPartitions("block", "id").mapInArrow(pack, _RECORD)


def _most(x: np.ndarray) -> np.ndarray:
    """The largest magnitude of each column."""
    return np.maximum(-x.min(axis=0, initial=0).astype(np.float64), x.max(axis=0, initial=0).astype(np.float64))


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products by terms; exact whatever the size of the weights."""
    width = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :width], rows[:, :width]
    most_q, most_r = _most(queries), _most(rows)
    with np.errstate(over="ignore"):
        bound = float((most_q * most_r).sum())
    if max(bound, most_q.max(initial=0), most_r.max(initial=0)) < 2.0**24:
        kind = np.float32  # whole numbers up to 2**24: sums are exact in any order
    elif bound < 2.0**52:
        kind = np.float64  # below 2**53, the same
    elif bound < 2.0**62:
        kind = np.int64
    else:
        kind = object
    as_kind = (lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)) if kind is object else (lambda x: x.astype(kind))
    q, r = as_kind(queries), as_kind(rows)
    held = np.count_nonzero(rows, axis=0)
    dense = held * 8 >= len(rows) if kind in (np.float32, np.float64) else np.zeros(width, bool)
    out = q @ r.T if dense.all() and width else q[:, dense] @ r[:, dense].T if dense.any() else np.zeros((len(q), len(r)), kind)
    for t in np.flatnonzero(~dense & (held > 0)).tolist():
        at = np.flatnonzero(r[:, t])
        posting = r[at, t]
        for i in np.flatnonzero(q[:, t]).tolist():
            out[i, at] += q[i, t] * posting
    if kind is object:  # beyond a long is as good as its end
        out = np.array([[max(-_LONG, min(_LONG - 1, x)) for x in row] for row in out.tolist()], np.int64).reshape(out.shape)
    return out


def _best(q_ids: np.ndarray, qm: np.ndarray, chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of the ``k`` best rows for each query; chunks: ids, their order, weights."""
    who = ids = score = np.zeros(0, np.int64)
    least = np.full(len(q_ids), -_LONG, np.int64)  # a query's k-th best so far
    for c_ids, by_id, m in chunks:
        s, n = scores(qm, m), len(c_ids)
        from_, to = (np.searchsorted(c_ids, q_ids, side, sorter=by_id) for side in ("left", "right"))
        own = [(i, j) for i in np.flatnonzero(to > from_).tolist() for j in by_id[from_[i] : to[i]].tolist()]
        if s.dtype.kind == "f":
            end, nothing = (2**24 if s.dtype == np.float32 else 2**53), -np.inf
            bar = np.clip(least, -end, end).astype(s.dtype)  # all scores are within these ends
        else:
            bar, nothing = least.copy(), -_LONG
        for i, j in own:
            s[i, j] = nothing
        few = np.flatnonzero(least == -_LONG)
        if len(few) and n > k:
            bar[few] = np.maximum(bar[few], np.partition(s[few], n - k, axis=1)[:, n - k])
        hot = np.flatnonzero(s.max(axis=1) >= bar)
        i, j = np.divmod(np.flatnonzero(s[hot] >= bar[hot, None]), n)  # ties too: the order by id decides below
        i = hot[i]
        if own:
            other = ~np.isin(i * n + j, [i * n + j for i, j in own])
            i, j = i[other], j[other]
        if not len(i):
            continue
        who, ids, score = np.concatenate([who, i]), np.concatenate([ids, c_ids[j]]), np.concatenate([score, s[i, j].astype(np.int64)])
        order = np.lexsort((ids, ~score, who))
        who, ids, score = who[order], ids[order], score[order]
        top = np.arange(len(who)) - np.searchsorted(who, who) < k
        who, ids, score = who[top], ids[top], score[top]
        n_of = np.bincount(who, minlength=len(q_ids))
        full = n_of == k
        least[full] = score[np.cumsum(n_of)[full] - 1]
    return q_ids[who], ids, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` (id, v) against ``vectors`` (id, v)."""
    usable = lambda df: df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    vectors, queries = usable(vectors), usable(queries)
    ends = F.min(F.array_min("v")).cast("double"), F.max(F.array_max("v")).cast("double")
    count, cells, *ends = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)), *ends).first()
    size = np.dtype(_type(np.floor(SCALE * np.array([x for x in ends if x is not None], np.float64)))).itemsize
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-count // rows), -(-cells * size // BYTES), min(4 * cores, -(-count // LEAST)))
    r = _blocks(vectors, n, rows, 0)
    q = _blocks(queries, max(1, -(-queries.count() // query_rows)), query_rows, 1)
    spread = q.withColumn("part", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = r.withColumn("part", F.lit(None).cast("int")).unionByName(spread).repartitionById(n, "block").sortWithinPartitions("block", "kind")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                block, kind, raw_ids, as_type, width, raw = (batch[c][row].as_py() for c in ("block", "kind", "ids", "type", "width", "weights"))
                part = batch["part"].slice(row, 1)
                ids = np.frombuffer(raw_ids, "<i8")
                m = np.frombuffer(raw, as_type).reshape(len(ids), width)
                if block != now:
                    now, chunks = block, []
                if kind == 0:
                    step = max(1, min(CHUNK, PIECE // max(1, width)))
                    chunks += [(ids[at : at + step], np.argsort(ids[at : at + step], kind="stable"), m[at : at + step]) for at in range(0, len(ids), step)]
                elif chunks:
                    yield pa.RecordBatch.from_arrays([part, *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in _best(ids, m, chunks, k))], ["part", "query_ids", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, []

        def flush() -> pa.RecordBatch:
            who, ids, score = (np.concatenate(x) for x in zip(*lists, strict=True))
            lists.clear()
            order = np.lexsort((ids, ~score, who))
            who, ids, score = who[order], ids[order], score[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
            top = rank <= k
            return pa.RecordBatch.from_arrays([pa.array(who[top]), pa.array(rank[top].astype(np.int32)), pa.array(ids[top]), pa.array(score[top])], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                part = batch["part"][row].as_py()
                if lists and part != now:
                    yield flush()
                now = part
                lists.append([np.frombuffer(batch[c][row].as_py(), "<i8") for c in ("query_ids", "ids", "scores")])
        if lists:
            yield flush()

    found = met.mapInArrow(best, _FOUND)
    # rows of one query id are all in its part
    return found.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "query_id long, rank int, vec_id long, score long")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return top_k(vectors, vectors.where(F.col("id") % EVERY == 0))


ORACLE = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (
    select q.vec_id as query_id, r.vec_id as vec_id,
        list_sum(list_transform(list_zip(q.w, r.w), lambda z: z[1] * z[2]))::bigint as score
    from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 50 = 0),
n as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from n where rank <= 5
"""
