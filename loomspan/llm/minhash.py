"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

1. A document becomes its set of word shingles (64-bit hashes), a fingerprint of that set, 256
   minima under keyed permutations, ``BANDS`` keys over ``ROWS`` minima each, and a signature of
   the low two bits of every minimum. Documents with one set form a class; copies stop here.
2. In every band bucket each class is paired with the bucket's least class (a star, never all
   pairs). Pairs that can't reach the similarity by their sizes, or whose signatures' bit counts
   put the collision-corrected estimate far below it, are left out; the rest are confirmed on the
   full sets. Confirmed links give components.
3. Only buckets that still hold several components are looked at again: pairs across components,
   in blocks of bounded size, go through the same estimate and confirmation. Pairs within a
   component can't change the result, so after this no candidate pair is left untested.

Classes are numbered, so no two share a name. A bucket of m classes in different components costs
m / ``BLOCK`` copies of each of its rows and m * m / 2 comparisons of signatures, in groups of at
most two blocks each; a bucket's first class, which the stars join on, is split by the planner's
handling of skewed joins, and in the confirmation by ``MEMBERS``.

A pair at the similarity 0.8 shares no band with probability (1 - 0.8**6)**42 < 3e-6.

Defined results: a null text, or one without words, has an empty set and is linked with nothing.
A text shorter than a shingle is one shingle. A null ``doc_id`` takes part by its text and never
names a component while another id is there; texts without an id are found again by their hash.
Repeated rows are copies of each other. An empty
table gives no rows. Columns besides ``doc_id`` and ``text`` aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.shingles import mix, sets_of
from loomspan.llm.words import table
from loomspan.operators.components import connected_components
from loomspan.plans.scratch import drop, freed_shuffles, written

BANDS, ROWS, MINIMA = 42, 6, 256
#: An estimate may lie so far below the similarity: over six standard errors of 256 two-bit minima.
MARGIN = 0.2
#: Classes of one bucket that are compared in one block; members that one confirmation block holds.
BLOCK, MEMBERS = 2048, 256
#: Pairs whose signatures are compared at a time.
PAIRS = 1 << 18
#: Bits of a sieve for each row that it is made of, and its 64-bit words at most.
SIEVE_BITS, SIEVE_WORDS = 16, 1 << 18
WIDTH, SIMILARITY = 5, 0.8

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(77))
_TIMES = (_rng.integers(0, 1 << 31, MINIMA, np.uint32) << np.uint32(1)) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, MINIMA, np.uint32)
_BAND = mix(_rng.integers(0, 1 << 63, ROWS, np.uint64)) | _U(1)
_EVEN = 0x5555555555555555


def minima(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each non-empty set under each permutation: one row a set, 32-bit."""
    out = np.empty((len(bounds) - 1, MINIMA), np.uint32)
    x = (sets >> _U(32)).astype(np.uint32)
    for k in range(MINIMA):
        h = x * _TIMES[k] + _PLUS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(h, bounds[:-1])
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band is part of it."""
    parts = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS).astype(np.uint64)
    return mix((parts * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def packed(least: np.ndarray) -> np.ndarray:
    """The low two bits of each minimum, 32 minima to a 64-bit word."""
    low = (least & np.uint32(3)).astype(np.uint64).reshape(len(least), -1, 32)
    return (low << (np.arange(32, dtype=np.uint64) * _U(2))).sum(axis=2, dtype=np.uint64)


def _corrected(differ: float | np.ndarray) -> float | np.ndarray:
    """Similarity from the number of differing cells; equal by chance are a quarter of the others."""
    return (1 - differ / MINIMA - 0.25) / 0.75


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, fp (16 bytes), sig (8 words), bands (keys); null fp for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, sets, bounds in sets_of(batch["text"], width):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                n = end - at
                fp, sig, bands = [None] * n, [None] * n, [None] * n
                if len(full):
                    least = minima(sets, np.append(bounds[full], len(sets)))
                    words, keys = packed(least).view(np.int64).tolist(), band_keys(least).view(np.int64).tolist()
                    for k, i in enumerate(full.tolist()):
                        fp[i] = hashlib.blake2b(sets[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest()
                        sig[i], bands[i] = words[k], keys[k]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, n).cast(pa.int64()), batch["text_hash"].slice(at, n), pa.array(sizes.astype(np.int64)), pa.array(fp, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_shingles", "fp", "sig", "bands"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, fp binary, sig array<bigint>, bands array<bigint>")


def _estimate(a: Column, b: Column) -> Column:
    differ = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EVEN)))
    )
    return (1 - differ / MINIMA - 0.25) / 0.75


def _sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    return 100 * F.least(a, b) >= round(100 * similarity) * F.greatest(a, b)


def _sieve(rows: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """A bitmap of the hashed ``columns`` of ``rows``, as a broadcast table of its words that aren't 0, and the number of all words."""
    words = min(SIEVE_WORDS, max(1, rows.count() * SIEVE_BITS // 64))
    bits = rows.select(*_place(words, *columns)).groupBy("__minhash_slot").agg(F.expr("bit_or(shiftleft(1L, __minhash_bit))").alias("__minhash_bits"))
    return F.broadcast(bits), words


def _place(words: int, *columns: str) -> tuple[Column, Column]:
    h = F.xxhash64(*columns)
    return F.pmod(h, F.lit(words)).alias("__minhash_slot"), F.shiftrightunsigned(h, 58).cast("int").alias("__minhash_bit")


def _sifted(rows: DataFrame, sieve: tuple[DataFrame, int], *columns: str, passes: bool = True) -> DataFrame:
    """Those of ``rows`` that the sieve lets pass, or those that it holds back: all that it was made of pass, and few others, without a shuffle."""
    bits, words = sieve
    slot, bit = _place(words, *columns)
    hit = (slot == F.col("__minhash_slot")) & (F.getbit("__minhash_bits", bit) == 1)
    return rows.join(bits, hit, "left_semi" if passes else "left_anti")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b: classes), those whose full sets reach the similarity.

    The sets are made again from the texts of the classes that occur. Blocks of one class a with at
    most about MEMBERS classes b keep a popular class from gathering all of its pairs in one task.
    """
    percent = round(100 * similarity)
    pairs = written(pairs.distinct(), "pairs")
    n_a = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    placed = written(pairs.join(n_a, "a").withColumn("block", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks")))).drop("blocks"), "pairs")
    drop(pairs)
    needed = placed.select(F.col("a").alias("cid")).unionByName(placed.select(F.col("b").alias("cid"))).distinct()
    wanted = written(classes.join(needed, "cid").select("cid", F.col("fp").alias("wanted"), F.col("first_id").alias("doc_id"), "text_hash"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, flat, bounds in sets_of(batch["text"], width):
                rows = [flat[bounds[i] : bounds[i + 1]].tobytes() for i in range(end - at)]
                same = [hashlib.blake2b(r, digest_size=16).digest() == w for r, w in zip(rows, batch["wanted"].slice(at, end - at).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["cid"].slice(at, end - at), pa.array(rows, pa.binary())], ["cid", "set"]).filter(pa.array(same, pa.bool_()))

    own = docs.select(F.col("doc_id").alias("own_id"), "text", F.xxhash64("text").alias("own_hash"))
    # of most texts no pair is asked for: those aren't shuffled
    own = _sifted(own, _sieve(wanted.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")), "own_id", "own_hash"), "own_id", "own_hash")
    texts = own.join(wanted, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))).select("cid", "wanted", "text")
    made = written(texts.mapInArrow(sets, "cid long, set binary").dropDuplicates(["cid"]), "sets")
    drop(wanted)
    heads = placed.select("block", F.col("a").alias("cid")).distinct().withColumn("is_head", F.lit(True))
    members = placed.select("block", F.col("b").alias("cid")).withColumn("is_head", F.lit(False))
    rows = heads.unionByName(members).join(made, "cid").repartition("block").sortWithinPartitions("block", F.desc("is_head"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, head, head_set = None, 0, None
        for batch in batches:
            links: list[tuple[int, int]] = []
            for b, cid, is_head, raw in zip(*(batch[c].to_pylist() for c in ("block", "cid", "is_head", "set")), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if is_head:
                    block, head, head_set = b, cid, own
                elif b == block:
                    both = len(np.intersect1d(head_set, own, assume_unique=True))
                    if 100 * both >= percent * (len(head_set) + len(own) - both):
                        links.append((head, cid))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    links = written(rows.mapInArrow(confirm, "a long, b long"), "links")
    drop(placed, made)
    return links


def _across(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that sizes and signatures allow.

    ``members``: key, cid, component, n_shingles, sig. Large buckets are cut into blocks, and each
    pair of blocks is one group, so a group holds about two blocks at most.
    """
    sized = members.join(members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts")), "key")
    own = F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int")
    rows = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "cuts")
    percent, least = round(100 * similarity), similarity - MARGIN

    def near(part: tuple[np.ndarray, ...]) -> np.ndarray:
        """Pairs among the rows of whole groups, which stand one after the other."""
        group, cid, component, n, own, is_one, sig = part
        at = np.arange(len(group))
        more = np.searchsorted(group, group, "right") - at - 1  # rows of the group after each
        found, begin, so_far = [], 0, np.cumsum(more)
        while begin < len(group):
            end = max(begin + 1, int(np.searchsorted(so_far, (so_far[begin - 1] if begin else 0) + PAIRS, "right")))
            k = more[begin:end]
            x = np.repeat(at[begin:end], k)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
            fine = (component[x] != component[y]) & (is_one[x] | (own[x] != own[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[fine], y[fine]
            diff = sig[x] ^ sig[y]
            differ = np.bitwise_count((diff | diff >> _U(1)) & _U(_EVEN)).sum(axis=1, dtype=np.int64)
            close = _corrected(differ) >= least
            found.append(np.stack([cid[x[close]], cid[y[close]]], axis=1))
            begin = end
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            key, i, j, cid, component, n, own = (table[c].to_numpy() for c in ("key", "i", "j", "cid", "component", "n_shingles", "own"))
            sig = table["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), -1)
            group = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            both = near((group, cid, component, n, own, i == j, sig))
            return pa.RecordBatch.from_arrays([pa.array(both.min(axis=1, initial=2**63 - 1)), pa.array(both.max(axis=1, initial=-(2**63)))], ["a", "b"])

        for batch in batches:
            left.append(batch)
            key, i, j = (batch[c].to_numpy() for c in ("key", "i", "j"))
            # the last group may go on in the next batch
            last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1])) if batch.num_rows else []
            if len(last):
                cut = int(last[-1]) + 1
                left[-1] = batch.slice(0, cut)
                yield out(pa.Table.from_batches(left))
                left = [batch.slice(cut)]
        if sum(b.num_rows for b in left):
            yield out(pa.Table.from_batches(left))

    # so many tasks as shuffles have, however few bytes: comparing is the work
    n_tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.sparkSession.sparkContext.defaultParallelism)
    columns = ["key", "i", "j", "cid", "component", "n_shingles", "own", "sig"]
    grouped = rows.select(*columns).repartition(n_tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, and fp and component_key, which name set and component also where ids are null."""
    with freed_shuffles(docs.sparkSession):
        return _near_duplicates(docs, width, similarity)


def _near_duplicates(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    sketched = written(sketches(docs, width), "sketches")
    full = sketched.where(F.col("fp").isNotNull())
    # the row of the least id, a null one last, stands for a class
    one = F.min(F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "text_hash")).alias("one")
    classes = full.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")), one)
    classes = classes.select("fp", "n_shingles", "sig", "bands", F.col("one.doc_id").alias("first_id"), F.col("one.text_hash").alias("text_hash"))
    # numbered once, in what is written
    banded = written(classes.withColumn("cid", F.monotonically_increasing_id()), "banded")
    # band keys are most of a sketch, and are needed for the buckets only
    rows = written(sketched.select("doc_id", "n_shingles", "fp"), "rows")
    drop(sketched)
    keys = banded.select("cid", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("cid").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    members = written(keys.join(heads, "key"), "members")
    classes = written(banded.drop("bands"), "classes")
    drop(banded)
    small = classes.select("cid", "n_shingles", "sig")
    stars = members.where(F.col("head") != F.col("cid")).select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    of = lambda s: small.select(*(F.col(c).alias(f"{c}_{s}") for c in small.columns))
    stars = stars.join(of("a"), F.col("a") == F.col("cid_a")).join(of("b"), F.col("b") == F.col("cid_b"))
    stars = stars.where(_sizes_allow(F.col("n_shingles_a"), F.col("n_shingles_b"), similarity) & (_estimate(F.col("sig_a"), F.col("sig_b")) >= similarity - MARGIN))
    links = _confirmed(stars.select("a", "b"), classes, docs, width, similarity)
    first = written(connected_components(links).withColumnRenamed("node", "cid"), "components")

    labelled = members.select("key", "cid").join(first, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    labelled = written(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    again = _across(labelled.join(mixed, "key").join(small, "cid"), similarity)
    more = _confirmed(again, classes, docs, width, similarity)
    drop(members, labelled)
    joined = more.join(first.toDF("a", "component_a"), "a", "left").join(first.toDF("b", "component_b"), "b", "left")
    between = joined.select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    second = connected_components(between)
    # a class: its component of the first round, if any, renamed by the second, if any
    named = classes.select("fp", "cid", "first_id").join(first, "cid", "left").withColumn("one", F.coalesce("component", "cid")).drop("component")
    named = named.join(second.toDF("one", "two"), "one", "left").withColumn("component_key", F.coalesce("two", "one"))
    named = named.select("fp", "component_key", "first_id")
    ids = named.groupBy("component_key").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(ids, "component_key").select("fp", "component_key", "component_id")
    out = rows.select("doc_id", "n_shingles", "fp").join(by_class, "fp", "left")
    own = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.withColumn("component_id", own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "fp", "component_key")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component, with all its columns: that of the least doc_id, among equal ids that of the least text.

    Rows with empty sets all stay.
    """
    columns = docs.columns
    with freed_shuffles(docs.sparkSession):
        found = written(near_duplicates(docs, width, similarity), "near-duplicates")
        odd = written(found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("__minhash_id")), "repeated-ids")
        gone = written(found.where("not kept").select("doc_id").unionByName(odd.toDF("doc_id")), "gone")
        sieve = _sieve(gone, "doc_id")
    kept = found.where("kept").select(F.col("doc_id").alias("__minhash_id"))
    # what the sieve holds back is no copy and has an id of its own; only the rest is shuffled, to see what it is
    sure, maybe = (_sifted(docs, sieve, "doc_id", passes=p) for p in (False, True))
    plain = maybe.join(kept.join(odd, "__minhash_id", "left_anti").where("__minhash_id is not null"), F.col("doc_id") == F.col("__minhash_id"), "left_semi")
    plain = sure.select(*columns).unionByName(plain.select(*columns))
    if odd.isEmpty():
        return plain.select(*columns)
    # ids that stand for several rows: such a row is known by its id and the fingerprint of its set
    there = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("__minhash_id")), "left_semi")
    keys = found.where("kept").join(odd, F.col("doc_id").eqNullSafe(F.col("__minhash_id")), "left_semi")
    keys = keys.select(F.col("doc_id").alias("__minhash_id"), F.col("fp").alias("__minhash_fp"), F.coalesce(F.col("component_key").cast("string"), F.lit("")).alias("__minhash_key")).distinct()
    marked = _with_fingerprint(there, width).join(keys, F.col("doc_id").eqNullSafe(F.col("__minhash_id")) & F.col("__minhash_own").eqNullSafe(F.col("__minhash_fp")))
    row = F.struct(*columns)
    one = marked.where("__minhash_key <> ''").groupBy("__minhash_key").agg(F.min_by(row, F.struct("text", F.coalesce(F.to_json(row), F.lit("")))).alias("row")).select("row.*")
    return plain.select(*columns).unionByName(one).unionByName(marked.where("__minhash_key = ''").select(*columns))


def _with_fingerprint(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``__minhash_own``: the fingerprint of a text's set, null for an empty one."""
    from pyspark.sql import types as T

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[bytes | None] = []
            for at, end, flat, bounds in sets_of(batch["text"], width):
                rows = (flat[bounds[i] : bounds[i + 1]].tobytes() for i in range(end - at))
                own += [hashlib.blake2b(r, digest_size=16).digest() if r else None for r in rows]
            yield batch.append_column("__minhash_own", pa.array(own, pa.binary()))

    return docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField("__minhash_own", T.BinaryType())]))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
