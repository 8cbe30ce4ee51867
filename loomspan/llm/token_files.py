"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

A shard is a sequence of blocks of whole documents. A block ranks its own ids by how often they
occur and writes ranks: one to four little-endian bytes each, without leading zeros, with the
lengths of four ranks in one separate control byte. Being ranked block by block, a shard needs no
statistics of other shards, is written in one pass and can be rewritten alone by a retried task.

Block: magic ``LSTK``; counts of documents, ids, ranked ids, bytes of data (u32 x 4); then per
document its id (i64), whether it has one (u8) and its number of ids (u32); the ranked ids (u32);
control bytes (a quarter of the ids, rounded up); data bytes. Documents ascend by id through
blocks and shards, a null id first, equal ids by text.

Documents are range-partitioned by id and the begin of their text, so neither null nor repeated ids
fill one task; a task writes shard after shard, each closed at ``SHARD_BYTES`` of text. Shards are
named by task and number, so their names ascend as their documents do.

Defined results: a null or empty text has the end id only. Repeated rows are written once each.
An empty table gives no shard and an empty result. Extra columns aren't read. A document longer
than a block makes a block of its own.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.encoder import VOCABULARY, encoder, slices, vocabulary_path
from loomspan.llm.words import table
from loomspan.plans.numbering import numbered
from loomspan.plans.scratch import scratch_path, written

MAGIC = b"LSTK"
END_ID = 1
#: Bytes of text at which a shard is closed, that a task gets at most and at least, and ids at which a block is closed.
SHARD_BYTES, TASK_BYTES, SMALL_BYTES, BLOCK_IDS = 32 << 20, 128 << 20, 2 << 20, 1 << 21
#: Ids below this are counted in a table, where a block has no larger ones.
TABLE_IDS = 1 << 20
#: Characters of a text that decide, among equal ids, in which task it is.
BEGIN = 64

MANIFEST = "shard long, path string, n_docs long, n_ids long, n_bytes long"
#: Of a control byte, the byte lengths of its four ranks.
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    n = len(ranks)
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.arange(4, dtype=np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(n, 4)[at < lengths[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    starts = ends - lengths
    out = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= padded[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def ranked(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids that occur, most frequent first, then by id; the place there of each id of ``flat``)."""
    if flat.max(initial=0) < TABLE_IDS:  # counted without sorting all ids
        counts = np.bincount(flat)
        known, at = np.flatnonzero(counts), flat
        counts, place = counts[known], np.empty(len(counts), np.uint32)
        keys = known
    else:
        known, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        keys, place = np.arange(len(known)), np.empty(len(known), np.uint32)
    order = np.lexsort((known, -counts))
    place[keys[order]] = np.arange(len(known), dtype=np.uint32)
    return known[order], place[at]


def encode_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    flat = np.frombuffer(b"".join(ids), "<u4")
    values, ranks = ranked(flat)
    control, data = encode_ranks(ranks)
    head = np.array([len(ids), len(flat), len(values), len(data)], "<u4")
    return b"".join((
        MAGIC, head.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(x) // 4 for x in ids], "<u4").tobytes(), values.astype("<u4").tobytes(), control, data,
    ))


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, whether each is one, counts of ids, all ids) of each block of a shard."""

    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError(f"token file ends early: {len(got)} bytes of {n}")
        return got

    while head := stream.read(4):
        if head != MAGIC:
            raise ValueError("not a token file block")
        n_docs, n, n_values, n_data = map(int, np.frombuffer(take(16), "<u4"))
        doc_ids, known = np.frombuffer(take(8 * n_docs), "<i8"), np.frombuffer(take(n_docs), np.uint8)
        counts, values = np.frombuffer(take(4 * n_docs), "<u4"), np.frombuffer(take(4 * n_values), "<u4")
        control = take(-(-n // 4))
        yield doc_ids, known, counts, values[decode_ranks(control, take(n_data), n)]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_shards(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = END_ID, shard_bytes: int = SHARD_BYTES, block_ids: int = BLOCK_IDS, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """Writes ``doc_id, text`` as shards below the URI ``path``; a lazy manifest, a row a shard.

    A shard's file is written under a name of its own and then renamed, so of a task that runs
    twice one whole file remains.
    """
    docs = docs.select("doc_id", "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # as many tasks as the session's shuffles have, more where they would get too much, fewer where next to nothing
    n = max(1, math.ceil(n_bytes / task_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // SMALL_BYTES))
    first = F.asc_nulls_first("doc_id")
    # a text's begin is in order wherever the text is
    placed = docs.repartitionByRange(n, first, F.asc_nulls_first(F.left("text", F.lit(BEGIN)))).sortWithinPartitions(first, F.asc_nulls_first("text"))
    source, end = vocabulary or vocabulary_path(VOCABULARY), b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, shard = encoder(source), TaskContext.get().partitionId(), 0
        out, own, row, n_text = None, "", {}, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def flush():
            nonlocal size
            if ids:
                block = encode_block(doc_ids, ids)
                out.write(block)
                row["n_docs"] += len(ids)
                row["n_ids"] += size
                row["n_bytes"] += len(block)
                doc_ids.clear()
                ids.clear()
                size = 0

        def close() -> pa.RecordBatch:
            nonlocal out, shard, n_text
            flush()
            out.close()
            files.move(own, own.removesuffix(own[own.rindex(".") :]))
            out, shard, n_text = None, shard + 1, 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            for doc_id, text, found in zip(batch["doc_id"].to_pylist(), texts, known.encode_all(texts), strict=True):
                if out is None:
                    files, root = _open(path)
                    files.create_dir(root, recursive=True)
                    name = f"{part:08d}-{shard:06d}.tokens"
                    own = f"{root}/{name}.{os.getpid()}-{os.urandom(4).hex()}"
                    out = files.open_output_stream(own)
                    row = {"shard": part << 24 | shard, "path": f"{path}/{name}", "n_docs": 0, "n_ids": 0, "n_bytes": 0}
                some = found + end
                if ids and size + len(some) // 4 > block_ids:
                    flush()
                doc_ids.append(doc_id)
                ids.append(some)
                size += len(some) // 4
                n_text += len(text or "")
                if n_text >= shard_bytes:
                    yield close()
        if out:
            yield close()

    return placed.mapInArrow(write, MANIFEST)


def read_token_shards(manifest: DataFrame, n_tasks: int) -> DataFrame:
    """Per document of the shards in ``manifest``, from the files: doc_id, start, n_tokens, ids_crc32."""
    starts = numbered(manifest.select("shard", "path", "n_ids"), "shard", sum_of="n_ids", sum_as="start")
    rows = starts.select("path", F.col("start").cast("long").alias("start")).repartition(max(1, n_tasks))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                files, at = _open(path)
                with files.open_input_stream(at) as stream:
                    for doc_ids, known, counts, ids in read_blocks(stream):
                        ends = np.cumsum(counts, dtype=np.int64)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, mask=known == 0), pa.array(start + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        start += int(ends[-1]) if len(ends) else 0

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = written(write_token_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens")), "token-manifest")
    return read_token_shards(manifest, manifest.count())
