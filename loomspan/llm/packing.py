"""Best-fit packing of tokenised documents into sequences of at most ``capacity`` ids.

Each task tokenises its documents, cuts only those longer than a sequence, and packs the pieces
best-fit, longest first, in blocks of bounded size. Nearly full bins are final. The others become
items again: groups of them are packed best-fit, groups shrink in number round by round (a tree),
and the last group holds what all tasks left over. A group never holds more than ``group_items``.

Defined results: a null or empty text is its end id alone. Repeated rows, and documents that share
an id, are packed once each. A text of any length is cut into whole sequences and one rest. Ties
go by document id and piece. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.encoder import VOCABULARY, encoder, slices, vocabulary_path
from loomspan.llm.words import table
from loomspan.plans.scratch import written

CAPACITY, END_ID = 2048, 0
#: Pieces that a task packs at a time, bins of one group of a later round, groups that merge into one.
BLOCK_ITEMS, GROUP_ITEMS, FAN_IN = 1 << 17, 1 << 18, 8
#: Bins with at most this much room are final.
SLACK = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill; longest items first, each into the fullest bin that has room.

    Bins with equal room form a stack; a bit set of the rooms that occur finds the best one at once.
    """
    n = len(lengths)
    bins, at, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            k = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(fill)
            fill.append(0)
        bins[i], at[i] = k, fill[k]
        fill[k] += length
        left = room - length
        stacks[left].append(k)
        rooms |= 1 << left
    return bins, at, np.array(fill, np.int64)


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pieces of all documents with the bin, offset and bin's fill that their task chose."""
    source, end = vocabulary or vocabulary_path(VOCABULARY), np.uint32(end_id).astype("<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, next_bin = encoder(source), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal next_bin
            rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], r[4]))
            columns = list(zip(*rows, strict=True))
            bins, at, fill = best_fit(np.array(columns[3], np.int64), capacity)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            out = [pa.array(c, t) for c, t in zip(columns, types, strict=True)] + [pa.array(bins + next_bin), pa.array(at), pa.array(fill[bins])]
            next_bin += len(fill)
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in slices(batches):
            for doc_id, found in zip(batch["doc_id"].to_pylist(), known.encode_all(batch["text"].to_pylist()), strict=True):
                ids = found + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    raw = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(raw) // 4, zlib.crc32(raw)))
            if len(rows) >= block_items:
                yield flush()
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(pack, PIECES)


def merged_bins(bins: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, group_items: int = GROUP_ITEMS) -> DataFrame | None:
    """``bin, sequence_id, base`` of the underfull bins (bin, fill) that found company or none; None where there are none.

    An item carries the bins it consists of, at most one for each id of a sequence.
    """

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        into, at, fill = best_fit(df["fill"].to_numpy(), capacity)
        first = np.full(len(fill), -1, np.int64)
        members: list[list[dict]] = [[] for _ in fill]
        for k, base, own, parts in zip(into.tolist(), at.tolist(), df["bin"].tolist(), df["parts"].tolist(), strict=True):
            if first[k] < 0:
                first[k] = own
            members[k] += [{"bin": p["bin"], "base": p["base"] + base} for p in parts]
        return pd.DataFrame({"bin": first, "fill": fill, "parts": members})

    left = bins.select("bin", "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("base"))).alias("parts"))
    done: DataFrame | None = None
    n, groups = left.count(), None
    while n:
        least = -(-n // group_items)
        groups = max(least, -(-groups // FAN_IN)) if groups else max(least, min(64, n // 4096 or 1))
        grouped = left.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
        new = written(grouped.groupBy("g").applyInPandas(lambda df: pack(df), left.schema), "bins")
        full = new if groups == 1 else new.where(F.col("fill") > capacity - slack)
        done = full if done is None else done.unionByName(full)
        if groups == 1:
            break
        left, before = new.where(F.col("fill") <= capacity - slack), n
        n = left.count()
        if groups == least and n > 0.99 * before:  # bins that fill each other nowhere: more merging changes nothing
            done = done.unionByName(left)
            break
    return done and done.select(F.col("bin").alias("sequence_id"), F.explode("parts").alias("p")).select("sequence_id", F.col("p.bin").alias("bin"), F.col("p.base").alias("base"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(packed_pieces(docs, capacity, vocabulary, end_id), "pieces")
    under = pieces.where((F.col("at") == 0) & (F.col("fill") <= capacity - SLACK)).select("bin", "fill")
    moved = merged_bins(under, capacity)
    if moved is None:
        out = pieces.withColumns({"sequence_id": F.col("bin"), "offset": F.col("at")})
    else:
        both = pieces.join(moved, "bin", "left")
        out = both.withColumns({"sequence_id": F.coalesce("sequence_id", "bin"), "offset": F.col("at") + F.coalesce("base", F.lit(0))})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
