"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources share ``budget`` times all words by their weights, none above ``most`` times its own size;
what a full source can't take goes to the others by weight. A source's documents fall into keyed
blocks, and its blocks into a permuted order. The source's quota is a number of block draws: whole
passes over all blocks, then as many further blocks as the rest of the target holds, and one that
is taken in part, document by document. A tree splits the quotas of all sources among the output
shards: each half of a node's shards gets a multivariate-hypergeometric sample of its draws. So a
shard has, of every source, a range of draw numbers: these are the blocks that it draws, disjoint
from all others' and exact in their sum. A document is taken as often as the shards draw its
block. A shard orders its rows by a keyed hash of its own.

Nothing that grows with the documents, sources or shards is collected. Targets are found from sums
over the sources, one row a round; places and sums in permuted order come from range-partitioned
numbering; the tree is a table with a row for each node and source that still has draws, split by
tasks, each of which holds at most about ``CELLS`` of them. A block holds about ``BLOCK_DOCS``
documents, more where there would be over ``MOST_BLOCKS`` (the sampler's urns hold 10**9 draws).

Defined results: a null text has size 0 and is taken as often as its block is drawn. A null source
is one more source, ordered last. Rows fall into blocks by id and text, so null and repeated ids
are spread; rows alike in both are one block's, counted, not gathered. A source of size 0 has
target 0. An empty table gives no rows. Extra columns pass through ``mix``, whatever their names,
and aren't read by ``mixing_plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.words import count_words, table
from loomspan.plans.numbering import numbered
from loomspan.plans.scratch import written

WEIGHTS, BUDGET, MOST, SEED = (5, 2, 1), 1.5, 2.0, 20240607
#: Documents of a block, on average, block draws of an output shard, and blocks of which all draws fit into an urn.
BLOCK_DOCS, SHARD_DRAWS, MOST_BLOCKS = 512, 32, 200_000_000
#: Children of a node that one task splits off, and numbers that it makes.
FAN, CELLS = 1024, 1_000_000


def split_draws(quotas: Sequence[int], shards: int | Sequence[int], seed: int = SEED) -> list[np.ndarray]:
    """Draws of each source for each of some shards, or nodes of so many shards: multivariate-hypergeometric halvings with exact totals."""
    widths = np.ones(shards, np.int64) if isinstance(shards, int) else np.array(shards, np.int64)
    out: list[np.ndarray] = []
    stack = [(np.array(quotas, np.int64), 0, len(widths))]
    while stack:
        urn, a, b = stack.pop()
        if b - a == 1:
            out.append(urn)
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        # the "count" and "marginals" ways differ only in speed; the latter has no bound on the urn's memory
        took = rng.multivariate_hypergeometric(urn, int(urn.sum()) * int(widths[a:mid].sum()) // int(widths[a:b].sum()), method="marginals")
        stack += [(urn - took, mid, b), (took, a, mid)]
    return out


def _tree(quotas: DataFrame, shards: int, n_sources: int, seed: int) -> DataFrame:
    """``shard, s, lo, n``: of source s, shard draws the numbers lo to lo + n - 1; from ``quotas`` (s, n). Rows with draws only."""
    fan = max(2, min(FAN, CELLS // max(1, n_sources)))
    names = ["shard", "width", "s", "lo", "n"]

    def split(df: pd.DataFrame) -> pd.DataFrame:
        first, width = int(df["shard"].iat[0]), int(df["width"].iat[0])
        df = df.sort_values("s", ignore_index=True)
        step = -(-width // fan)
        widths = [min(step, width - at) for at in range(0, width, step)]
        s, lo, rows, at = df["s"].to_numpy(), df["lo"].to_numpy(), [], first
        for took, w in zip(split_draws(df["n"].to_numpy(), widths, seed + 1_000_003 * first + width), widths, strict=True):
            has = np.flatnonzero(took)
            rows.append(pd.DataFrame({"shard": at, "width": w, "s": s[has], "lo": lo[has], "n": took[has]}))
            lo, at = lo + took, at + w
        return pd.concat(rows)[names]

    level = quotas.where("n > 0").select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("width"), "s", F.lit(0).cast("long").alias("lo"), "n")
    width = shards
    while width > 1:
        level = written(level.groupBy("shard", "width").applyInPandas(split, "shard long, width long, s long, lo long, n long"), "tree")
        width = -(-width // fan)
    return level.select("shard", "s", "lo", "n")


def _sources(sized: DataFrame, weights: Sequence[float], budget: float, most: float) -> tuple[DataFrame, int]:
    """(a row a source: s, source, source_size, target, whole, rest, n_docs; their number)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("s", F.lit(len(weights))) + 1).cast("int"))
    sources = written(numbered(totals, F.asc_nulls_last("source"), as_="s").withColumn("weight", weight), "sources")
    n, total, all_weight = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # words a unit of weight: full sources leave their rest to the others, which may fill some of these, and so on
    share, full = budget * total / all_weight if n else 0.0, -1
    while n:
        is_full = F.lit(share) * F.col("weight") >= most * F.col("source_size")
        now, size, w = sources.where(is_full).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if now == full or now == n:
            break
        full, share = now, (budget * total - most * size) / (all_weight - w)
    target = F.least(F.lit(float(share)) * F.col("weight"), most * F.col("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("target", target.cast("double")).withColumn("whole", whole)
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    return sources.select("s", "source", "source_size", "target", "whole", rest.alias("rest"), "n_docs"), n


def _planned(docs: DataFrame, weights: Sequence[float], budget: float, most: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with source and block, sources, the blocks' draws, how many alike rows of the blocks taken in part are taken once more)."""
    key = F.xxhash64(F.lit(seed), "doc_id", "text").alias("key")
    sized = written(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), key), "sizes")
    sources, n_sources = _sources(sized, weights, budget, most)
    n_docs = sources.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    per_block = max(BLOCK_DOCS, -(-n_docs // MOST_BLOCKS))
    sources = written(sources.withColumn("n_blocks", F.ceil(F.col("n_docs") / per_block).cast("long")), "sources")
    placed = sized.withColumnRenamed("source", "own").join(sources, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    placed = placed.select("doc_id", "source", "size", "s", "source_size", "target", F.pmod("key", "n_blocks").alias("block"))

    # blocks in permuted order: place 0.. and words before, each from the source's first block on
    blocks = placed.groupBy("s", "block").agg(F.sum("size").alias("words"))
    order = ("s", F.xxhash64(F.lit(seed + 1), "s", "block"), "block")
    blocks = written(numbered(blocks, *order, as_="place", sum_of="words", sum_as="before"), "blocks")
    starts = blocks.groupBy("s").agg(F.min("place").alias("place0"), F.min("before").alias("before0"), F.count("*").alias("m"))
    blocks = blocks.join(starts, "s").join(sources.select("s", "whole", "rest"), "s")
    place, room = F.col("place") - F.col("place0"), F.col("rest") - (F.col("before") - F.col("before0"))
    blocks = written(blocks.select("s", "block", place.alias("place"), "m", "whole", ((room > 0) & (F.col("words") > room)).alias("in_part"), room.alias("room"), (room > 0).alias("more")), "blocks")
    # of the last pass, the blocks before the target's end; the one across it is its last draw
    quotas = blocks.groupBy("s").agg((F.first("m") * F.first("whole") + F.count(F.when(F.col("more"), 1))).alias("n"))
    total = quotas.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tree = _tree(quotas, max(1, -(-total // SHARD_DRAWS)), n_sources, seed)
    draws = tree.select("s", "shard", F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)).alias("draw")).join(starts.select("s", "m"), "s")
    drawn = draws.groupBy("s", (F.col("draw") % F.col("m")).alias("place")).agg(F.sort_array(F.collect_list(F.struct("draw", "shard"))).alias("d"))
    shards = F.coalesce(F.transform("d", lambda x: x["shard"]), F.array().cast("array<bigint>"))
    plan = written(blocks.join(drawn, ["s", "place"], "left").select("s", "block", "in_part", "room", shards.alias("draw_shards")), "plan")
    # one block a source is taken in part: about BLOCK_DOCS rows, alike ones counted
    some = placed.join(plan.where("in_part"), ["s", "block"]).groupBy("s", "doc_id", "size").agg(F.count("*").alias("n"), F.first("room").alias("room"))

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        """Largest first, as many as still fit; then the smallest left over, if that comes nearer."""
        df = df.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        left, more = float(df["room"].iat[0]), np.zeros(len(df), np.int64)
        sizes, n = df["size"].to_numpy(), df["n"].to_numpy()
        for i in range(len(df)):
            more[i] = n[i] if sizes[i] == 0 else min(n[i], int(left // sizes[i]))
            left -= float(more[i] * sizes[i])
        rest = np.flatnonzero(more < n)
        if len(rest) and abs(left - sizes[rest[-1]]) < left:
            more[rest[-1]] += 1
        return df.assign(more=more)[["s", "doc_id", "size", "more"]]

    fitted = written(some.groupBy("s").applyInPandas(fit, "s long, doc_id long, size long, more long"), "fitted")
    return placed, sources, plan, fitted


def _taken(joined: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows with times, taken and shards: a row is taken as often as its block is drawn, but one draw of a block in part."""
    by = ["s", "doc_id", "size"]
    drawn = F.size("draw_shards")
    rest = joined.where("not in_part").withColumn("times", drawn)
    # rows that share these columns are told apart by a number; which has which doesn't matter, they are alike
    some = joined.where("in_part").withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0))))
    more = fitted.select(*(F.col(c).alias(f"f_{c}") for c in (*by, "more")))
    same = (F.col("s") == F.col("f_s")) & F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("size") == F.col("f_size"))
    some = some.join(more, same).withColumn("times", F.when(drawn > 0, drawn - 1 + F.when(F.col("nth") <= F.col("f_more"), 1).otherwise(0)).otherwise(0))
    out = [*columns, F.col("times").cast("int").alias("times"), (F.col("times") * F.col("size")).cast("long").alias("taken"), F.slice("draw_shards", F.lit(1), F.col("times")).alias("shards")]
    return rest.select(*out).unionByName(some.select(*out))


def mixing_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, times (how often it is taken), taken and shards (of each taking)."""
    placed, _, plan, fitted = _planned(docs, weights, budget, most, seed)
    return _taken(placed.join(plan, ["s", "block"]), fitted, ["doc_id", "source", "size", "source_size", "target"])


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixture: each row of ``docs`` as often as the plan takes it, with all its columns, shuffled within its output shards.

    Texts meet only the small tables of sources and blocks and move once, to their shards.
    """
    _, sources, plan, fitted = _planned(docs, weights, budget, most, seed)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source").alias("own"), count_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
    rows = rows.join(sources.select("s", "source", "n_blocks"), F.col("own").eqNullSafe(F.col("source"))).withColumn("block", F.pmod("key", "n_blocks"))
    taken = _taken(rows.join(plan, ["s", "block"]), fitted, ["row", "doc_id"]).where("times > 0")
    out = taken.select("row", "doc_id", F.posexplode("shards").alias("pass", "shard"))
    out = out.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 2), "shard", "doc_id", "pass"))
    return out.select("row.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")
