"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled text. A text is parsed
greedily against each automaton: a phrase is the longest match, extended until no continuation
exists, and the text needs as many phrases as it has breaks. Few phrases mean that the language's
sample predicts the text well. Counts are normalised to bits per letter, phrases times log2 of the
sample's length over the text's length; the language with the fewest wins. Samples count as
``LEAST_SIZE`` letters at least: a phrase of a sample of a few letters would be cheap in any text.

Texts are lower-cased and reduced to letters and single spaces. All texts of a batch are parsed in
step, in segments of ``SEGMENT`` letters (a phrase ends with its segment), so the automaton runs as
array look-ups over thousands of positions at once. Whole texts are parsed. Every letter of a
language's sample counts: the ``dense`` commonest are columns of its table, the others are looked
up in a sorted list of transitions.

Training reads ``text`` and non-null ``lang`` of a sample of the documents outside the held-out fold,
bounded by two parameters: of each language the first ``SAMPLE_DOCS`` by a hash of their id, as many
as ``SAMPLE_LETTERS`` characters hold. Only whole texts are learned from; longer ones aren't sampled
unless a language has no other, which then is learned from its shortest. Every language is learned:
samples, and the time to parse a text, grow with their number.

Defined results: ``und`` with score 0 for a text that is null or has no letter, or when nothing
could be learned. Ties go to the language that sorts first. The score is how far the winner's bits
lie below the runner-up's, as a share of these; 1 if there is only one language. Letters foreign
to all samples end a phrase in every language. Repeated rows give the same result. A null
``doc_id`` is never learned from and counts as held out. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.words import crc_mod, table

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS, SAMPLE_LETTERS = 256, 60_000
SEGMENT, STEP_TEXTS = 1024, 8192
#: Commonest signs of a language that are columns of its table, bytes of all tables, and least letters that a sample counts as.
DENSE, TABLE_BYTES, LEAST_SIZE = 63, 512 << 20, 1024
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased letters, each other run one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


class Automaton:
    """Suffix automaton as a flat table: ``2 * (state * columns) + broke`` by ``state * columns + sign``.

    Signs are numbered by frequency. The first ``dense`` have a column each, the last column stands
    for all that the sample lacks. Further signs are numbered after it; their transitions are two
    arrays, sorted by ``state * rare + sign``. A missing continuation ends the phrase and begins the
    next one with the sign itself.
    """

    def __init__(self, sample: str, dense: int = DENSE):
        total = Counter(sample)
        order = sorted(total, key=lambda ch: (-total[ch], ch))
        self.columns = columns = min(dense, len(order)) + 1
        self.signs = {ch: i if i < dense else i + 1 for i, ch in enumerate(order)}
        links, lengths, moves = [-1], [0], [{}]
        last = 0
        for ch in sample:
            c, now = self.signs[ch], len(moves)
            links.append(0)
            lengths.append(lengths[last] + 1)
            moves.append({})
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = now
                p = links[p]
            if p >= 0:
                q = moves[p][c]
                if lengths[p] + 1 == lengths[q]:
                    links[now] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = links[p]
                    links[q] = links[now] = twin
            last = now
        self.rare = rare = len(order) + 1 - columns
        root = np.zeros(columns + rare, np.int64)
        for c, to in moves[0].items():
            root[c] = to
        next_ = np.repeat((2 * root[:columns] * columns + 1).astype(np.int32)[None, :], len(moves), axis=0)
        rows = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        signs = np.fromiter((c for m in moves for c in m), np.int64, len(rows))
        to = np.fromiter((t for m in moves for t in m.values()), np.int64, len(rows))
        few = signs >= columns
        next_[rows[~few], signs[~few]] = 2 * to[~few] * columns
        self.table = next_.ravel()
        keys = rows[few] * rare + signs[few] - columns
        by = np.argsort(keys)
        # one more key than any state has, so that each search ends at one
        self.keys, self.to = np.append(keys[by], len(moves) * max(rare, 1)), np.append(2 * to[few][by] * columns, 0).astype(np.int32)
        self.begin = (2 * root[columns:] * columns + 1).astype(np.int32)
        self.size = max(2, len(sample))

    def breaks(self, codes: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrase ends of each segment; ``codes`` is one row a position, ``active`` how many segments (longest first) reach it."""
        n = codes.shape[1]
        state, found = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for row, m in zip(codes, active.tolist(), strict=True):
            at, row = state[:m] >> 1, row[:m]
            if self.rare and len(few := np.flatnonzero(row >= self.columns)):
                sign = row[few] - self.columns
                key = at[few].astype(np.int64) // self.columns * self.rare + sign
                place = np.searchsorted(self.keys, key)
                step = self.table.take(at + np.minimum(row, self.columns - 1))
                step[few] = np.where(self.keys[place] == key, self.to[place], self.begin[sign])
            else:
                step = self.table.take(at + row)
            found[:m] += step & 1
            state[:m] = step
        return found + 1


class Model:
    """Automata of all languages, each over all signs of its own sample."""

    def __init__(self, samples: dict[str, str], dense: int = DENSE, least_size: int = 2):
        self.languages, self.least_size = sorted(samples), least_size
        # an automaton has at most two states a letter
        dense = min(dense, TABLE_BYTES // (8 * max(1, sum(map(len, samples.values())))))
        self.automata = [Automaton(samples[k], dense) for k in self.languages]
        signs = sorted(set().union(*(a.signs for a in self.automata)))
        other = len(signs)
        self.codes = np.full(max(map(ord, signs), default=0) + 2, other, np.int32)
        self.codes[[ord(ch) for ch in signs]] = np.arange(other)
        # each automaton's numbers of all signs; the last of its columns for those that its sample lacks
        self.own = [np.array([*(a.signs.get(ch, a.columns - 1) for ch in signs), a.columns - 1], np.int32) for a in self.automata]

    def bits(self, texts: list[str]) -> np.ndarray:
        """Bits per letter, a row a text and a column a language; infinite for empty texts."""
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[np.minimum(flat, len(self.codes) - 1)]
        per = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = (np.cumsum(lengths) - lengths)[owner] + nth * SEGMENT
        length = np.minimum(SEGMENT, lengths[owner] - nth * SEGMENT)
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(owner), STEP_TEXTS):
            part = slice(at, at + STEP_TEXTS)
            order = np.argsort(-length[part], kind="stable")
            size, begin, who = length[part][order], start[part][order], owner[part][order]
            longest = int(size[0])
            grid = codes[np.minimum(begin + np.arange(longest)[:, None], len(codes) - 1)]
            active = np.searchsorted(-size, -np.arange(longest), "left")
            for k, a in enumerate(self.automata):
                np.add.at(out[:, k], who, a.breaks(self.own[k].take(grid), active) * np.log2(max(a.size, self.least_size)))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(lengths[:, None] > 0, out / np.maximum(lengths, 1)[:, None], np.inf)


_MODELS: dict[str, Model] = {}


def _model(samples: dict[str, str]) -> Model:
    """This worker's automata for these samples; workers are reused between tasks."""
    name = hashlib.blake2b(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(samples, least_size=LEAST_SIZE)
    return _MODELS[name]


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS) -> dict[str, str]:
    """A bounded sample of whole texts' letters per language, from labelled documents outside the held-out fold."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False)))
    labelled = labelled.select("lang", "doc_id", "text", F.char_length("text").alias("n")).where("n > 0")
    order = Window.partitionBy("lang").orderBy(F.when(F.col("n") > sample_letters, F.col("n")).otherwise(0), F.xxhash64("doc_id"), "doc_id", "n")
    # sizes first: a rank over few columns, cut down before it is shuffled; the sum is over what is left
    first = labelled.select("lang", "doc_id", "n").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs)
    sizes = first.select("lang", "doc_id", "n").distinct().withColumn("rank", F.row_number().over(order))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    ids = sizes.withColumn("upto", upto).where((F.col("upto") <= sample_letters) | (F.col("rank") == 1)).select("lang", "doc_id", "n", "rank")
    # at most sample_docs ids a language; of rows that share id and size one text is taken
    picked = labelled.join(F.broadcast(ids), ["lang", "doc_id", "n"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "rank").toLocalIterator():
        samples.setdefault(r.lang, []).append(letters(r.text))
    return {k: " ".join(v) for k, v in samples.items() if any(v)}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score; only the text decides."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples) if samples else None
        for batch in batches:
            pred, score = [], []
            for group in _groups(batch["text"]):
                texts = [letters(t) if t else "" for t in group]
                if model is None:
                    pred += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                bits = model.bits(texts)
                best = bits.argmin(axis=1)
                two = np.sort(bits, axis=1)
                for i, t in enumerate(texts):
                    pred.append(model.languages[best[i]] if t else "und")
                    score.append(0.0 if not t else 1.0 if bits.shape[1] == 1 else float(1 - two[i, 0] / two[i, 1]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def _groups(column: pa.Array, most: int = 8 << 20) -> Iterator[list[str | None]]:
    """The texts in lists of bounded bytes; a longer text alone."""
    at, size = 0, 0
    sizes = [0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()]
    for i, n in enumerate(sizes):
        if i > at and size + n > most:
            yield column.slice(at, i - at).to_pylist()
            at, size = i, 0
        size += n
    if at < len(column):
        yield column.slice(at).to_pylist()


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True)).alias("held_out"), "lang_pred", "score")
