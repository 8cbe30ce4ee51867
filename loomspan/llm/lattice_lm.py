"""Language-model scores: marginal document probability over all segmentations into subwords.

The pieces are those of an existing vocabulary (``piece_bpe_32k.model``), which isn't changed. It is
a BPE vocabulary, as no unigram one is available, and its scores are merge ranks, no probabilities.
So they are only the begin: weights Zipf-like in the ranks, then expectation steps over the words of
all training documents, weighted by their counts, until the words' likelihood settles. A word's
spelling probability sums over all ways to spell it with pieces, the first of which begins with the
word mark, by a forward recursion in log space; bytes spell what no piece covers, so no text is
impossible. ``lattice_score`` is a document's probability by spelling alone. For ``score`` a word
seen in training is one more arc, from its begin to its end, with its count less a discount; the
discounts of all words are what spelling shares out. A document is its words and one end, and the
probabilities of all tokens sum to one.

Flow: documents are cut into chunks of bounded size, each with a word list of its own; texts
become numbers into that list. Word counts are joined over all chunks by word, spelling is made
once per distinct word, and each chunk gets back one row per word of its list. Nothing that grows
with the corpus is collected: the driver sees totals and at most one number per piece.

Defined results: a null or empty text is its end alone. A null ``doc_id`` has no remainder, is
scored and isn't learned from (``held_out`` is true). Repeated rows are counted and scored each.
Ties don't occur. A text larger than a chunk is a chunk of its own. With no training documents
every count is 0 and pieces keep their first weights. Extra columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.encoder import vocabulary_path
from loomspan.llm.words import table
from loomspan.plans.scratch import drop, written

PIECES = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 5, 1
#: Bytes of text in a chunk.
CHUNK_BYTES = 16 << 20
MARK, END = "▁", -1
#: Added to each piece's expected count; the gain in nats a word at which steps end, and how many there are at most.
SMOOTHING, SETTLED, STEPS = 0.1, 0.01, 12
LOG10 = math.log(10)
#: Commonest characters of pieces that have a column in the trie's table, words of one pass, and their characters.
DENSE, PASS_WORDS, PASS_CHARS = 128, 16_384, 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; on bytes, Python's own split and lower know just these characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Trie:
    """The pieces as a table of nodes by character; ``piece`` is the piece that ends at a node, or -1."""

    def __init__(self, pieces: list[str]):
        total = Counter(ch for p in pieces for ch in p)
        order = sorted(total, key=lambda ch: (-total[ch], ch))
        self.codes = {ch: i for i, ch in enumerate(order)}
        moves: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for ch in p:
                c = self.codes[ch]
                to = moves[node].get(c)
                if to is None:
                    to = moves[node][c] = len(moves)
                    moves.append({})
                    ends.append(-1)
                node = to
            if p:
                ends[node] = k
        self.piece, self.n = np.array(ends, np.int32), len(order) + 1
        self.dense = min(DENSE, len(order))
        self.table = np.zeros((len(moves), self.dense), np.int32)  # 0 is no move: nothing leads to the root
        rare = []
        for node, m in enumerate(moves):
            for c, to in m.items():
                if c < self.dense:
                    self.table[node, c] = to
                else:
                    rare.append((node * self.n + c, to))
        rare.sort()
        self.keys, self.to = np.array([k for k, _ in rare] + [1 << 62], np.int64), np.array([t for _, t in rare] + [0], np.int32)
        # by code point; characters of no piece, and the mark inside a word, lead nowhere
        self.of_point = np.full(max(map(ord, order), default=0) + 2, len(order), np.int32)
        self.of_point[[ord(ch) for ch in order]] = np.arange(len(order))

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), np.int32)
        common = codes < self.dense
        out[common] = self.table[nodes[common], codes[common]]
        few = np.flatnonzero(~common)
        if len(few):
            key = nodes[few].astype(np.int64) * self.n + codes[few]
            place = np.searchsorted(self.keys, key)
            out[few] = np.where(self.keys[place] == key, self.to[place], 0)
        return out


def _segments(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups of equal neighbours in ``of``, log of the sum of exponentials of each)."""
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    most = np.maximum.reduceat(values, first)
    safe = np.where(np.isfinite(most), most, 0.0)
    with np.errstate(divide="ignore"):
        return of[first], safe + np.log(np.add.reduceat(np.exp(values - np.repeat(safe, np.diff(np.append(first, len(of))))), first))


class Lattice:
    """All ways to spell words with pieces of given natural-log weights, many words at a time."""

    def __init__(self, trie: Trie, weights: np.ndarray, bytes_: list[int]):
        self.trie, self.weights, self.bytes = trie, weights, bytes_

    def _arcs(self, words: list[str]):
        """Places are those before each character of all words, marks first, one after the other, and each word's end.

        (begin, end, what, weight) of all arcs, local offsets of places, first and last place of each word,
        characters that bytes spell: what >= 0 is a piece, below that -1 - k means the k-th of these.
        """
        text = "".join(MARK + w for w in words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        offset = np.arange(len(points)) - (ends - lengths)[word]
        codes = self.trie.of_point[np.minimum(points, len(self.trie.of_point) - 1)]
        codes = np.where((points == ord(MARK)) & (offset > 0), self.trie.n - 1, codes)
        last = ends[word]  # the character after a word's last
        at, node = np.arange(len(points)), np.zeros(len(points), np.int32)
        begins, stops, whats = [], [], []
        k = 0
        while len(at):
            node = self.trie.step(node, codes[at + k])
            live = node > 0
            at, node, k = at[live], node[live], k + 1
            piece = self.trie.piece[node]
            has = piece >= 0
            begins.append(at[has])
            stops.append(at[has] + k)
            whats.append(piece[has].astype(np.int64))
            more = at + k < last[at]
            at, node = at[more], node[more]
        inner = np.flatnonzero(offset > 0)
        signs, which = np.unique(points[inner], return_inverse=True)
        spelled = [[self.bytes[b] for b in chr(int(x)).encode("utf-8", "surrogatepass")] for x in signs]
        of_sign = np.array([self.weights[x].sum() for x in spelled])
        begin, end, what = np.concatenate([*begins, inner]), np.concatenate([*stops, inner + 1]), np.concatenate([*whats, -1 - which])
        weight = np.where(what >= 0, self.weights[np.maximum(what, 0)], of_sign[np.clip(-1 - what, 0, len(signs) - 1)] if len(signs) else 0.0)
        # one place more a word than it has characters: its end
        begin, end = begin + word[begin], end + word[end - 1]
        first = ends - lengths + np.arange(len(words))
        return begin, end, what, weight, first, first + lengths, spelled

    @staticmethod
    def _sweep(key: np.ndarray, value_at: np.ndarray, source: np.ndarray, into: np.ndarray, weight: np.ndarray) -> None:
        """``value_at[into]`` = log sum of ``value_at[source] + weight``, step after step by ``key``."""
        order = np.argsort(key * len(value_at) + into)
        cuts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            some = order[a:b]
            where, total = _segments(value_at[source[some]] + weight[some], into[some])
            value_at[where] = total

    def _forward(self, arcs) -> np.ndarray:
        begin, end, _, weight, first, last, _ = arcs
        a = np.full(int(last[-1]) + 1, -np.inf)
        a[first] = 0.0
        at = end - np.repeat(first, last - first + 1)[end]
        self._sweep(at, a, begin, end, weight)
        return a

    def _passes(self, words: list[str]) -> Iterator[np.ndarray]:
        """Numbers of the words of each pass: words of like length together, a bounded number of characters."""
        sizes = np.array([len(w) for w in words], np.int64)
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            upto = np.searchsorted(np.cumsum(sizes[order[at : at + PASS_WORDS]] + 1), PASS_CHARS, "right")
            n = max(1, int(upto))
            yield order[at : at + n]
            at += n

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for some in self._passes(words):
            arcs = self._arcs([words[i] for i in some])
            out[some] = self._forward(arcs)[arcs[5]]
        return out

    def expect(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> float:
        """Adds each piece's expected uses in the words, each as often as counted; the words' log likelihood."""
        total = 0.0
        for some in self._passes(words):
            arcs = self._arcs([words[i] for i in some])
            begin, end, what, weight, first, last, spelled = arcs
            n, a = counts[some].astype(np.float64), self._forward(arcs)
            b = np.full(len(a), -np.inf)
            b[last] = 0.0
            width = last - first + 1
            self._sweep(np.repeat(last, width)[begin] - begin, b, end, begin, weight)
            own = np.repeat(np.arange(len(some)), width)[begin]
            share = n[own] * np.exp(a[begin] + weight + b[end] - a[last][own])
            piece = what >= 0
            into += np.bincount(what[piece], share[piece], len(into))
            by_sign = np.bincount(-1 - what[~piece], share[~piece], len(spelled))
            for x, uses in zip(spelled, by_sign, strict=True):
                np.add.at(into, x, uses)
            total += float((n * a[last]).sum())
        return total

    def log_probability(self, word: str) -> float:
        return float(self.log_probabilities([word])[0])


_VOCABULARIES: dict[str, tuple[list[str], list[bool], np.ndarray]] = {}


def vocabulary(path: str) -> tuple[list[str], list[bool], np.ndarray]:
    """Pieces (empty where not usable), which of them are bytes, and first weights: the scores' ranks, Zipf-like."""
    if path not in _VOCABULARIES:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        is_byte = [m.is_byte(i) for i in range(n)]
        usable = [not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and (is_byte[i] or MARK not in pieces[i][1:]) for i in range(n)]
        score = np.array([m.get_score(i) for i in range(n)])
        weight = np.where(is_byte, 1e-7, 1 / (10 - np.minimum(score, 0)))
        weight[~np.array(usable)] = 0
        _VOCABULARIES[path] = [p if u else "" for p, u in zip(pieces, usable, strict=True)], is_byte, weight / weight.sum()
    return _VOCABULARIES[path]


_TRIES: dict[str, tuple[Trie, list[int]]] = {}


def lattice(path: str, probability: np.ndarray) -> Lattice:
    pieces, is_byte, _ = vocabulary(path)
    if path not in _TRIES:
        by_byte = {int(p[3:5], 16): i for i, (p, b) in enumerate(zip(pieces, is_byte, strict=True)) if b}
        _TRIES[path] = Trie(["" if b else p for p, b in zip(pieces, is_byte, strict=True)]), [by_byte[b] for b in range(256)]
    trie, bytes_ = _TRIES[path]
    return Lattice(trie, np.log(np.maximum(probability, 1e-300)), bytes_)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of two kinds: documents (``doc_id, at``: numbers into their chunk's word list) and words (``word, no, n``: uses in training)."""
    names = ["kind", "chunk", "doc_id", "at", "word", "no", "n"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 24, 0
        numbers: dict[bytes, int] = {}
        used = np.zeros(1 << 16, np.int64)
        docs_of: list[tuple[int | None, bytes]] = []

        def rows(kind: str, count: int, **columns) -> pa.RecordBatch:
            own = {"kind": [kind] * count, "chunk": [chunk] * count} | columns
            return pa.RecordBatch.from_arrays([pa.array(own[c], t) if c in own else pa.nulls(count, t) for c, t in zip(names, types, strict=True)], names)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, size, numbers, used
            words = list(numbers)
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield rows("word", len(some), word=some, no=range(i, i + len(some)), n=used[i : i + len(some)])
            numbers, used, size, chunk = {}, np.zeros(1 << 16, np.int64), 0, chunk + 1

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    words = words_of(text)
                    at = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.uint32, len(words))
                    if not is_held_out(doc_id):
                        if len(used) < len(numbers):
                            used = np.concatenate([used, np.zeros(len(numbers), np.int64)])
                        np.add.at(used, at, 1)
                    docs_of.append((doc_id, at.astype("<u4").tobytes()))
                    size += len(text or "")
                if len(used) < len(numbers):
                    used = np.concatenate([used, np.zeros(len(numbers), np.int64)])
                yield rows("doc", len(docs_of), doc_id=[d for d, _ in docs_of], at=[x for _, x in docs_of])
                docs_of = []
                if size >= chunk_bytes:
                    yield from close()
        if numbers:
            yield from close()

    return docs.select("doc_id", "text").mapInArrow(cut, "kind string, chunk long, doc_id long, at binary, word binary, no int, n long")


def piece_probabilities(counts: DataFrame, path: str) -> np.ndarray:
    """Probability of each piece, from its expected uses over all training words, as often as they occur; steps until the likelihood settles."""
    first = vocabulary(path)[2]
    words, now, before = counts.where("c > 0").select("word", "c"), first, -math.inf
    for _ in range(STEPS):

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            model, into, said, n = lattice(path, now), np.zeros(len(now)), 0.0, 0
            for batch in batches:
                c = batch["c"].to_numpy()
                said += model.expect([x.decode("utf-8", "surrogatepass") for x in batch["word"].to_pylist()], c, into)
                n += int(c.sum())
            at = np.flatnonzero(into)
            # piece -1: the likelihood, and -2: of how many words
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]).astype(np.int32)), pa.array(np.append(into[at], [said, n]))], ["piece", "n"])

        uses, told = np.where(first > 0, SMOOTHING, 0.0), {-1: 0.0, -2: 0.0}
        for r in words.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most one row a piece
            if r.piece < 0:
                told[r.piece] = r.n
            else:
                uses[r.piece] += r.n
        if not told[-2]:
            return uses / uses.sum() if before > -math.inf else first
        now, gain, before = uses / uses.sum(), told[-1] / told[-2] - before, told[-1] / told[-2]
        if gain < SETTLED:
            break
    return now


def score_documents(docs: DataFrame, pieces: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score."""
    path = pieces or vocabulary_path(PIECES)
    made = written(chunked(docs, chunk_bytes), "chunks", "kind")
    texts, lists = made.where("kind = 'doc'").select("chunk", "doc_id", "at"), made.where("kind = 'word'").select("chunk", "word", "no", "n")
    counts = written(lists.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    of = lambda k: F.count(F.when(F.col("c") == k, 1))
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), of(1).alias("once"), of(2).alias("twice")).first()
    learned = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    n_ends = texts.where(learned).count()
    n, v = int(seen.n) + n_ends, int(seen.v) + (n_ends > 0)
    # absolute discount by the usual estimate from the words seen once and twice
    less = seen.once / (seen.once + 2 * seen.twice) if seen.once and seen.twice else 0.5
    spelled = (less * seen.v + 0.5) / (n + 1)
    probability = piece_probabilities(counts, path)
    shared = docs.sparkSession.sparkContext.broadcast(probability)  # a number a piece, 256 KB for 32,000
    pieces_of = vocabulary(path)[0]
    begins = np.array([p.startswith(MARK) for p in pieces_of])
    # the first piece is one with the mark; each later one without, or the word stops
    fixed = math.log(1 - probability[~begins].sum()) - math.log(probability[begins].sum())

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, shared.value)
        for batch in batches:
            w = model.log_probabilities([x.decode("utf-8", "surrogatepass") for x in batch["word"].to_pylist()]) + fixed
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(w, pa.float64())], ["word", "c", "w"])

    spelt = counts.mapInArrow(spell, "word binary, c long, w double")
    back = lists.select("chunk", "word", "no").join(spelt, "word").select(F.col("chunk").alias("part"), "no", "c", "w")
    log_base = math.log10(n + 0.5 * (v + 1))
    # by spelling alone, a token that isn't an end is a word
    log_more = math.log10(1 - (n_ends + 0.5) / (n + 1))
    end_base, end_score = math.log10(n_ends + 0.5) - log_base, math.log10((n_ends + 0.5) / (n + 1))

    def score(doc: pa.Table, words: pa.Table) -> pa.Table:
        no = words["no"].to_numpy()
        c, by_spelling = np.zeros(len(no), np.int64), np.zeros(len(no))
        c[no], by_spelling[no] = words["c"].to_numpy(), words["w"].to_numpy()
        with np.errstate(divide="ignore"):
            w = np.logaddexp(np.log(np.maximum(c - less, 0) / (n + 1)), math.log(spelled) + by_spelling) / LOG10
        by_spelling = by_spelling / LOG10 + log_more
        base = np.log10(c + 0.5) - log_base
        out: list[tuple] = []
        for doc_id, raw in zip(doc["doc_id"].to_pylist(), doc["at"].to_pylist(), strict=True):
            at = np.frombuffer(raw, "<u4")
            out.append((doc_id, is_held_out(doc_id), len(at) + 1, int((c[at] > 0).sum()) + (n_ends > 0), n, float(base[at].sum()) + end_base, float(w[at].sum()) + end_score, float(by_spelling[at].sum()) + end_score))
        names, types = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        columns = list(zip(*out, strict=True)) or [()] * 8
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    scored = written(texts.groupBy("chunk").cogroup(back.groupBy("part")).applyInArrow(score, kinds), "scores")
    drop(made, counts)
    return scored


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
