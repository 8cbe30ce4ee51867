"""Whole texts to token ids, many words at a time.

The vocabulary of ``word_bpe_49k.json`` drops white space and never forms a token across it, so the
ids of a text are the ids of its parts at spaces and line ends, one after the other. Of some MB of
texts each different part is encoded once. Parts of Latin letters, digits and ASCII signs are cut
into pieces exactly as the vocabulary's own rules do, and its merges are applied to all pieces at
once: each takes the pair that ranks lowest, the first of equals, until none ranks. Other parts
(other letters, apostrophes, special tokens, very long words) go through the library, word by word
through a bounded cache. Ids are kept as little-endian unsigned 32-bit integers throughout.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Parts from the library that one worker remembers at most, about 150 bytes each, and characters of the longest of them.
CACHE_PARTS, LONGEST = 600_000, 64
#: Bytes of the longest piece to which merges are applied here, and pieces to which they are applied together.
WIDEST, PIECES_AT_ONCE = 32, 1 << 17
#: Bytes of text (a row counts one more) that are encoded together, and parts whose ids are put in order together.
SLICE_BYTES, AT_ONCE = 4 << 20, 1 << 17


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters whose lower case is one letter and which normalisation leaves as they are.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(r"[!-~ÀÁ-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile(r"[ -~\nÀÁ-ÖØ-öø-ÿ]+")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _byte_signs() -> dict[int, str]:
    """The sign by which byte-level vocabularies write each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of parts, asked for where they are new. When half of ``most`` are known, they become those
    before, which are taken over as they occur again, so frequent parts outlive rare ones."""

    def __init__(self, ask: Callable[[str], bytes], most: int):
        super().__init__()
        self._ask, self._half, self._before = ask, max(1, most // 2), {}

    def __missing__(self, part: str) -> bytes:
        ids = self._before.get(part)
        if ids is None:
            ids = self._ask(part)
        if len(part) <= LONGEST:
            if len(self) >= self._half:
                self._before = self.copy()
                self.clear()
            self[part] = ids
        return ids


class _Merges:
    """A byte-level merge model of words, applied to many pieces at once."""

    NONE, _BITS = np.uint32(0xFFFFFFFF), 18

    def __init__(self, model: dict):
        vocabulary, signs, end = model["vocab"], _byte_signs(), model.get("end_of_word_suffix") or ""
        self._first = np.array([vocabulary[signs[b]] for b in range(256)], np.uint32)
        self._last = np.array([vocabulary[signs[b] + end] for b in range(256)], np.uint32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._made = np.array([vocabulary[a + b] for a, b in merges], np.uint32)
        # a table of pairs and ranks with linear probing; no pair is 2 ** 32 - 1
        pairs = (np.array([vocabulary[a] for a, _ in merges], np.uint32) << np.uint32(16)) | np.array([vocabulary[b] for _, b in merges], np.uint32)
        table = [(1 << 64) - 1] * (1 << self._BITS)
        for rank, (pair, at) in enumerate(zip(pairs.tolist(), self._slot(pairs).tolist(), strict=True)):
            while table[at] != (1 << 64) - 1:
                at = (at + 1) % len(table)
            table[at] = pair << 32 | rank
        self._table = np.array(table, np.uint64)

    @staticmethod
    def suits(model: dict) -> bool:
        """Whether the model is of the kind that is applied here."""
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        ends = {s + e for s in _byte_signs().values() for e in ("", model.get("end_of_word_suffix") or "")}
        return plain and max(model["vocab"].values()) < 0xFFFF and len(model["merges"]) < 1 << 17 and ends <= model["vocab"].keys()

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * np.uint32(2654435769)) >> np.uint32(32 - self._BITS)).astype(np.intp)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it has none."""
        pairs = (a << np.uint32(16) | b).ravel()
        at = self._slot(pairs)
        found = self._table[at]
        ranks, owners = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
        left = np.flatnonzero(owners != pairs)
        ranks[left] = self.NONE
        left = left[owners[left] != self.NONE]
        while len(left):
            at[left] = (at[left] + 1) % len(self._table)
            found = self._table[at[left]]
            owners = (found >> np.uint64(32)).astype(np.uint32)
            hit = owners == pairs[left]
            ranks[left[hit]] = found[hit].astype(np.uint32)
            left = left[~hit & (owners != self.NONE)]
        return ranks.reshape(a.shape)

    def ids(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has); a piece is ``sizes`` bytes of ``text`` from ``starts``.

        From the widest pieces on: what still has a pair that ranks is one symbol shorter after each step.
        """
        order = np.argsort(-sizes, kind="stable")
        n_ids, done, at, wide = np.zeros(len(sizes), np.int64), [], 0, int(sizes.max(initial=0))
        own, symbols, ranks = order[:0], np.empty((0, wide), np.uint32), np.empty((0, max(0, wide - 1)), np.uint32)
        for w in range(wide, 0, -1):
            to = at + int(np.searchsorted(-sizes[order[at:]], -w, "right"))
            if to > at:
                new = order[at:to]
                raw = text[starts[new][:, None] + np.arange(w)]
                more = self._first[raw]
                more[:, -1] = self._last[raw[:, -1]]
                own, symbols = np.concatenate((own, new)), np.concatenate((symbols, more))
                ranks = np.concatenate((ranks, self._ranks(more[:, :-1], more[:, 1:])))
                at = to
            if w == 1:
                n_ids[own] = 1
                done.append((own, symbols))
                break
            j = ranks.argmin(1)
            best = ranks[np.arange(len(j)), j]
            over, on = np.flatnonzero(best == self.NONE), np.flatnonzero(best != self.NONE)
            n_ids[own[over]] = w
            done.append((own[over], symbols[over]))
            own, symbols, ranks, j, best = own[on], symbols[on], ranks[on], j[on], best[on]
            rows, columns = np.arange(len(on)), np.arange(w - 1)
            made = self._made[best]
            symbols = np.where(columns <= j[:, None], symbols[:, :-1], symbols[:, 1:])
            symbols[rows, j] = made
            ranks = np.where(columns[:-1] < j[:, None], ranks[:, :-1], ranks[:, 1:])
            before, after = np.flatnonzero(j > 0), np.flatnonzero(j < w - 2)
            ranks[before, j[before] - 1] = self._ranks(symbols[before, j[before] - 1], made[before])
            ranks[after, j[after]] = self._ranks(made[after], symbols[after, j[after] + 1])
        places, out = np.cumsum(n_ids) - n_ids, np.empty(int(n_ids.sum()), "<u4")
        for own, symbols in done:
            out[places[own][:, None] + np.arange(symbols.shape[1])] = symbols
        return out, n_ids


#: Of a byte: 0 not plain, 1 of a letter, 2 a digit, 3 another sign. An apostrophe isn't plain, as it may begin a piece of letters.
_KINDS = np.array([0 if b < 33 or b == 127 or b == 39 or b > 0xC3 or 0xC0 <= b < 0xC3 else 2 if 48 <= b < 58 else 1 if b >= 0x80 or chr(b).isalpha() else 3 for b in range(256)], np.uint8)


class Encoder:
    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._signs = self._tokenizer.model, _byte_signs()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known = _Known(self._new, cache_parts)
        model = json.loads(self._tokenizer.to_str())["model"]
        self._merges = _Merges(model) if _Merges.suits(model) else None

    def _piece(self, piece: str) -> list[int]:
        signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._signs)
        return [t.id for t in self._model.tokenize(signs)]

    def _new(self, part: str) -> bytes:
        if _PLAIN.fullmatch(part) and not ("<|" in part and any(t in part for t in self._special)):
            ids = [i for p in _PIECES.findall(part.lower()) for i in self._piece(p)]
        else:
            ids = self._tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _own(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each part begin, how many it has)."""
        cuts = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        text = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
        cuts = cuts - cuts[0]
        sizes = np.diff(cuts)
        where, count = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        ids, other = np.empty(0, "<u4"), np.ones(len(parts), bool)
        if self._merges and len(text):
            # capitals become small: A to Z, and the second byte of those from 0xC3 on
            second = np.concatenate(([False], text[:-1] == 0xC3))
            text = text + np.uint8(32) * ((text - np.uint8(65) < 26) | second & (text - np.uint8(0x80) < 31) & (text != 0x97))
            kinds = _KINDS[text]
            odd = (kinds == 0) | ((text >= 0x80) & (text < 0xC0) & ~second) | second & ((text == 0x97) | (text == 0xB7))
            odd[1:] |= (text[1:] == 124) & (text[:-1] == 60)
            begins = np.concatenate(([True], kinds[1:] != kinds[:-1])) | (kinds == 2)
            begins[cuts[:-1][sizes > 0]] = True
            starts = np.flatnonzero(begins)
            wide = np.diff(starts, append=len(text))
            part = np.repeat(np.arange(len(parts)), sizes)
            other[:] = False
            other[part[odd]] = True
            other[part[starts[wide > WIDEST]]] = True
            part = part[starts]
            good = ~other[part]
            starts, wide = starts[good], wide[good]
            some = [self._merges.ids(text, starts[k : k + PIECES_AT_ONCE], wide[k : k + PIECES_AT_ONCE]) for k in range(0, len(starts), PIECES_AT_ONCE)]
            ids, n = (np.concatenate(x) for x in zip(*some, strict=True)) if some else (ids, where[:0])
            count = np.bincount(part[good], n, len(parts)).astype(np.int64)
            where = np.cumsum(count) - count
        rest = np.flatnonzero(other)
        if len(rest):
            own = [self._known[p] for p in parts.take(pa.array(rest)).to_pylist()]
            count[rest] = np.fromiter(map(len, own), np.int64, len(own)) // 4
            where[rest] = len(ids) + np.cumsum(count[rest]) - count[rest]
            ids = np.concatenate((ids, np.frombuffer(b"".join(own), "<u4")))
        return ids, where, count

    def _parts(self, text: str | None) -> str:
        """The text with spaces between parts. Lower-cased where plain as a whole; special tokens are told by case."""
        text = text or ""
        return (text.lower() if "<|" not in text and _PLAIN_TEXT.fullmatch(text) else text).replace("\n", " ")

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as bytes; a null text is an empty one."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a part is looked for once, however often the texts have it."""
        lists = pc.split_pattern(pa.array(map(self._parts, texts), pa.large_string()), " ")
        parts = lists.values.dictionary_encode()
        ids, starts, sizes = self._own(parts.dictionary)
        at = parts.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[at])))
        out = np.empty(ends[-1], "<u4")
        for k in range(0, len(at), AT_ONCE):
            some, first, last = at[k : k + AT_ONCE], ends[k], ends[min(k + AT_ONCE, len(at))]
            out[first:last] = ids[np.arange(first, last) + np.repeat(starts[some] - ends[k : k + len(some)], sizes[some])]
        raw, cuts = out.tobytes(), (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file; workers are reused between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many bytes of text or one row, so that what is made from one batch stays small."""
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch["text"].cast(pa.large_string())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to
