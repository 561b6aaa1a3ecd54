"""SentencePiece encoding and decoding over a shared-prefix trie.

A text is cut into marked words (a run of spaces with what follows it, and characters that
no longer piece holds), of which each distinct one is encoded once.  Distinct words are
sorted, so that walking them is a depth-first walk of their trie: the forward states of a
common prefix are kept on a stack and reused.

A forward state holds the last piece of the best encoding of a prefix.  The Viterbi choice
is that with the largest sum of scores: this is how unigram models encode.  A BPE model's
merges are not the path of the largest sum, so for its own ids the choice among the pieces
that end at a place is the only one that merges keep apart from the piece before it.  One
walk makes both states from the same trie and automaton, if both are wanted: a BPE
vocabulary can also be read as a unigram model of the same scores.

Unknown characters become byte pieces if the model has them, else its unknown piece.  A null
text has null ids, an empty one none.  Very long texts are encoded whole, word by word.
Repeated rows get equal results; an empty table gives no row; columns other than the id and
the text are left behind, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, slices, table
from .textkit import Words

MARK = "▁"
MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
BLOCK_BYTES = 4 << 20
CACHED_WORDS = 300_000
PAIRS = 1_000_000
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: numbers, and bytes of nested or fixed values."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """Pieces of a SentencePiece model, and encoding by prefix states."""

    def __init__(self, proto: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.prefix, self.squeeze, rules = UNIGRAM, True, True, b""
        for field, value in _fields(proto):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, 1))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(_fields(value))
                rules, self.prefix, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or rules:
            raise ValueError("only unigram and BPE models without character rules")
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] in (1, 4)}
        self.unknown = kinds.index(2)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == 6}
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = [b for b in range(128) if b != 32 and chr(b) not in inside]
        self.split_words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.raw = [bytes([int(p[3:5], 16)]) if kinds[i] == 6 else b"" if kinds[i] == 3 else " ⁇ ".encode() if kinds[i] == 2 else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self._apart: dict[int, bool] = {}
        self._known: dict[int, int] = {}

    # --- forward states ---

    def _merged(self, text: str) -> list[str]:
        """The merges of a short string, the best score first and then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _stays_apart(self, left: int, right: int) -> bool:
        a, b = self.pieces[left], self.pieces[right]
        return self._merged(a + b) == [a, b]

    def _build(self) -> None:
        """The automaton of pieces: from a state and a character to the state of the longest
        suffix that begins a piece; with each state the pieces that end there, longest first."""
        self._next: dict[int, int] = {}
        self._fail, self._ends = [0], [()]
        children: list[list[tuple[str, int]]] = [[]]
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                key = at << 21 | ord(c)
                to = self._next.get(key)
                if to is None:
                    to = self._next[key] = len(self._ends)
                    self._ends.append(())
                    self._fail.append(0)
                    children.append([])
                    children[at].append((c, to))
                at = to
            self._ends[at] = ((i, len(piece)),)
        queue = [0]
        for at in queue:
            for c, to in children[at]:
                if at:
                    self._fail[to] = self._follow(self._fail[at], ord(c))
                self._ends[to] += self._ends[self._fail[to]]
                queue.append(to)

    def _follow(self, at: int, c: int) -> int:
        while (to := self._next.get(at << 21 | c)) is None and at:
            at = self._fail[at]
        return to or 0

    def encode_words(self, words: list[str], kinds: tuple[int, ...] | None = None) -> dict[str, tuple[list[int], ...]]:
        """Ids of distinct marked words, one list for each of ``kinds`` (None: the model's),
        walked in sorted order with shared prefix states.

        Stacks hold, for each prefix of the current word, the automaton's state and, for each
        kind, the last piece (-1 none, -2 unknown character) and where it begins; for the
        Viterbi choice also the score so far.
        """
        if not hasattr(self, "_ends"):
            self._build()
        kinds = kinds or (self.kind,)
        out: dict[str, tuple[list[int], ...]] = {}
        bpe, viterbi = BPE in kinds, UNIGRAM in kinds
        ends, scores, step, unknown_score = self._ends, self.scores, self._next, self.unknown_score
        apart, stays_apart = self._apart, self._stays_apart
        known: dict[int, int] = self._known
        if len(apart) > PAIRS:
            apart.clear()
        if len(known) > PAIRS:
            known.clear()
        state, merged, opened, best, begin, total = [0], [-1], [0], [-1], [0], [0.0]
        previous = ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            for stack in (state, merged, opened, best, begin, total):
                del stack[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                c = ord(word[end - 1])
                key = state[-1] << 21 | c
                to = step.get(key)
                if to is None:
                    to = known.get(key)
                    if to is None:
                        to = known[key] = self._follow(state[-1], c)
                state.append(to)
                here = ends[to]
                if bpe:
                    piece, start = -2, end - 1
                    for i, size in here:
                        before = merged[end - size]
                        if before >= 0:
                            pair = before << 24 | i
                            fits = apart.get(pair)
                            if fits is None:
                                fits = apart[pair] = stays_apart(before, i)
                            if not fits:
                                continue
                        piece, start = i, end - size
                        break
                    merged.append(piece)
                    opened.append(start)
                if viterbi:
                    piece, start, score, single = -2, end - 1, total[end - 1] + unknown_score, False
                    for i, size in here:
                        sum_ = total[end - size] + scores[i]
                        if size == 1 and not single:  # a character that is a piece is not unknown
                            single = True
                            if piece == -2:
                                piece, start, score = i, end - 1, sum_
                                continue
                        if sum_ > score:
                            piece, start, score = i, end - size, sum_
                    best.append(piece)
                    begin.append(start)
                    total.append(score)
            out[word] = tuple(self._trace(word, merged, opened) if k == BPE else self._trace(word, best, begin) for k in kinds)
            previous = word
        return out

    def _trace(self, word: str, last: list[int], begin: list[int]) -> list[int]:
        """The ids of a word from its last pieces, backwards."""
        ids: list[int] = []
        at = len(word)
        while at:
            piece, start = last[at], begin[at]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(word[start:at].encode())]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at = start
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the mark that encoding put in front."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@cache
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


@cache
def encoder(path: str, kinds: tuple[int, ...] | None = None) -> Encoder:
    """One encoder a worker process, so that its bounded caches outlive a task."""
    return Encoder(load(path), kinds)


class MarkedWords(Words):
    """Marked words of texts whose bytes are joined by a byte that no text holds."""

    def __init__(self, texts: list[bytes], model: Model):
        self.raw = self.data = data = np.frombuffer(b"\xff".join([*texts, b""]) if texts else b"", np.uint8)
        stop = data == 0xFF
        alone = np.zeros(256, bool)
        alone[[*model.alone, 0xFF]] = True
        single = alone[data]
        opens = single.copy()
        opens[1:] |= single[:-1]
        if model.split_words:
            space = data == 32
            opens[1:] |= space[1:] & ~space[:-1]
        opens[:1] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        real = ~stop[starts]
        self.start, self.end = starts[real], ends[real]
        self.text_end = np.flatnonzero(stop)
        self.text_start = np.append(0, self.text_end[:-1] + 1)[: len(self.text_end)]
        self.first = np.searchsorted(self.start, np.append(self.text_start, len(data)))


class Encoder:
    """A model with a cache of words."""

    def __init__(self, model: Model, kinds: tuple[int, ...] | None = None):
        self.model, self.kinds = model, kinds or (model.kind,)
        self.known: dict[bytes, tuple[list[int], ...]] = {}
        self.raw_size = np.array([len(r) for r in model.raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw_all = np.frombuffer(b"".join(model.raw) or b"\0", np.uint8)

    def marked(self, text: str) -> bytes:
        """The text as it is encoded, marks as spaces."""
        text = text.replace(MARK, " ")
        if self.model.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return (" " + text if self.model.prefix and text else text).encode("utf-8", "replace")

    def distinct(self, words: MarkedWords) -> tuple[list[bytes], np.ndarray]:
        """(distinct words, which of them each word is).  They are grouped by hash; each is
        then compared with the first of its group, and if any differs they go by their bytes."""
        _, at, kind = np.unique(words.hashes(), return_index=True, return_inverse=True)
        size = words.end - words.start
        first = at[kind]
        same = bool((size == size[first]).all())
        if same and len(size):
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            same = np.array_equal(words.raw[within + np.repeat(words.start, size)], words.raw[within + np.repeat(words.start[first], size)])
        spell = lambda k: words.raw[words.start[k] : words.end[k]].tobytes()
        if same:
            return [spell(k) for k in at.tolist()], kind
        seen: dict[bytes, int] = {}
        kind = np.array([seen.setdefault(spell(k), len(seen)) for k in range(len(size))])
        return list(seen), kind

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind (ids of all texts, bounds of each) of marked texts."""
        words = MarkedWords(texts, self.model)
        if not len(words.start):
            return [(np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)) for _ in self.kinds]
        keys, kind = self.distinct(words)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = {k.decode().replace(" ", MARK): k for k in keys if k not in self.known}
        self.known.update((new[w], ids) for w, ids in self.model.encode_words(list(new), self.kinds).items())
        found = [self.known[k] for k in keys]
        out = []
        for j in range(len(self.kinds)):
            ids = [f[j] for f in found]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat, first = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), np.cumsum(size) - size
            counts = size[kind]
            bounds = np.concatenate([[0], np.cumsum(counts)])
            source = np.arange(bounds[-1]) + np.repeat(first[kind] - bounds[:-1], counts)
            out.append((flat[source], bounds[words.first]))
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Marked texts of ids."""
        size = self.raw_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.raw_all[np.arange(ends[-1]) + np.repeat(self.raw_at[ids] - ends[:-1], size)].tobytes()
        cut = ends[bounds].tolist()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def encode(df: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", viterbi: bool = False) -> DataFrame:
    """(id, ids, exact): piece ids of each text, and whether decoding them gives it back; with
    ``viterbi`` also (viterbi_ids, viterbi_exact), those of the largest sum of scores.

    The model file must be at ``model_path`` on every worker.  Nothing is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["ids", "exact", *(["viterbi_ids", "viterbi_exact"] if viterbi else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path, (load(model_path).kind, *([UNIGRAM] if viterbi else [])))
        front = b" " if own.model.prefix else b""
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            marked = [own.marked(t) if t else b"" for t in texts]
            for lo, hi in chunks([len(t) for t in marked], BLOCK_BYTES):
                null = pa.array([t is None for t in texts[lo:hi]])
                whole = [None if t is None else front + t.encode("utf-8", "replace") if t else b"" for t in texts[lo:hi]]
                columns = []
                for ids, bounds in own.encode(marked[lo:hi]):
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=null))
                    columns.append(pa.array([b == t for b, t in zip(own.decode(ids, bounds), whole, strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["id", *names])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {'boolean' if n.endswith('exact') else 'array<int>'}" for n in names))


def decode(df: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of piece ids; null ids give a null text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in slices(batches):
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def library(path: str = MODEL) -> sentencepiece.SentencePieceProcessor:
    """The public library's processor, to compare with."""
    return sentencepiece.SentencePieceProcessor(model_file=path)


def op7_sentencepiece_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text of ``documents``, by the model's merges and by the
    largest sum of its scores, and whether they decode to it."""
    found = encode(table(spark, sf_dir, "documents"), viterbi=True)
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return found.select(F.col("id").alias("doc_id"), count("ids").alias("n_pieces"), "ids", "exact", count("viterbi_ids").alias("n_viterbi"), "viterbi_ids", "viterbi_exact")


QUERIES = {"op7_sentencepiece_trie": op7_sentencepiece_trie}
ORACLE_SQL: dict[str, str] = {}
