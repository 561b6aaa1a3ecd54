"""Language of words and texts by a linear-chain conditional random field.

A word is a run of letters (A-Z, a-z and bytes from 128).  Its emission sums weights of its
prefixes and suffixes of 1-3 bytes, its byte trigrams and its own lexicon entry; learned
transitions link neighbours, and forward-backward gives each word's language in
code-switched text.  A text's language is that with the largest sum of word marginals, its
score that sum's share.

The chain runs over the whole text, however long: blocks of ``BLOCK`` words are first
reduced to one transfer matrix each, these are scanned, and the words of all blocks are then
labelled at once, which is exact.

Texts that are null or have no letter are ``und`` with score 0; so are all texts when
nothing could be learnt.  Repeated rows get equal results, an empty table gives no row, and
ties go to the first language in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, slices, table, text_bytes
from .quality import remainder
from .textkit import LOWER, Words

BITS = 17
BLOCK = 32
SAMPLE_ROWS = 400
SEGMENT_WORDS = 160
BLOCK_BYTES = 1 << 19
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ASCII_LETTER = _LETTER & (np.arange(256) < 128)


class LetterWords(Words):
    """Runs of letters instead of runs without white space."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts) + b" "
        self.raw = np.frombuffer(joined, np.uint8)
        self.data = LOWER[self.raw]
        letter = _LETTER[self.raw]
        before = np.empty_like(letter)
        before[0] = False
        before[1:] = letter[:-1]
        self.start = np.flatnonzero(letter & ~before)
        self.end = np.flatnonzero(before & ~letter)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        self.first = np.searchsorted(self.start, np.append(self.text_start, len(joined)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def word_features(words: LetterWords) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, first, feature, weight): word i is distinct word ``kind[i]``, which has the
    hashed features ``feature[first[k]:first[k+1]]`` with their weights."""
    sums = words.sums()
    whole = words.span(sums, words.start, words.end)
    _, at, kind = np.unique(whole, return_index=True, return_inverse=True)
    start, end = words.start[at], words.end[at]
    size, n = end - start, len(at)
    mask = np.uint64((1 << BITS) - 1)
    owners, hashes, weights = [np.arange(n)], [whole[at] + np.uint64(1)], [np.ones(n)]
    for k in (1, 2, 3):
        fits = np.flatnonzero(size >= k)
        for salt, begin in ((2 * k, start[fits]), (2 * k + 1, end[fits] - k)):
            owners.append(fits)
            hashes.append(words.span(sums, begin, begin + k) * np.uint64(2 * salt + 3))
            weights.append(np.ones(len(fits)))
    inner = np.maximum(size - 2, 0)
    owner = np.repeat(np.arange(n), inner)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(inner) - inner, inner) + start[owner]
    owners.append(owner)
    hashes.append(words.span(sums, begin, begin + 3) * np.uint64(41))
    weights.append((1 / np.sqrt(np.maximum(inner, 1)))[owner])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    feature = ((np.concatenate(hashes) >> np.uint64(11)) & mask).astype(np.int64)[order]
    first = np.searchsorted(owner[order], np.arange(n + 1))
    return kind, first, feature, np.concatenate(weights)[order]


class Chain:
    """Weights of the field over ``languages``, and its inference."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        n = len(languages)
        self.emit = np.zeros((1 << BITS, n), np.float32)
        self.step = np.zeros((n, n))

    def emissions(self, first: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(distinct words, languages) positive potentials, the largest of each word 1."""
        if len(first) < 2:
            return np.ones((0, len(self.languages)))
        e = np.add.reduceat(self.emit[feature] * weight[:, None], first[:-1], axis=0)
        return np.exp(e - e.max(axis=1, keepdims=True))

    def marginals(self, potentials: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Word marginals of the concatenated chains of lengths ``counts``."""
        n = potentials.shape[1]
        move = np.exp(self.step - self.step.max())
        blocks = -(-counts // BLOCK)
        total = int(blocks.sum())
        if not total:
            return potentials
        opening = np.cumsum(blocks) - blocks
        chain = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(chain)) - (np.cumsum(counts) - counts)[chain]
        row, column = opening[chain] + within // BLOCK, within % BLOCK
        e = np.ones((BLOCK, total, n))
        e[column, row] = potentials
        width = np.zeros(total, np.int64)
        np.maximum.at(width, row, column + 1)
        transfer = np.broadcast_to(np.eye(n), (total, n, n)).copy()
        for t in range(BLOCK):
            on = slice(None) if width.min() > t else np.flatnonzero(width > t)
            step = (transfer[on].reshape(-1, n) @ move).reshape(-1, n, n) * e[t, on][:, None, :]
            transfer[on] = step / step.max(axis=(1, 2), keepdims=True)
        entry, leave = np.full((total, n), 1 / n), np.ones((total, n))
        most = int(blocks.max())
        by_size = np.argsort(-blocks, kind="stable")
        sizes = -blocks[by_size]
        for j in range(1, most):
            at = opening[by_size[: np.searchsorted(sizes, -j)]] + j
            v = np.einsum("ci,cij->cj", entry[at - 1], transfer[at - 1])
            entry[at] = v / v.sum(axis=1, keepdims=True)
        for j in range(most - 1, 0, -1):
            at = opening[by_size[: np.searchsorted(sizes, -j)]] + j
            v = np.einsum("cij,cj->ci", transfer[at], leave[at])
            leave[at - 1] = v / v.sum(axis=1, keepdims=True)
        forward = np.empty_like(e)
        v = entry
        for t in range(BLOCK):
            v = np.where((width > t)[:, None], (v @ move) * e[t], v)
            v = v / v.sum(axis=1, keepdims=True)
            forward[t] = v
        v = leave
        for t in range(BLOCK - 1, -1, -1):
            here = forward[t] * v
            forward[t] = here / here.sum(axis=1, keepdims=True)
            v = np.where((width > t)[:, None], (e[t] * v) @ move.T, v)
            v = v / v.sum(axis=1, keepdims=True)
        return forward[column, row]

    def label(self, texts: list[bytes]) -> tuple[LetterWords, np.ndarray]:
        """The words of the texts and their marginals."""
        words = LetterWords(texts)
        if not len(words.start):
            return words, np.zeros((0, len(self.languages)))
        kind, first, feature, weight = word_features(words)
        return words, self.marginals(self.emissions(first, feature, weight)[kind], np.diff(words.first))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        words, p = self.label(texts)
        count = np.diff(words.first)
        sums = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(count)
        if len(full):
            sums[full] = np.add.reduceat(p, words.first[full], axis=0)
        score = np.clip(sums.max(axis=1) / np.maximum(count, 1), 0, 1)
        ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[words.raw])])
        plain = ascii_letters[words.text_end - 1] > ascii_letters[words.text_start]
        best = sums.argmax(axis=1)
        names = []
        for i, t in enumerate(texts):
            if count[i] and (plain[i] or any(c.isalpha() for c in t.decode("utf-8", "replace"))):
                names.append(self.languages[best[i]])
            else:
                names.append(UNKNOWN)
                score[i] = 0.0
        return names, score

    def fit(self, segments: list[tuple[bytes, int]], epochs: int = 6, rate: float = 0.25, decay: float = 1e-6, length: int = 64, batch: int = 64, seed: int = 5) -> Chain:
        """Adagrad on the conditional likelihood of spliced chains.

        Each chain of ``length`` words is put together from runs of 4-40 words of random
        segments, so that transitions between languages are seen.
        """
        rng = np.random.default_rng(seed)
        words = LetterWords([t for t, _ in segments])
        kind, first, feature, weight = word_features(words)
        truth = np.array([y for _, y in segments])
        spans = [(words.first[i], words.first[i + 1]) for i in range(len(segments)) if words.first[i + 1] > words.first[i]]
        if not spans:
            return self
        n, total = len(self.languages), len(kind)
        gain = np.full_like(self.emit, 1e-3)
        gain_step = np.full_like(self.step, 1e-3)
        for _ in range(epochs * max(1, total // (length * batch))):
            pick = np.empty((batch, length), np.int64)
            for i in range(batch):
                at = 0
                while at < length:
                    lo, hi = spans[rng.integers(len(spans))]
                    run = min(int(rng.integers(4, 41)), length - at, hi - lo)
                    begin = int(rng.integers(lo, hi - run + 1))
                    pick[i, at : at + run] = np.arange(begin, begin + run)
                    at += run
            own, place = np.unique(kind[pick], return_inverse=True)
            place = place.reshape(batch, length)
            cut = np.concatenate([[0], np.cumsum(first[own + 1] - first[own])])
            index = np.arange(cut[-1]) - np.repeat(cut[:-1] - first[own], np.diff(cut))
            f, w = feature[index], weight[index]
            e = self.emissions(cut, f, w)[place].transpose(1, 0, 2)
            move = np.exp(self.step - self.step.max())
            alpha = np.empty_like(e)
            v = np.full((batch, n), 1 / n)
            for t in range(length):
                v = (v @ move) * e[t]
                v /= v.sum(axis=1, keepdims=True)
                alpha[t] = v
            y = truth[words.doc[pick]].T
            d = np.zeros_like(e)
            d_step = np.zeros_like(self.step)
            v = np.ones((batch, n))
            for t in range(length - 1, -1, -1):
                here = alpha[t] * v
                d[t] = -here / here.sum(axis=1, keepdims=True)
                if t:
                    joint = alpha[t - 1][:, :, None] * move * (e[t] * v)[:, None, :]
                    d_step -= (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                v = (e[t] * v) @ move.T
                v /= v.sum(axis=1, keepdims=True)
            np.add.at(d, (np.arange(length)[:, None], np.arange(batch), y), 1)
            np.add.at(d_step, (y[:-1], y[1:]), 1)
            flat, to = d.transpose(1, 0, 2).reshape(-1, n) / batch, place.ravel()
            by_word = np.stack([np.bincount(to, flat[:, k], len(own)) for k in range(n)], axis=1)
            owner = np.repeat(np.arange(len(own)), np.diff(cut))
            used, slot = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(slot, by_word[owner, k] * w, len(used)) for k in range(n)], axis=1) - decay * self.emit[used]
            gain[used] += grad**2
            self.emit[used] += rate * grad / np.sqrt(gain[used])
            d_step /= batch
            gain_step += d_step**2
            self.step += rate * d_step / np.sqrt(gain_step)
        return self


def segments(text: bytes) -> list[bytes]:
    """The whole text in pieces of ``SEGMENT_WORDS`` words."""
    words = text.split()
    return [b" ".join(words[i : i + SEGMENT_WORDS]) for i in range(0, len(words), SEGMENT_WORDS)]


def fit_chain(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A field learnt from (doc_id, text, lang) rows whose language is known, over every
    language that occurs; its weights take half a megabyte a language.

    Of each language the ``sample_rows`` rows with the smallest hashes of the id are picked
    (ids alone move), and of all segments of their whole texts the ``sample_rows`` with the
    smallest hashes.  So the sample is bounded, also where ids repeat, and every part of a
    text is as likely to be in it as any other.
    """
    known = documents.where("lang is not null and doc_id is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = known.select("doc_id", "lang").withColumn("_rank", rank).where(F.col("_rank") <= sample_rows).select("doc_id", "lang").distinct()
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(x, s) for x, t in zip(batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True) for s in segments(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.binary())], ["lang", "segment"])

    each = rows.mapInArrow(run, "lang string, segment binary")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("segment"), "segment"))
    found = sorted((r.lang, bytes(r.segment)) for r in each.withColumn("_rank", order).where(F.col("_rank") <= sample_rows).collect())
    languages = sorted({x for x, _ in found})
    return Chain(languages).fit([(s, languages.index(x)) for x, s in found])


def identify(df: DataFrame, chain: Chain, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``df`` with the language and score of each text; nothing is shuffled."""
    kept = [f for f in df.schema.fields if f.name not in (lang_col, score_col)]
    at = [f.name for f in kept].index(text_col)
    fields = [*kept, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    shared = df.sparkSession.sparkContext.broadcast(chain)  # 2**BITS weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_bytes(batch.column(at))
            names: list[str] = []
            scores = [np.zeros(0)]
            for lo, hi in chunks([len(t) for t in texts], BLOCK_BYTES):
                found, score = shared.value.predict(texts[lo:hi])
                names += found
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores))], [f.name for f in fields])

    return df.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, T.StructType(fields))


def language_runs(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, lang, score): runs of words of one language in each text, as UTF-8
    byte positions, with the mean marginal; a text without letters has none."""
    shared = df.sparkSession.sparkContext.broadcast(chain)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for lo, hi in chunks([len(t) for t in texts], BLOCK_BYTES):
                words, p = shared.value.label(texts[lo:hi])
                best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
                new = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (words.doc[1:] != words.doc[:-1]))) if len(best) else np.zeros(0, int)
                last = np.append(new[1:], len(best)) - 1 if len(best) else new
                owner = words.doc[new]
                top = p.max(axis=1) if len(p) else np.zeros(0)
                mean = np.add.reduceat(top, new) / (last - new + 1) if len(new) else np.zeros(0)
                columns = [[ids[lo + i] for i in owner], (words.start[new] - words.text_start[owner]).tolist(), (words.end[last] - words.text_start[owner]).tolist(), [shared.value.languages[k] for k in best[new]], mean.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.float64())], ["id", "start", "end", "lang", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, start long, end long, lang string, score double")


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learnt outside the held-out fifth."""
    documents = table(spark, sf_dir, "documents")
    chain = fit_chain(documents.select("doc_id", "text", "lang").where(remainder("doc_id", 5) != 0))
    found = identify(documents.select("doc_id", "text"), chain)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op10_language_crf": op10_language_crf}
ORACLE_SQL: dict[str, str] = {}
