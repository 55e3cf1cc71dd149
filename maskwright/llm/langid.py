"""Language identification by unigram pieces with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum over all its segmentations into pieces, found by the forward
algorithm; a text's is the product over its words. The forward algorithm runs over the distinct
words of a batch at once, one word length at a time, and remembers words within a worker.

Piece probabilities are learned in the same model: words of a bounded sample of rows, about
``per_lang`` documents of each language chosen by a hash, with their whole texts, are counted on
Spark, and ``ROUNDS`` rounds of expectation-maximisation sum each piece's expected count over all
segmentations (forward-backward), from equal probabilities on. Prediction is a map over whole
texts with no shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0; words of more than
``LONGEST`` characters are walked in runs of that many, and segmentations across the runs count;
with nothing to learn from all is ``und``; ties go to the first language in code-point order; a
null key is kept; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialise
from maskwright.llm.tokencount import runs

LONGEST = 48
#: Rounds of expectation-maximisation.
ROUNDS = 3
#: Characters after which forward and backward values are scaled anew.
SCALED = 6
#: Words that a worker remembers before it starts anew.
REMEMBERED = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(r"(?<=\w) (?=\w)")
_loaded: dict[str, object] = {}


def _processor(path: str) -> object:
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


@dataclass(frozen=True)
class Model:
    """log_p: pieces by languages; a character outside the vocabulary costs its bytes' pieces."""

    path: str
    langs: tuple[str, ...]
    log_p: np.ndarray


class Pieces:
    """The vocabulary's pieces, found at all places of words of one length."""

    def __init__(self, path: str) -> None:
        sp = _processor(path)
        pieces = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        keys = np.array([self._hash(p) for _, p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for i, _ in pieces])[order]
        self.size, self.longest = sp.get_piece_size(), max(len(p) for _, p in pieces)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * int(_BASE) + ord(ch) + 1) % 2**64
        return h

    def found(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per size (from 1) the piece at each place of each word or -1, and the byte pieces of characters outside the vocabulary.

        The k-th of these characters stands as piece ``size + k``.
        """
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, n).astype(np.uint64)
        h, out, outside = np.zeros((m, n), np.uint64), [], []
        for size in range(1, min(self.longest, n) + 1):
            h = h[:, : n - size + 1] * _BASE + codes[:, size - 1 :] + np.uint64(1)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.where(self.keys[at] == h, self.ids[at], -1)
            if size == 1 and (hit < 0).any():
                chars, which = np.unique(codes[hit < 0], return_inverse=True)
                hit[hit < 0] = self.size + which
                outside = [self.bytes[list(chr(c).encode("utf-8", "replace"))] for c in chars.tolist()]
            out.append(hit)
        return out, outside


def _priced(p: np.ndarray, outside: list[np.ndarray]) -> np.ndarray:
    """Probabilities of pieces and, behind them, of characters outside the vocabulary."""
    return np.concatenate([p, np.array([p[b].prod(axis=0) for b in outside])]) if outside else p


def _forward(found: list[np.ndarray], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled sums over the segmentations up to each place (places, words, languages), and their log scales."""
    m, n = found[0].shape
    alpha, scale = np.zeros((n + 1, m, p.shape[1])), np.zeros((n + 1, m, p.shape[1]))
    alpha[0] = 1
    for i in range(n):
        if i and i % SCALED == 0:
            most = alpha[i : i + len(found)].max(axis=0)
            alpha[i : i + len(found)] /= most
            scale[i:] += np.log(most)
        for size, ids in enumerate(found[: n - i], 1):
            hit = np.flatnonzero(ids[:, i] >= 0)
            if len(hit):
                alpha[i + size, hit] += alpha[i, hit] * p[ids[hit, i]]
    return alpha, scale


def expected(pieces: Pieces, words: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words of one length, each as often as ``times`` says; ``p`` is one language's."""
    found, outside = pieces.found(words)
    price = _priced(p[:, None], outside)
    n = len(words[0])
    alpha, up = _forward(found, price)
    # the same from the end: place i of the mirrored words is place n - i
    beta, down = _forward([ids[:, ::-1] for ids in found], price)
    total = np.log(alpha[n]) + up[n]
    out = np.zeros(len(price))
    for size, ids in enumerate(found, 1):
        row, i = np.nonzero(ids >= 0)
        piece = ids[row, i]
        log = up[i, row, 0] + down[n - i - size, row, 0] - total[row, 0]
        share = alpha[i, row, 0] * beta[n - i - size, row, 0] * price[piece, 0] * np.exp(log)
        out += np.bincount(piece, share * times[row], len(price))
    for k, b in enumerate(outside):
        np.add.at(out, b, out[pieces.size + k])
    return out[: pieces.size]


class Forward:
    """Log-probabilities of words in every language, all segmentations summed."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces, self.p = model, Pieces(model.path), np.exp(model.log_p)
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)))

    def _words(self, words: list[str]) -> np.ndarray:
        """Words of one length, as they stand in the text with the mark of a word's start."""
        found, outside = self.pieces.found(words)
        alpha, scale = _forward(found, _priced(self.p, outside))
        return np.log(alpha[-1]) + scale[-1]

    def _long(self, word: str) -> np.ndarray:
        """A long word run by run; only the sums that a piece can still reach are held."""
        reach = self.pieces.longest
        ahead, log, at = [np.ones(self.p.shape[1]), *[np.zeros(self.p.shape[1])] * reach], np.zeros(self.p.shape[1]), 0
        for run in pieces_of(word[1:]):
            found, outside = self.pieces.found([word[at : at + len(run) + reach - 1]])
            price = _priced(self.p, outside)
            for i in range(len(run)):
                here = ahead[0]
                for size, ids in enumerate(found, 1):
                    if i < ids.shape[1] and ids[0, i] >= 0:
                        ahead[size] = ahead[size] + here * price[ids[0, i]]
                ahead = [*ahead[1:], np.zeros(self.p.shape[1])]
                if i % SCALED == SCALED - 1:
                    most = np.max(ahead, axis=0)
                    ahead, log = [a / most for a in ahead], log + np.log(most)
            at += len(run)
        return np.log(ahead[0]) + log

    def learn(self, words: set[str]) -> None:
        """Score the words that are not known yet."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > REMEMBERED:
            self.index, self.table, new = {}, np.zeros((0, len(self.model.langs))), list(words)
        by: dict[int, list[str]] = {}
        for w in new:
            by.setdefault(len(w), []).append(w)
        found = [self.table]
        for group in by.values():
            for i in range(0, len(group), 10_000):
                part = group[i : i + 10_000]
                self.index.update(zip(part, range(len(self.index), len(self.index) + len(part)), strict=True))
                found.append(self._words(part))
        self.table = np.concatenate(found)

    def texts(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text in each language."""
        split = [["▁" + w for w in t.split()] for t in texts]
        self.learn({w for words in split for w in words if len(w) <= LONGEST})
        out, get = np.zeros((len(texts), len(self.model.langs))), self.index.__getitem__
        for n, words in enumerate(split):
            if words and max(map(len, words)) > LONGEST:
                out[n] = sum(self._long(w) for w in words if len(w) > LONGEST)
                words = [w for w in words if len(w) <= LONGEST]
            out[n] += self.table[list(map(get, words))].sum(axis=0)
        return out


def pieces_of(text: str) -> list[str]:
    """A text's words behind the start mark, long ones in runs."""
    words = ["▁" + w for w in text.split()]
    if max(map(len, words), default=0) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def stretches(text: str, least: int = 100_000) -> Iterator[str]:
    """The whole text in stretches of at least ``least`` characters, cut at single blanks between words."""
    start = 0
    while len(text) - start > least and (m := _CUT.search(text, start + least)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def fit(docs: DataFrame, learnable: Column, vocabulary: str, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 1500, smoothing: float = 0.1) -> Model:
    """Fit piece probabilities from the text and language of rows for which ``learnable`` holds."""
    told = docs.filter(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["lang"]: r["n"] for r in told.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = tuple(sorted(counts, key=lambda x: x.encode()))
    size = _processor(vocabulary).get_piece_size()
    if not langs:
        return Model(vocabulary, (), np.zeros((size, 0)))
    # a document is in the sample if its hash is in its language's share; equal ids are told apart by text
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))])
    draw = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit("langid")), F.lit(1_000_003)) / 1_000_003.0
    sample = told.filter(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, 2_000_000):
                found: Counter = Counter()
                for k, t in zip(run.column(0).to_pylist(), run.column(1).to_pylist(), strict=True):
                    found.update((k, w) for part in stretches(t) for w in part.split())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    words = materialise(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    at = {k: i for i, k in enumerate(langs)}
    p = np.full((size, len(langs)), 1 / size)
    for _ in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(p)  # pieces x languages doubles

        def expect(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            pieces = Pieces(vocabulary)
            for batch in batches:
                groups: dict[tuple[str, int], list[tuple[str, int]]] = {}
                for k, w, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    groups.setdefault((k, len(w) + 1), []).append(("▁" + w, times))
                sums: dict[str, np.ndarray] = {}
                for (k, length), members in groups.items():
                    step = max(1, 200_000 // length)
                    for i in range(0, len(members), step):
                        ws, times = zip(*members[i : i + step], strict=True)
                        sums[k] = sums.get(k, 0) + expected(pieces, list(ws), np.array(times, float), shared.value[:, at[k]])
                for k, total in sums.items():
                    some = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some], pa.float64())], ["lang", "piece", "n"])

        n = np.full((size, len(langs)), smoothing)
        for r in words.mapInArrow(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():  # at most pieces x languages
            n[r["piece"], at[r["lang"]]] += r["n"]
        p = n / n.sum(axis=0)
    return Model(vocabulary, langs, np.log(p))


def predictions(forward: Forward | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its probability of each text; without a model all is ``und``."""
    ok = [i for i, t in enumerate(texts) if forward and t and any(map(str.isalpha, t))]
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    if ok:
        logs = forward.texts([texts[i] for i in ok])
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i, row, best in zip(ok, p, p.argmax(axis=1), strict=True):
            pred[i], score[i] = forward.model.langs[best], float(row[best])
    return pred, score


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (its probability under equal priors) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages doubles

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = Forward(shared.value) if shared.value.langs else None
        for batch in batches:
            for run in runs(batch, 4_000_000):
                pred, score = predictions(forward, run.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(predict, f"key {kind}, lang_pred string, score double")
    return found.withColumnRenamed("key", key)


def keep_known(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, in a language that the model tells with ``least`` probability."""
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = Forward(shared.value) if shared.value.langs else None
        for batch in batches:
            for run in runs(batch, 4_000_000):
                pred, score = predictions(forward, run.column(at).to_pylist())
                yield run.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
