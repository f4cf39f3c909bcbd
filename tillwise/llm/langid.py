"""Language identification by a convolutional network over bytes, trained in numpy.

A text is cut into windows of a fixed number of bytes. Filters of several widths slide over
a window; each keeps its largest response (max pooling), and a softmax over the pooled
responses names the language. A text's language is the one with the largest mean
probability over all its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillwise.llm.common import LOWER, draw, giving_back, held_out, set_aside, small_batches, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
TRAIN_DOCUMENTS = 1_500
#: Documents that each language is learnt from at least, if it has so many.
LEAST_DOCUMENTS = 50
TRAIN_WINDOWS = 3
BLOCK = 512
NO_LETTERS = "und"

ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def windows(text: bytes) -> np.ndarray:
    """A text's bytes in rows of one window; the last is filled up with zeros."""
    data = np.frombuffer(text.translate(LOWER), np.uint8)
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, WINDOW)


class ByteNetwork:
    """Filters as tables: one row per byte value and place in the filter."""

    def __init__(self, classes: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        n = x.shape[1] - width + 1
        table = self.tables[width]
        total = table[0][x[:, :n]]
        for k in range(1, width):
            total += table[k][x[:, k : n + k]]
        return total

    def pooled(self, x: np.ndarray) -> np.ndarray:
        best = [self.responses(x, w).max(axis=1) for w in WIDTHS]
        return np.maximum(np.concatenate(best, 1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 2) -> None:
        """Adam on the mean cross-entropy, classes weighted alike."""
        rng = np.random.default_rng(seed)
        counts = np.bincount(y, minlength=len(self.classes))
        weight = (len(y) / (len(self.classes) * np.maximum(counts, 1))).astype(np.float32)
        names = [*self.tables, "bias", "out", "out_bias"]
        get = lambda k: self.tables[k] if k in self.tables else getattr(self, k)
        first = {k: np.zeros_like(get(k)) for k in names}
        second = {k: np.zeros_like(get(k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                grads = self._gradients(x[rows], y[rows], weight[y[rows]])
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    mean = first[k] / (1 - 0.9**step)
                    get(k)[...] -= rate * mean / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        n = len(x)
        best, where = [], []
        for w in WIDTHS:
            response = self.responses(x, w)
            place = response.argmax(axis=1)
            where.append(place)
            best.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0, :])
        pooled = np.maximum(np.concatenate(best, 1) + self.bias, 0)
        z = pooled @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), y] -= 1
        z *= (weight / n)[:, None]
        back = (z @ self.out.T) * (pooled > 0)
        grads: dict = {"out": pooled.T @ z, "out_bias": z.sum(0), "bias": back.sum(0)}
        for i, w in enumerate(WIDTHS):
            mine = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(self.tables[w])
            filters = np.broadcast_to(np.arange(FILTERS), where[i].shape)
            for k in range(w):
                np.add.at(grad[k], (np.take_along_axis(x, where[i] + k, 1), filters), mine)
            grads[w] = grad
        return grads


def labelled_windows(documents: DataFrame, limit: int) -> DataFrame:
    """(draw, lang, cut): the training sample, as windows of bytes.

    Each language gets an equal part of ``limit`` documents, but ``LEAST_DOCUMENTS`` at least,
    those with the smallest hashes, or all it has. So a rare language is learnt as well as a
    common one. Hashes are first held against a share of 62 bits per language, which keeps
    nearly all rows out of the ranking in a table of any size.
    """
    known = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    each = max(LEAST_DOCUMENTS, limit // max(1, len(counts)))
    # Twice the share wanted, and some more for small numbers.
    bounds = {lang: min(1.0, (2 * each + 50) / n) * (1 << 62) for lang, n in counts.items()} or {"": 0.0}
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]
    number = draw("doc_id", "text")
    few = known.withColumn("draw", number).where(F.col("draw").cast("double") <= bound)
    # A window's bytes are all that the driver needs of a document.
    starts = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), F.octet_length("text") - WINDOW + 1)) for k in range(TRAIN_WINDOWS)]
    data = F.col("text").cast("binary")
    cut = F.array(*[F.substring(data, (s + 1).cast("int"), F.lit(WINDOW)) for s in starts])
    ranked = few.select("draw", "lang", cut.alias("cut"), F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id")).alias("place"))
    return ranked.where(F.col("place") <= each).drop("place")


def train(documents: DataFrame, limit: int = TRAIN_DOCUMENTS, seed: int = 3) -> ByteNetwork:
    """A network fitted to about ``limit`` labelled documents outside the held-out quarter.

    ``limit`` is the bound of the training sample; see ``labelled_windows``. Of each document
    ``TRAIN_WINDOWS`` windows from anywhere in the text are learnt from.
    """
    rows = labelled_windows(documents, limit).collect()
    rows.sort(key=lambda r: (r.draw, r.lang, *map(bytes, r.cut)))
    classes = sorted({r.lang for r in rows}) or [NO_LETTERS]
    net = ByteNetwork(classes)
    x = [windows(bytes(c)) for r in rows for c in dict.fromkeys(map(bytes, r.cut)) if has_letter(bytes(c))]
    y = [classes.index(r.lang) for r in rows for c in dict.fromkeys(map(bytes, r.cut)) if has_letter(bytes(c))]
    if x and len(classes) > 1:
        net.fit(np.concatenate(x), np.array(y))
    return net


def predict(net: ByteNetwork, batch: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score of each text, all windows of the batch in blocks."""
    alive = [has_letter(t) for t in batch]
    cut = [windows(t) if a else np.zeros((0, WINDOW), np.uint8) for t, a in zip(batch, alive)]
    rows = np.concatenate(cut) if cut else np.zeros((0, WINDOW), np.uint8)
    p = [net.probabilities(rows[k : k + BLOCK]) for k in range(0, len(rows), BLOCK)]
    sums = np.concatenate([np.zeros((1, len(net.classes))), np.cumsum(np.concatenate(p), axis=0, dtype=np.float64)]) if p else np.zeros((1, len(net.classes)))
    langs, scores, at = [], [], 0
    for a, c in zip(alive, cut):
        mean = (sums[at + len(c)] - sums[at]) / max(1, len(c))
        at += len(c)
        best = int(mean.argmax())
        langs.append(net.classes[best] if a else NO_LETTERS)
        scores.append(float(min(1.0, max(0.0, mean[best]))) if a else 0.0)
    return langs, scores


def identify(documents: DataFrame, net: ByteNetwork) -> DataFrame:
    """The documents' columns with ``_lang`` and ``_score``, over all windows of whole texts.

    Null text, empty text and text without a letter are ``und`` with score 0. Rows are
    independent of each other, so repeated rows get the same answer. Without training rows
    every text is ``und``. Columns of the input that have the results' names are replaced.
    """
    documents, named_back = set_aside(documents.drop("_lang", "_score"), "text")
    shared = documents.sparkSession.sparkContext.broadcast(net)
    names = documents.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            waiting: list[bytes] = []
            size = 0
            for text in texts(batch):
                waiting.append(text)
                size += len(text)
                if size >= 1 << 20:
                    for out, more in zip((langs, scores), predict(shared.value, waiting)):
                        out += more
                    waiting, size = [], 0
            for out, more in zip((langs, scores), predict(shared.value, waiting)):
                out += more
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, "_lang", "_score"],
            )

    found = small_batches(documents).mapInArrow(giving_back(apply), f"{fields}, `_lang` string, `_score` double")
    return named_back(found, "_lang", "_score")


def keep_identified(documents: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents in a known language, unchanged.

    Rejected are texts without a letter, and texts for which no language reaches ``least``:
    with four languages even an undecided network gives the best about a quarter. Columns may
    have any names.
    """
    net = train(documents)
    rows, named_back = set_aside(documents, "text")
    found = identify(rows, net)
    good = (F.col("_lang") != NO_LETTERS) & (F.col("_score") >= least)
    return named_back(found.where(good))
