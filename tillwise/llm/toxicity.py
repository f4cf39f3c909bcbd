"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel compares two pieces of text by the letters they have in common in the same order,
three at a time, gaps allowed: a common subsequence weighs ``DECAY`` to the power of the
stretch it spans. So an insult with gaps or with characters put between its letters stays
close to the insult. Landmarks (Nystroem) stand for the space of all pieces, and a linear
machine with squared hinge loss is trained on them. The kernel's features are few enough to
be numbered, so the trained machine becomes one weight per subsequence, and every piece of
every text is scored; a text is as toxic as its worst piece.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillwise.llm.common import draw, giving_back, held_out, set_aside, small_batches, texts
from tillwise.session import materialize

DECAY = 0.8
REACH = 5
STARTS = 10
PIECE = STARTS + REACH
CODES = 64
TRAIN_DOCUMENTS = 1_000
#: Tasks that the sample is dealt to.
TRAIN_TASKS = 8
LANDMARKS = 256
OFFSETS = [(a, b) for b in range(2, REACH + 1) for a in range(1, b)]
THRESHOLD = 0.3


@lru_cache(maxsize=1)
def code_table() -> np.ndarray:
    """Code of each code point: 1 for what is no letter, letters alike in both cases.

    Latin letters have codes of their own as far as there are any. The letters of all other
    scripts share 36 codes by a hash, so that a word of theirs keeps its shape.
    """
    table = np.ones(0x110000, np.uint8)
    codes: dict[str, int] = {}
    for c in range(0x250):
        low = chr(c).lower()
        if len(low) == 1 and low.isalpha() and ord(low) < 0x180:
            number = codes.setdefault(low, len(codes))
            table[c] = 2 + number if number < 56 else 58 + number % 6
    for c in range(0x250, 0x110000):
        if chr(c).isalpha():
            table[c] = 28 + (ord(chr(c).lower()[0]) * 40503 >> 7) % 36
    return table


def codes_of(text: str) -> np.ndarray:
    """A text's codes; what is no letter becomes one 1, also around the text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.ones(len(points) + 2, np.int32)
    out[1:-1] = code_table()[points]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 1) | (out[:-1] != 1)
    out = out[keep]
    return np.concatenate([out, np.zeros(max(0, PIECE - len(out)), np.int32)])


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of a piece's subsequences that start in its first part."""
    n = len(codes)
    ids, weights = [], []
    for a, b in OFFSETS:
        m = min(STARTS, n - b)
        if m > 0:
            one = (codes[:m] * CODES + codes[a : a + m]) * CODES + codes[b : b + m]
            real = (codes[:m] > 0) & (codes[a : a + m] > 0) & (codes[b : b + m] > 0)
            ids.append(one[real])
            weights.append(np.full(int(real.sum()), DECAY ** (b + 1)))
    return np.concatenate(ids), np.concatenate(weights)


def piece_scores(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The kernel machine's value of each piece of a text, without its constant."""
    n = len(codes) - REACH
    total = np.zeros(n, np.float32)
    for a in range(1, REACH):
        two = (codes[:n] * CODES + codes[a : a + n]) * CODES
        for b in range(a + 1, REACH + 1):
            total += weights[b][two + codes[b : b + n]]
    sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
    width = min(STARTS, n)
    return sums[width:] - sums[:-width]


class Machine:
    """A trained machine: a weight per subsequence, a constant, and the scale of scores."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        table = weights.astype(np.float32)
        table.reshape(CODES, CODES, CODES)[0] = table.reshape(CODES, CODES, CODES)[:, 0] = table.reshape(CODES, CODES, CODES)[:, :, 0] = 0
        self.by_span = {b: (table * DECAY ** (b + 1)).astype(np.float32) for b in range(2, REACH + 1)}
        self.slope, self.shift = slope, shift

    def worst(self, text: str, chunk: int = 1 << 18, full: bool = False) -> tuple[float, np.ndarray]:
        """The largest value of any piece, and that piece's codes.

        Zeros after the text let its last letters start a subsequence; ``full`` pieces, which
        training learns from, have none.
        """
        codes = np.concatenate([codes_of(text), np.zeros(0 if full else REACH, np.int32)])
        best, piece = -math.inf, codes[:PIECE]
        for k in range(0, max(1, len(codes) - PIECE + 1), chunk):
            part = codes[k : k + chunk + PIECE - 1]
            scores = piece_scores(part, self.by_span)
            at = int(scores.argmax())
            if scores[at] > best:
                best, piece = float(scores[at]), part[at : at + PIECE]
        return best, piece

    def score(self, text: str) -> float:
        z = self.slope * self.worst(text)[0] + self.shift
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def fit_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1, steps: int = 30) -> np.ndarray:
    """Squared hinge loss by Newton steps on the rows inside the margin; last entry: constant."""
    x = np.concatenate([z, np.ones((len(z), 1))], 1)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(steps):
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(xa.T @ x[active] + np.diag(ridge), xa.T @ y[active])
        again = y * (x @ new) < 1
        w = new
        if (again == active).all():
            break
        active = again
    return w


def _kernel_machine(pieces: list[np.ndarray], y: np.ndarray, landmarks: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Weight per subsequence and constant of a machine trained on pieces."""
    known = [features(p) for p in landmarks]
    used = np.unique(np.concatenate([i for i, _ in known]))
    if not len(used):  # no landmark has three letters
        return np.zeros(CODES**3), 0.0
    base = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for k, (ids, w) in enumerate(known):
        np.add.at(base[:, k], np.searchsorted(used, ids), w)
    inner = base.T @ base
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.zeros((len(pieces), len(landmarks)))
    for k, p in enumerate(pieces):
        ids, w = features(p)
        at = np.minimum(np.searchsorted(used, ids), len(used) - 1)
        at = np.where(used[at] == ids, at, len(used))
        z[k] = w @ base[at]
    z = z @ root
    scale = float(np.sqrt((z**2).sum(1).mean())) or 1.0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w = fit_svm(z / scale, y.astype(float), share)
    alpha = root @ (w[:-1] / scale)
    table = np.zeros(CODES**3)
    table[used] = base[:-1] @ alpha
    return table, float(w[-1])


def _looser(piece: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """The piece with gaps, and with a letter put in at one place or two."""
    core = piece[piece > 0]
    inside = core[1:-1] if len(core) > 2 else core
    gaps = np.ones(2 * len(inside) + 1, np.int32)
    gaps[1::2] = inside
    out = [gaps]
    for n in (1, 2):
        at = np.sort(rng.integers(1, max(2, len(core) - 1), n))
        out.append(np.insert(core, at, rng.choice([1, *range(2, 28)], n)))
    return [np.concatenate([p[:PIECE], np.zeros(max(0, PIECE - len(p)), np.int32)]) for p in out]


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of toxic texts over their worst values."""
    mean, spread = x.mean(), x.std() or 1.0
    t = (x - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * t + b)))
        g = np.array([((p - y) * t).sum() + 0.01 * a, (p - y).sum()])
        v = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * t * t).sum() + 0.01, (v * t).sum()], [(v * t).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    a = max(a, 1e-3)
    return a / spread, b - a * mean / spread


def words_in(text: str) -> set[str]:
    return set("".join(c if c.isalpha() else " " for c in text.lower()).split())


def draws_in(text: str) -> list[np.ndarray]:
    """Two pieces from places that the text's hash gives."""
    codes = codes_of(text)
    seeds = (zlib.crc32(text.encode("utf-8", "replace")), zlib.crc32(text[::-1].encode("utf-8", "replace")))
    return [codes[at : at + PIECE] for at in (s % (len(codes) - PIECE + 1) for s in seeds)]


class Samples:
    """Labelled whole texts, and what training asks of them; here in this process.

    The driver never holds more of a text than a few pieces of it.
    """

    def __init__(self, rows: list[tuple[str, int]]):
        self.rows = rows

    def sizes(self) -> dict[int, int]:
        return {y: sum(label == y for _, label in self.rows) for y in (0, 1)}

    def word_counts(self, often: int) -> list[tuple[str, int, int]]:
        """(word, toxic texts, clean texts that have it) for words in ``often`` toxic texts or more."""
        seen = {0: Counter(), 1: Counter()}
        for text, label in self.rows:
            seen[label].update(words_in(text))
        return [(w, n, seen[0][w]) for w, n in seen[1].items() if n >= often]

    def ask(self, question: Callable[[str, int], object]) -> list:
        """The answers of all texts, None left out."""
        return [a for text, label in self.rows if (a := question(text, label)) is not None]


class TableSamples(Samples):
    """The same of a table (text, toxic), asked in its tasks."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def sizes(self) -> dict[int, int]:
        return {0: 0, 1: 0} | {r.toxic: r["count"] for r in self.rows.groupBy("toxic").count().collect()}

    def word_counts(self, often: int) -> list[tuple[str, int, int]]:
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, label in zip(texts(batch), batch.column("toxic").to_pylist()):
                    words = sorted(words_in(text.decode("utf-8", "replace")))
                    columns = [pa.array(words, pa.string()), pa.array([label] * len(words), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "toxic"])

        words = self.rows.mapInArrow(giving_back(split), "word string, toxic int")
        counts = words.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
        return [tuple(r) for r in counts.where(F.col("bad") >= often).collect()]

    def ask(self, question: Callable[[str, int], object]) -> list:
        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(texts(batch), batch.column("toxic").to_pylist())
                found = [question(t.decode("utf-8", "replace"), label) for t, label in rows]
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f) for f in found if f is not None], pa.binary())], names=["answer"])

        answers = self.rows.mapInArrow(giving_back(answer), "answer binary").collect()
        return [pickle.loads(bytes(r.answer)) for r in answers]


def train_machine(samples: Samples | list[tuple[str, int]], rounds: int = 6, seed: int = 11) -> Machine:
    """A machine from labelled whole texts.

    A toxic text does not say which piece makes it so. The first guess is its word that is
    most peculiar to toxic texts; from then on it is the piece the last machine thinks worst.
    Of clean texts the worst piece so far is learnt as clean.
    """
    if not isinstance(samples, Samples):
        samples = Samples(samples)
    rng = np.random.default_rng(seed)
    sizes = samples.sizes()
    n_toxic, n_clean = sizes[1], sizes[0]
    if not n_toxic or not n_clean:
        rate = n_toxic / max(1, n_toxic + n_clean)
        return Machine(np.zeros(CODES**3), 1e-3, math.log((rate + 0.01) / (1.01 - rate)))
    # A word must recur to be telling; how often, grows slowly with the sample.
    often = max(2, round(0.01 * n_toxic))
    telling = {}
    for w, bad, good in samples.word_counts(often):
        odds = math.log((bad + 0.2) / (n_toxic + 1)) - math.log((good + 0.2) / (n_clean + 1))
        if odds > 1.5:
            telling[w] = odds * math.log(1 + bad)
    in_order = lambda pieces: sorted(pieces, key=lambda p: p.tolist())
    best_word = lambda t, y: max(words_in(t) & telling.keys(), key=lambda w: (telling[w], w), default=None) if y else None
    as_piece = lambda w: codes_of(w)[:PIECE]
    positive = [as_piece(w) for w in sorted(samples.ask(best_word))] if telling else []
    marks = [as_piece(w) for w in sorted(telling, key=lambda w: (-telling[w], w))[: LANDMARKS // 2]]
    if not marks:
        positive = in_order(samples.ask(lambda t, y: as_piece(t) if y else None))
        marks = positive[:8]
    drawn = samples.ask(lambda t, y: None if y else draws_in(t))
    random_pieces = in_order(p for pieces in drawn for p in pieces)
    picked = rng.permutation(len(random_pieces))[: LANDMARKS // 4]
    others = [random_pieces[k] for k in picked]
    hard: list[np.ndarray] = []
    negative = list(random_pieces)
    machine = None
    for r in range(rounds):
        loose = [q for p in positive for q in _looser(p, rng)]
        pieces = [*positive, *loose, *negative]
        y = np.array([1] * (len(positive) + len(loose)) + [-1] * len(negative))
        table, _ = _kernel_machine(pieces, y, [*marks, *others, *hard[-LANDMARKS:]])
        machine = Machine(table, 1.0, 0.0)
        found = samples.ask(lambda t, y, machine=machine: (y, *machine.worst(t, full=True)))
        found.sort(key=lambda f: (f[0], -f[1], f[2].tolist()))
        clean = [(v, p) for y, v, p in found if y == 0]
        negative += [p for _, p in clean]
        hard += [p for _, p in clean[: LANDMARKS // 4]]
        line = np.quantile([v for v, _ in clean], 0.95)
        # Toxic texts whose worst piece looks clean may be mislabelled; they teach nothing.
        positive = [p for y, v, p in found if y == 1 and v > line] or positive
    values = sorted(samples.ask(lambda t, y: (y, machine.worst(t)[0])))
    slope, shift = _calibrate(np.array([v for _, v in values]), np.array([float(y) for y, _ in values]))
    machine.slope, machine.shift = slope, shift
    return machine


def train(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> Machine:
    """A machine from labelled documents outside the held-out quarter.

    ``limit`` bounds the sample: so many toxic documents at most and twice as many clean ones,
    those with the smallest hashed ids, whatever the size of the table. Their whole texts are
    learnt from. Of rows that share an id the first text in order counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    first = [known.where(F.col("toxic") == y).orderBy(draw("doc_id"), "doc_id").limit(limit * (2 - y)) for y in (0, 1)]
    # At most three times ``limit`` rows of two numbers.
    some = F.broadcast(materialize(first[0].union(first[1]), "sample"))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(some, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    few = rows.select(F.col("text").cast("binary").alias("text"), "toxic").repartition(TRAIN_TASKS)
    return train_machine(TableSamples(materialize(few, "sample-texts")))


def score_documents(documents: DataFrame, machine: Machine) -> DataFrame:
    """The documents' columns with ``_score``: 0 to 1, higher: toxic likelier.

    Every piece of a whole text counts. Null and empty texts are scored as a text without
    letters. Rows are independent, so repeated rows score alike. Columns may have any names; a
    column that has the result's is replaced.
    """
    documents, named_back = set_aside(documents.drop("_score"), "text")
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    names = documents.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            values = [score(t.decode("utf-8", "replace")) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*names, "_score"])

    found = small_batches(documents).mapInArrow(giving_back(apply), f"{fields}, `_score` double")
    return named_back(found, "_score")
