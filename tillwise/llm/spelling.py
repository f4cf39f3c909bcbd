"""Spelling variants: words one edit apart, by blocked Gram matrices.

A word is a vector of letter counts. An edit moves it little: one letter put in or taken out is
a squared distance of one, one replaced a distance of two. So words are compared by products
of blocks of vectors, which give all squared distances of two blocks at once, and only pairs at
a distance of at most two are compared letter by letter.

Blocks hold words of one length and of equal counts in five classes of letters. An edit leads
to the same block, to one where a count is one more, or to one where one count is one more and
another one less; nothing else is compared, and nothing near is missed. A block is cut into
tiles. A tile's words are at home in it, and the words of neighbouring blocks and of later
tiles visit it, so each pair meets exactly once and no task holds more than a tile of homes
and a part of the visitors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillwise.llm.common import giving_back
from tillwise.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters a word may hold; all are single bytes in Latin-1.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
CLASSES = 5
#: Words at home in a tile, fewer if they are long: their letters are bounded as well.
TILE = 4_096
TILE_LETTERS = 1 << 22
#: Visitors compared at once.
VISITORS = 1_024


# --- words -----------------------------------------------------------------------------


def misspelt(run: Column, doc_id: Column, one_in: int) -> Column:
    """``run`` without one letter where ``one_in`` divides the CRC-32 of ``<doc_id>:<run>``.

    The letter is that at the CRC's remainder by the run's length. A null id changes nothing.
    """
    hashed = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (hashed % F.length(run)).cast("int")
    less = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(hashed % one_in == 0, less).otherwise(run)


def counted_words(documents: DataFrame, one_in: int | None = 97, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): the words of whole texts that are long and frequent enough.

    Words are runs of letters, A-Z lower-cased; with ``one_in``, misspelt now and then. Null
    texts have none; repeated rows count again. Counts merge before they are shuffled.
    """
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run"))
    low = F.translate("run", UPPER, LOWER)
    word = low if one_in is None else misspelt(low, F.col("doc_id"), one_in)
    long = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


# --- blocks ----------------------------------------------------------------------------


def class_counts(word: Column) -> Column:
    """How many letters of each class a word has; the counts add up to its length."""
    groups = ["".join(c for c in LETTERS if ord(c) % CLASSES == k) for k in range(CLASSES)]
    return F.array(*[F.length(word) - F.length(F.translate(word, g, "")) for g in groups])


def _moves() -> list[list[int]]:
    """What a visitor's counts have more than those of the home: one letter more, or one in another class."""
    unit = np.eye(CLASSES, dtype=int)
    more = [unit[i] for i in range(CLASSES)]
    other = [unit[i] - unit[j] for i in range(CLASSES) for j in range(i)]
    return [m.tolist() for m in (*more, *other)]


def _dealt(words: DataFrame) -> DataFrame:
    """(block, tile, visits, word, n): each word once at home and once for each tile it visits."""
    keyed = words.select("word", "n", class_counts(F.col("word")).alias("counts"))
    length = F.aggregate("counts", F.lit(0), lambda a, c: a + c)
    rows = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_LETTERS) / length)))
    blocks = keyed.groupBy("counts").agg(F.count("*").alias("size"))
    blocks = blocks.select("counts", F.ceil(F.col("size") / rows).cast("int").alias("tiles"), F.monotonically_increasing_id().alias("block"))
    blocks = materialize(blocks, "blocks")
    homes = F.array(*[F.array(*[F.col("counts")[k] - m[k] for k in range(CLASSES)]) for m in _moves()])
    of_home = blocks.select(F.col("counts").alias("home"), F.struct("block", "tiles").alias("host"))
    hosts = blocks.select("counts", F.explode(homes).alias("home")).join(of_home, "home")
    # At most as many hosts as there are moves.
    hosts = hosts.groupBy("counts").agg(F.collect_list("host").alias("hosts"))
    known = materialize(blocks.join(hosts, "counts", "left"), "hosts")
    placed = keyed.join(known, "counts").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    place = lambda block, tile, visits: F.struct(block.alias("block"), tile.alias("tile"), F.lit(visits).alias("visits"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda t: t < n)
    own = F.transform(upto(F.col("tile")), lambda t: place(F.col("block"), t, True))
    other = F.flatten(F.transform("hosts", lambda h: F.transform(upto(h["tiles"]), lambda t: place(h["block"], t, True))))
    none = F.array().cast("array<struct<block:long,tile:int,visits:boolean>>")
    places = F.concat(F.array(place(F.col("block"), F.col("tile"), False)), own, F.coalesce(other, none))
    return placed.select(F.explode(places).alias("place"), "word", "n").select("place.*", "word", "n")


# --- comparison ------------------------------------------------------------------------


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _vectors(letters: np.ndarray, side: int) -> np.ndarray:
    """Letter counts, with two more places so that products of both sides are minus half the squared distances."""
    m, width = letters.shape
    at = (np.arange(m)[:, None] * 256 + letters).ravel()
    # Single precision is exact as long as squares stay below 2^24.
    kind = np.float32 if width < 4_000 else np.float64
    counts = np.bincount(at, minlength=m * 256).reshape(m, 256).astype(kind)
    half = -(counts**2).sum(axis=1, keepdims=True) / 2
    one = np.ones((m, 1), kind)
    return np.concatenate([counts[:, 0x60:], *((half, one) if side == 0 else (one, half))], axis=1)


def _same_until(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters rows have in common at their begin."""
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` are one edit from those of ``b``, as long or one letter longer."""
    n = a.shape[1]
    front = _same_until(a, b[:, :n])
    back = _same_until(a[:, ::-1], b[:, ::-1][:, :n])
    return front + back == n - 1 if b.shape[1] == n else front + back >= n


class Tile:
    """The words at home in a tile, compared with its visitors as they come."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, np.array(n, np.int64)
        self.letters = letters_of(words)
        self.vectors = _vectors(self.letters, 0)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places (home, visitor) of words of one length that are one edit apart."""
        letters = letters_of(words)
        vectors = _vectors(letters, 1)
        used = np.flatnonzero(self.vectors.any(axis=0) & vectors.any(axis=0))
        close = self.vectors[:, used] @ vectors[:, used].T >= -1
        i, j = np.nonzero(close)
        good = np.zeros(len(i), bool)
        step = max(1, TILE_LETTERS // max(1, letters.shape[1]))
        for k in range(0, len(i), step):
            good[k : k + step] = one_edit(self.letters[i[k : k + step]], letters[j[k : k + step]])
        return i[good], j[good]


def _best(target: np.ndarray, other: np.ndarray, words: list[str], near: list[str], n: np.ndarray) -> list[tuple]:
    """Per target word: its near words here, and of these the most frequent, the first of equal ones."""
    order = np.lexsort((np.argsort(np.argsort(np.array(near, object)))[other], -n[other], target))
    target, other = target[order], other[order]
    begin = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    many = np.diff(np.append(begin, len(target)))
    return [(words[t], m, -int(n[o]), near[o]) for t, o, m in zip(target[begin].tolist(), other[begin].tolist(), many.tolist())]


FOUND = "word string, n_near long, minus_n long, near string"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles one after another: homes first, then their visitors."""
    key: tuple | None = None
    homes: list[tuple[str, int]] = []
    waiting: dict[int, list[tuple[str, int]]] = {}
    tile: Tile | None = None

    def settle(length: int) -> list[tuple]:
        visitors = waiting.pop(length)
        words, n = [w for w, _ in visitors], np.array([k for _, k in visitors], np.int64)
        i, j = tile.near(words)
        if not len(i):
            return []
        return _best(i, j, tile.words, words, n) + _best(j, i, words, tile.words, tile.n)

    def opened() -> list[tuple]:
        """The pairs among the homes themselves, once all are there."""
        nonlocal tile
        tile = Tile([w for w, _ in homes], [n for _, n in homes])
        found = []
        for k in range(0, len(homes), VISITORS):
            i, j = tile.near(tile.words[k : k + VISITORS])
            if len(i):  # each pair is found from both sides
                found += _best(i, j + k, tile.words, tile.words, tile.n)
        return found

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, kinds)], names=["word", "n_near", "minus_n", "near"])

    def closed() -> list[tuple]:
        found = opened() if tile is None and homes else []
        for length in list(waiting):
            found += settle(length)
        return found

    for batch in batches:
        rows: list[tuple] = []
        for block, number, visits, word, n in zip(*(batch.column(c).to_pylist() for c in ("block", "tile", "visits", "word", "n"))):
            if (block, number) != key:
                if key is not None:
                    rows += closed()
                key, homes, tile = (block, number), [], None
            if not visits:
                homes.append((word, n))
                continue
            if tile is None:
                if not homes:  # a tile that no word fell into
                    continue
                rows += opened()
            mine = waiting.setdefault(len(word), [])
            mine.append((word, n))
            if len(mine) >= VISITORS or len(mine) * len(word) >= TILE_LETTERS:
                rows += settle(len(word))
        yield out(rows)
    if key is not None and (homes or waiting):
        yield out(closed())


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) for each of ``words`` (word, n) with a word one edit from it.

    ``form`` is the near word of the largest n, of equal ones the first in code-point order.
    Words are distinct and made of ``LETTERS``.
    """
    dealt = _dealt(words).repartition("block", "tile").sortWithinPartitions("block", "tile", "visits")
    found = dealt.mapInArrow(giving_back(_compare), FOUND)
    best = F.min(F.struct("minus_n", "near")).alias("best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.minus_n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``forms`` (word, form).

    Chains double their step each round. A form is at least twice as frequent as its word, so
    no chain comes back, and six rounds would do for any count of 64 bits.
    """
    turn = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    moved = not turn.isEmpty()
    while moved:
        onward = turn.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = turn.join(onward, "root", "left")
        step = step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        turn = materialize(step, "roots")
        moved = not turn.where("moved").isEmpty()
        turn = turn.drop("moved")
    return turn


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n).

    A word's form is its most frequent near word if that is at least twice as frequent, else
    null, as is form_n; ``root`` is where the forms of forms end, the word itself without one;
    ``n_near`` is 0 for a word alone. An empty table gives no rows.
    """
    words = materialize(words, "words")
    near = materialize(near_words(words), "near")
    joined = words.join(near.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    good = F.col("form_n") >= 2 * F.col("n")
    chosen = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"),
    )
    chosen = materialize(chosen, "variants")
    ends = roots(chosen.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    rooted = chosen.join(ends, F.col("word") == F.col("of"), "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
