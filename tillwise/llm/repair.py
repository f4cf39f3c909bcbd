"""Token ids in a compressed binary form: a Re-Pair grammar per shard.

A shard is a run of documents in doc_id order, about a million ids. The most frequent pairs
of neighbouring ids become nonterminals, again and again, until no pair is seen eight times or
the 16-bit symbols run out; pairs never span two documents. A shard holds the rules, the
expansion length of each nonterminal, the compressed ids and where each document begins, so
one document is decoded without the others.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types as pytypes
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from tillwise.llm.common import giving_back, small_batches, texts

SHARD_IDS = 1 << 20
SYMBOLS = 1 << 16
#: A pair that repeats less saves little more than its rule takes.
LEAST = 8
MAGIC = b"TWRP1\0\0\0"
END_ID = 1


# --- tokenizer -------------------------------------------------------------------------


# The rules by which a tokenizer's file must clean and part texts for ``Encoder`` to
# take them apart at white space.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def parts_at_white_space(rules: dict) -> bool:
    """Whether a tokenizer's file cleans and parts texts by exactly the rules above."""
    model, found = rules["model"], (rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {})
    splitters = found[1].get("pretokenizers") or [{}, {}]
    split, bytewise = splitters[0], splitters[-1]
    return (
        found[0].get("normalizers") == NORMALIZERS
        and len(splitters) == 2
        and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": PIECES}, "Removed", True)
        and (bytewise.get("type"), bytewise.get("add_prefix_space"), bytewise.get("use_regex")) == ("ByteLevel", False, False)
        and model["type"] == "BPE"
        and not model.get("dropout")
        and all("<|" in a["content"] and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in rules["added_tokens"])
    )


class _Known(dict):
    """The ids of words; those of a word that is not kept are worked out."""

    def __init__(self, work: Callable[[bytes], bytes]):
        super().__init__()
        self.work = work

    def __missing__(self, word: bytes) -> bytes:
        return self.work(word)


class Encoder:
    """Texts to ids, the ids of each word kept between texts.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those
    of its words in a row. A word of Latin letters is one piece to the tokenizer's model and
    goes straight to it, spelled in the model's alphabet for bytes; any other word takes the
    whole way through the tokenizer. With files of other rules all texts do.
    """

    KEEP = 700_000
    # Letters, then ASCII marks but no apostrophe, which the tokenizer may join to letters.
    LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size() >= SYMBOLS:
            raise ValueError("The vocabulary must have fewer than 65,536 ids.")
        with open(path, encoding="utf-8") as file:
            self.by_words = parts_at_white_space(json.load(file))
        # How the model spells the two bytes of each Latin letter beyond ASCII.
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.marks = {"": b""}
        self.known = _Known(self.word)

    def _whole(self, word: str) -> bytes:
        return array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, spelled: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _marks(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self._whole(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = found
        return found

    def word(self, word: bytes) -> bytes:
        """The ids of a word that is not kept."""
        if word.isalpha() and word.islower():
            ids = self._letters(word.decode())
        elif latin := self.LATIN.fullmatch(word.decode()):
            # Marks after letters are a piece of their own; the letters alone are often known.
            letters = latin[1].lower()
            ids = self.known.get(letters.encode()) if latin[2] else None
            ids = (ids or self._letters(letters.translate(self.spelling))) + self._marks(latin[2])
        else:
            ids = self._whole(word.decode())
        if len(self.known) < self.KEEP:
            self.known[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """A text's ids as little-endian unsigned 16-bit numbers."""
        if not self.by_words:
            return self._whole(text.decode("utf-8", "replace"))
        # Special tokens are known by their exact letters, so only texts without any are lowered.
        words = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.known.__getitem__, words))


def encoder(path: str) -> Encoder:
    """The worker's encoder: one for all tasks it runs, with what it has learnt."""
    kept = sys.modules.setdefault("_tillwise_encoders", pytypes.ModuleType("_tillwise_encoders"))
    found = kept.__dict__.get(path)
    if found is None:
        found = kept.__dict__[path] = Encoder(path)
    return found


# --- grammar ---------------------------------------------------------------------------


#: The threshold falls as soon as fewer pairs reach it: a round costs much the same for few.
FEW_PAIRS = 256


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of matches at ``at``, each followed by the place ``after``, which don't overlap.

    In a run of matches, each of which begins where the last one ends, every other one stays.
    """
    fresh = np.concatenate([[True], after[:-1] != at[1:]])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    return np.flatnonzero((np.arange(len(at)) - begin) % 2 == 0)


class _Sequence:
    """Symbols in order; those that a pair swallowed stay in place until many have.

    ``live`` marks places where a pair may begin that repeats.
    """

    def __init__(self, symbols: np.ndarray, last: np.ndarray):
        self._hold(symbols, last, ~last)

    def _hold(self, symbols: np.ndarray, last: np.ndarray, live: np.ndarray) -> None:
        self.symbols, self.last, self.live = symbols, last, live
        self.n, self.there = len(symbols), np.ones(len(symbols), bool)
        self.after = np.arange(1, self.n + 1, dtype=np.int32)
        self.before = np.arange(-1, self.n - 1, dtype=np.int32)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        return self.symbols[self.there], self.last[self.there]

    def merge(self, at: np.ndarray, names: np.ndarray) -> None:
        """Puts a new symbol for the one at each place and the one after it."""
        gone = self.after[at]
        self.symbols[at] = names
        self.last[at] = self.last[gone]
        self.there[gone] = self.live[gone] = False
        beyond = self.after[gone]
        self.after[at] = beyond
        inside = beyond < len(self.there)
        self.before[beyond[inside]] = at[inside]
        # Only new symbols make pairs more frequent.
        self.live[at] = ~self.last[at]
        left = self.before[at]
        left = left[left >= 0]
        self.live[left] = ~self.last[left]
        self.n -= len(at)
        if self.n < 0.7 * len(self.there):
            self._hold(*self.packed(), self.live[self.there])


def compress(ids: np.ndarray, lengths: np.ndarray, first_free: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols per document, rules). Rule k stands for symbol first_free + k.

    Rounds go on until no pair is seen ``LEAST`` times or no symbol is free. More frequent pairs
    come first: the threshold falls only when few pairs reach it any more.
    """
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    text = _Sequence(ids.astype(np.uint16), last)
    rules = np.zeros((0, 2), np.uint16)
    least = max(LEAST, len(ids) // 20_000)
    while len(rules) < SYMBOLS - first_free:
        places = np.flatnonzero(text.live)
        if not len(places):
            break
        keys = (text.symbols[places].astype(np.uint32) << 16) | text.symbols[text.after[places]]
        slot = (keys * np.uint32(2654435761)) >> np.uint32(14)
        ordered = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(starts, len(ordered)))
        if int(counts.max()) < LEAST:
            break
        while least > LEAST and np.count_nonzero(counts >= least) < FEW_PAIRS:
            least = max(LEAST, least // 2)
        # A round takes only the most frequent pairs, so that these win overlaps.
        often = np.flatnonzero(counts >= least)
        often = often[np.argsort(-counts[often], kind="stable")[: min(SYMBOLS - first_free - len(rules), 3_000)]]
        chosen = np.sort(ordered[starts[often]])
        # A table by hash finds the rule of each pair; of pairs that share a slot one waits for the next round.
        own = (chosen * np.uint32(2654435761)) >> np.uint32(14)
        table = np.zeros(1 << 18, np.int32)
        table[own] = np.arange(len(chosen))
        chosen, own = (x[table[own] == np.arange(len(chosen))] for x in (chosen, own))
        table[own] = np.arange(len(chosen))
        rule = table[slot]
        found = np.flatnonzero(chosen[rule] == keys)
        at = places[found]
        alone = _apart(at, text.after[at])
        at, rule = at[alone], rule[found[alone]]
        # Pairs that lost every overlap take no symbol.
        used = np.zeros(len(chosen), bool)
        used[rule] = True
        name = first_free + len(rules) + (np.cumsum(used) - 1)[rule]
        chosen = chosen[used]
        rules = np.concatenate([rules, np.stack([chosen >> 16, chosen & 0xFFFF], 1).astype(np.uint16)])
        again = np.zeros(1 << 18, bool)
        enough = ordered[starts[counts >= LEAST]]
        again[(enough * np.uint32(2654435761)) >> np.uint32(14)] = True
        text.live[places] = again[slot]
        text.merge(at, name)
    symbols, last = text.packed()
    ends = np.flatnonzero(last) + 1
    per = np.zeros(len(lengths), np.int64)
    per[lengths > 0] = np.diff(np.concatenate([[0], ends]))
    assert len(ends) == (lengths > 0).sum()
    return symbols, per, rules


def expansion_lengths(rules: np.ndarray, first_free: int) -> np.ndarray:
    """How many ids each nonterminal stands for; a rule uses only earlier ones."""
    sizes = np.ones(SYMBOLS, np.int64)
    done, n = 0, len(rules)
    while done < n:
        # Rules of one round name symbols of earlier rounds only.
        upto = done + int(np.argmax(np.append((rules[done:].max(axis=1) >= first_free + done), True)))
        sizes[first_free + done : first_free + upto] = sizes[rules[done:upto, 0]] + sizes[rules[done:upto, 1]]
        done = upto
    return sizes[first_free : first_free + n].astype(np.uint32)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, first_free: int) -> bytes:
    """A shard's bytes: header, documents, rules with expansion lengths, symbols."""
    symbols, per, rules = compress(ids, lengths, first_free)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        [
            MAGIC,
            struct.pack("<4Q", len(doc_ids), len(rules), len(symbols), first_free),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            known.tobytes(),
            lengths.astype("<u8").tobytes(),
            per.astype("<u8").tobytes(),
            rules.astype("<u2").tobytes(),
            expansion_lengths(rules, first_free).astype("<u4").tobytes(),
            symbols.astype("<u2").tobytes(),
        ]
    )


class Shard:
    """A packed shard, opened: documents are expanded on demand."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("Not a shard of this format.")
        n, n_rules, n_symbols, self.first_free = struct.unpack_from("<4Q", data, 8)
        at = 40

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", n), take("u1", n)
        self.doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
        self.lengths, per = take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        rules, self.sizes = take("<u2", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules).astype(np.int64)
        self.symbols = take("<u2", n_symbols)
        self.begins = np.concatenate([[0], np.cumsum(per)])
        self._expand_rules(rules)

    def _expand_rules(self, rules: np.ndarray) -> None:
        """All expansions in one array; a rule copies those of its two symbols."""
        n, free = len(rules), self.first_free
        size = np.concatenate([np.ones(free, np.int64), self.sizes])
        self.size, self.begin = size, np.concatenate([[0], np.cumsum(size)[:-1]])
        self.flat = np.zeros(int(size.sum()), np.uint16)
        self.flat[:free] = np.arange(free)
        done = 0
        while done < n:
            # Rules of one round name symbols of earlier rounds only, so they are copied at once.
            upto = done + int(np.argmax(np.append(rules[done:].max(axis=1) >= free + done, True)))
            self.flat[self.begin[free + done] : self.begin[free + upto - 1] + size[free + upto - 1]] = self.expand(rules[done:upto].ravel())
            done = upto

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        ends = np.cumsum(size)
        shift = self.begin[symbols] - ends + size
        return self.flat[np.arange(int(size.sum())) + np.repeat(shift, size)]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.begins[k] : self.begins[k + 1]])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in turn, expanded some thousand symbols at a time."""
        k = 0
        while k < len(self.doc_ids):
            upto = max(k + 1, int(np.searchsorted(self.begins, self.begins[k] + 65_536)))
            upto = min(upto, len(self.doc_ids))
            ids = self.expand(self.symbols[self.begins[k] : self.begins[upto]])
            ends = np.cumsum(self.lengths[k:upto]).tolist()
            for j, (begin, end) in enumerate(zip([0, *ends], ends)):
                yield self.doc_ids[k + j], ids[begin:end]
            k = upto


# --- files -----------------------------------------------------------------------------


def write_shards(documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes the ids of all texts, in ascending doc_id order (null ids first).

    ``folder`` is a Parquet table with a row per shard: the range of documents it belongs to
    (``part``), its number there, its first id's place in the part, its number of ids, and
    its bytes. Spark commits the files, so a lost executor leaves no half-written shard.
    Null text counts as empty; every document ends with ``end_id``. ``tokenizer`` is the path
    of a tokenizers file with fewer than 65,536 ids, readable by every executor.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool = encoder(tokenizer)
        first_free = tool.tokenizer.get_vocab_size()
        part = TaskContext.get().partitionId()
        number, start = 0, 0
        ids: list[int | None] = []
        held: list[bytes] = []
        n_held = 0
        end = np.array([end_id], "<u2").tobytes()

        def out() -> pa.RecordBatch:
            nonlocal number, start, ids, held, n_held
            lengths = np.array([len(h) // 2 for h in held], np.int64)
            data = pack(ids, lengths, np.frombuffer(b"".join(held), "<u2"), first_free)
            row = [[part], [number], [start], [n_held], [data]]
            number, start = number + 1, start + n_held
            ids, held, n_held = [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["part", "number", "start", "n_ids", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids.append(doc_id)
                held.append(tool.encode(text) + end)
                n_held += len(held[-1]) // 2
                if n_held >= SHARD_IDS:
                    yield out()
        if held:
            yield out()

    ordered = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    # Rows of one id are put in order by their text, so that reruns agree.
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    small_batches(ordered).mapInArrow(giving_back(encode), "part int, number int, start long, n_ids long, data binary").write.parquet(folder)


def decode(
    spark: SparkSession, folder: str, value: Callable[[np.ndarray], object], kind: str
) -> DataFrame:
    """(doc_id, start, n_tokens, value) per document of written shards.

    ``value`` turns a document's ids into what is wanted of them, of the SQL type ``kind``;
    ``start`` counts the ids of all documents before it.
    """
    shards = spark.read.parquet(folder)
    # One row per written range: as many as Spark had partitions, whatever the size of the data.
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(c) for c in ("part", "start", "data"))):
                rows: list[tuple] = []
                place = start.as_py()
                for doc_id, ids in Shard(data.as_py()).documents():
                    rows.append((part.as_py(), doc_id, place, len(ids), value(ids)))
                    place += len(ids)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = f"part int, doc_id long, local long, n_tokens long, value {kind}"
    schema = to_arrow_schema(_parse_datatype_string(text))
    opened = shards.select("part", "start", "data").mapInArrow(giving_back(open_), text)
    placed = opened.join(F.broadcast(offsets), F.col("part") == F.col("of_part"))
    return placed.select("doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "value")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_documents(documents: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the shards and reads them back: doc_id, start, n_tokens, ids_crc32."""
    write_shards(documents, folder, tokenizer)
    found = decode(documents.sparkSession, folder, crc, "long")
    return found.withColumnRenamed("value", "ids_crc32")
