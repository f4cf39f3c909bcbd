"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A text is cut into pieces as the tokenizer's file says. Inside a piece an automaton over all
tokens gives the tokens that end at each place. The encoding of a prefix ends in exactly one
of them: the one whose predecessor, the last token of the prefix before it, stays apart from it
under the merge rules. So one token per prefix is stored, and following these tokens back from
the end of the piece gives its ids. No merge is ever carried out.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, functions as F

from tillwise.llm.common import giving_back, small_batches, texts

#: Pieces, and pairs of tokens, whose answers a worker keeps.
KEEP = 400_000
NEVER = 1 << 62

# Fixed value: how the byte-level splitter cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: code points whose class no Unicode version has changed since the splitter's own.
# Texts with others are cut by the tokenizer's library.
SETTLED = r"[\x00-\u052F\u2010-\u2027\u2030-\u205E\u20A0-\u20AF]*"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves, the other bytes in turn for the code
    points from 256 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """Encodes and decodes as a byte-level BPE file of the tokenizers library says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self._check(data)
        self.path = path
        self.pieces = regex.compile(PIECES)
        self.settled = regex.compile(SETTLED)
        self.library = None
        vocabulary, model = data["model"]["vocab"], data["model"]
        letters = byte_letters()
        added = {a["content"]: a["id"] for a in data["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *added.values()])
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        for content, i in added.items():
            self.tokens[i] = content.encode()
        self.special = {content: array("i", [i]).tobytes() for content, i in added.items()}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # A token's two parts and the rank of the merge that makes it; single bytes have none.
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocabulary[a], vocabulary[b]), vocabulary[a + b]
            self.merges[pair] = rank
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = *pair, rank
        self.size = list(map(len, self.tokens))
        self.apart: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.values():
            if self._reached(i):
                self.automaton.add_word(self.tokens[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _check(data: dict) -> None:
        """Refuses files whose rules are not those written down here."""
        model, split = data["model"], data.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        bytewise = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in data["added_tokens"])
        decodes = (data.get("decoder") or {}).get("type") == "ByteLevel"
        if model["type"] != "BPE" or not (plain and bytewise and added and decodes) or data.get("normalizer"):
            raise ValueError("Not a plain byte-level BPE file.")

    def _reached(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        if len(self.tokens[token]) == 1:
            return True
        if self.rank[token] < 0:
            return False
        a, b = self.left[token], self.right[token]
        return self._reached(a) and self._reached(b) and self._stays(a, b, self.rank[token])

    def _stays(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge with a rank below ``until`` joins ``a`` and the ``b`` after it.

        Merging goes by rank, so it is followed backwards: of the two symbols that touch, the
        one made later is taken apart. Two touching symbols merge if their rank comes before
        either is used up by its own token; of equal ranks the one further left comes first.
        """
        used_a = used_b = NEVER
        while True:
            rank = self.merges.get((a, b))
            if rank is not None and rank < until and rank < used_a and rank <= used_b:
                return False
            if self.rank[a] > self.rank[b]:
                used_a, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                used_b, b = self.rank[b], self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` may be followed by ``b`` in an encoding."""
        found = self._stays(a, b)
        if len(self.apart) < KEEP:
            self.apart[a << 32 | b] = found
        return found

    def last_tokens(self, piece: bytes) -> list[int]:
        """For each prefix, the empty one included, the last token of its encoding."""
        last = [-1] * (len(piece) + 1)
        size, apart = self.size, self.apart.get
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = last[end - size[token]]
                if before < 0:
                    last[end] = token
                else:
                    stays = apart(before << 32 | token)
                    if stays or stays is None and self.compatible(before, token):
                        last[end] = token
        return last

    def encode_piece(self, piece: bytes) -> list[int]:
        last = self.last_tokens(piece)
        ids, at, size = [], len(piece), self.size
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        return ids[::-1]

    def _cut(self, text: str) -> list[str]:
        if self.settled.fullmatch(text):
            return self.pieces.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for a, b in self._spans(text)]

    def _spans(self, text: str) -> Iterator[tuple[int, int]]:
        # Letters of several bytes may be named by each byte's span; a piece begins where the last ends.
        at = 0
        for _, (_, end) in self.library.pre_tokenize_str(text):
            yield at, end
            at = end

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens, as 32-bit numbers."""
        pieces = self._cut(text)
        ids = list(map(self.known.get, pieces))
        if None in ids:
            for k, found in enumerate(ids):
                if found is None:
                    piece = pieces[k]
                    found = self.known.get(piece)
                    if found is None:
                        found = array("i", self.encode_piece(piece.encode())).tobytes()
                        if len(self.known) < KEEP and len(piece) < 64:
                            self.known[piece] = found
                    ids[k] = found
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """A text's ids; special tokens written out in the text are those tokens."""
        if self.cut_special is None or not self.cut_special.search(text):
            return self._plain(text)
        parts = self.cut_special.split(text)
        return b"".join(self.special.get(p) or self._plain(p) for p in parts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens written out; what is no UTF-8 is replaced."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's codec: one for all tasks it runs, with what it has learnt."""
    return Codec(path)


def encode_documents(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, a row per row of ``documents``.

    ``tokenizer`` is the path of a byte-level BPE file, readable by every executor. Null and
    empty texts have no ids. Rows are independent: repeated rows, null ids and ids of any type
    stay as they are; other columns are not read.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer)
        for batch in batches:
            found = [tool.encode(t.decode("utf-8", "replace")) for t in texts(batch)]
            ends = np.cumsum([0, *(len(f) // 4 for f in found)])
            values = pa.array(np.frombuffer(b"".join(found), np.int32), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return small_batches(rows).mapInArrow(giving_back(apply), f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) of rows with ``doc_id`` and ``ids``; null ids give an empty text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer)
        for batch in batches:
            ids = batch.column("ids")
            ends = np.cumsum(pa.compute.list_value_length(ids).fill_null(0).to_numpy()).tolist()
            flat = ids.flatten().to_numpy().tolist()
            text = pa.array([tool.decode(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), text], names=["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    kind = dict(rows.dtypes)["doc_id"]
    return small_batches(rows).mapInArrow(giving_back(apply), f"doc_id {kind}, ids array<int>, text string")
