"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document's tokens are those of its whole text and an end mark.  Documents are read in
shards of about ``SHARD_TOKENS`` tokens, each packed by itself inside one task: no shuffle,
and memory bounded by a shard and one document.  A shard of T tokens opens T // capacity full
sequences; what is left over is opened as sequences of power-of-two lengths, which need no
padding.  Runs of ``capacity`` tokens of long documents fill sequences of their own.  The
remaining pieces go, longest first, to the sequence of least cost that has room, where the
cost of a piece is linear plus quadratic in its length (attention inside a document).  When
no sequence has room for a piece it is cut: the roomiest sequence takes what fits, and the
rest goes on.  All opened sequences end up full, so no padding is needed at all.

Null texts are empty: the end mark alone.  Rows that repeat are packed as rows of their own
(``row`` tells them apart); a null doc_id stays null.  A vocabulary whose rules are not ``RULES``
is asked for whole texts, which is slower.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trailmetrics.llm.common import id_and_text, map_batches

CAPACITY = 4096
END_MARK = 2
ID_BYTES = 4
END = END_MARK.to_bytes(ID_BYTES, "little")
SHARD_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 2048  # cost of a token, and of a pair of tokens of a document
KNOWN_PIECES = 1 << 17

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, `offset` bigint, row bigint, sequence_tokens bigint"
)


def cost(length: np.ndarray | int) -> np.ndarray | float:
    return LINEAR * length + QUADRATIC * length * length


#: Texts of these letters, ASCII signs and blanks are lower-cased and cut by the vocabulary's
#: own rules here; for each cut piece the tokenizer's model gives the ids.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN = re.compile(f"[{LETTERS}\\n\\t -~]*")
CUTS = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^{LETTERS}0-9\\s]+")


#: The normaliser and pre-tokeniser that these rules stand for, as a file states them.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class KnownPieces(dict):
    """Ids of text pieces, asked of the model once; emptied at ``KNOWN_PIECES`` pieces."""

    def __init__(self, model: object) -> None:
        super().__init__()
        self._model, self._letters = model, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KNOWN_PIECES:
            self.clear()
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
        found = self[piece] = array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()
        return found


class PieceTokenizer:
    """Token ids of texts as little-endian 32-bit numbers.

    Under ``RULES`` signs are never joined across white space, so a text's ids are those of
    its parts one after another, and parts with other letters go through the whole tokenizer.
    With a vocabulary of other rules whole texts go through it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._pieces = KnownPieces(self._tokenizer.model)
        stated = json.loads(self._tokenizer.to_str())
        self._in_parts = all(stated.get(name) == rule for name, rule in RULES.items())

    def ids(self, text: str) -> bytes:
        if not self._in_parts:
            return self._whole(text)
        if PLAIN.fullmatch(text) and not any(s in text for s in self._special):
            return b"".join(map(self._pieces.__getitem__, CUTS.findall(text.lower())))
        words = text.replace("\n", " ").replace("\t", " ").split(" ")
        if len(words) > 1:
            return b"".join(map(self.ids, words))
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@functools.cache
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One per worker process, so that its memory outlives a task."""
    return PieceTokenizer(path)


def open_sequences(tokens: int, capacity: int) -> np.ndarray:
    """Lengths of the sequences that hold exactly ``tokens`` tokens."""
    full, rest = divmod(tokens, capacity)
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * full + tail, np.int64)


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences end up full."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= capacity:
            pieces.append((doc, start, capacity, sequences, 0))
            sequences, start = sequences + 1, start + capacity
        if n > start:
            rest.append((n - start, doc, start))
    room = open_sequences(sum(r[0] for r in rest), capacity)
    size, costs = room.copy(), np.zeros(len(room))
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, doc, start in rest:
        while n:
            ranked = np.where(room >= n, costs, np.inf)
            at = int(ranked.argmin())
            if ranked[at] == np.inf:
                at = int(room.argmax())
            part = min(n, int(room[at]))
            pieces.append((doc, start, part, sequences + at, int(size[at] - room[at])))
            room[at] -= part
            costs[at] += cost(part)
            n, start = n - part, start + part
    return pieces


def packed_sequences(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    def shard(number: int, held: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
        lengths = np.array([len(ids) // ID_BYTES for _, _, ids in held], np.int64)
        found = pack(lengths, capacity)
        first = (TaskContext.get().partitionId() << 40) + (number << 24)
        columns: list[list] = [[] for _ in range(9)]
        total: dict[int, int] = {}
        for _, _, length, sequence, _ in found:
            total[sequence] = total.get(sequence, 0) + length
        for doc, start, length, sequence, offset in found:
            doc_id, row, ids = held[doc]
            part = ids[ID_BYTES * start : ID_BYTES * (start + length)]
            values = (doc_id, start, length, zlib.crc32(part), len(ids) // ID_BYTES,
                      first + sequence, offset, row, total[sequence])
            for column, value in zip(columns, values):
                column.append(value)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row",
                 "sequence_tokens"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(tokenizer_path)
        held: list[tuple[int | None, int, bytes]] = []
        tokens, number, row = 0, 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokenizer.ids(text.as_py()) + END
                held.append((doc_id, row, ids))
                tokens, row = tokens + len(ids) // ID_BYTES, row + 1
                if tokens >= shard_tokens:
                    yield shard(number, held)
                    held, tokens, number = [], 0, number + 1
        if held:
            yield shard(number, held)

    return map_batches(id_and_text(docs), work, PIECES)
