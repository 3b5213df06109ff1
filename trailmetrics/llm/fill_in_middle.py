"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never
change: its text and the sentinels.  Cutting splits descriptors, an arrangement permutes
them, and the digest of an output runs over the descriptors without building the output.
The way back starts from the output alone: its own table has one descriptor, the sentinels
that ``form`` announces say where to cut, and the inverse permutation brings the pieces back.

Texts are cut between lines, at places drawn from the document's id.  One pass over the
documents, no shuffle; a task holds one batch of texts.

Null texts count as empty.  An empty text, a text with a sentinel in it, and one that the
draw leaves alone is ``plain`` and its own output.  A null doc_id draws like an empty one,
so its rows are all cut by the same draw; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from trailmetrics.llm.common import as_bytes, id_and_text, map_batches

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

PLAIN, PSM, SPM = "plain", "psm", "spm"
TEXT, SENTINEL = 0, 1
SENTINELS = PREFIX + SUFFIX + MIDDLE

#: Places of (prefix, middle, suffix, <P>, <S>, <M>) in an output, from left to right.
ARRANGEMENTS = {PSM: (3, 0, 4, 2, 5, 1), SPM: (4, 2, 3, 0, 5, 1)}

Piece = tuple[int, int, int]


@dataclass(frozen=True)
class PieceTable:
    """Descriptors over immutable buffers; every change gives a new table."""

    buffers: tuple[bytes, bytes]
    pieces: tuple[Piece, ...]

    @classmethod
    def over(cls, text: bytes) -> PieceTable:
        return cls((text, SENTINELS), ((TEXT, 0, len(text)),))

    def cut(self, *places: int) -> PieceTable:
        """Split descriptors at the given places (ascending); a place at a bound gives an empty piece."""
        found, at, pending = [], 0, list(places)
        for buffer, start, length in self.pieces:
            end = at + length
            while pending and pending[0] <= end:
                part = pending.pop(0) - at
                found.append((buffer, start, part))
                start, at, length = start + part, at + part, length - part
            found.append((buffer, start, length))
            at = end
        return PieceTable(self.buffers, tuple(found))

    def with_sentinels(self) -> PieceTable:
        """The sentinels' descriptors behind the others."""
        marks, start = [], 0
        for mark in (PREFIX, SUFFIX, MIDDLE):
            marks.append((SENTINEL, start, len(mark)))
            start += len(mark)
        return PieceTable(self.buffers, self.pieces + tuple(marks))

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def first(self, n: int) -> PieceTable:
        return PieceTable(self.buffers, self.pieces[:n])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield memoryview(self.buffers[buffer])[start : start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    back = [0] * len(order)
    for place, piece in enumerate(order):
        back[piece] = place
    return tuple(back)


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def line_count(text: bytes) -> int:
    """Lines with their ends; a last line may have none."""
    return text.count(b"\n") + (bool(text) and not text.endswith(b"\n"))


def line_start(text: bytes, line: int) -> int:
    """Byte at which line number ``line`` (from 0) begins; past the last line, the end."""
    at = 0
    for _ in range(line):
        end = text.find(b"\n", at)
        if end < 0:
            return len(text)
        at = end + 1
    return at


def characters(part: memoryview) -> int:
    return len(str(part, "utf-8"))


def transformed(text: bytes, doc_id: int | None, seed: int, rate: int, spm_share: int) -> tuple[str, int, PieceTable]:
    """(form, lines, output) of one document."""
    n = line_count(text)
    a, b, chosen, layout = draws(doc_id, seed)
    table = PieceTable.over(text)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or chosen % 100 >= rate:
        return PLAIN, n, table
    form = SPM if layout % 100 < spm_share else PSM
    first, second = sorted((a % (n + 1), b % (n + 1)))
    cuts = line_start(text, first), line_start(text, second)
    return form, n, table.cut(*cuts).with_sentinels().arranged(ARRANGEMENTS[form])


def restored(output: bytes, form: str) -> PieceTable:
    """The document's text, from nothing but an output and its form."""
    table = PieceTable.over(output)
    if form == PLAIN:
        return table
    order = ARRANGEMENTS[form]
    marks = (PREFIX, SUFFIX, MIDDLE)
    places, at = [], 0
    for piece in order:
        if piece >= 3:
            at = output.index(marks[piece - 3], at)
            if at:
                places.append(at)
            at += len(marks[piece - 3])
            places.append(at)
    return table.cut(*places).arranged(inverse(order)).first(3)


RESULT = ("doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, "
          "output_sha256 string, restored_sha256 string")
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
NAMES = [field.split()[0] for field in RESULT.split(", ")]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_share: int = 50, outputs: bool = True) -> DataFrame:
    """One row per document: form, lines, lengths of prefix and middle in code points (null if
    plain), the output, its digest and the digest of the text rebuilt from it.

    ``rate`` of 100 documents are rearranged, ``spm_share`` of 100 of these with the suffix
    first.  Without ``outputs`` the texts stay in the workers and ``output`` is null.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                form, n, table = transformed(text, doc_id, seed, rate, spm_share)
                prefix = middle = None
                if form != PLAIN:
                    pieces = list(table.arranged(inverse(ARRANGEMENTS[form])).stream())
                    prefix, middle = characters(pieces[0]), characters(pieces[1])
                output = table.content()
                rows.append((doc_id, n, form, prefix, middle, output if outputs else None,
                             table.sha256(), restored(output, form).sha256()))
            columns = list(zip(*rows)) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary()).cast(t) if n == "output" else pa.array(c, t)
                 for c, t, n in zip(columns, TYPES, NAMES)], names=NAMES)

    return map_batches(id_and_text(docs), work, RESULT)
