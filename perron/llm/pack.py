"""Op 7: vector bin packing of token sequences by the dot-product heuristic.

A bin is a sequence with three limits: tokens, segments, and loss-bearing tokens. An item is a piece of an example.
The next piece of an open bin is the one that fits and whose demand vector has the largest dot product with what
remains of the bin, both as shares of the limits. Where no piece fits and cutting is allowed, the piece of the largest
demand is cut to what remains, so only the last bin of a run stays partly filled; it is dealt into sequences whose
lengths are powers of two.

Pieces are packed where they are read, in runs of bounded size: no shuffle, no state that grows with the input, and a
lost task packs the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import tokens as tk


@dataclass(frozen=True)
class Limits:
    """tokens: length of a sequence. segments: pieces in one sequence. loss_tokens: loss-bearing tokens in one."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass(frozen=True)
class Piece:
    """``length`` tokens of example ``example`` from ``start`` on; the first ``context`` of them bear no loss."""

    example: int
    start: int
    length: int
    context: int

    @property
    def loss(self) -> int:
        return self.length - self.context

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.example, self.start, at, min(self.context, at)),
            Piece(self.example, self.start + at, self.length - at, max(0, self.context - at)),
        )


class DotProductPacker:
    """Fills one bin after another from the pieces it was given."""

    def __init__(self, limits: Limits, cut: bool = True):
        self.limits, self.cut = limits, cut
        self.stock: dict[tuple[int, int], list[Piece]] = {}
        self.kinds = np.zeros((0, 2), np.int64)  # (length, loss) of each kind of piece, and how many there are
        self.left = np.zeros(0, np.int64)
        self.place: dict[tuple[int, int], int] = {}

    def add(self, pieces: Iterable[Piece]) -> None:
        for p in pieces:
            self.stock.setdefault((p.length, p.loss), []).append(p)
        self.place = {k: i for i, k in enumerate(self.stock)}
        self.kinds = np.array(list(self.stock), np.int64).reshape(-1, 2)
        self.left = np.array([len(v) for v in self.stock.values()], np.int64)

    def _take(self, i: int) -> Piece:
        self.left[i] -= 1
        return self.stock[int(self.kinds[i, 0]), int(self.kinds[i, 1])].pop()

    def _put(self, p: Piece) -> None:
        key = (p.length, p.loss)
        if key in self.place:
            self.stock[key].append(p)
            self.left[self.place[key]] += 1
        else:
            self.stock[key] = [p]
            self.place[key] = len(self.left)
            self.kinds = np.vstack([self.kinds, [key]])
            self.left = np.append(self.left, 1)

    def bins(self) -> Iterator[list[Piece]]:
        t, s, c = self.limits.tokens, self.limits.segments, self.limits.loss_tokens
        while self.left.any():
            out, room, segments, loss = [], t, s, c
            while room and segments:
                length, bears = self.kinds[:, 0], self.kinds[:, 1]
                there = self.left > 0
                if not there.any():
                    break
                gain = length * (room / (t * t)) + bears * (loss / (c * c)) + segments / (s * s)
                gain[~(there & (length <= room) & (bears <= loss))] = -1.0
                i = int(gain.argmax())
                if gain[i] < 0:
                    if not self.cut or not loss:
                        break
                    i = int(np.where(there, length / t + bears / c, -1.0).argmax())
                    whole = self._take(i)
                    at = min(room, loss + whole.context, whole.length)
                    piece, rest = whole.cut(at) if at < whole.length else (whole, None)
                    if rest is not None:
                        self._put(rest)
                else:
                    piece = self._take(i)
                out.append(piece)
                room, segments, loss = room - piece.length, segments - 1, loss - piece.loss
            if not out:
                raise ValueError("a piece is larger than an empty sequence")
            yield out
        self.stock.clear()
        self.add(())


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces of a partly filled bin in sequences whose lengths are its binary digits, largest first."""
    todo, out = list(pieces), []
    total = sum(p.length for p in todo)
    for bit in range(total.bit_length() - 1, -1, -1):
        room, row = total & (1 << bit), []
        while room:
            p = todo.pop(0)
            if p.length > room:
                p, rest = p.cut(room)
                todo.insert(0, rest)
            row.append(p)
            room -= p.length
        if row:
            out.append(row)
    return out


def pack_run(lengths: Iterable[int], contexts: Iterable[int], limits: Limits, cut: bool = True) -> list[list[Piece]]:
    """Sequences for one run of examples. Without cutting, an example over a limit raises ValueError."""
    packer, out, rest = DotProductPacker(limits, cut), [], []
    for n, (length, context) in enumerate(zip(lengths, contexts)):
        p = Piece(n, 0, int(length), min(int(context), int(length)))
        while cut and p.length >= limits.tokens and p.loss >= 0:
            head, tail = p.cut(limits.tokens) if p.length > limits.tokens else (p, None)
            if head.loss > limits.loss_tokens:
                break
            out.append([head])
            if tail is None:
                p = None
                break
            p = tail
        if p is not None and p.length:
            rest.append(p)
    packer.add(rest)
    for row in packer.bins():
        full = sum(p.length for p in row) == limits.tokens
        out.extend([row] if full or not cut else powers_of_two(row))
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    context_column: str | None = None,
    tokenizer: str | None = None,
    end_id: int = 1,
    limits: Limits = Limits(),
    run_tokens: int = 6_000_000,
    cut: bool = True,
) -> DataFrame:
    """One row for each piece of a document in a sequence, by ``PIECES``.

    A null text is an empty one, so the document is its end id alone. A null id stays null; repeated rows are packed
    as often as they come. Documents are read once, in runs of about ``run_tokens`` tokens, each packed on its own;
    sequence_id = task number * 2^32 + number in the task. An empty table gives no rows. Other columns are not read.

    ``context_column`` holds what comes before the text of an example, such as its prompt: its ids, encoded on their own,
    come first and bear no loss (null: none). Without it all tokens bear loss, so a loss limit of the sequence length
    never binds.
    """
    path = tokenizer or tk.default_tokenizer()
    shared.bound_batches(docs.sparkSession)

    def run(ids: list, raw: list[bytes], contexts: list[int], dtype, first: int) -> tuple[pa.RecordBatch, int]:
        words = [np.frombuffer(x, dtype) for x in raw]
        cols: list[list] = [[] for _ in range(8)]
        rows = pack_run([len(w) for w in words], contexts, limits, cut)
        for number, row in enumerate(rows):
            at = 0
            for p in row:
                w = words[p.example]
                found = (ids[p.example], p.start, p.length, tk.crc32_of(w[p.start : p.start + p.length]), len(w), first + number, at, p.loss)
                for c, v in zip(cols, found):
                    c.append(v)
                at += p.length
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names), first + len(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tk.encoder(path)
        end = np.asarray([end_id], enc.dtype).tobytes()
        most = run_tokens * enc.dtype.itemsize
        sequence = TaskContext.get().partitionId() << 32
        ids, raw, contexts, held = [], [], [], 0
        for batch in tk.pieces_of(batches, *range(1, batch_columns)):
            ids += batch.column(0).to_pylist()
            new = [x + end for x in enc.encode(batch.column(1).to_pylist())]
            before = enc.encode(batch.column(2).to_pylist()) if context_column else [b""] * len(new)
            contexts += [len(x) // enc.dtype.itemsize for x in before]
            new = list(map(bytes.__add__, before, new))
            raw += new
            held += sum(map(len, new))
            if held >= most:
                out, sequence = run(ids, raw, contexts, enc.dtype, sequence)
                yield out
                ids, raw, contexts, held = [], [], [], 0
        if ids:
            yield run(ids, raw, contexts, enc.dtype, sequence)[0]

    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), *([F.col(context_column).alias("context")] if context_column else []))
    batch_columns = len(picked.columns)
    return picked.mapInArrow(shared.tidy(task), PIECES)
