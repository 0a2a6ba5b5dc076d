"""Token ids of whole texts by a public tokenizer file, word by word from a bounded cache.

A byte-level BPE pre-tokenizer ends a piece at every single space and line end that stands between other characters.
So a text without neighbouring white space is the concatenation of independent chunks " word" and "\nword", and each
distinct chunk needs the tokenizers library once. Texts with neighbouring or closing white space, and texts that hold
the string of an added token (such as ``<|endoftext|>``), go through the library whole.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: End-of-document id of the 50k byte-level vocabulary; ordinary text never gives it.
END_OF_TEXT = 50256
_HAZARD = re.compile(r"\s\s|\s\Z")
_BLANK = re.compile(r"\s")
_NEWLINE = 198
_CLOSING = ".,!?:;|$%&*#)"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """texts -> ids as little-endian bytes of ``dtype``; the cache holds at most ``entries`` chunks.

    Ids are those of the library. With ``literal``, strings of special tokens are ordinary text, so a separator's id
    never comes from a text.
    """

    def __init__(self, path: str, entries: int = 500_000, literal: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = literal
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (literal and t.special)]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.chunked = byte_level and self.tokenizer.encode("a\nb", add_special_tokens=False).ids[1:2] == [_NEWLINE]
        self.entries, self.cache, self.marks = entries, {}, {}

    def raw(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.asarray(e.ids, self.dtype).tobytes() for e in found]

    def _joined(self, words: list[str], before: str) -> Iterator[bytes]:
        """Ids of before + word for words without white space, from one text with a line end between them."""
        for a in range(0, len(words), 2_000):
            part = words[a : a + 2_000]
            text = "\n".join([before + w for w in part])
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == _NEWLINE)
            data, size, start = ids.tobytes(), self.dtype.itemsize, 0
            for end in [*ends.tolist(), len(ids)]:
                yield data[start * size : end * size]
                start = end + 1

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of chunks that the cache lacks. A letter or digit before closing punctuation ends a piece as well, so
        "word," is "word" and ","; most chunks that the cache lacks have a word that it holds."""
        cache, found, ended, spaced, lines, rest = self.cache, {}, [], [], [], []
        for w in missing:
            core = w.rstrip(_CLOSING)
            if core is not w and len(core) < len(w):
                if core and core[-1].isalnum():
                    ended.append((w, core))
                    if core in cache or core in found:
                        continue
                    found[core] = b""
                    w = core
            if w[:1] == "\n":
                (lines if len(w) > 1 and not _BLANK.search(w, 1) else rest).append(w)
            elif w and not _BLANK.search(w):
                spaced.append(w)
            else:
                rest.append(w)
        newline = np.asarray([_NEWLINE], self.dtype).tobytes()
        found.update(zip(spaced, self._joined(spaced, " ")))
        found.update(zip(lines, [newline + x for x in self._joined([w[1:] for w in lines], "")]))
        found.update(zip(rest, self.raw([w if w[:1] == "\n" else " " + w for w in rest])))
        for w, core in ended:
            mark = w[len(core) :]
            if mark not in self.marks:
                self.marks[mark] = self.raw([mark])[0]
                if len(self.marks) > 10_000:
                    self.marks = {mark: self.marks[mark]}
            found[w] = (cache.get(core) or found[core]) + self.marks[mark]
        return found

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Nulls count as empty texts."""
        collecting = gc.isenabled()
        gc.disable()  # the many short-lived lists would make it walk the cache again and again
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: Sequence[str | None]) -> list[bytes]:
        if not self.chunked:
            return self.raw([t or "" for t in texts])
        out, whole, heads, todo, missing = [b""] * len(texts), [], [], [], {}
        known = self.cache.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if _HAZARD.search(text) or any(t in text for t in self.added):
                whole.append(i)
                continue
            words = text.replace("\n", " \n").split(" ")
            heads.append(words[0])
            words[0] = ""
            ids = list(map(known, words))
            gaps = [j for j, x in enumerate(ids) if x is None] if None in ids else []
            gaps = [(j, words[j]) for j in gaps if j]
            missing.update([(w, None) for _, w in gaps])
            todo.append((i, ids, gaps))
        found = self._learn(list(missing))
        for (i, ids, gaps), head in zip(todo, self.raw(heads)):
            ids[0] = head
            for j, w in gaps:
                ids[j] = found[w]
            out[i] = b"".join(ids)
        if len(self.cache) + len(found) <= self.entries:  # the first chunks seen are the frequent ones: they stay
            self.cache.update(found)
        for a in range(0, len(whole), 64):
            for i, ids in zip(whole[a : a + 64], self.raw([texts[i] for i in whole[a : a + 64]])):
                out[i] = ids
        return out


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, literal: bool = False) -> ChunkEncoder:
    """One encoder of each kind for each Python worker."""
    if (path, literal) not in _encoders:
        _encoders[path, literal] = ChunkEncoder(path, literal=literal)
    return _encoders[path, literal]


def pieces_of(batches: Iterable[pa.RecordBatch], *texts_at: int, budget: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``budget`` bytes of text at most (single long texts stay whole)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for k in texts_at if batch.num_rows else ():
            sizes += pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > budget:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
