"""Packing by power-of-two decomposition.

A document of L token ids (its text's ids and the end id) is cut into pieces whose lengths are powers of
two: as many of the longest length as fit, then the binary digits of the rest. Pieces of one length
form a bucket, and a training batch is filled from one bucket. So a sequence is one piece: it never
crosses documents and needs no padding.

Cases: a null or empty text is the end id alone, one piece of length 1. Equal texts and repeated rows
give equal pieces in sequences of their own. Texts are encoded whole; a text is encoded chunk by chunk
between plain spaces and line ends, where the tokenizer never joins characters, so frequent chunks
are encoded once per task. Extra input columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import batch

LONGEST = 4096
END_ID = 2
BYTES_AT_ONCE = 6_000_000
#: Chunks of text whose ids a task remembers.
REMEMBERED = 400_000
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(tokens: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``tokens`` ids; ``longest`` is a power of two."""
    out, at = [], 0
    while tokens - at >= longest:
        out.append((at, longest))
        at += longest
    while at < tokens:
        size = 1 << ((tokens - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


def slices(rows: pa.RecordBatch, bytes_at_once: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows of about ``bytes_at_once`` of text together; a longer text stands alone."""
    sizes = np.nan_to_num(pc.binary_length(rows.column(1)).cast(pa.float64()).to_numpy(zero_copy_only=False))
    part = np.cumsum(sizes) // bytes_at_once
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), rows.num_rows]
    for begin, end in zip(bounds, bounds[1:]):
        if begin < end:
            yield rows.slice(begin, end - begin)


def split(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Chunks(dict):
    """Chunk of text to its ids as little-endian unsigned 32-bit numbers, kept up to a bound.

    What is full becomes the older half, from which what is met again is taken over: frequent chunks stay.

    A chunk of Latin letters, perhaps with signs behind them, is one word and one run of signs to the
    tokenizer. The word is handed to its model directly, without the normaliser and splitter, which
    take most of the time; whether that gives the tokenizer's own ids is tried on ``PROBES`` first.
    """

    LATIN = "".join(chr(i) for r in ((65, 90), (97, 122), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF)) for i in range(r[0], r[1] + 1))
    SIGNS = "".join(chr(i) for r in ((33, 47), (58, 64), (91, 96), (123, 126)) for i in range(r[0], r[1] + 1))
    PROBES = ("a", "I", "then", "Then,", "zebra.", "qqxyzv", "STONE###", "Über", "éêre,", "ñbo$$$", "STÖß&&&.", "anonthreingtion,", "ÿç.")

    def __init__(self, tokenizer: str | None, bound: int = REMEMBERED) -> None:
        super().__init__()
        self.bound = bound
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer or default_tokenizer())
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        splitter = self.tokenizer.pre_tokenizer
        letters = [c for c in self.LATIN if not c.isascii()]
        shown = {c: splitter.pre_tokenize_str(c) if splitter else [] for c in letters}
        self.table = {ord(c): parts[0][0] for c, parts in shown.items() if len(parts) == 1}
        self.direct = True
        self.learn(set(self.PROBES))
        self.direct = all(self[p] == self._whole(p) for p in self.PROBES)
        self.clear()

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        out = self[chunk] = self._whole(chunk)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode unknown chunks together, which is faster than one by one."""
        if len(self) > self.bound // 2:
            self.older = dict(self)
            self.clear()
        if len(self.words) > self.bound // 4:
            self.older_words, self.words = self.words, {}
        if len(self.marks) > self.bound // 8:
            self.marks.clear()
        older, words, older_words, marks = self.older, self.words, self.older_words, self.marks
        model, table, latin, signs = self.tokenizer.model, self.table, self.LATIN, self.SIGNS
        rest = []
        for c in chunks.difference(self):
            known = older.get(c)
            if known is not None:
                self[c] = known
                continue
            word = c.rstrip(signs) if self.direct else ""
            if not word or word.strip(latin):
                rest.append(c)
                continue
            low = word.lower()
            ids = words.get(low)
            if ids is None:
                ids = older_words.get(low)
                if ids is None:
                    shown = low if low.isascii() else low.translate(table)
                    ids = array("I", [t.id for t in model.tokenize(shown)]).tobytes()
                words[low] = ids
            if len(word) < len(c):
                mark = c[len(word) :]
                if mark not in marks:
                    marks[mark] = self._whole(mark)
                ids += marks[mark]
            self[c] = ids
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self[c] = array("I", e.ids).tobytes()

    def encode_words(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))

    def encode(self, text: str) -> bytes:
        return self.encode_words(split(text))


def pack(
    documents: DataFrame,
    longest: int = LONGEST,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    bytes_at_once: int = BYTES_AT_ONCE,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece of ``documents`` (doc_id, text), without a shuffle.

    ``bytes_at_once`` and ``remembered`` trade memory of a task for time; the pieces are the same.

    Columns: doc_id, start, length, doc_tokens, ids (the piece as little-endian unsigned 32-bit numbers),
    bucket (the binary logarithm of length), sequence_id and offset, always 0. Written with
    ``partitionBy("bucket")`` the result is one folder of equally long sequences per bucket.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(tokenizer, remembered)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for b in slices(whole, bytes_at_once):
                several = [split(t or "") for t in b.column(1).to_pylist()]
                chunks.learn(set().union(*several))
                rows = []
                for d, words in zip(b.column(0).to_pylist(), several):
                    ids = chunks.encode_words(words) + end
                    n = len(ids) // 4
                    rows += [(d, s, k, n, ids[4 * s : 4 * (s + k)]) for s, k in cut(n, longest)]
                doc, start, length, total, ids = zip(*rows)
                yield batch([
                    ("doc_id", pa.array(doc, pa.int64())),
                    ("start", pa.array(start, pa.int64())),
                    ("length", pa.array(length, pa.int64())),
                    ("doc_tokens", pa.array(total, pa.int64())),
                    ("ids", pa.array(ids, pa.binary())),
                ])

    pieces = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)
    return pieces.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
