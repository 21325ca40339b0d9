"""Words, shingles and hashes of whole texts, as the Arrow functions of this package use them."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words kept in a task's memo before it starts anew; bounds memory, never results.
MEMO_WORDS = 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xD6E8FEB86659FD93)


class WordHash(dict):
    """64-bit hash of a word, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. ``bytes`` methods know ASCII only, which is
    exactly this definition: other letters and other spaces stay as they are. Null has no words."""
    return text.lower().split() if text else []


def hashes_of(words: list[bytes], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIXER
    h = (h ^ (h >> np.uint64(29))) * MIXER
    return h ^ (h >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words in order; of the whole sequence, if it is shorter."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    size = min(size, len(hashes))
    last = len(hashes) - size + 1
    h = np.full(last, size, np.uint64)
    for i in range(size):
        h = mixed(h * MULTIPLIER + hashes[i : i + last])
    return h


def shingle_set(words: list[bytes], size: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct shingles."""
    return np.unique(shingles(hashes_of(words, memo), size))


def fold(doc_id: int | None) -> int:
    """crc32 of the id written as text; null counts as the text ``null``."""
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode())


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def values_of(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def in_pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so results of one are sent on before the next is worked on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
