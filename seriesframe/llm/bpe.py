"""Byte-pair encoding of texts with a public byte-level vocabulary, and its inverse."""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from seriesframe.llm.sharing import received, sent
from seriesframe.llm.words import in_pieces, values_of

#: Words a task remembers twice over before it forgets the older ones, and the longest word; bounds memory, never results.
MEMO_WORDS, MEMO_CHARS = 250_000, 64
#: Largest vocabulary file that is sent to the tasks.
VOCABULARY_BYTES = 64_000_000

# Code points that became letters or numbers after Unicode 16, the version of the vocabulary's library.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
FIRST_NEWER = "\u0558"
# The split of byte-level vocabularies before the merges, for code points as the regex module knows them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII, for which the standard module is faster.
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: The same where a text holds newer letters or numbers, which belong to neither class.
SPLIT_OLD = (
    r"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--[" + NEWER + r"]]+| ?[\p{N}--[" + NEWER + r"]]+"
    r"| ?[[^\s\p{L}\p{N}]||[" + NEWER + r"]]+|\s+(?!\S)|\s+"
)


def byte_names() -> dict[str, int]:
    """How byte-level vocabularies write each byte: visible Latin-1 characters stand for themselves, the other bytes
    follow from code point 256 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Merges and symbols of a byte-level vocabulary file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, names = spec["model"], byte_names()
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        before = spec.get("pre_tokenizer") or {}
        bytewise = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
        bytewise &= (spec.get("decoder") or {}).get("type") == "ByteLevel"
        added = spec.get("added_tokens") or []
        exact = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or not (plain and bytewise and exact):
            raise ValueError("the file is no plain byte-level BPE vocabulary")
        ids = model["vocab"]
        spelled = lambda name: bytes(names[c] for c in name) if all(c in names for c in name) else name.encode()
        symbols = {i: spelled(name) for name, i in ids.items()} | {t["id"]: spelled(t["content"]) for t in added}
        #: Bytes of each id; ids that the file does not know have none.
        self.symbols = [symbols.get(i, b"") for i in range(max(symbols, default=-1) + 1)]
        #: The id of each byte, None where the vocabulary lacks it.
        self.first = [None] * 256
        for name, byte in names.items():
            self.first[byte] = ids.get(name)
        #: For each left id the rank of each right id, and the id of both by rank; the last entry stands for no symbol.
        self.ranks: list[dict] = [{} for _ in range(len(self.symbols) + 1)]
        self.joined = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left]].setdefault(ids[right], rank)
            self.joined.append(ids[left + right])
        #: Added symbols are found in the text before it is split; the longest of several at one place counts.
        self.added = {t["content"]: t["id"] for t in added}

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank is joined first, the leftmost of equal ones.

        Symbols form a doubly linked list. The queue holds a pair's rank and place in one number; an entry is stale, and
        skipped, when the pair that now begins at its place has another rank.
        """
        ranks, joined, push, pop = self.ranks, self.joined, heapq.heappush, heapq.heappop
        symbol = [i for i in map(self.first.__getitem__, word) if i is not None]
        end = len(symbol)
        queue = []
        for at in range(end - 1):
            right_of = ranks[symbol[at]]
            if symbol[at + 1] in right_of:
                queue.append(right_of[symbol[at + 1]] * end + at)
        if not queue:
            return symbol
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            rank, at = entry // end, entry % end
            gone = after[at]
            if gone == end or ranks[symbol[at]].get(symbol[gone]) != rank:
                continue
            both = symbol[at] = joined[rank]
            symbol[gone] = -1
            far = after[at] = after[gone]
            if far != end:
                before[far] = at
                right_of = ranks[both]
                if symbol[far] in right_of:
                    push(queue, right_of[symbol[far]] * end + at)
            near = before[at]
            if near >= 0:
                right_of = ranks[symbol[near]]
                if both in right_of:
                    push(queue, right_of[both] * end + near)
        return [i for i in symbol if i >= 0]


class _Words(dict):
    """Ids of words as bytes of 32-bit numbers, remembered within a task: the latest words, and those before them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.vocabulary.merged(word.encode())).tobytes()
            if len(word) > MEMO_CHARS:
                return ids
        if len(self) >= MEMO_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Splits texts into words and looks the ids of each up."""

    def __init__(self, vocabulary: Vocabulary):
        self.words = _Words(vocabulary)
        self.split_ascii = re.compile(SPLIT_ASCII, re.ASCII)
        self.split, self.split_old = regex.compile(SPLIT), regex.compile(SPLIT_OLD)
        self.newer = regex.compile(f"[{NEWER}]")
        self.added = vocabulary.added
        longest_first = sorted(filter(None, self.added), key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    def ids(self, text: str) -> np.ndarray:
        if text.isascii():
            split = self.split_ascii
        else:
            split = self.split_old if max(text) >= FIRST_NEWER and self.newer.search(text) else self.split
        # Every second piece is an added symbol.
        pieces = self.marks.split(text) if self.marks else [text]
        runs: list[bytes] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                runs.append(array("i", [self.added[piece]]).tobytes())
            elif piece:
                runs.extend(map(self.words.__getitem__, split.findall(piece)))
        return np.frombuffer(b"".join(runs), np.int32)


def _vocabulary(docs: DataFrame, path: str):
    """Read by the driver and sent to the tasks, whose machines need no such file; its size is checked."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary file may have {VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        return sent(docs.sparkSession, Vocabulary(file.read()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Columns ``doc_id`` and ``ids`` (array of int): each whole text in the symbols of the vocabulary file at ``path``.

    The file is a byte-level BPE vocabulary of the tokenizers library; its truncation and padding are not used and no special
    symbols are added, but the added symbols that a text spells out are recognised. One row per row of ``docs``, repeated rows
    included; null and empty texts have no ids; a null id stays null; an empty table gives no rows; other columns do not
    come along.
    """
    shared = _vocabulary(docs, path)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(received(shared))
        for batch in in_pieces(batches, 128):
            runs = [encoder.ids(text or "") for text in values_of(batch, "text")]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(runs), pa.int32()))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``text``: the strings of the ids one after the other.

    Bytes that are no UTF-8 become replacement characters, ids the vocabulary does not have and null ids give nothing; a null
    array gives an empty text.
    """
    shared = _vocabulary(encoded, path)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = received(shared).symbols
        known = range(len(symbols))
        for batch in in_pieces(batches, 128):
            lists = batch.column(batch.schema.get_field_index("ids"))
            texts = []
            for row in lists:
                ids = row.values
                if ids is None or not len(ids):
                    texts.append("")
                    continue
                every = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array(ids.drop_null(), np.int64)
                if len(every) and (every.min() < 0 or every.max() >= len(symbols)):
                    every = np.array([i for i in every.tolist() if i in known], np.int64)
                texts.append(b"".join(map(symbols.__getitem__, every.tolist())).decode("utf-8", "replace"))
            columns = [batch.column(batch.schema.get_field_index("doc_id")), lists, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"])

    ready = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return ready.mapInArrow(work, "doc_id long, ids array<int>, text string")
