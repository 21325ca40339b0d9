"""Fill-in-the-middle: texts cut at two hashed places and put in an order that asks for the middle last."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seriesframe.llm.words import in_pieces, texts_of, values_of

#: Bytes of a text block; a cut is looked for byte by byte inside one block only.
BLOCK = 1_024
MARKERS = ("<P>", "<S>", "<M>")
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _line_ends(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return data[lo:hi] == 0x0A


def _word_ends(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """A word and the white space before it are one unit; white space at the end of the text is one of its own."""
    space = SPACES[data[lo : hi + 1]]
    ends = np.zeros(hi - lo, bool)
    ends[: len(space) - 1] = ~space[:-1] & space[1:]
    return ends


def _character_ends(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    inner = (data[lo + 1 : hi + 1] & 0xC0) == 0x80
    ends = np.zeros(hi - lo, bool)
    ends[: len(inner)] = ~inner
    return ends


UNITS: dict[str, Callable] = {"line": _line_ends, "word": _word_ends, "character": _character_ends}


class Blocks:
    """A text in blocks of BLOCK bytes with a Fenwick tree over the units that end and the code points that begin in each."""

    def __init__(self, text: bytes, unit: str):
        self.data = np.frombuffer(text, np.uint8)
        self.ends_in = UNITS[unit]
        size = len(text)
        starts = np.arange(0, size, BLOCK)
        counts = np.zeros((len(starts) + 1, 2), np.int64)
        if size:
            # Block by block, so a very long text needs no masks of its whole length.
            for k, lo in enumerate(starts.tolist(), 1):
                hi = min(lo + BLOCK, size)
                counts[k] = np.count_nonzero(self._ends(lo, hi)), self._points(lo, hi)
        sums = counts.cumsum(axis=0)
        at = np.arange(len(sums))
        #: Node i holds the sums of the lowbit(i) blocks that end with block i.
        self.tree = sums - sums[at - (at & -at)]
        self.units, self.points = sums[-1].tolist()

    def _ends(self, lo: int, hi: int) -> np.ndarray:
        """Which bytes end a unit; the last byte of the text always does."""
        ends = self.ends_in(self.data, lo, hi)
        if hi == len(self.data):
            ends[-1] = True
        return ends

    def _points(self, lo: int, hi: int) -> int:
        return int(np.count_nonzero((self.data[lo:hi] & 0xC0) != 0x80))

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units.

        Halving steps go down the tree to the last block before which fewer units end; the cut lies in the next block.
        """
        if units == 0:
            return 0, 0
        blocks, before, points = 0, 0, 0
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            node = blocks + step
            if node < len(self.tree) and before + self.tree[node, 0] < units:
                blocks, before, points = node, before + int(self.tree[node, 0]), points + int(self.tree[node, 1])
            step >>= 1
        lo = blocks * BLOCK
        ends = np.flatnonzero(self._ends(lo, min(lo + BLOCK, len(self.data))))
        place = lo + int(ends[units - before - 1]) + 1
        return place, points + self._points(lo, place)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of a document: the first 8-digit groups of the sha256 of ``seed:doc_id``; null counts as ``null``."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearranged(
    text: bytes, h: list[int], unit: str, percent: int, suffix_first: int, markers: tuple[bytes, bytes, bytes]
) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, code points of prefix and middle, and the new text."""
    blocks = Blocks(text, unit)
    n = blocks.units
    if not text or any(m in text for m in markers) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    (a, before), (b, upto) = sorted(blocks.cut(x % (n + 1)) for x in h[:2])
    p, s, m = markers
    if h[3] % 100 < suffix_first:
        out = b"".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, "spm", before, upto - before, out
    return n, "psm", before, upto - before, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def _check(markers: tuple[str, ...]) -> None:
    """The first place of a marker in the output is the marker only if no marker can begin inside another or in its end."""
    for a in markers:
        for b in markers:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                raise ValueError(f"markers {a!r} and {b!r} can overlap, so the text could not be rebuilt")


def fill_in_middle(
    docs: DataFrame,
    unit: str = "line",
    percent: int = 100,
    suffix_first: int = 50,
    seed: int = 7,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """Columns ``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``: each text with its middle last.

    A text of ``n`` units is cut after two hashed numbers of units from 0 to ``n``. ``percent`` of the documents are
    rearranged, ``suffix_first`` percent of them with the suffix first: form ``psm`` is prefix, suffix, middle, form ``spm``
    suffix, prefix, middle, each part behind its marker. Empty texts, texts that hold a marker and the other documents
    stay as they are, form ``plain``, and have null lengths. Lengths are code points.

    One row per row of ``docs``, wherever it lies: the draws depend on the id and ``seed`` alone, so repeated ids draw alike
    and reruns agree. A null text is empty, a null id draws as the text ``null``; an empty table gives no rows; other
    columns do not come along. ``restored`` is the inverse.
    """
    _check(markers)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    signs = tuple(m.encode() for m in markers)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            ids = values_of(batch, "doc_id")
            rows = [
                rearranged(text or b"", draws(i, seed), unit, percent, suffix_first, signs)
                for i, text in zip(ids, texts_of(batch))
            ]
            n, form, prefix, middle, output = zip(*rows)
            columns = [
                pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)


def restored(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` was given, from its form and output alone."""
    p, s, m = markers

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows the marker at the start, the one in the middle and the last one."""
        at, last = F.instr(output, F.lit(second)), F.instr(output, F.lit(m))
        head = F.substr(output, F.lit(len(first) + 1), at - 1 - len(first))
        return head, F.substr(output, at + len(second), last - at - len(second)), F.substr(output, last + len(m))

    prefix, suffix, middle = between(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
