"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seriesframe.llm.license_templates import HEADERS, NAMES, full_texts, wordings
from seriesframe.llm.sharing import received, sent
from seriesframe.llm.words import MEMO_WORDS, MULTIPLIER, WordHash, hashes_of, in_pieces, mixed, shingles, texts_of, words_of

#: Chance to miss a template that a window contains to the required share.
MISS = 1e-6
#: Bands up to which two minima per band are taken; one minimum per band beyond.
MOST_BANDS = 40
#: Bytes of templates that one scanner holds; more templates are scanned block by block.
TEMPLATE_BYTES = 4_000_000

# Short notices by which texts state their license, by identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met:"),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
#: The tag by which files name their license, with an expression of identifiers.
TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*([(]*[\w.+:-]+(?:[() \t]+(?:AND|OR|WITH)[() \t]+[\w.+:-]+)*)", re.I)
WITH = re.compile(rb"[() \t]+WITH[() \t]+[\w.+:-]+", re.I)
JOINED = re.compile(rb"[() \t]+(?:(?:AND|OR)[() \t]+)?", re.I)
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class BareHash(WordHash):
    """Hash of a word without the punctuation at its edges; 0 if nothing else is in it."""

    def __missing__(self, word: bytes) -> int:
        bare = EDGES.sub("", word.decode("utf-8", "replace")).replace("\u2019", "'").encode()
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(bare) if bare else 0
        return value


def bare_hashes(text: bytes | None, memo: BareHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that are not mere punctuation (marks of comments and lists), and their places in the text."""
    hashes = hashes_of(words_of(text), memo)
    places = np.flatnonzero(hashes)
    return hashes[places], places


@dataclass
class SizeClass:
    """Templates of similar length and how to look for them."""

    size: int  # words of a shingle
    shortest: int
    longest: int
    share: int

    @property
    def window(self) -> int:
        return self.longest + max(1, self.longest // 4)

    @property
    def step(self) -> int:
        """Windows overlap so that a template of any length of this class stands whole in one."""
        return self.window - self.longest + 1

    @property
    def width(self) -> int:
        return self.window - self.size + 1

    @property
    def banding(self) -> tuple[int, int]:
        """Bands and minima per band. A window with the required share of a template has at least this similarity to it;
        (1 - similarity^rows)^bands stays under MISS."""
        own = self.shortest - self.size + 1
        found = max(1.0, own * self.share / 100)
        similarity = found / (self.width + own - found)
        for rows in (2, 1):
            bands = math.ceil(math.log(MISS) / math.log(1 - min(similarity, 0.999) ** rows))
            if bands <= MOST_BANDS or rows == 1:
                return bands, rows
        raise AssertionError


class Scanner:
    def __init__(self, templates: list[tuple[str, bytes]], size: int, share: int, whole: int = 0):
        """The last ``whole`` templates count only with all their shingles."""
        memo = BareHash()
        self.names = [n for n, _ in templates]
        self.shares = [share] * (len(templates) - whole) + [100] * whole
        texts = [bare_hashes(t, memo)[0] for _, t in templates]
        groups: dict[tuple[int, int], list[int]] = {}
        for k, words in enumerate(texts):
            if len(words):  # lengths up to a quarter apart share a class
                groups.setdefault((min(size, len(words)), math.floor(math.log(len(words), 1.25))), []).append(k)
        self.sets = [np.unique(shingles(w, size)) for w in texts]
        rng = np.random.default_rng(7)
        self.classes = []
        for (own_size, _), members in sorted(groups.items()):
            lengths = [len(texts[k]) for k in members]
            c = SizeClass(own_size, min(lengths), max(lengths), share)
            bands, rows = c.banding
            a = rng.integers(0, 2**31, (bands, rows), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
            b = rng.integers(0, 2**32, (bands, rows), dtype=np.uint32)
            keys = []
            for j in range(bands):
                by_key: dict[int, list[int]] = {}
                for k in members:
                    top = (self.sets[k] >> np.uint64(32)).astype(np.uint32)
                    key = self._join([(top * a[j, r] + b[j, r]).min(keepdims=True) for r in range(rows)])
                    by_key.setdefault(int(key[0]), []).append(k)
                slots = np.zeros(2**16, bool)
                slots[[x >> 48 for x in by_key]] = True
                keys.append((by_key, slots))
            every = np.unique(np.concatenate([self.sets[k] for k in members]))
            seen = np.zeros(2**20, bool)
            seen[every >> np.uint64(44)] = True
            need = min(-(-self.shares[k] * len(self.sets[k]) // 100) for k in members)
            self.classes.append((c, a, b, keys, every, seen, need))

    @staticmethod
    def _join(minima: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(minima[0]), 1, np.uint64)
        for m in minima:
            h = mixed(h * MULTIPLIER + m.astype(np.uint64))
        return h

    @staticmethod
    def _sliding(x: np.ndarray, width: int) -> np.ndarray:
        """Least of ``width`` values from each place on, by doubling."""
        done = 1
        while done < width:
            step = min(done, width - done)
            x = np.minimum(x[: len(x) - step], x[step:])
            done += step
        return x

    def matches(self, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, int]]:
        """For (text, template): shingles found and first word of the first window that holds most of them.

        ``texts`` are word hashes. Texts stand in one row with gaps of empty places, so no window crosses two. A text
        that has fewer shingles of a class's templates than any of them needs is left out of that class; nothing is
        missed by it.
        """
        out: dict[tuple[int, int], tuple[int, int]] = {}
        by_size: dict[int, tuple] = {}
        for c, a, b, keys, every, seen, need in self.classes:
            if c.size not in by_size:
                own = [shingles(t, c.size) if len(t) >= c.size else np.empty(0, np.uint64) for t in texts]
                flat = np.concatenate(own)
                by_size[c.size] = own, flat, (flat >> np.uint64(44)).astype(np.int64), np.repeat(np.arange(len(texts)), [len(p) for p in own])
            all_pieces, flat, slot, of = by_size[c.size]
            hits = np.flatnonzero(seen[slot])
            hits = hits[np.isin(flat[hits], every)]
            reach = np.flatnonzero(np.bincount(of[hits], minlength=len(texts)) >= need)
            if not len(reach):
                continue
            pieces = [all_pieces[d] for d in reach.tolist()]
            counts = np.array([len(p) for p in pieces])
            starts = np.cumsum(counts + c.width) - (counts + c.width)
            top = np.zeros(int((counts + c.width).sum()), np.uint32)
            empty = np.ones(len(top), bool)
            for s, p in zip(starts.tolist(), pieces):
                top[s : s + len(p)] = (p >> np.uint64(32)).astype(np.uint32)
                empty[s : s + len(p)] = False
            windows = [-(-n // c.step) for n in counts.tolist()]
            at = np.concatenate([s + c.step * np.arange(w) for s, w in zip(starts.tolist(), windows)])
            owner = np.repeat(np.arange(len(pieces)), windows)
            candidates: set[tuple[int, int]] = set()
            for j, (by_key, slots) in enumerate(keys):
                minima = []
                for r in range(a.shape[1]):
                    h = top * a[j, r] + b[j, r]
                    h[empty] = 2**32 - 1
                    minima.append(self._sliding(h, c.width)[at])
                key = self._join(minima)
                hit = np.flatnonzero(slots[key >> np.uint64(48)])
                for w, x in zip(hit.tolist(), key[hit].tolist()):
                    candidates.update((w, k) for k in by_key.get(x, ()))
            for w, k in sorted(candidates):
                d = int(owner[w])
                first = int(at[w] - starts[d])
                own = np.unique(pieces[d][first : first + c.width])
                found = int(np.isin(self.sets[k], own, assume_unique=True).sum())
                text = int(reach[d])
                if 100 * found >= self.shares[k] * len(self.sets[k]) and found > out.get((text, k), (0, 0))[0]:
                    out[text, k] = (found, first)
        return out


SCHEMA = "doc_id long, license string, n_shingles long, found long, first_word long"
ARROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("n_shingles", pa.int64()), ("found", pa.int64()), ("first_word", pa.int64())])


def tagged(text: bytes | None) -> dict[str, int]:
    """Identifiers of the SPDX tags in a text, and the place of the word that holds the tag."""
    out: dict[str, int] = {}
    for m in TAG.finditer(text or b""):
        first = len(text[: m.start() + 1].split()) - 1
        for x in JOINED.split(WITH.sub(b"", m[1]).strip(b"() \t")):
            name = x.rstrip(b".").decode("utf-8", "replace")
            out.setdefault(KNOWN.get(name.lower(), name), first)
    return out


#: Identifiers as they are written, by lower case; tags know older forms of those of GNU licenses.
KNOWN = {x.lower(): x for x in NAMES} | {f"{x.lower()}{y}": x for x in NAMES if "GPL" in x or "GFDL" in x for y in ("-only", "-or-later", "+")}


def _scan(shared, own: bool) -> Callable:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, memo = received(shared), BareHash()
        for batch in in_pieces(batches, 128):
            ids, texts = batch.column(0).to_pylist(), texts_of(batch)
            bare = [bare_hashes(t, memo) for t in texts]
            found = [
                {"doc_id": d, "license": scanner.names[k], "n_shingles": len(scanner.sets[k]), "found": n, "first_word": int(bare[d][1][first])}
                for (d, k), (n, first) in sorted(scanner.matches([h for h, _ in bare]).items())
            ]
            if own:  # the longest template of each license
                found += [{"doc_id": d, "license": x, "n_shingles": 1, "found": 1, "first_word": at} for d, t in enumerate(texts) for x, at in tagged(t).items()]
                best: dict[tuple, dict] = {}
                for r in found:
                    if r["found"] > best.get((r["doc_id"], r["license"]), {"found": 0})["found"]:
                        best[r["doc_id"], r["license"]] = r
                found = [best[k] for k in sorted(best)]
            yield pa.RecordBatch.from_pylist([r | {"doc_id": ids[r["doc_id"]]} for r in found], schema=ARROW)

    return scan


def license_matches(docs: DataFrame, templates: DataFrame | None = None, size: int = 5, share: int = 80) -> DataFrame:
    """One row per row of ``docs`` and template (``license``, ``text``) that it contains: ``doc_id``, ``license``, ``n_shingles`` of the
    template, those ``found`` in the best window, and the ``first_word`` of that window (from 0).

    Words are lower-cased and lose punctuation at their edges, and words of punctuation only do not count; a template shorter than ``size`` words is one shingle. For templates of similar length, windows
    somewhat longer than they are slide over the whole text, overlapping so that a template stands whole in one.
    A window that contains ``share`` % of a template shares a band with it but for a chance of MISS (see ``SizeClass``);
    what shares a band is compared on full shingle sets.

    Without ``templates``, one row per row of ``docs`` and license: the longest match among NOTICES, the full texts and usual
    headers of common licenses, short statements that name one (only whole), and SPDX tags with any identifier. A text that
    holds another one, or a near version of it, gives both. Templates are held in blocks of at most
    TEMPLATE_BYTES, one pass over the texts each, and texts are not shuffled. Null and empty texts and templates match
    nothing. Repeated rows and null ids give their own rows; templates that repeat a name give a row each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    if templates is None:
        whole = wordings()
        scanner = Scanner([(n, t.encode()) for n, t in [*full_texts(), *HEADERS, *NOTICES, *whole]], size, share, len(whole))
        return docs.mapInArrow(_scan(sent(spark, scanner), True), SCHEMA)
    for block in _blocks(templates):
        scanner = Scanner([(n, t.encode()) for n, t in block], size, share)
        out = out.unionByName(docs.mapInArrow(_scan(sent(spark, scanner), False), SCHEMA))
    return out


def _blocks(templates: DataFrame) -> Iterator[list[tuple[str, str]]]:
    rows = templates.select(F.col("license").cast("string"), F.col("text").cast("string")).filter("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // TEMPLATE_BYTES)
    for k in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("license", "text"), F.lit(blocks)) == k)
        yield sorted((r.license, r.text) for r in own.collect())
