"""Benchmark decontamination by q-gram lemma filtering.

Two texts of length w within e edits share at least w + 1 - q (e + 1) q-grams,
all of them on e + 1 neighbouring diagonals. Shared q-grams of a document and a
benchmark item are dealt to diagonal bands that overlap by e, so that some band
holds them all. Regions of a band with enough q-grams inside one window are
retained, and a banded alignment decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import ODD, segment_index, text_slices, within

#: A document is contaminated by 64 normalised characters of an item within 5
#: edits, or by all of a shorter item within a share of edits.
WINDOW, EDITS, Q = 64, 5, 8
BAND = 16
#: Normalised benchmark characters that one pass over the documents carries.
BLOCK_CHARS = 4_000_000
TABLE_BITS = 22
#: Shared q-grams of a slice of texts that are opened at once.
HITS = 4_000_000


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """Code point -> itself where it is a letter or digit, a space elsewhere."""
    return np.array([i if chr(i).isalnum() else 32 for i in range(0x110000)], dtype=np.uint32)


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, characters per text, place in the lower-cased text): letters and digits, all else one space."""
    lowered = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = _signs()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = segment_index(lengths)
    keep = codes != 32
    if len(codes):
        keep[1:] |= (codes[:-1] != 32) & (owner[1:] == owner[:-1])
        # no space at the end of a text
        place = np.flatnonzero(keep)
        last = place[np.append(owner[place[1:]] != owner[place[:-1]], True)] if len(place) else place
        keep[last[codes[last] == 32]] = False
    return codes[keep], np.bincount(owner[keep], minlength=len(texts)), within(lengths)[keep]


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q code points from each place on, made from hashes of half the length."""
    h, size = codes.astype(np.uint64), 1
    parts = bin(q)[3:]
    one = h
    for bit in parts:
        shift = np.uint64(pow(int(ODD), size, 1 << 64))
        h, size = h[:len(h) - size] * shift + h[size:], 2 * size
        if bit == "1":
            h, size = h[:len(h) - 1] * ODD + one[size:], size + 1
    return h


def spell(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class Benchmark:
    """Q-gram index of a block of normalised items; items shorter than a q-gram are kept by their words."""

    def __init__(self, ids: list[int | None], texts: list[str], window: int = WINDOW, edits: int = EDITS, q: int = Q, band: int = BAND):
        codes, lengths, _ = normalise(texts)
        self.ids, self.codes, self.q, self.band, self.edits = list(ids), codes, q, band, edits
        self.first = np.cumsum(lengths) - lengths
        self.length = lengths
        self.window = np.minimum(lengths, window)
        # edits in proportion, as many as the lemma can still filter for
        self.budget = np.maximum(np.minimum(self.window * edits // window, self.window // q - 1), 0)
        self.needed = self.window + 1 - q * (self.budget + 1)
        self.short: dict[tuple[str, ...], list[int]] = {}
        for k in np.flatnonzero((lengths > 0) & (lengths < q)).tolist():
            words = tuple(spell(codes[self.first[k]:self.first[k] + lengths[k]]).split(" "))
            self.short.setdefault(words, []).append(k)
        h = qgram_hashes(codes, q) if len(codes) >= q else np.zeros(0, np.uint64)
        owner = segment_index(lengths)
        at = np.flatnonzero(owner[:len(h)] == owner[q - 1:]) if len(h) else np.zeros(0, np.int64)
        order = at[np.argsort(h[at], kind="stable")]
        self.hashes, start, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.start, self.item = start, owner[order]
        self.place = order - self.first[owner[order]]
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * ODD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def shared(self, codes: np.ndarray) -> int:
        """Number of q-gram hits before they are made."""
        if len(codes) < self.q or not len(self.hashes):
            return 0
        h = qgram_hashes(codes, self.q)
        h = h[self.table[self._slot(h)]]
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return int(self.count[slot[self.hashes[slot] == h]].sum())

    def hits(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, place in the text, place in the item) of every shared q-gram."""
        none = np.zeros(0, np.int64)
        if len(codes) < self.q or not len(self.hashes):
            return none, none, none, none
        h = qgram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[self._slot(h)])
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[slot] == h[at]
        at, slot = at[same], slot[same]
        owner = segment_index(lengths)
        whole = owner[at] == owner[at + self.q - 1]
        at, slot = at[whole], slot[whole]
        n = self.count[slot]
        entry = np.repeat(self.start[slot], n) + within(n)
        at = np.repeat(at, n)
        return owner[at], self.item[entry], at - (np.cumsum(lengths) - lengths)[owner[at]], self.place[entry]

    def regions(self, hits) -> tuple[np.ndarray, ...]:
        """(text, item, band, first window, last window) where a band has the q-grams that a window needs."""
        doc, item, i, j = hits
        diagonal = i - j
        band = diagonal // self.band
        low = diagonal - band * self.band < self.edits  # also in the band below, which reaches over by as much
        # most bands hold a few chance hits: counts by hash drop them before they are sorted
        slots = [((doc * 31 + item) * 1_000_003 + b & (1 << 20) - 1) for b in (band, band - 1)]
        full = np.bincount(slots[0], minlength=1 << 20) + np.bincount(slots[1][low], minlength=1 << 20)
        own, under = full[slots[0]] >= self.needed[item], low & (full[slots[1]] >= self.needed[item])
        doc, item, i, j = (np.concatenate([x[own], x[under]]) for x in (doc, item, i, j))
        band = np.concatenate([band[own], band[under] - 1])
        order = np.lexsort((j, band, item, doc))
        doc, item, band, j = doc[order], item[order], band[order], j[order]
        found = []
        for need in np.unique(self.needed[item]).tolist():
            mine = np.flatnonzero(self.needed[item] == need)
            if len(mine) < need:
                continue
            a, z = mine[:len(mine) - need + 1], mine[need - 1:]
            ok = (doc[a] == doc[z]) & (item[a] == item[z]) & (band[a] == band[z]) & (j[z] - j[a] <= self.window[item[a]] - self.q)
            a, z = a[ok], z[ok]
            found.append((doc[a], item[a], band[a], np.maximum(j[z] + self.q - self.window[item[a]], 0),
                          np.minimum(j[a], self.length[item[a]] - self.window[item[a]])))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))

    def align(self, codes, lengths, doc, item, band, start) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end in the text) of the item's window at ``start``, against the text on the diagonals of one band.

        Windows that pass their budget on the way keep a large number.
        """
        edits, end = np.full(len(doc), 1 << 30), np.zeros(len(doc), dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        padded = np.concatenate([codes, np.zeros(1, codes.dtype)])
        for m in np.unique(self.window[item]).tolist():
            own = np.flatnonzero(self.window[item] == m)
            width = self.band + self.edits
            offset = (start[own] + band[own] * self.band)[:, None] + np.arange(width)
            letters = self.first[item[own]] + start[own]
            text, size = first[doc[own]][:, None], lengths[doc[own]][:, None]
            cost = np.zeros((len(own), width), dtype=np.int32)
            steps = np.arange(width, dtype=np.int32)
            for r in range(m):
                if r % 8 == 0:  # the least cost of a row never falls again
                    open_ = cost.min(axis=1) <= self.budget[item[own]]
                    own, offset, letters, text, size, cost = (x[open_] for x in (own, offset, letters, text, size, cost))
                at = offset + r
                letter = padded[np.where((at >= 0) & (at < size), text + at, len(codes))]
                # a step along the diagonal, or a letter of the item without one in the text
                step = cost + (letter != self.codes[letters + r][:, None])
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                # letters of the text without one in the item
                cost = np.minimum.accumulate(step - steps, axis=1) + steps
            best = cost.argmin(axis=1)
            edits[own] = cost[np.arange(len(own)), best]
            end[own] = offset[np.arange(len(own)), best] + m
        return edits, end

    def whole_words(self, codes, lengths, place) -> dict[tuple[int, int], tuple[int, int, int]]:
        """First places of the items shorter than a q-gram: all their words one after another, without edits."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        sizes = sorted({len(w) for w in self.short})
        first = np.cumsum(lengths) - lengths
        for d in range(len(lengths) if sizes else 0):
            words = spell(codes[first[d]:first[d] + lengths[d]]).split(" ")
            ends = (first[d] + np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
            for n in sizes:
                for i in range(len(words) - n + 1):
                    for m in self.short.get(tuple(words[i:i + n]), ()):
                        begin, end = ends[i] - len(words[i]), ends[i + n - 1]
                        out.setdefault((d, m), (0, int(place[begin]), int(place[end - 1]) + 1))
        return out

    def matches(self, texts: list[str]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item id, edits, start, end in the lower-cased text) for every text and item that match.

        A slice with very many shared q-grams is taken in halves, so that
        memory is bounded by HITS, or by what one text shares with the items.
        """
        codes, lengths, place = normalise(texts)
        if len(texts) > 1 and self.shared(codes) > HITS:
            half = len(texts) // 2
            return self.matches(texts[:half]) + [(d + half, *rest) for d, *rest in self.matches(texts[half:])]
        out = self.whole_words(codes, lengths, place)
        doc, item, band, low, high = self.regions(self.hits(codes, lengths))
        if not len(doc):
            return [(d, self.ids[m], *rest) for (d, m), rest in sorted(out.items())]
        first = np.cumsum(lengths) - lengths

        def verify(pick) -> None:
            edits, end = self.align(codes, lengths, *pick)
            for k in np.flatnonzero(edits <= self.budget[pick[1]]).tolist():
                d, m = int(pick[0][k]), int(pick[1][k])
                stop = min(max(int(end[k]), 1), int(lengths[d]))
                begin = max(stop - int(self.window[m]), 0)
                seen = (int(edits[k]), int(place[first[d] + begin]), int(place[first[d] + stop - 1]) + 1)
                out[d, m] = min(out.get((d, m), seen), seen)

        # most matches show at the first window of a text and item; the others try every window
        key = doc * len(self.ids) + item
        _, one = np.unique(key, return_index=True)
        verify((doc[one], item[one], band[one], low[one]))
        left = ~np.isin(key, np.array([d * len(self.ids) + m for d, m in out], dtype=np.int64))
        if left.any():
            n = (high - low + 1)[left]
            rows = np.repeat(np.flatnonzero(left), n)
            start = low[rows] + within(n)
            same = np.lexsort((start, band[rows], key[rows]))
            rows, start = rows[same], start[same]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (key[rows[1:]] != key[rows[:-1]]) | (band[rows[1:]] != band[rows[:-1]]) | (start[1:] != start[:-1])
            verify((doc[rows[new]], item[rows[new]], band[rows[new]], start[new]))
        return [(d, self.ids[m], *rest) for (d, m), rest in sorted(out.items())]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of bounded size, read one after another; rows without text are left out."""
    ids, texts, size = [], [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").distinct().toLocalIterator():
        if ids and size + len(row["text"]) > block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, edits: int = EDITS, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, start, end for every row of ``docs`` and item of ``benchmark`` that match.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored. Texts are compared lower-cased, with one space for everything but
    letters and digits; start and end are places in the lower-cased text.

    - Null and empty texts match nothing; a null doc_id is reported as null.
    - Repeated rows are reported each; an item id with two texts counts for either.
    - A null item id is reported as null. An item with fewer than ``q`` normalised
      characters matches where its words stand one after another, without edits;
      one without letters and digits matches nothing. An empty table on either
      side gives an empty result.

    The benchmark is the query set: it goes to the tasks in blocks of at most
    ``block_chars``, each in a pass of its own over the documents.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, edits int, start long, end long"
    out = None
    for ids, texts in blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(Benchmark(ids, texts, window, edits, q))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, part in text_slices(batch):
                    found = sent.value.matches(part)
                    if found:
                        doc, item, n, start, end = map(list, zip(*found))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(first, len(part)).take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(n, pa.int32()),
                             pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "edits", "start", "end"])

        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item. Rows are told by id and text."""
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_text"))
    slim = docs.select(F.struct("doc_id", F.xxhash64("text").alias("_text")).alias("doc_id"), "text")
    bad = leaks(slim, benchmark, **kw).select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id._text").alias("_hash")).distinct()
    return keyed.join(bad, keyed["_own"].eqNullSafe(bad["_id"]) & (keyed["_text"] == bad["_hash"]), "left_anti").select("_all.*")
