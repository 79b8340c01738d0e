"""License scans: short notices found with a bounded number of edits.

A notice that occurs within k edits holds one of its k + 1 pieces exactly. The
pieces of all notices are the seeds of one automaton; where a seed occurs, the
regex library looks in a window around it for the whole notice within its edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import text_slices


@dataclass(frozen=True)
class Notice:
    """A label and the words that stand for it, lower-cased with single spaces; ``edits`` it may have."""

    label: str
    words: str
    edits: int
    base: bool = False


#: The phrases that count as base places, and sentences that public licenses open with or are named by.
NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 1, True),
    Notice("gpl", "general public license", 2, True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    Notice("apache", "you may not use this file except in compliance with the license", 4),
    Notice("gpl", "you can redistribute it and or modify it under the terms of the gnu", 4),
    Notice("lgpl", "lesser general public license", 2),
    Notice("agpl", "affero general public license", 2),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 4),
    Notice("bsd", "neither the name of the copyright holder nor the names of its contributors", 4),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("cc", "licensed under a creative commons", 3),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 4),
    Notice("boost", "boost software license", 2),
    Notice("zlib", "this software is provided as is without any express or implied warranty", 4),
)

#: A word before lower-casing.
WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Byte -> lower-cased byte of a word, or a space. Bytes of other characters than ASCII stay.
_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

SPAN = "struct<label:string,notice:int,first_word:bigint,last_word:bigint,start:bigint,end:bigint,edits:int>"
KIND = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), *((c, pa.int64()) for c in ("first_word", "last_word", "start", "end")), ("edits", pa.int32())]))


def spaced_words(text: str) -> tuple[str, int]:
    """The words of a text with A-Z lower-cased and a space before each, and how many they are."""
    found = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
    return b" ".join([b"", *found]).decode("utf-8", "surrogatepass"), len(found)


def pieces(words: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece): ``words`` cut into edits + 1 pieces of nearly equal length."""
    cuts = [len(words) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Seeds and patterns of a list of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            if " " + notice.words != spaced_words(notice.words)[0] or len(notice.words) <= notice.edits:
                raise ValueError(f"a notice needs lower-cased words with single spaces, longer than its edits: {notice}")
            for place, piece in pieces(notice.words, notice.edits):
                seeds.setdefault(piece, []).append((k, place))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if seeds:
            self.automaton.make_automaton()
        # a search never starts with an inserted character where it begins, so it begins at the space before a word
        bounded = r"(?<= )(?:%s)%s(?![^ ])"
        quoted = [regex.escape(n.words, literal_spaces=True) for n in notices]
        self.exact = [regex.compile(bounded % (q, "")) for q in quoted]
        self.fuzzy = [regex.compile("(?e)" + bounded % (q, "{e<=%d}" % n.edits)) for q, n in zip(quoted, notices)]

    def windows(self, words: str) -> dict[int, list[list[int]]]:
        """Notice -> stretches that hold all its places: whole words and the space before, from the left, apart from each other."""
        found: dict[int, list[list[int]]] = {}
        if not len(self.automaton):
            return found
        starts: dict[int, list[int]] = {}
        for end, (length, owners) in self.automaton.iter(words):
            for k, place in owners:
                starts.setdefault(k, []).append(end + 1 - length - place)
        for k, at in starts.items():
            notice = self.notices[k]
            merged = found[k] = []
            for s in sorted(at):
                lo, hi = max(0, s - notice.edits), s + len(notice.words) + notice.edits
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for w in merged:
                w[0] = max(0, words.rfind(" ", 0, w[0]))
                to = words.find(" ", min(w[1], len(words)))
                w[1] = len(words) if to < 0 else to
        return found

    def near(self, k: int, words: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of a notice inside words[lo:hi], block by block, so that long stretches cost no more per character."""
        reach = len(self.notices[k].words) + self.notices[k].edits
        while lo < hi:
            to = words.find(" ", min(lo + 8 * reach, hi), hi)
            to = hi if to < 0 else to
            hit = self.fuzzy[k].search(words, lo, to)
            if hit:
                yield hit.start(), hit.end(), sum(hit.fuzzy_counts)
                lo = hit.end()
            elif to == hi:
                return
            else:
                back = words.rfind(" ", lo + 1, to - reach)
                lo = to if back < 0 else back

    def spans(self, words: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of all places. Exact places come first; edited ones lie between them."""
        out = set()
        for k, stretches in self.windows(words).items():
            for lo, hi in stretches:
                for hit in self.exact[k].finditer(words, lo, hi, overlapped=True):
                    out.add((k, hit.start(), hit.end(), 0))
                    if lo < hit.start():
                        out.update((k, *x) for x in self.near(k, words, lo, hit.start() - 1))
                    lo = max(lo, hit.end())
                out.update((k, *x) for x in self.near(k, words, lo, hi))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of words, and the places with word numbers and code points of the text."""
        words, n = spaced_words(text)
        spans = self.spans(words)
        if not spans:
            return n, []
        at = [m.span() for m in WORD.finditer(text)]
        number, seen, out = 0, 0, []
        for k, start, end, edits in spans:
            number += words.count(" ", seen, start - 1)
            seen = start - 1
            last = number + words.count(" ", start, end)
            out.append({"label": self.notices[k].label, "notice": k, "first_word": number, "last_word": last, "start": at[number][0], "end": at[last][1], "edits": edits})
        return n, out


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def find_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, spans for every row of ``docs``; only doc_id and text are read.

    A span has the label, the number of the notice, its first and last word
    (from 0), its code points in the text and its edits. Spans of one notice that
    have edits do not overlap. A null or empty text has no words and no spans;
    null ids and repeated rows stay; an empty table gives an empty result. Texts
    are read whole; a text is in memory as its words.
    """
    notices = tuple(notices)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scanner(notices)
        for batch in batches:
            for first, texts in text_slices(batch):
                found = [tool.scan(t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], KIND)],
                                                 names=["doc_id", "n_words", "spans"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, spans array<{SPAN}>")

