"""Exact token counts at every prefix of a text, by dynamic programming over a BPE vocabulary.

In a byte-pair encoding two neighbouring tokens decide by themselves whether
they may stand side by side, and the encoding of a prefix that ends at a token
is a prefix of the encoding. So the last token of every prefix of a word is the
one token that ends there and goes with the last token of the shorter prefix;
its count is one more than that prefix's. The last letter of a word is a symbol
of its own (it carries the end-of-word mark), so each prefix also has a second
last token, as a finished word; that one counts when a text is cut there.

The counts answer later questions without encoding again: tokens of any prefix,
the longest prefix within a budget, whether a limit is passed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import text_slices
from .vocabulary import PIECES, REMEMBERED, SEPARATORS, byte_letters, chunks, load, merges, one_word

LIMIT = 2048
END = "</w>"
#: Pairs of tokens that a task remembers.
REMEMBERED_PAIRS = 500_000


class PrefixCounter:
    """Prefix counts of chunks of text for one vocabulary file, remembered per task."""

    def __init__(self, path: str):
        ranks, vocabulary = merges(path)
        self._rank = ranks
        self._made = {a + b: (rank, a, b) for (a, b), rank in ranks.items()}
        # beginning of a token -> 1 if it is one, 2 if it is one at the end of a word, 3 if both, 0 if neither
        self._starts: dict[str, int] = {}
        for token in vocabulary:
            body, bit = (token[:-len(END)], 2) if token.endswith(END) else (token, 1)
            for i in range(1, len(body)):
                self._starts.setdefault(body[:i], 0)
            self._starts[body] = self._starts.get(body, 0) | bit
        self._longest = max(map(len, self._starts))
        tokenizer = load(path)
        self._normal = tokenizer.normalizer.normalize_str
        self._special = regex.compile("|".join(regex.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, tuple[bytes, int]] = {}
        self._letters = byte_letters()

    def _fits(self, left: str, right: str) -> bool:
        """Whether two tokens may be neighbours.

        Undo the merges that made them, latest first: before each, the symbols
        that met at the border must not have had a merge that came earlier.
        """
        key = (left, right)
        bound = len(self._rank) + 1
        fits = True
        while True:
            border = self._rank.get((left, right), bound)
            if border < bound:
                fits = False
                break
            of_left, of_right = self._made.get(left), self._made.get(right)
            if of_left is None and of_right is None:
                break
            # of equal merges the one further left comes first
            if of_right is None or (of_left is not None and of_left[0] > of_right[0]):
                bound, left = of_left[0], of_left[2]
            else:
                bound, right = of_right[0] + 1, of_right[1]
        if len(self._pairs) < REMEMBERED_PAIRS:
            self._pairs[key] = fits
        return fits

    def _walk(self, symbols: str, last: list, count: list[int]) -> tuple[list, list[int], list[int]]:
        """(last token, tokens, tokens as a finished word) of every prefix of a word of byte letters.

        ``last`` and ``count`` hold what is known of the first prefixes and end
        where the walk has to go on. Tokens are tried from where they begin, as
        long as some token goes on.
        """
        size, starts, pairs, fits = len(symbols), self._starts, self._pairs, self._fits
        known_to = len(last)
        last, count, finished = last + [None] * (size + 1 - known_to), count + [0] * (size + 1 - known_to), [0] * (size + 1)
        for j in range(size):
            left, n = last[j], count[j] + 1
            for i in range(j + 1, size + 1):
                token = symbols[j:i]
                kind = starts.get(token)
                if kind is None:
                    break
                if kind & 1 and last[i] is None and (left is None or (fits(left, token) if (known := pairs.get((left, token))) is None else known)):
                    last[i], count[i] = token, n
                if kind & 2 and not finished[i]:
                    token += END
                    if left is None or (fits(left, token) if (known := pairs.get((left, token))) is None else known):
                        finished[i] = n
        return last, count, finished

    def _octets(self, text: str) -> str:
        return "".join([self._letters[b] for b in text.encode()])

    def word(self, piece: str) -> tuple[bytes, int]:
        """(counts after each character as unsigned 32-bit numbers, count of the whole) of one normalised piece."""
        known = self._words.get(piece)
        if known is None:
            symbols = self._octets(piece)
            steps = self._walk(symbols, [None], [0])[2][1:]
            if len(symbols) != len(piece):
                steps = [steps[i - 1] for i in np.cumsum([len(c.encode()) for c in piece]).tolist()]
            known = np.array(steps, dtype=np.uint32).tobytes(), steps[-1]
            if len(self._words) < REMEMBERED:
                self._words[piece] = known
        return known

    def _pieces(self, text: str) -> int:
        return sum([self.word(p)[1] for p in PIECES.findall(text)])

    def count(self, text: str) -> int:
        """Tokens of a text, as the library counts them: special strings, normalising, pieces, then words."""
        parts = self._special.split(text)
        return sum(self._pieces(self._normal(p)) for p in parts) + len(parts) - 1

    def chunk(self, chunk: str) -> bytes:
        """Counts after each character of a chunk without white space, from 0 at its start."""
        simple = one_word(chunk)
        if simple:
            steps, whole = self.word(simple[0])
            return steps + (whole + self.word(simple[1])[1]).to_bytes(4, "little") if simple[1] else steps
        counts, at, base = [], 0, 0
        for special in self._special.finditer(chunk):
            head = self._plain(chunk[at:special.start()])
            counts.append(head + base)
            # a cut inside a special string leaves ordinary text
            counts.append([base + self.count(chunk[at:i]) for i in range(special.start() + 1, special.end())])
            base += (int(head[-1]) if len(head) else 0) + 1
            counts.append([base])
            at = special.end()
        counts.append(self._plain(chunk[at:]) + base)
        return np.concatenate(counts).astype(np.uint32).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        """Counts after each character of a text without special strings.

        Prefixes of composed text are composed, so pieces come from the whole and
        a cut only shortens the last one. Text that composing or lower-casing
        makes longer or shorter takes ``_changed``.
        """
        low = "".join([c.lower() for c in text])
        if len(low) != len(text) or not unicodedata.is_normalized("NFC", text):
            return self._changed(text)
        return self._pieces_at_every_place(low)

    def _changed(self, text: str) -> np.ndarray:
        """Counts after each character of a text that normalising changes.

        The text is cut where composing cannot reach across. Its normal form is
        that of the parts, one after the other, and a prefix that ends inside a
        part differs from the normal form in that part only.
        """
        cuts = [i for i in range(len(text)) if i == 0 or _closed(text[i])] + [len(text)]
        parts = [(a, b, self._normal(text[a:b])) for a, b in zip(cuts, cuts[1:])]
        low = "".join([p for _, _, p in parts])
        whole = np.concatenate([[0], self._pieces_at_every_place(low)])
        found = [(m.start(), m.end()) for m in PIECES.finditer(low)]
        counts, done, k = np.zeros(len(text), dtype=np.int64), 0, 0
        walk: tuple | None = None
        for a, b, part in parts:
            while k < len(found) and found[k][1] < done:
                k, walk = k + 1, None
            for i in range(a + 1, b):
                tail = self._normal(text[a:i])
                start, end = found[k] if k < len(found) else (done, done)
                quoted = start > 0 and low[start - 1] == "'"
                if not (start < done <= end):
                    counts[i - 1] = whole[done] + self._pieces(tail)
                elif low[start:end].isalpha() and tail.isalpha() and (done - start > 1 or not quoted):
                    if walk is None:
                        symbols = self._octets(low[start:end])
                        walk = symbols, self._walk(symbols, [None], [0]), np.cumsum([0] + [len(c.encode()) for c in low[start:end]])
                    counts[i - 1] = whole[start] + self._branch(walk[0], walk[1], int(walk[2][done - start]), self._octets(tail))
                else:
                    # signs before a letter, contractions: the run of letters or signs is counted again
                    from_ = found[k - 1][0] if quoted else start
                    counts[i - 1] = whole[from_] + self._pieces(low[from_:done] + tail)
            done += len(part)
            counts[b - 1] = whole[done]
        return counts

    def _pieces_at_every_place(self, low: str) -> np.ndarray:
        """Counts after each character of a normalised text."""
        counts, base, at = np.zeros(len(low), dtype=np.int64), 0, 0
        for m in PIECES.finditer(low):
            counts[at:m.start()] = base
            piece, (steps, n) = m.group(), self.word(m.group())
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
                counts[m.start():m.end()] = [base + self._pieces(piece[:i]) for i in range(1, len(piece))] + [base + n]
            else:
                counts[m.start():m.end()] = np.frombuffer(steps, np.uint32)
                counts[m.start():m.end()] += base
            base, at = base + n, m.end()
        counts[at:] = base
        return counts

    def _branch(self, symbols: str, walked: tuple, at: int, tail: str) -> int:
        """Tokens of the finished word of the first ``at`` symbols and a tail; only tokens that reach into the tail are tried."""
        if not tail:
            return walked[2][at]
        first = max(0, at - self._longest)
        last, count, _ = walked
        return self._walk(symbols[first:at] + tail, last[first:at + 1], count[first:at + 1])[2][-1]


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Starters that can compose with the character before them."""
    seconds = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


@lru_cache(maxsize=4096)
def _closed(c: str) -> bool:
    """Whether no composing reaches across the place before this character."""
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) == 0 and first not in _joining()


class Chunks(dict):
    """Chunk -> its counts, filled on demand up to a bound."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self._counter = counter

    def __missing__(self, chunk: str) -> bytes:
        counts = self._counter.chunk(chunk)
        if len(self) < REMEMBERED:
            self[chunk] = counts
        return counts


@lru_cache(maxsize=1)
def counted_chunks(path: str) -> Chunks:
    """The memory of this worker process for one vocabulary; tasks that follow use it too."""
    return Chunks(PrefixCounter(path))


@lru_cache(maxsize=2)
def _spaces(ascii_only: bool) -> np.ndarray:
    """Code point -> whether ``chunks`` cuts there."""
    return np.array([chr(i) in " \t\n\x0b\x0c\r" if ascii_only else chr(i).isspace() for i in range(0x110000)])


def prefix_counts(texts: list[str], known: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """(counts, characters per text): the tokens of every non-empty prefix of every text, text after text."""
    cut = [chunks(t) for t in texts]
    n_chunks = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = [c for part in cut for c in part]
    inside = np.frombuffer(b"".join(map(known.__getitem__, flat)), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(size)
    total = np.concatenate([[0], np.cumsum(inside[ends - 1] if len(flat) else inside)])
    first = np.cumsum(n_chunks) - n_chunks
    base = total[:-1] - np.repeat(total[first], n_chunks)
    inside += np.repeat(base, size)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = ~_spaces(False)[codes]
    starts = np.cumsum(length) - length
    for i, text in enumerate(texts):
        if any(c in text for c in SEPARATORS):
            solid[starts[i]:starts[i] + length[i]] = ~_spaces(True)[codes[starts[i]:starts[i] + length[i]]]
    # white space keeps the count of the last character before it in the same text
    seen = np.cumsum(solid)
    own = seen - np.repeat(np.concatenate([[0], seen])[starts], length)
    counts = np.zeros(len(codes), dtype=np.int64)
    counts[own > 0] = inside[seen[own > 0] - 1]
    return counts, length


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens (counts can fall inside a word)."""
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, keep_counts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_chars for every row of ``docs``.

    Only doc_id and text are read. ``n_tokens`` is the count at the last prefix,
    ``over_limit`` whether it is above ``limit``, ``cut_chars`` the length of the
    longest prefix with at most ``limit`` tokens. With ``keep_counts`` a column
    ``counts`` holds the count at every prefix (four bytes each, little-endian).

    Null and empty texts have 0 bytes and tokens. A vocabulary is a parameter: the
    path of a word BPE file. What a task remembers is bounded.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counted_chunks(vocabulary)
        for batch in batches:
            for first, texts in text_slices(batch):
                counts, length = prefix_counts(texts, known)
                stop = np.cumsum(length)
                n = np.where(length > 0, np.concatenate([counts, [0]])[stop - 1], 0)
                n_bytes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
                cut = [m if k <= limit else longest_within(counts[e - m:e], limit) for k, m, e in zip(n.tolist(), length.tolist(), stop.tolist())]
                columns = [batch.column(0).slice(first, len(texts)), pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit), pa.array(cut, pa.int64())]
                if keep_counts:
                    columns.append(pa.array([counts[e - m:e].astype("<u4").tobytes() for m, e in zip(length.tolist(), stop.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", "text")
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"] + ["counts"] * keep_counts
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long" + ", counts binary" * keep_counts
    return rows.mapInArrow(answer, schema)
