"""A public word BPE vocabulary: ids of chunks of text, and merges for prefix counts."""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: Words that a task remembers, and half the chunks of text. Most words beyond
#: this many occur once, so what is not remembered costs little.
REMEMBERED = 300_000

#: How the vocabulary's pre-tokeniser cuts (fixed values of the vocabulary file).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def chunk_ids(path: str, width: int) -> ChunkIds:
    """The memory of this worker process for one vocabulary; tasks that follow use it too."""
    return ChunkIds(path, width)


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def one_word(chunk: str) -> tuple[str, str] | None:
    """(letters, sign or nothing) of a chunk that is one run of letters, lower-cased, with at most one ASCII sign after it.

    None for all other chunks, and for those that normalising may change otherwise.
    """
    low = chunk.lower()
    if not low.isascii() and (len(low) != len(chunk) or "\u03a3" in chunk or not unicodedata.is_normalized("NFC", chunk)):
        return None
    if low.isalpha():
        return low, ""
    if low[:-1].isalpha() and "!" <= low[-1] <= "~" and low[-1] != "'" and not low[-1].isalnum():
        return low[:-1], low[-1]
    return None


class ChunkIds(dict):
    """Chunk of text without ASCII white space -> its ids as bytes, filled on demand.

    White space is dropped by the vocabulary and no token, composed character or
    special string crosses it, so the ids of a text are those of its chunks.
    """

    def __init__(self, path: str, width: int):
        super().__init__()
        self._tokenizer, self._type = load(path), {2: "H", 4: "I"}[width]
        self._model = self._tokenizer.model
        self._words: dict[str, bytes] = {}
        self._letters = byte_letters()

    def _word(self, word: str) -> bytes:
        """Ids of normalised letters or one sign: one word of the library's model."""
        mapped = word if word.isascii() else "".join([self._letters[b] for b in word.encode()])
        packed = array(self._type, [t.id for t in self._model.tokenize(mapped)]).tobytes()
        if len(self._words) < REMEMBERED:
            self._words[word] = packed
        return packed

    def __missing__(self, chunk: str) -> bytes:
        simple = one_word(chunk)
        if simple:
            word, sign = simple
            packed = self._words.get(word) or self._word(word)
            if sign:
                packed += self._words.get(sign) or self._word(sign)
        else:
            packed = array(self._type, self._tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(self) < 2 * REMEMBERED:
            self[chunk] = packed
        return packed


ASCII_SPACE = regex.compile(r"[ \t\n\x0b\x0c\r]+")
#: ``str.split`` cuts here, the vocabulary does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def chunks(text: str) -> list[str]:
    """Runs between white space. At white space beyond ASCII, cut or not, the vocabulary gives the same ids."""
    if any(c in text for c in SEPARATORS):
        return [c for c in ASCII_SPACE.split(text) if c]
    return text.split()


def vocabulary_size(path: str) -> int:
    return load(path).get_vocab_size(with_added_tokens=True)


def merges(path: str) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """(pair -> merge rank, token -> id) of the vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}, model["vocab"]
