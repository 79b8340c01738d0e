import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm.helpers import LONG, SF, edge
from tokenizers import Tokenizer
from waymark.cluster import scratch_path
from waymark.llm import queries, tokencount, tokenfiles, vocabulary
from waymark.llm.batches import table

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "the", "Thing", "é", "É", "é", "Σ", "ς", "İ", "I", "'s", "'re", "'", "1", "23", " ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85",
          " ", "​", "<|endoftext|>", "<|ENDOFTEXT|>", "<|start", "<|startoftext|>", ".", "!!", "你", "好", "🙂", "ß", "ﬁ", "≠", "̸", "_", "|",
          "\x00", "\x7f", "ing", "xyzzy", "tion"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 9))) for _ in range(n)]


def test_ids_of_chunks_are_those_of_the_library(library):
    known = vocabulary.ChunkIds(PATH, 2)
    for text in odd_texts(5000, 1):
        got = np.frombuffer(b"".join(map(known.__getitem__, vocabulary.chunks(text))), "<u2").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_prefix_count_is_that_of_the_library(spark, library):
    docs = [r["text"] for r in table(spark, SF, "documents").where("doc_id IN (0, 5, 22, 24)").collect()]
    texts = odd_texts(1500, 2) + [t[:400] for t in docs]
    counts, length = tokencount.prefix_counts(texts, tokencount.Chunks(tokencount.PrefixCounter(PATH)))
    ends = np.cumsum(length)
    for text, n, end in zip(texts, length.tolist(), ends.tolist(), strict=True):
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, n + 1)]
        assert counts[end - n:end].tolist() == want, repr(text)


def test_counts_of_given_documents(spark, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in queries.QUERIES["op9_token_counts"](spark, SF).collect():
        text = texts[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 2048)
        cut = text[:r["cut_chars"]]
        assert len(library.encode(cut, add_special_tokens=False).ids) <= 2048 and (cut == text) == (n <= 2048)


def test_count_edges(spark, library):
    out = {r["doc_id"]: r for r in tokencount.count_tokens(edge(spark), PATH, keep_counts=True).collect()}
    assert (out[3]["n_tokens"], out[3]["n_bytes"], out[3]["counts"], out[4]["n_tokens"], out[5]["n_tokens"]) == (0, 0, b"", 0, 0)
    assert out[6]["n_tokens"] == len(library.encode(LONG, add_special_tokens=False).ids) and out[6]["over_limit"]
    counts = np.frombuffer(out[7]["counts"], "<u4")
    assert counts[-1] == out[7]["n_tokens"] and tokencount.longest_within(counts, 3) == int(np.flatnonzero(counts <= 3)[-1]) + 1
    assert tokencount.count_tokens(edge(spark, []), PATH).count() == 0


def test_coding_round_trip():
    r = np.random.default_rng(5)
    counts = np.array([0, 1, 3, 0, 4, 5, 1000, 2])
    ranks = (r.integers(0, 1 << 32, counts.sum()) >> r.integers(0, 32, counts.sum())).astype(np.uint32)
    control, data = tokenfiles.encode_ranks(ranks, counts)
    assert [len(c) for c in control] == [-(-n // 4) for n in counts.tolist()]
    assert (tokenfiles.decode_ranks(control, data, counts) == ranks).all()
    assert tokenfiles.encode_ranks(ranks[:0], counts[:0]) == ([], [])


def test_token_files_of_given_documents(spark, library):
    rows = table(spark, SF, "documents").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_token_files"](spark, SF).collect()}
    start = 0
    for r in rows:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 2]
        own = got[r["doc_id"]]
        assert (own["start"], own["n_tokens"], own["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_token_file_edges(spark, library):
    path = scratch_path(spark, "test-tokens")
    tokenfiles.write_files(edge(spark), path, PATH)
    out = tokenfiles.read_files(spark, path).orderBy("start").collect()
    assert len(out) == 14 and [r["doc_id"] for r in out] == sorted((r["doc_id"] for r in out), key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in out] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in out])[:-1]]).tolist()
    by = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out}
    assert by[3] == by[4] == by[5] == [2] and by[6] == [*library.encode(LONG, add_special_tokens=False).ids, 2]
    empty = scratch_path(spark, "test-tokens")
    tokenfiles.write_files(edge(spark, []), empty, PATH)
    assert tokenfiles.read_files(spark, empty).count() == 0


def test_prefix_counts_of_text_that_normalising_changes():
    path = queries.WORD_BPE
    counter, library = tokencount.PrefixCounter(path), vocabulary.load(path)
    r = random.Random(9)
    signs = ["é", "ä", "ñ", "ß", "İ", "Σ", "th", "ing", "x", "'", "s", "'ll", ".", "!́", "7", "각",
             "ऩ", "̈́", "Å", "ệ", "́", "[UNK]", "</s>", "<|endoftext|>", "\U0001d15e"]
    for _ in range(150):
        text = "".join(r.choice(signs) for _ in range(r.randrange(1, 14)))
        counts = np.frombuffer(counter.chunk(text), np.uint32).tolist()
        assert counts == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)], ascii(text)
    long = "".join(r.choice(signs[:9]) for _ in range(12_000))
    begin = time.perf_counter()
    counts = np.frombuffer(counter.chunk(long), np.uint32).tolist()
    assert time.perf_counter() - begin < 10
    for i in [*r.sample(range(1, len(long)), 12), len(long)]:
        assert counts[i - 1] == len(library.encode(long[:i], add_special_tokens=False).ids)
