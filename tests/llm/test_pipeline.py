"""Every stage of the pipeline against a plain version of it, on the smallest tables."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import pytest
from llm.helpers import SF, near_classes
from llm.test_near_and_leaks import brute_leak, plain
from tokenizers import Tokenizer
from waymark.cluster import scratch_path
from waymark.llm import mixing, toxicity
from waymark.llm.batches import held_out, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into each stage, and those of the last."""
    docs, out = table(spark, SF, "documents"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append([tuple(r) for r in docs.collect()])
        if number:
            assert docs.columns == COLUMNS
        path = scratch_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, [tuple(r) for r in docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect()]]


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels").where(~held_out()))
    assert sorted(stages[1]) == sorted(r for r in stages[0] if model.score([r[1]])[0] < 0.7)


def test_one_of_each_near_class_stays(stages):
    rows = sorted(stages[1])
    classes = near_classes([r[:2] for r in rows])
    firsts = {}
    for row, c in zip(rows, classes, strict=True):
        firsts.setdefault(c, row)
    assert sorted(stages[2]) == sorted(firsts.values())


def test_documents_with_benchmark_text_go(spark, stages):
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    kept = set(stages[3])
    assert kept <= set(stages[2])
    for row in stages[2]:
        if row in kept:
            assert not any(plain(i) in plain(row[1]) for i in items)
        else:
            assert any(brute_leak(row[1], i) for i in items)


def test_the_mix_meets_its_targets(stages):
    words = lambda t: len((t or "").split())
    before = {r[0]: r for r in stages[3]}
    longest = collections.Counter()
    sizes, taken, copies = collections.Counter(), collections.Counter(), collections.Counter(r[0] for r in stages[4])
    for r in stages[3]:
        sizes[r[3]] += words(r[1])
        longest[r[3]] = max(longest[r[3]], words(r[1]))
    for r in stages[4]:
        taken[r[3]] += words(r[1])
        assert r[:4] == before[r[0]][:4] and r[4] == len(r[1])  # texts stay whole
    names = sorted(sizes)
    goal = mixing.water_level([sizes[n] for n in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    # the document in which a target ends is taken whole
    assert all(-0.5 <= taken[n] - g < longest[n] + 0.5 for n, g in zip(names, goal, strict=True)) and max(copies.values()) <= 2


def test_token_files_hold_the_mix(stages):
    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    want, rows = [], []
    for doc, text, *_ in stages[4]:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for doc, at, n, crc in sorted(stages[5], key=lambda r: r[1]):
        assert at == start and (not rows or rows[-1][0] <= doc)
        rows.append((doc, n, crc))
        start += n
    assert sorted(rows) == sorted(want)


def test_run_gives_the_rows_of_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert sorted(tuple(r) for r in got) == sorted((r[0], r[2]) for r in stages[5])


def test_the_mix_keeps_texts_as_they_stand(spark):
    rows = [(1, "\tone  two\n\nthree four\r\nfive six seven eight \n", "en", "b", 0), *((i, "x y\nz " * 4, "en", "a", 0) for i in range(2, 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # source b (weight 1) holds one document of 8 words and gets 6 of them
    kw = {"weights": (1.0, 1.0), "share": 12 / 80}
    cut = {r["doc_id"]: r for r in mixing.mixed_texts(docs, **kw).collect()}
    assert cut[1]["text"] == "\tone  two\n\nthree four\r\nfive six" and cut[1]["n_chars"] == len(cut[1]["text"])
    whole = mixing.mixed_texts(docs, whole=True, **kw).collect()
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r["doc_id"] for r in whole) == sorted(cut) and all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in whole)
