import hashlib
import random

import numpy as np
import oracle
import pytest
from llm.helpers import LONG, SF, edge, multiset
from pyspark.sql import functions as F
from waymark.llm import contentsort, linedup, mixing, queries


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_content_sort_edges(spark):
    rows = contentsort.content_sort(edge(spark)).collect()
    assert len(rows) == 14
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    same = by[hashlib.sha256(b"same text here").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(2, 4)} and sum(r["kept"] for r in same) == 1
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(4, 3)} and [r["doc_id"] for r in empty if r["kept"]] == [4]
    assert all(sum(r["kept"] for r in g) == 1 for g in by.values())
    assert contentsort.content_sort(edge(spark, [])).count() == 0
    nulls = contentsort.content_sort(edge(spark, [(None, "a", None, None, None)] * 2)).collect()
    assert [r["keep_id"] for r in nulls] == [None, None] and sum(r["kept"] for r in nulls) == 1


def test_content_sort_of_a_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot Copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = contentsort.content_sort(rows)
    hot = out.where("group_size > 1")
    assert hot.count() == 1000 and hot.where("kept").select("doc_id").collect() == [(2997,)]
    assert {tuple(r) for r in hot.select("keep_id", "group_size").distinct().collect()} == {(2997, 1000)}
    assert out.where("kept").count() == 2001


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = {}
    for n, (doc, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), {})[n] = doc
    out = []
    for doc, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            h = holders.get(key(line), {})
            ids = [d for d in h.values() if d is not None]
            if len(h) < min_docs or doc == (max(ids) if ids else None):
                kept.append(line)
        out.append((doc, len((text or "").split("\n")), len((text or "").split("\n")) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def line_rows():
    r = random.Random(4)
    common = [f"  This line of licence text number {i} is found in many documents " for i in range(12)] + ["short", "é" * 39, "Ä" * 40]
    rows = [(i, "\n".join(r.choice(common) if r.random() < 0.6 else f"own line {i} {r.random()}" * 2 for _ in range(r.randint(1, 9)))) for i in range(60)]
    return rows + [(None, common[0]), (None, None), (3, ""), (5, rows[5][1]), (5, rows[5][1]), (77, LONG + "\n" + common[1].upper())]


@pytest.mark.parametrize("sizes", [{}, {"keys_per_shard": 2, "pass_bytes": 300}])
def test_line_dedup_against_brute_force(spark, sizes):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("bits", F.lit(1))
    got = linedup.drop_repeated_lines(docs, **sizes).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_lines(rows)


def test_line_dedup_edges(spark):
    assert linedup.drop_repeated_lines(edge(spark, [])).count() == 0
    out = {r["doc_id"]: r for r in linedup.drop_repeated_lines(edge(spark)).collect()}
    assert (out[3]["n_lines"], out[3]["text"]) == (1, "") and out[6]["text"] == LONG
    alone = spark.createDataFrame([(None, "x" * 50)] * 6, "doc_id long, text string")
    assert linedup.drop_repeated_lines(alone).where("n_dropped > 0").count() == 0


def test_minimal_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    sizes, bits, ranks = linedup.build_hash(keys)
    assert sorted(linedup.rank_of(keys, sizes, bits, ranks).tolist()) == list(range(5000))


def test_water_level():
    assert mixing.water_level([10, 10, 10], [3, 1, 2], 45) == [20.0, 25 / 3, 50 / 3]
    assert mixing.water_level([], [], 0) == [] and mixing.water_level([0, 4], [3, 1], 6) == [0.0, 6.0]


def test_schedule_gives_every_block_once_and_evenly(spark):
    blocks = [3000, 17, 1, 0, 982]
    rows = mixing.schedule(spark, blocks).orderBy("slot").collect()
    assert sorted((r["_s"], r["block"]) for r in rows) == [(s, k) for s, n in enumerate(blocks) for k in range(n)]
    assert len({r["slot"] for r in rows}) == sum(blocks)
    for stop in range(100, sum(blocks), 250):  # every beginning of the mix is near the shares
        assert abs(sum(r["_s"] == 0 for r in rows[:stop]) - stop * 0.75) < 12
    assert mixing.schedule(spark, []).count() == 0


def test_mixing_edges(spark):
    out = mixing.taken_words(edge(spark))
    rows = out.collect()
    assert len(rows) == 14 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    documents, pieces = mixing.mix(edge(spark), block_words=7)
    per = {tuple(r) for r in documents.join(pieces, "_row").groupBy("source", "target").agg(F.sum("n_words")).collect()}
    assert all(abs(t - n) <= 0.5 for _, t, n in per) and len(per) == 4
    assert multiset(out, "doc_id", "taken") == multiset(mixing.taken_words(edge(spark).repartition(5)), "doc_id", "taken")
    assert mixing.taken_words(edge(spark, [])).count() == 0
    mixed = mixing.mixed_texts(edge(spark))
    assert mixed.columns == edge(spark).columns and mixed.where("_key <> 'x'").count() == 0
    words = mixed.select(F.sum(mixing.text_size(F.col("text")))).first()[0]
    assert words == sum(r["taken"] for r in rows)
