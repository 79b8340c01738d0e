import random
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from llm.helpers import LONG, SF, edge, near_classes, prose
from pyspark.sql import functions as F
from waymark.llm import components, dartminhash, qgram, queries
from waymark.llm.batches import table


def edited(text, seed, share):
    r = random.Random(seed)
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[r.randrange(len(words))] = f"w{r.randrange(10 ** 6)}"
    return " ".join(words)


def planted():
    """Stars around a base, chains of edits, unrelated texts, copies and edge cases."""
    rows = []
    for g in range(6):
        base = prose(g, 150)
        rows.append((len(rows), base))
        for k in range(25):
            rows.append((len(rows), edited(base, 100 * g + k, 0.03)))
        chain = prose(50 + g, 200)
        for k in range(8):
            rows.append((len(rows), chain))
            chain = edited(chain, 1000 + 10 * g + k, 0.025)
    rows += [(len(rows) + k, prose(500 + k, 80)) for k in range(40)]
    rows += [(len(rows) + k, rows[k][1]) for k in range(10)]
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " ", "one two", "One  two", "one two three", LONG, edited(LONG, 1, 0.01)])]
    return rows


def same_partition(got, want):
    return len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_near_classes_against_all_pairs(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("band", F.lit(0))
    out = {r["doc_id"]: r for r in dartminhash.near_classes(docs).collect()}
    want = near_classes(rows)
    assert same_partition([out[d]["class_id"] for d, _ in rows], want)
    assert all((r["kept"]) == (r["class_id"] == d) and r["class_size"] == sum(x["class_id"] == r["class_id"] for x in out.values()) for d, r in out.items())


def test_near_classes_of_given_documents(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    out = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op2_dart_minhash"](spark, SF).collect()}
    assert same_partition([out[d] for d, _ in rows], near_classes(rows))


def test_near_edges(spark):
    out = dartminhash.near_classes(edge(spark)).collect()
    assert len(out) == 14
    assert {(r["class_id"], r["class_size"]) for r in out if r["doc_id"] in (1, 2)} == {(1, 4)}
    assert sum(r["kept"] for r in out) == len(near_classes([(r[0], r[1]) for r in edge(spark).collect()]) and set(near_classes([(r[0], r[1]) for r in edge(spark).collect()])))
    distinct = dartminhash.near_distinct(edge(spark))
    assert distinct.count() == sum(r["kept"] for r in out) and distinct.columns == edge(spark).columns and distinct.where("_key <> 'x'").count() == 0
    assert dartminhash.near_classes(edge(spark, [])).count() == 0 and dartminhash.near_distinct(edge(spark, [])).count() == 0
    twins = edge(spark, [(1, "a b c d e f", None, None, None)] * 3 + [(None, "q r s t u v", None, None, None)] * 2)
    assert dartminhash.near_distinct(twins).count() == 2


@pytest.mark.parametrize("weigh", ["unit", "real"])
def test_signatures_estimate_weighted_similarity(weigh):
    r = np.random.default_rng(3)
    t = 512
    for _ in range(4):
        ids = np.sort(r.integers(1, 1 << 62, 120).astype(np.uint64))
        one = r.uniform(0.1, 9, 120) if weigh == "real" else np.ones(120)
        two = one * r.uniform(0.5, 1.6, 120) if weigh == "real" else one
        keep_one, keep_two = r.random(120) < 0.9, r.random(120) < 0.9
        a = dartminhash.dart_minhash(ids[keep_one], one[keep_one], np.zeros(keep_one.sum(), np.int64), 1, t)[0]
        b = dartminhash.dart_minhash(ids[keep_two], two[keep_two], np.zeros(keep_two.sum(), np.int64), 1, t)[0]
        x, y = one * keep_one, two * keep_two
        assert (a == b).mean() == pytest.approx(np.minimum(x, y).sum() / np.maximum(x, y).sum(), abs=0.09)


def test_short_documents_do_not_fill_memory():
    texts = [f"a{k} b c d e f{k}" for k in range(3000)]
    tracemalloc.start()
    many = dartminhash.bands_of(texts, 40, 6, 5, "set")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert many[::500] == [dartminhash.bands_of([t], 40, 6, 5, "set")[0] for t in texts[::500]]
    assert dartminhash.dart_minhash(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), 0, 8).shape == (0, 8)


def test_large_buckets_need_few_rounds(spark):
    # stars around 40 centres that all share bands: one leader at a time, or two, four, ... would go on for many rounds
    folders = []
    keep, dartminhash.scratch_path = dartminhash.scratch_path, lambda s, label: folders.append(path := keep(s, label)) or path
    try:
        base = prose(7, 60)
        rows = [(k, edited(base, k, 0.12)) for k in range(120)]
        out = {r["doc_id"]: r["class_id"] for r in dartminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        dartminhash.scratch_path = keep
    assert same_partition([out[d] for d, _ in rows], near_classes(rows))
    assert len(list(Path(folders[0].removeprefix("file:")).glob("stars*"))) <= 3


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(300) if i % 50] + [(1000, 1000 + k) for k in range(1, 80)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain(text):
    return " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def best_edits(window, text):
    row = np.zeros(len(text) + 1, dtype=np.int64)
    other, steps = np.array(list(text), dtype="U1"), np.arange(len(text) + 1)
    for i, c in enumerate(window, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (other != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def brute_leak(text, item):
    """Some window of the item lies within its budget of edits of a part of the text."""
    text, item = plain(text), plain(item)
    w = min(len(item), qgram.WINDOW)
    budget = max(min(w * qgram.EDITS // qgram.WINDOW, w // qgram.Q - 1), 0)
    if w < qgram.Q:
        return w > 0 and f" {item} " in f" {text} "
    return any(best_edits(item[j:j + w], text) <= budget for j in range(len(item) - w + 1))


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    items = [(k, prose(900 + k, 9 + k)) for k in range(6)] + [(50, "Short item, only!"), (51, "tiny"), (52, None), (None, "x" * 90), (53, "日本 語"), (54, "?!")]
    docs = []
    for k in range(40):
        item = list(r.choice(items[:7])[1])
        for _ in range(r.randint(0, 14)):
            p = r.randrange(len(item))
            item[p:p + 1] = r.choice([[], ["q"], [item[p], "z"], [item[p].upper()]])
        cut = r.choice([0, 0, 20, 40])
        docs.append((k, prose(k, r.randint(0, 12)) + " " + "".join(item)[cut:] + ", " + prose(70 + k, r.randint(0, 12))))
    docs += [(110, "a Tiny, one"), (111, "tinyness"), (112, "x" * 95), (113, "in 日本-語!"), (114, "日本語"), (115, "tiny tiny"), (100, None), (101, ""), (None, items[2][1]), (102, prose(3, 30)), (103, items[1][1]), (103, items[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = sorted(repr((d, i)) for d, t in docs for i, x in items if x is not None and brute_leak(t, x))
    for size in (10 ** 6, 100):
        got = qgram.leaks(frame, bench, block_chars=size)
        assert sorted(repr((x["doc_id"], x["item_id"])) for x in got.collect()) == want
    assert qgram.clean(frame, bench).count() == len([1 for d, t in docs if not any(x and brute_leak(t, x) for i, x in items)])


def test_leaks_of_given_documents(spark):
    docs, items = (table(spark, SF, n).collect() for n in ("documents", "benchmark"))
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if plain(i["text"]) in plain(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op4_qgram_lemma"](spark, SF).collect()}
    assert want and want <= got and all(brute_leak(next(d["text"] for d in docs if d["doc_id"] == a), next(i["text"] for i in items if i["item_id"] == b)) for a, b in got - want)


def test_leak_edges(spark):
    bench = table(spark, SF, "benchmark")
    assert qgram.leaks(edge(spark, []), bench).count() == 0 and qgram.leaks(edge(spark), bench).count() == 0
    assert qgram.leaks(edge(spark), bench.limit(0)).count() == 0 and qgram.clean(edge(spark), bench.limit(0)).count() == 14
    own = spark.createDataFrame([(1, LONG[5000:5100])], "item_id long, text string")
    assert [r["doc_id"] for r in qgram.leaks(edge(spark), own).collect()] == [6]
    cleaned = qgram.clean(edge(spark), own)
    assert cleaned.count() == 13 and cleaned.columns == edge(spark).columns and cleaned.where("_key <> 'x'").count() == 0
