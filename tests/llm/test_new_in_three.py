import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from llm.helpers import LONG, edge, prose
from pyspark.sql import functions as F
from waymark.llm import licenses, queries, spelling, whitening
from waymark.llm.batches import table

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# spelling variants

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain_words(rows, slip):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] = n.get(run, 0) + 1
    return n


def plain_variants(counts, times=5):
    words = list(counts)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in words}


def variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_query_against_plain(spark):
    docs = table(spark, SF, "documents")
    counts = plain_words([(r["doc_id"], r["text"]) for r in docs.collect()], 199)
    want = plain_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert variants(queries.QUERIES["op11_spelling_variants"](spark, SF)) == want and any(v[0] for v in want.values())


def test_near_words_lose_no_pair(spark):
    r = random.Random(7)
    made = set()
    for letters in ("ab", "abcdé", "aÿß"):
        while len(made) < 260 * len(letters):
            w = [r.choice(letters) for _ in range(r.randint(6, 11))]
            made.add("".join(w))
            for _ in range(3):  # its neighbours, and theirs
                k, kind = r.randrange(len(w)), r.randrange(3)
                w[k:k + (kind > 0)] = [r.choice(letters)] if kind < 2 else []
                if len(w) >= 6:
                    made.add("".join(w))
    words = sorted(made)
    got = {(x["word"], x["near"]) for x in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert got == want and len(want) > 1_000


def test_pivots_are_disjoint_and_least():
    r = random.Random(3)
    for _ in range(300):
        grams = [(r.randrange(50), p) for p in sorted(r.sample(range(12), r.randint(3, 6)))]
        got = spelling.pivots(grams)
        pairs = [(a[0] + b[0]) for a in grams for b in grams if b[1] - a[1] >= 2]
        assert len(got) == 2 and got[1][1] - got[0][1] >= 2 and sum(g[0] for g in got) == min(pairs)


def test_forms_form_chains_and_break_ties_by_code_point(spark):
    n = {"aaaaaa": 10_000, "aaaaab": 1_000, "aaaabb": 100, "aaabbb": 10, "aabbbb": 1, "zzzzzz": 50, "zzzzzé": 50, "zzzzzx": 5, "alone_": 7}
    got = variants(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == plain_variants(n)
    assert got["aabbbb"][:2] == ("aaabbb", "aaaaaa") and got["zzzzzx"][0] == "zzzzzz" and got["alone_"] == (None, "alone_", 7, 0, None)


def test_spelling_edges(spark):
    docs = edge(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {w: n for w, n in plain_words(rows, 3).items() if len(w) >= 6 and n >= 2}
    got = variants(spelling.spelling_variants(docs, min_count=2, slip=3))
    assert got == plain_variants(want) and "lantern" in got and any(n == 6 for n in map(len, got))
    assert spelling.spelling_variants(edge(spark, [])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, min_length=5)


def test_spelling_of_one_frequent_gram(spark):
    """Every word holds the same grams: no group may grow with the square of the words."""
    r = random.Random(1)
    words = sorted({"thth" + "".join(r.choice("thabcdef") for _ in range(8)) for _ in range(2_000)})
    got = {(x["word"], x["near"]) for x in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


# license notices

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def plain_labels(text, notices):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    found, base = set(), []
    for n in notices:
        size = n.words.count(" ") + 1
        for i in range(len(words)):
            if n.base and words[i:i + size] == n.words.split(" "):
                base.append((i, n.label))
            for j in range(i + 1, len(words) + 1):
                part = " ".join(words[i:j])
                if len(part) > len(n.words) + n.edits:
                    break
                if len(part) >= len(n.words) - n.edits and edit_distance(part, n.words) <= n.edits:
                    found.add(n.label)
    return len(words), base, found


def worn(r, text, edits):
    text = list(text)
    for _ in range(edits):
        k, kind = r.randrange(len(text)), r.randrange(3)
        text[k:k + (kind > 0)] = [r.choice("aeé x")] if kind < 2 else []
    return "".join(text)


def test_notices_against_all_stretches_of_words(spark):
    r = random.Random(11)
    texts = [None, "", " -- ", "MIT License", "mit-license mit license!", "smit license", "mit licenses", "mit  lic ense", "IT LICENSE", "Élan MIT\nLicense"]
    for k in range(120):
        notice = r.choice(licenses.NOTICES)
        texts.append(f"{prose(k, 3)} {worn(r, notice.words.title(), r.randint(0, notice.edits + 3))} {prose(k + 1, 2)} {worn(r, notice.words, r.randint(0, 2))}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in licenses.find_notices(docs).collect()}
    seen = 0
    for i, text in enumerate(texts):
        n, base, labels = plain_labels(text, licenses.NOTICES)
        spans = got[i]["spans"]
        exact = [(s["first_word"], s["label"]) for s in spans if s["edits"] == 0 and licenses.NOTICES[s["notice"]].base]
        assert (got[i]["n_words"], sorted(exact), {s["label"] for s in spans}) == (n, sorted(base), labels), text
        for s in spans:
            stretch = licenses.spaced_words(text[s["start"]:s["end"]])[0][1:]
            assert edit_distance(stretch, licenses.NOTICES[s["notice"]].words) <= s["edits"] and stretch.count(" ") == s["last_word"] - s["first_word"]
            seen += s["edits"] > 0
    assert seen > 50


def test_notice_query_against_sql(spark):
    base = duckdb.sql(rf"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM '/root/testdata/sf0.01/documents.parquet'),
        p AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM t),
        b AS (SELECT doc_id, i, CASE WHEN w[i+1:i+2] = ['mit', 'license'] THEN 'mit' WHEN w[i+1:i+2] = ['apache', 'license'] THEN 'apache'
          WHEN w[i+1:i+3] = ['general', 'public', 'license'] THEN 'gpl' END AS label FROM p)
        SELECT t.doc_id, len(w), count(label), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM t LEFT JOIN (FROM b WHERE label IS NOT NULL) b USING (doc_id) GROUP BY ALL
    """).fetchall()
    got = queries.QUERIES["op12_license_notices"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == sorted(base)
    assert all(0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"]) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert sum(r["n_base"] for r in got) > 0


def test_notice_edges(spark):
    out = licenses.find_notices(edge(spark))
    assert out.count() == 14 and out.where("n_words > 0 AND size(spans) > 0").count() == 0
    assert {r["n_words"] for r in out.where("doc_id IN (3, 4, 5)").collect()} == {0}
    assert licenses.find_notices(edge(spark, [])).count() == 0
    assert licenses.find_notices(edge(spark), ()).count() == 14
    long = edge(spark, [(1, LONG + " the MIT Licens " + "license " * 3_000, None, None, None)])
    row = licenses.find_notices(long).first()
    assert [s["edits"] for s in row["spans"]] == [1] and row["n_words"] == 40_000 + 3 + 3_000
    with pytest.raises(ValueError):
        licenses.Scanner((licenses.Notice("x", "Upper", 1),))


# whitening

def plain_whitening(vectors, take=4):
    x = np.array([[math.floor(256 * float(np.float64(c))) for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1][:take], columns[:, ::-1][:, :take]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, deviation, values / np.trace(cov), (x - s / n) @ columns / np.sqrt(values)


def test_whitening_query_against_numpy(spark):
    rows = table(spark, SF, "embeddings").collect()
    n, deviation, share, want = plain_whitening([r["embedding"] for r in rows])
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = queries.QUERIES["op13_whitened_embeddings"](spark, SF).collect()
    assert len(got) == 4 * len(rows)
    y = np.zeros_like(want)
    for r in got:
        i, k = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i] and r["explained"] == pytest.approx(share[k], rel=1e-9) and r["identity_error"] < 1e-9
        y[i, k] = r["whitened"]
    assert np.abs(y * np.sign((y * want).sum(axis=0)) - want).max() < 1e-7


def test_eigenvectors_of_hard_matrices():
    r = np.random.default_rng(3)
    made = [np.eye(6), np.zeros((4, 4)), np.diag([5.0, 5, 5, 1, 1, 0]), np.ones((5, 5)), np.kron(np.eye(3), np.ones((3, 3))), np.diag([1.0, 1 + 1e-15, 1 - 1e-15, 1e-300])]
    for n in (1, 2, 3, 17, 80):
        a = r.standard_normal((n, n))
        made.append(a @ a.T)
    q = np.linalg.qr(r.standard_normal((30, 30)))[0]
    made.append((q * np.r_[3, 3 + 1e-13, 3 - 1e-13, 3 - 1e-9, np.linspace(2, 0, 26)]) @ q.T)
    for a in made:
        a = (a + a.T) / 2
        values, vectors = whitening.leading(a, 4)
        want = np.linalg.eigvalsh(a)[::-1][:4]
        scale = max(want[0], 1e-300)
        assert np.abs(values - want[:len(values)]).max(initial=0) <= 1e-13 * scale and (want[len(values):] <= 1e-12 * scale).all()
        assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-13 * scale * len(a)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) <= 1e-13 * len(a)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(2)
    good = [(i, [float(c) for c in r.standard_normal(3) * [1, 5, 300]]) for i in range(20)]
    rows = [*good, (None, good[0][1]), (3, good[3][1]), *[(90 + i, good[5][1]) for i in range(30)], (40, None), (41, [1.0, None, 2.0]), (42, [nan, 1.0, 1.0]),
            (43, [inf, 1.0, 1.0]), (44, [1.0, 2.0]), (45, []), (46, [1e300, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, i int, packed string, dims string, id string"
    vectors = spark.createDataFrame([(*x, 1, "x", "y", "z") for x in rows], schema)
    model, fitted = whitening.fit(vectors)
    n, deviation, share, want = plain_whitening([v for _, v in rows[:52]], 3)
    assert model.n == n == 20 and whitening.identity_error(fitted, model) < 1e-9
    out = whitening.whiten(vectors, model).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"], r["deviation"]) for r in out) == sorted((i is None, i, d) for (i, _), d in zip(rows, deviation))
    assert all(len(r["whitened"]) == 3 for r in out)
    for few in ([], [good[0]], [good[0]] * 5, [(1, None)]):
        model, fitted = whitening.fit(spark.createDataFrame([(*x, 1, "x", "y", "z") for x in few], schema))
        assert len(model.values) == 0 and whitening.identity_error(fitted, model) == 0
        assert whitening.whiten(vectors, model).count() == (0 if not model.n else 52)


def test_deviation_is_exact_or_null():
    model = whitening.Model(3, [10, -(1 << 40)], np.ones(1), np.array([[1.0], [0.0]]), 1.0)
    x = np.array([[5, 7], [1 << 30, -(1 << 29)], [1 << 61, 0], [4, -(1 << 30)]])
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, model.sums)) for r in x]
    assert model.deviation(x) == [w if w < 1 << 63 else None for w in want] and None in model.deviation(x)
