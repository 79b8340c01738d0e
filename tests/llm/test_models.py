import math
import zlib

import numpy as np
import pytest
from llm.helpers import LONG, edge, prose
from pyspark.sql import functions as F
from waymark.llm import langid, pseudolm, queries, toxicity
from waymark.llm.batches import held_out, table

SF01 = "/root/testdata/sf0.01"


def test_held_out_is_crc32(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF01, "documents")
    got = queries.QUERIES["op1_language_id"](spark, SF01).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() > 0


def test_language_scores_against_plain_naive_bayes(spark):
    train = [("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"), ("der hund ist im haus", "de"), ("the dog is in the house", "en")]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    text = "the hund sur mat 12 the"
    counts = {lang: np.zeros(1 << model.bits) for lang in model.langs}
    for t, lang in train:
        for order in model.orders:
            np.add.at(counts[lang], langid.grams(*langid.letters([t]), order, model.bits)[0], 1)
    logs = []
    for lang in model.langs:
        p = np.log(counts[lang] + langid.SMOOTHING) - np.log(counts[lang].sum() + langid.SMOOTHING * len(counts[lang]))
        found = sum(p[langid.grams(*langid.letters([text]), o, model.bits)[0]].sum() for o in model.orders)
        logs.append(found + math.log(sum(x == lang for _, x in train) / len(train)))
    want = np.exp(np.array(logs) - max(logs))
    langs, score = model.score(["", text, "x"])
    assert langs[1] == model.langs[int(np.argmax(logs))] and score[1] == pytest.approx(want.max() / want.sum(), rel=1e-4)


def test_language_edges(spark):
    docs = edge(spark)
    model = langid.fit(docs)
    out = {r["doc_id"]: r for r in langid.identify(docs, model).where("doc_id IS NOT NULL").collect()}
    assert langid.identify(docs, model).count() == 14
    for i in (3, 4, 5, 8):  # no letters
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert out[6]["lang_pred"] == "en" and 0 < out[6]["score"] <= 1
    nothing = langid.fit(edge(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(edge(spark, []), model).count() == 0


def test_toxicity_held_out(spark):
    labels = table(spark, SF01, "labels")
    got = queries.QUERIES["op6_toxicity"](spark, SF01)
    assert got.count() == 1000 and got.where("score < 0 OR score > 1").count() == 0
    known = got.join(labels, "doc_id").where("held_out")
    assert known.where("toxic = 0 AND predicted = 1").count() == 0
    assert known.where("toxic = 1 AND predicted = 1").count() >= 0.55 * known.where("toxic = 1").count()
    docs = table(spark, SF01, "documents")
    insult = docs.where(F.lower("text").rlike("idiot|moron|scum") & F.lower("text").rlike("clown|trash|loser|pathetic|stupid")).select("doc_id")
    caught = got.join(insult, "doc_id")
    assert caught.where("predicted = 1").count() >= 0.9 * caught.count() > 0


def test_toxicity_finds_planted_words(spark):
    rows = [(i, prose(i, 40) + (" you vile grubworm" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in out)
    assert toxicity.keep_clean(docs, model).count() == 300 and toxicity.keep_clean(docs, model).columns == docs.columns


def test_toxicity_edges(spark):
    docs = edge(spark)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, none).collect())
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (9, 0), (11, 0), (6, 0)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert out[3] == out[4] == out[5] and all(0 <= s <= 1 for s in out.values())
    assert toxicity.score(edge(spark, []), model).count() == 0


def test_pseudo_likelihood_against_one_by_one(spark):
    docs = spark.createDataFrame([(i, prose(i, 200)) for i in range(8)], "doc_id long, text string")
    tokens, network = pseudolm.fit(docs, rounds=2, steps=60, parts=4)
    texts = [prose(50, 30), "a", "", "Zz 99\n"]
    _, total = pseudolm.Scorer(tokens, network).score(texts)
    for text, got in zip(texts, total.tolist(), strict=True):
        codes = pseudolm.characters([text])[0]
        ids = [0, 0, *[int(tokens[min(int(c), len(tokens) - 1)]) for c in codes], 0, 0]
        want = 0.0
        for k in range(2, len(ids) - 2):
            near = np.array([[ids[k - 2], ids[k - 1], ids[k + 1], ids[k + 2]]])
            logs = network.forward(near)[1][0]
            assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
            want += float(logs[ids[k]])
        assert got == pytest.approx(want, rel=1e-4, abs=1e-6)
    prose_mean = pseudolm.Scorer(tokens, network).score([prose(70, 50)])[1][0] / len(prose(70, 50))
    junk = "".join(np.random.default_rng(1).permutation(list(prose(70, 50))))
    assert prose_mean > pseudolm.Scorer(tokens, network).score([junk])[1][0] / len(junk) + 0.5


def test_window_counts_cover_every_character(spark):
    docs = edge(spark)
    tokens = pseudolm.vocabulary(docs)
    total = pseudolm.window_counts(docs, tokens).agg(F.sum("n")).first()[0]
    assert total == sum(len((r["text"] or "").lower()) for r in docs.collect())


def test_pseudo_likelihood_edges(spark):
    docs = edge(spark)
    fitted = pseudolm.fit(docs, rounds=1, steps=5, parts=2)
    out = {r["doc_id"]: r for r in pseudolm.score(docs, *fitted).collect()}
    assert (out[3]["n_tokens"], out[3]["log_prob"], out[3]["mean_log_prob"]) == (0, 0.0, None)
    assert out[6]["n_tokens"] == len(LONG) and out[6]["mean_log_prob"] < 0
    again = {r["doc_id"]: r for r in pseudolm.score(docs, *pseudolm.fit(docs, rounds=1, steps=5, parts=2)).collect()}
    assert out[7] == again[7]
    empty = pseudolm.fit(edge(spark, []), rounds=1)
    assert pseudolm.score(edge(spark, []), *empty).count() == 0 and pseudolm.score(docs, *empty).count() == 14


def test_every_character_counts_in_the_pseudo_likelihood(spark):
    r = np.random.default_rng(5)
    signs = "".join(chr(0x4E00 + i) for i in range(600))
    texts = [prose(i, 100) + " fjord quiz 57 Ж" for i in range(6)] + ["".join(r.choice(list(signs[:40]), 60)) + signs for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = pseudolm.vocabulary(docs)
    known = {c for t in texts for c in t.lower()}
    assert len({int(tokens[ord(c)]) for c in known}) == len(known) and pseudolm.OTHER not in tokens[[ord(c) for c in known]]
    counted = pseudolm.window_counts(docs, tokens, 3)
    assert counted.columns == ["k0", "k1", "n"]  # more than 63 bits
    want = {}
    for t in texts:
        padded = "\0" * 3 + t.lower() + "\0" * 3
        for i in range(len(t)):
            want[padded[i:i + 7]] = want.get(padded[i:i + 7], 0) + 1
    rows = counted.toPandas()
    near = pseudolm.unpack([rows["k0"].to_numpy(), rows["k1"].to_numpy()], int(tokens.max()) + 1, 3)
    back = {int(tokens[ord(c)]): c for c in known} | {0: "\0"}
    assert {"".join(back[int(x)] for x in w): int(n) for w, n in zip(near, rows["n"], strict=True)} == want
    scorer = pseudolm.Scorer(*pseudolm.fit(docs, rounds=1, steps=20, parts=2, side=3))
    swapped = ["a fjord quiz", "a qjord fuiz", "57", "75", "line\nbreak", "line break", signs[:30], "".join(r.permutation(list(signs[:30]))), "ajbcd", "aqbcd"]
    _, total = scorer.score(swapped)
    assert all(a != pytest.approx(b, abs=1e-4) for a, b in zip(total[::2], total[1::2], strict=True))
    assert scorer.score(swapped)[1].tolist() == total.tolist()


def test_toxicity_features_are_not_halved():
    assert toxicity.FEATURES == 4_096


def test_toxicity_against_plain_fit(spark):
    """Ratios, coefficients and scores of 40 rows, made one n-gram at a time and fitted by Newton steps."""
    rows = [(i, prose(i, 6) + (f" you vile {'grubworm' if i % 8 else 'toad'}" if i % 4 == 0 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, features=100_000)
    y = np.array([float(i % 4 == 0) for i in range(40)])
    held = [set() for _ in rows]
    for i, (_, text) in enumerate(rows):
        for order in toxicity.ORDERS:
            held[i].update(langid.grams(*langid.letters([text]), order, toxicity.BUCKET_BITS)[0].tolist())
    kept = sorted(set().union(*held))
    p, q = ({b: sum(b in h for h, t in zip(held, y) if t == label) for b in kept} for label in (1, 0))
    ratio = np.array([math.log(((p[b] + 1) / 12) / ((q[b] + 1) / 32)) for b in kept])
    x = np.array([[float(b in h) for b in kept] for h in held]) * ratio

    def fitted(rows, ridge):
        u, size, v = np.linalg.svd(x[rows], full_matrices=False)
        a, t = np.column_stack([np.ones(len(rows)), u * size]), y[rows]
        share, keep = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum()))), np.r_[0, np.full(len(size), ridge)]

        def cost(w):
            return float((np.logaddexp(0, np.where(t == 1, -1, 1) * (a @ w)) * share).sum() + (keep * w * w).sum() / 2)

        w = np.zeros(a.shape[1])
        for _ in range(60):
            s = 1 / (1 + np.exp(-a @ w))
            step = np.linalg.solve(a.T @ (a * (share * s * (1 - s))[:, None]) + np.diag(keep + 1e-12), a.T @ (share * (s - t)) + keep * w)
            while cost(w - step) > cost(w) + 1e-12:
                step = step / 2
            w = w - step
        return np.r_[w[0], v.T @ w[1:]]

    def loss(rows, w):
        t = y[rows]
        z = np.where(t == 1, 1, -1) * (x[rows] @ w[1:] + w[0])
        share = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
        return float((np.log1p(np.exp(-z)) * share).mean())

    size = (len(kept) + 7) // 8 * 8
    bits = [np.packbits([int(b in h) for b in kept] + [0] * (size - len(kept))).tobytes() for h in held]
    order = np.array(sorted(range(40), key=lambda i: (y[i], bits[i])))
    test = np.arange(40) % 4 == 0
    ridge = min(toxicity.RIDGES, key=lambda r: loss(order[test], fitted(order[~test], r)))
    w = fitted(order, ridge)
    assert model.bias == pytest.approx(w[0], abs=2e-2 * abs(w[0]))
    assert model.weights[kept] == pytest.approx(w[1:] * ratio, abs=2e-3) and not np.delete(model.weights, kept).any()
    want = 1 / (1 + np.exp(-(x @ w[1:] + w[0])))
    assert model.score([t for _, t in rows]) == pytest.approx(want, abs=5e-3)
