"""Small tables and brute-force versions for the tests of the training-data operators."""

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(c, T.StringType()) for c in ("_key", "_row", "_all", "score", "kept", "node", "size", "n", "band", "held_out")],
])

WORDS = ["alpha", "river", "stone", "Green", "quiet", "market", "Élan", "über", "seven", "lantern", "paper", "cloud", "orbit", "maple", "salt"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


LONG = prose(99, 40_000)
#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text.
ROWS = [
    (1, "same text here", "en", "b", 14), (2, "Same text HERE", "en", None, 14), (2, "Same text HERE", "en", None, 14), (3, None, None, "a", None),
    (4, "", "en", "a", 0), (5, " \t\n ", "de", "a", 4), (None, "same text here", None, "c", 14), (None, None, None, None, None),
    (6, LONG, "en", "a", len(LONG)), (7, "Ünïcödé 日本語 text 🙂\nsecond line\n", "fr", "c", 30), (8, "!!! ??? 123", "en", "b", 11),
    (9, prose(1, 60), "en", "b", 1), (10, prose(1, 60), "en", "c", 1), (11, prose(2, 60), None, "c", 1),
]


def edge(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], SCHEMA)


def multiset(df, *cols):
    return sorted(tuple(repr(r[c]) for c in cols) for r in df.select(*cols).collect())


def shingles(text, k=5):
    w = [x for x in (text or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_classes(rows, similarity=0.8):
    """Class of each row number, by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (union and len(sets[i] & sets[j]) / union >= similarity):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]
