"""Near-dedup with DartMinHash signatures over weighted shingle sets.

An element of weight x is a region of width x above the rank axis. Hashed darts
fall on the plane of every element at one per unit of area, the same darts for
every document. Those inside a document's regions and below a rank bound are
its darts; each belongs to one coordinate of the signature, and the earliest
per coordinate is kept. The bound is set from the total weight so that all
coordinates are hit by about t (ln t + 2) darts; documents that miss one are
thrown at again with twice the bound. Two documents agree in a coordinate with
the probability of their weighted Jaccard similarity.

Bands of coordinates are joined; candidates are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import scratch_path
from .batches import ODD, mix64, text_slices, within
from .components import connected
from .shingles import WORDS, shingle_sets

SIMILARITY = 0.8
BANDS, ROWS = 40, 6
#: Darts that a task has in memory at once, about; one document is taken whole.
DARTS = 400_000
#: Leaders of a bucket grow by this factor from round to round.
MORE_LEADERS = 16

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_UNIT = 2.0 ** -53


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * _UNIT


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """Signatures [document, coordinate]; a document without weight has EMPTY everywhere.

    ``elements`` are 64-bit hashes, ``weights`` positive, ``owner`` the document
    of each, ascending. Documents are taken in parts of about ``DARTS`` darts: a
    short document has as many darts as a long one, so bytes do not bound them.
    """
    enough = t * (math.log(t) + 2)
    # a cell at least per element and slab, a dart per cell
    slabs = 1 + np.ceil(np.log2(np.maximum(weights, 1.0)))
    load = np.cumsum(np.bincount(owner, slabs, minlength=n_docs) + enough)
    part = (load // DARTS).astype(np.int64)
    firsts = np.flatnonzero(np.diff(part, prepend=-1))
    out = np.empty((n_docs, t), dtype=np.uint64)
    for first, end in zip(firsts, np.append(firsts[1:], n_docs)):
        own = slice(*np.searchsorted(owner, [first, end]))
        out[first:end] = _signed(elements[own], weights[own], owner[own] - first, end - first, t, enough)
    return out


def _signed(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_docs: int, t: int, enough: float) -> np.ndarray:
    """Signatures of a part of the documents."""
    total = np.bincount(owner, weights, minlength=n_docs)
    bound = np.divide(enough, total, out=np.zeros(n_docs), where=total > 0)
    signature = np.full(n_docs * t, EMPTY, dtype=np.uint64)
    open_ = total > 0
    while open_.any():
        mine = open_[owner]
        _throw(elements[mine], weights[mine], owner[mine], bound, t, signature)
        open_ &= (signature.reshape(n_docs, t) == EMPTY).any(axis=1)
        bound = np.where(open_, 2 * bound, bound)
    return signature.reshape(n_docs, t)


def _throw(elements, weights, owner, bound, t, signature) -> None:
    """Throws all darts below each document's rank bound and keeps the earliest per coordinate.

    The width of an element is cut in slabs [0, 1), [1, 2), [2, 4), ...; a slab is
    stacked with cells of unit area, each with a Poisson number of darts.
    """
    slabs = 1 + np.ceil(np.log2(np.maximum(weights, 1.0))).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), slabs)
    slab = within(slabs)
    width = np.where(slab < 2, 1.0, 2.0 ** (slab - 1))
    low = np.where(slab < 1, 0.0, width)
    cells = np.ceil(bound[owner[at]] * width).astype(np.int64)
    cell_at = np.repeat(np.arange(len(at)), cells)
    cell = within(cells)
    seed = mix64(elements[at][cell_at] + ODD * (cell.astype(np.uint64) << np.uint64(8) | slab[cell_at].astype(np.uint64)))
    darts = np.searchsorted(_POISSON, _uniform(mix64(seed + ODD)), side="right")
    dart_at = np.repeat(np.arange(len(cell_at)), darts)
    seed = mix64(seed[dart_at] + ODD * (within(darts).astype(np.uint64) + np.uint64(2)))
    row = cell_at[dart_at]
    rank = (cell[dart_at] + _uniform(mix64(seed ^ np.uint64(0x5851F42D4C957F2D)))) / width[row]
    doc = owner[at[row]]
    inside = rank < bound[doc]
    # only a slab that the weight fills in part needs the place across
    part = np.flatnonzero(inside & (weights[at[row]] < low[row] + width[row]))
    across = low[row[part]] + width[row[part]] * _uniform(mix64(seed[part] ^ np.uint64(0x14057B7EF767814F)))
    inside[part] = across < weights[at[row[part]]]
    seed, doc, rank = seed[inside], doc[inside], rank[inside]
    packed = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | seed & np.uint64(0xFFFFFFFF)
    np.minimum.at(signature, doc * t + (seed >> np.uint64(40)).astype(np.int64) % t, packed)


def bands_of(texts: list[str], bands: int, rows: int, words: int, weigh: str) -> list[list[int]]:
    """Band hashes per text, none for a text without words."""
    value, count, owner = shingle_sets(texts, words)
    weight = count.astype(np.float64) if weigh == "count" else np.ones(len(value))
    signature = dart_minhash(value, weight, owner, len(texts), bands * rows).reshape(len(texts), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), signature.shape[:2]).copy()
    for k in range(rows):
        h = mix64(h * ODD + signature[:, :, k])
    full = np.zeros(len(texts), dtype=bool)
    full[owner] = True
    return [row if some else [] for row, some in zip(h.view(np.int64).tolist(), full.tolist(), strict=True)]


def text_key(text: Column) -> Column:
    """Key of a text: 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _banded(docs: DataFrame, bands: int, rows: int, words: int, weigh: str) -> DataFrame:
    """_key, doc_id, bands per row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch):
                own = pa.array(bands_of(texts, bands, rows, words, weigh), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), own],
                                                 names=["_key", "doc_id", "bands"])

    slim = docs.select(text_key(F.col("text")).alias("_key"), F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(sign, "_key binary, doc_id long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, weigh: str) -> DataFrame:
    """node, shingles (sorted hashes; with counts, one more entry per further occurrence) of the wanted texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch):
                value, count, owner = shingle_sets(texts, words)
                if weigh == "count":
                    owner, value, nth = np.repeat(owner, count), np.repeat(value, count), within(count).astype(np.uint64)
                    value = np.where(nth > 0, mix64(value + ODD * nth), value)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), sets], names=["node", "shingles"])

    # one row carries the text of each node: the one with its smallest id
    slim = docs.select(text_key(F.col("text")).alias("_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), "text")
    rows = slim.hint("merge").join(wanted, ["_key", "_id"]).select("node", "text")
    return rows.mapInArrow(make, "node long, shingles array<long>").dropDuplicates(["node"])


def _private(sets: DataFrame) -> DataFrame:
    """node, private: how many shingles of a node no other node of ``sets`` has (nodes without one are left out)."""
    owners = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    return owners.where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("private"))


def _bound(n_one: Column, open_one: Column, n_two: Column, open_two: Column) -> Column:
    """The most that two sets of n shingles, ``open`` of them not private, can be similar."""
    common = F.least(open_one, open_two)
    return common / (n_one + n_two - common)


def near_links(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS,
               weigh: str = "set") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, nodes, links, component) over the distinct texts of ``docs``.

    - texts: _key, node, doc_id (smallest), n_rows per distinct text.
    - nodes: _key, node for the texts that share a band with another.
    - links: a, b (nodes), similarity, all at least ``similarity``.
    - component: node, component (smallest node) of the nodes with a link.

    Not all pairs of a bucket are compared. A shingle that one node alone has can
    be common to no pair, so sizes and numbers of such private shingles bound
    every similarity from above; nodes that cannot reach ``similarity`` with any
    size present in their bucket leave it unseen. A bucket has a leader, the node
    that shares most bands with others. Members are compared with it; those that
    are not similar enough choose leaders among themselves, 16 times as many each
    time, until none are left. As distance is a metric, what this may miss is a
    link between a member that a leader holds and one it refused by no more than
    twice the distance; where those two lie in different components at the end,
    they are compared as well.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "near")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    signed = _banded(docs, bands, rows, words, weigh)
    texts = signed.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"), F.first("bands").alias("bands"))
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    # the number of its band is part of a band's hash
    banded = texts.select("node", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(banded.join(shared, "h"), "members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    nodes = stored(texts.join(degree, "node").select("_key", F.coalesce("doc_id", F.lit(-1)).alias("_id"), "degree", "node"), "nodes")
    sets = stored(_sets(docs, nodes.select("_key", "_id", "node"), words, weigh), "sets")
    sized = sets.select("node", F.size("shingles").alias("n")).join(_private(sets), "node", "left")
    sized = sized.select("node", "n", (F.col("n") - F.coalesce("private", F.lit(0))).alias("open"))
    # the largest set that this one can be near to
    sized = sized.withColumn("most", F.col("open") * (1 + 1 / similarity) - F.col("n") + 1e-6).where(F.col("open") >= similarity * F.col("n") - 1e-6)
    ranked = sized.join(nodes.select("node", "degree"), "node")

    def possible(left: DataFrame) -> DataFrame:
        """Members for whom sizes in their bucket leave a partner."""
        reach = left.groupBy("h").agg(F.min("n").alias("_n"), F.max("most").alias("_most"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
        return left.join(reach, "h").where("most >= _n AND n <= _most").select(left.columns)

    left = stored(possible(members.select("h", "node").join(ranked, "node").select("h", "node", "n", "open", "most", "degree")), "left0")

    tested, step = None, 0

    def compare(pairs: DataFrame, name: int) -> DataFrame:
        """a, b, similarity, common of pairs (a, b, both: sizes added, bound) not compared yet; a bound that is too low stands for the similarity, without common."""
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs, f"sized/step={name}")
        near = pairs.where(F.col("bound") >= similarity)
        # of the sets only those that this round needs are moved
        here = sets.join(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "node", "left_semi")
        sa, sb = (here.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
        common = F.size(F.array_intersect("s_a", "s_b"))
        exact = near.join(sa, "a").join(sb, "b").select("a", "b", (common / (F.col("both") - common)).alias("similarity"), common.alias("common"))
        far = pairs.where(F.col("bound") < similarity).select("a", "b", F.col("bound").alias("similarity"), F.lit(None).cast("int"))
        return stored(exact.union(far), f"pairs/step={name}")

    def paired(df: DataFrame, x: str, y: str) -> DataFrame:
        """a, b, both, bound of the rows that hold n_x, open_x, n_y, open_y."""
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (F.col(f"n_{x}") + F.col(f"n_{y}")).alias("both"),
                         _bound(*(F.col(f"{v}_{w}") for w in (x, y) for v in ("n", "open"))).alias("bound")).distinct()

    def all_steps(name: str) -> DataFrame:
        """The rows of every step so far, as one folder."""
        return spark.read.parquet(f"{folder}/{name}").drop("step")

    while not left.isEmpty():
        best = Window.partitionBy("h").orderBy(F.desc("degree"), "node")
        leaders = left.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= MORE_LEADERS ** step)
        leaders = leaders.select("h", F.col("node").alias("leader"), F.col("n").alias("n_leader"), F.col("open").alias("open_leader"))
        stars = left.withColumnRenamed("n", "n_node").withColumnRenamed("open", "open_node").join(leaders, "h").where("node <> leader")
        stars = stored(stars, f"stars{step}")
        compare(paired(stars, "node", "leader"), step)
        tested = all_steps("pairs")
        ends = stars.withColumn("a", F.least("node", "leader")).withColumn("b", F.greatest("node", "leader"))
        judged = ends.join(tested, ["a", "b"]).select("h", "leader", "node", F.col("n_node").alias("n"), F.col("open_node").alias("open"), "most", "degree", "similarity", "common")
        judged = stored(judged, f"judged/step={step}")
        rest = judged.groupBy("h", "node", "n", "open", "most", "degree").agg(F.max("similarity").alias("best")).where(F.col("best") < similarity)
        rest = rest.join(judged.select("h", F.col("leader").alias("node")).distinct(), ["h", "node"], "left_anti")
        left = stored(possible(rest.select("h", "node", "n", "open", "most", "degree")), f"left{step + 1}")
        step += 1

    empty = spark.createDataFrame([], "a long, b long, similarity double")
    if tested is None:
        return texts, nodes, empty, connected(empty)
    links = tested.where(F.col("similarity") >= similarity)
    refused = stored(all_steps("judged").where(F.col("similarity") > 2 * similarity - 1).groupBy("leader", "node", "n", "open", "most").agg(
        F.max("similarity").alias("similarity"), F.max("common").alias("common")), "refused")
    component = connected(links.select("a", "b"))
    while True:
        # what a leader holds against what it refused by little, across components
        placed = refused.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = stored(placed, f"placed{step}")
        split = placed.groupBy("leader").agg(
            F.min("component").alias("_1"), F.max("component").alias("_2"), F.min(F.when(F.col("similarity") >= similarity, F.col("n"))).alias("_n"),
            F.max(F.when(F.col("similarity") >= similarity, F.col("most"))).alias("_most")).where("_1 <> _2")
        placed = placed.join(split, "leader")
        held, other = (placed.where(rule).select("leader", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "open", "similarity", "common", "component")))
                       for x, rule in (("x", F.col("similarity") >= similarity), ("y", (F.col("similarity") < similarity) & F.expr("most >= _n AND n <= _most"))))
        # two sets have in common what both share with the leader, at most, and of the rest what is not private
        beside = F.least("common_x", "common_y") + F.least(F.expr("open_x - common_x"), F.expr("open_y - common_y"))
        most_common = F.least("open_x", "open_y", beside)
        both = held.join(other, "leader").where(
            (F.col("component_x") != F.col("component_y")) & (F.col("similarity_x") - F.col("similarity_y") <= 1 - similarity)
            & (most_common / (F.col("n_x") + F.col("n_y") - most_common) >= similarity))
        found = compare(paired(both, "x", "y"), step)
        step += 1
        tested = all_steps("pairs")
        more = found.where(F.col("similarity") >= similarity)
        if more.isEmpty():
            return texts, nodes, tested.where(F.col("similarity") >= similarity), component
        # components so far are as good as the links they were made of
        component = connected(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))


def near_classes(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. Texts are near
    when the sets of their five-word shingles (lower-cased words between ASCII
    white space) have a Jaccard similarity of at least 0.8; with ``weigh="count"``
    shingles count as often as they occur. Classes are connected components over
    such links. ``class_id`` is the smallest doc_id of the class, and the row that
    holds it is kept.

    - Equal texts are one class, also null and empty texts (null counts as empty)
      and texts of fewer than five words, which are one shingle of all words.
    - A class of null ids has class_id null; of rows that share the smallest id
      (or of null ids only) one is kept.
    - An empty table gives an empty result.
    """
    return _classes(docs, **kw).drop("_key")


def _classes(docs: DataFrame, **kw) -> DataFrame:
    """The rows of near_classes with the key of their text."""
    texts, nodes, _, component = near_links(docs, **kw)
    component = component.join(nodes.select("_key", "node"), "node").select("_key", "component")
    own = texts.select("_key", "doc_id", "n_rows").join(component, "_key", "left")
    whole = own.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("_id"), F.sum("n_rows").alias("_n"))
    classes = own.join(whole, "component", "left").select(
        "_key", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("_id")).alias("class_id"),
        F.coalesce("_n", "n_rows").alias("class_size"), F.col("component").alias("_component"))
    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("_key")).join(classes, "_key")
    # only rows with the id of their class compete; they are few per class unless ids repeat
    same = F.col("doc_id").eqNullSafe(F.col("class_id"))
    pick = Window.partitionBy("_first", "_class", "doc_id").orderBy("_key")
    rows = rows.withColumn("_first", same).withColumn("_class", F.when(same, F.coalesce(F.col("_component").cast("string"), F.hex("_key"))))
    firsts = rows.where("_first").withColumn("kept", F.row_number().over(pick) == 1)
    rest = rows.where("NOT _first").withColumn("kept", F.lit(False))
    return firsts.unionByName(rest).select("doc_id", "class_id", "class_size", "kept", "_key")


def near_distinct(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_classes`` keeps: one of each class."""
    kept = _classes(docs, **kw).where("kept").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_kept")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_all"), text_key(F.col("text")).alias("_key"), F.col("doc_id").cast("long").alias("_own"))
    rows = rows.join(kept, rows["_own"].eqNullSafe(kept["_id"]) & (rows["_key"] == kept["_kept"]), "left_semi")
    # rows that repeat both id and text
    twin = Window.partitionBy("_own", "_key").orderBy(F.lit(0))
    return rows.withColumn("_n", F.row_number().over(twin)).where("_n = 1").select("_all.*")
