"""Approximate nearest neighbours: a forest of random-projection trees, searched
through one priority queue over all trees, then exact reranking of the leaves found.

A node of a tree splits by the projection on the difference of two random rows,
at the median. The queue holds nodes of all trees; a node's priority is the sum of
the squared margins by which the query misses the halves on its path. A search
takes the nearest node first and ends at the first one beyond the radius ``reach``,
or later if no tree has given ``k`` rows besides the query yet.

Fit: the trees split a sample of at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES``
bytes, drawn by a hash of the id. ``reach`` is calibrated: at most ``CALIBRATION``
queries are compared with ALL rows by brute force, and ``reach`` is the priority at
which the share ``RECALL`` of their true neighbours is met (``recall`` measures it
on all queries). Everything else covers all rows: every row is dealt to its leaf of
every tree, every query to the leaves it reaches. A (leaf, block of rows, block of
queries) is one group of bounded size, streamed by a task, which keeps k rows a query.

Scale: the rows are shuffled once per tree, the queries once per leaf they reach
and block of its rows. Leaves grow with the rows as the sample is bounded, and are cut
into blocks. What reaches the driver is bounded: the sample, the calibration queries
with k rows each and the counts per leaf. Of equal vectors at most k + 1 rows with the
smallest ids can be an answer, so copies beyond them are left out first.

Defined cases: vectors that are NULL, empty, zero or hold NULL, NaN or infinite
components take no part, nor do rows without an id, nor vectors of another length
than the commonest (ties: the longest). Rows equal in id and vector are one row; rows equal
in id alone are rows of their own, each a query. Ties of the distance go to the
smaller id. Fewer candidates than k give all. Extra columns are ignored, whatever
their names. An empty table gives no row."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import cut

K = 10
TREES = 4
LEAF_ROWS = 64
SAMPLE_ROWS = 1 << 16
SAMPLE_BYTES = 32 << 20
CALIBRATION = 256
RECALL = 0.98
#: Rows and queries of a group.
BLOCK_ROWS = 1 << 16
BLOCK_QUERIES = 1 << 11
#: Results a task holds before it hands them on.
HELD = 1 << 18
SEED = 11


class Tree:
    """Nodes in arrays: ``normal``, ``offset`` of the split, ``child`` (left, right), or -1 for
    a leaf, whose number is ``leaf``."""

    def __init__(self, sample: np.ndarray, rng: np.random.Generator) -> None:
        self.normal, self.offset, self.child, self.leaf = [], [], [], []
        leaves, work = 0, [(self._add(), np.arange(len(sample)))]
        while work:
            at, rows = work.pop()
            split = self._split(sample, rows, rng) if len(rows) > LEAF_ROWS else None
            if split is None:
                self.leaf[at], leaves = leaves, leaves + 1
                continue
            self.normal[at], self.offset[at], left = split
            self.child[at] = (self._add(), self._add())
            work += [(self.child[at][0], rows[left]), (self.child[at][1], rows[~left])]
        self.leaves = leaves
        dim = sample.shape[1] if sample.ndim == 2 else 0
        self.normal = np.array([np.zeros(dim) if n is None else n for n in self.normal]).reshape(len(self.leaf), dim)
        self.offset = np.array(self.offset)

    def _add(self) -> int:
        for column, value in ((self.normal, None), (self.offset, 0.0), (self.child, (-1, -1)), (self.leaf, -1)):
            column.append(value)
        return len(self.leaf) - 1

    @staticmethod
    def _split(sample: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple | None:
        for _ in range(8):  # rows may be equal
            a, b = rng.choice(rows, 2, replace=False)
            normal = sample[a] - sample[b]
            length = np.linalg.norm(normal)
            if not length > 0 or not np.isfinite(length):
                continue
            normal = normal / length
            at = sample[rows] @ normal
            offset = float(np.median(at))
            left = at <= offset
            if 0 < left.sum() < len(rows):
                return normal, offset, left
        return None

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.normal.T - self.offset

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each vector falls into."""
        out, work = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
        while work:
            node, rows = work.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            right = vectors[rows] @ self.normal[node] - self.offset[node] > 0
            work += [(c, r) for c, r in zip(self.child[node], (rows[~right], rows[right])) if len(r)]
        return out

    def priorities(self, margins: np.ndarray) -> np.ndarray:
        """Per leaf, the priority with which a query of these margins meets it."""
        out, work = np.zeros(self.leaves), [(0, 0.0)]
        while work:
            node, p = work.pop()
            if self.leaf[node] >= 0:
                out[self.leaf[node]] = p
                continue
            m = float(margins[node])
            left, right = self.child[node]
            work += [(left, p + max(m, 0.0) ** 2), (right, p + max(-m, 0.0) ** 2)]
        return out


def search(trees: list[Tree], counts: list[np.ndarray], margins: list[np.ndarray], reach: float, k: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one priority queue over all trees: those within
    ``reach``, and more while no tree alone has given k + 1 rows."""
    queue = [(0.0, t, 0) for t in range(len(trees))]
    heapq.heapify(queue)
    got, found = [0] * len(trees), []
    while queue:
        p, t, node = heapq.heappop(queue)
        if p > reach and max(got) > k:
            break
        tree = trees[t]
        if tree.leaf[node] >= 0:
            leaf = tree.leaf[node]
            if counts[t][leaf]:
                found.append((t, leaf))
                got[t] += int(counts[t][leaf])
            continue
        m = float(margins[t][node])
        left, right = tree.child[node]
        heapq.heappush(queue, (p + max(m, 0.0) ** 2, t, left))
        heapq.heappush(queue, (p + max(-m, 0.0) ** 2, t, right))
    return found


# --- the Spark job

def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """((id, h, v) of the rows that take part; the dimension)."""
    v = F.col(vector)
    size = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    good = (F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
            & (size > 0) & (size < F.lit(float("inf"))))
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(key).alias("id"), v.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return rows, 0
    return rows.filter(F.size("v") == lengths["n"]).select("id", F.xxhash64("v").alias("h"), "v"), lengths["n"]


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` without repeated ones, and without the copies of a vector that k + 1 smaller ids hold."""
    same = Window.partitionBy("h", "v").orderBy("id")
    return rows.withColumn("r", F.dense_rank().over(same)).filter(F.col("r") <= k + 1).dropDuplicates(["id", "h", "v"]).drop("r")


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows - q).sum(axis=1))


class _Best:
    """The k nearest rows per query so far: an approximate comparison of a whole
    batch, whose error is allowed for, then exact distances of what may enter."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, {}

    def add(self, keys: list, queries: np.ndarray, ids: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> None:
        q2, r2 = np.square(queries).sum(axis=1), np.square(rows).sum(axis=1)
        near = q2[:, None] + r2[None, :] - 2.0 * (queries @ rows.T)
        slack = 1e-10 * (q2 + r2.max())
        for i, key in enumerate(keys):
            best = self.rows.setdefault(key, [])
            limit = near[i]
            if len(limit) > self.k:  # the query's own row may be among them
                bar = np.partition(limit, self.k)[self.k] + slack[i]
                if len(best) >= self.k:
                    bar = min(bar, best[self.k - 1][0] ** 2 + slack[i])
                at = np.flatnonzero(limit <= bar)
            else:
                at = np.arange(len(limit))
            at = at[(ids[at] != key[0]) | (hashes[at] != key[1])]
            if len(at):
                far = _exact(queries[i], rows[at])
                self.rows[key] = sorted({*best, *zip(far.tolist(), ids[at].tolist(), hashes[at].tolist())})[:self.k]

    def take(self, kind: pa.DataType) -> pa.RecordBatch:
        flat = [(q, h, i, c, d) for (q, h), best in self.rows.items() for d, i, c in best]
        self.rows = {}
        cols = list(zip(*flat)) or [()] * 5
        kinds = (kind, pa.int64(), kind, pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["q", "qh", "id", "h", "d"])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query among partial results; a row that several trees gave counts once."""
    once = found.groupBy("q", "qh", "id", "h").agg(F.min("d").alias("d"))
    order = Window.partitionBy("q", "qh").orderBy("d", "id", "h")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """(q, qh, id, h, d, rank): the exact neighbours of a bounded list of queries (id, h, v)."""
    kind = rows.schema["id"].dataType.simpleString()
    keys = [(q["id"], q["h"]) for q in queries]
    points = np.array([q["v"] for q in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last = _Best(k), None
        for batch in batches:
            if batch.num_rows:
                last = batch.column(0).type
                best.add(keys, points, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(),
                         _matrix(batch.column(2), dim))
        if last is not None:
            yield best.take(last)
    return _top(rows.select("id", "h", "v").mapInArrow(run, f"q {kind}, qh bigint, id {kind}, h bigint, d double"), k)


class Forest:
    """Trees, rows per leaf, and the calibrated ``reach`` of a search."""

    def __init__(self, trees: list[Tree], dim: int, k: int) -> None:
        self.trees, self.dim, self.k, self.reach = trees, dim, k, 0.0
        self.counts: list[np.ndarray] = []

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([t.leaves_of(vectors) for t in self.trees], axis=1)

    def found(self, vectors: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        margins = [t.margins(vectors) for t in self.trees]
        for i in range(len(vectors)):
            yield search(self.trees, self.counts, [m[i] for m in margins], self.reach, self.k)

    def meeting(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The priority at which a search for ``query`` meets each of ``rows``."""
        best = np.full(len(rows), np.inf)
        for t in self.trees:
            best = np.minimum(best, t.priorities(t.margins(query[None, :])[0])[t.leaves_of(rows)])
        return best


def _share(n: int, most: int, salt: int) -> Column:
    """True for about ``most`` of ``n`` rows, by a hash of id and vector."""
    return F.pmod(F.xxhash64("id", "h", F.lit(salt)), F.lit(1 << 30)) < max(1, int((1 << 30) * min(1.0, most / max(n, 1))))


def fit(rows: DataFrame, queries: DataFrame, dim: int, k: int = K, trees: int = TREES, recall: float = RECALL) -> Forest:
    n = rows.count()
    most = min(SAMPLE_ROWS, max(SAMPLE_BYTES // (8 * dim), LEAF_ROWS))
    sample = rows.filter(_share(n, most, 1)).orderBy("h", "id").select("v").toArrow()["v"].combine_chunks()
    points = _matrix(sample, dim)
    forest = Forest([Tree(points, np.random.default_rng([SEED, t])) for t in range(trees)], dim, k)
    asked = queries.filter(_share(queries.count(), CALIBRATION, 2)).collect()
    if asked:
        exact = brute_force(rows, asked, dim, k).select("q", "qh", "id", "h")
        with_rows = exact.join(rows, ["id", "h"]).select("q", "qh", "v").collect()
        point = {(q["id"], q["h"]): np.array(q["v"], np.float64) for q in asked}
        met: dict = {}
        for r in with_rows:
            met.setdefault((r["q"], r["qh"]), []).append(r["v"])
        at = np.sort(np.concatenate([np.zeros(0)] + [forest.meeting(point[q], np.array(v, np.float64)) for q, v in met.items()]))
        if len(at):
            forest.reach = float(at[min(len(at) - 1, int(np.ceil(recall * len(at))))])
    return forest


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K,
            trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, neighbour, score): the k nearest rows found for each row for
    which ``is_query`` (over the column ``id``) holds."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    valid, dim = usable(vectors, key, vector)
    if not dim:
        return spark.createDataFrame([], f"query_id {kind}, rank int, neighbour {kind}, score double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a search takes time, so queries keep all tasks busy
    rows = cut(candidates(valid, k))
    queries = cut(valid.filter(is_query).repartition(parts, "id", "h").dropDuplicates(["id", "h", "v"]))
    forest = fit(rows, queries, dim, k, trees, recall)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.leaves(_matrix(batch.column(2), dim)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves.tolist(), pa.list_(pa.int32()))],
                                             names=["id", "h", "v", "leaves"])
    v_type = rows.schema["v"].dataType.simpleString()
    indexed = cut(rows.select("id", "h", "v").mapInArrow(placed, f"id {kind}, h bigint, v {v_type}, leaves array<int>"))
    index = indexed.select("id", "h", "v", F.posexplode("leaves").alias("tree", "leaf"))
    forest.counts = [np.zeros(t.leaves, np.int64) for t in forest.trees]
    for r in index.groupBy("tree", "leaf").count().collect():  # one row a leaf
        forest.counts[r["tree"]][r["leaf"]] = r["count"]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(forest.found(_matrix(batch.column(2), dim)))
            pairs = pa.array([[{"tree": t, "leaf": f} for t, f in x] for x in found],
                             pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pairs], names=["id", "h", "v", "found"])
    asked = cut(queries.mapInArrow(
        visits, f"id {kind}, h bigint, v {v_type}, found array<struct<tree:int,leaf:int>>"))
    visit = asked.select("id", "h", "v", F.explode("found").alias("x")).select("id", "h", "v", "x.tree", "x.leaf")
    # blocks per leaf; the counts are one row a leaf
    blocks = [(t, f, int(-(-c // BLOCK_ROWS))) for t, counts in enumerate(forest.counts) for f, c in enumerate(counts) if c]
    asked_per = {(r["tree"], r["leaf"]): -(-r["count"] // BLOCK_QUERIES) for r in visit.groupBy("tree", "leaf").count().collect()}
    sizes = spark.createDataFrame([(t, f, b, int(asked_per.get((t, f), 0))) for t, f, b in blocks], "tree int, leaf int, nb int, nq int")
    sizes = F.broadcast(sizes.filter("nq > 0"))

    def dealt(df: DataFrame, own: str, others: str, mine: str, theirs: str, is_row: int) -> DataFrame:
        """Rows go to one block of theirs and to every block of the other side."""
        return df.join(sizes, ["tree", "leaf"]).select(
            "tree", "leaf", F.pmod(F.xxhash64("id", "h"), F.col(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(theirs), F.lit(is_row).alias("is_row"), "id", "h", "v")
    group = ["tree", "leaf", "rb", "qb"]
    both = dealt(index, "nb", "nq", "rb", "qb", 1).unionByName(dealt(visit, "nq", "nb", "qb", "rb", 0))
    near = both.repartition(*group).sortWithinPartitions(*group, "is_row")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at, keys, points, last = _Best(k), None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c) for c in batch.schema.names}
            marks = np.column_stack([cols[c].to_numpy() for c in (*group, "is_row")])
            ids, hs = cols["id"].to_numpy(zero_copy_only=False), cols["h"].to_numpy()
            vs, last = _matrix(cols["v"], dim), cols["id"].type
            cuts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(marks)]])
            for a, b in zip(cuts, cuts[1:]):
                here = tuple(marks[a, :4])
                if here != at:
                    at, keys, points = here, [], []
                if marks[a, 4] == 0:
                    keys += list(zip(ids[a:b].tolist(), hs[a:b].tolist()))
                    points.append(vs[a:b])
                elif keys:
                    best.add(keys, np.concatenate(points), ids[a:b], hs[a:b], vs[a:b])
            if len(best.rows) * k > HELD:
                yield best.take(last)
        if last is not None:
            yield best.take(last)
    some = near.mapInArrow(ranked, f"q {kind}, qh bigint, id {kind}, h bigint, d double")
    return _top(some, k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                                F.col("id").alias("neighbour"), F.col("d").alias("score"))
