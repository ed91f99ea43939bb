"""Nearest neighbours by inner product: a forest of random-projection trees, searched through one priority queue a query."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from brightfield.llm.common import discard, materialize, partitions, quoted

#: Rows of a leaf, and queries that look into it, that one task holds together at most; larger leaves are dealt out in blocks.
BLOCK_ROWS = 1 << 16
#: Queries whose best candidates a task holds before it passes them on.
HELD_QUERIES = 1 << 17
#: Queries and candidates that are multiplied at once.
TILE = (512, 4096)


def usable(vector: Column, zeros: bool = False) -> Column:
    """Whether a vector has components, all of them finite, and (unless zeros are asked for) one that is not zero."""
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good if zeros else good & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows x components in double precision; vectors must be of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if n == 0:
        return np.empty((0, 0))
    return np.asarray(column.flatten().cast(pa.float64())).reshape(n, -1)


@dataclass
class Forest:
    """Trees in heap order: node i has the children 2i+1 (below the threshold) and 2i+2."""

    normals: np.ndarray  # trees x inner nodes x components
    thresholds: np.ndarray  # trees x inner nodes
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered over all trees."""
        trees, inner, _ = self.normals.shape
        out = np.empty((len(x), trees), dtype=np.int32)
        for t in range(trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[t][node]) >= self.thresholds[t][node])
            out[:, t] = node - inner + t * (inner + 1)
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, budget: float) -> list[tuple[list[int], list[int]]]:
        """For each query the leaves in the order of one queue over all trees, with the candidates met until each is done; it ends with the leaf that reaches the budget."""
        trees, inner, dim = self.normals.shape
        margins = (x @ self.normals.reshape(-1, dim).T).reshape(len(x), trees, inner) - self.thresholds
        found = []
        for margin in margins.tolist():
            queue, met, leaves, after = [(0.0, t, 0) for t in range(trees)], 0, [], []
            while queue and met < budget:
                far, t, node = heapq.heappop(queue)
                if node >= inner:
                    leaf = node - inner + t * (inner + 1)
                    if sizes[leaf]:
                        met += int(sizes[leaf])
                        leaves.append(leaf)
                        after.append(met)
                    continue
                m = margin[t][node]  # the half space on the query's other side costs its squared distance
                heapq.heappush(queue, (far + (m * m if m >= 0 else 0.0), t, 2 * node + 1))
                heapq.heappush(queue, (far + (m * m if m < 0 else 0.0), t, 2 * node + 2))
            found.append((leaves, after))
        return found


def grow(sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
    """Each node splits its share of the sample at the median along the line between two of its points (a random line where they coincide)."""
    rng = np.random.default_rng(seed)
    dim, inner = sample.shape[1], (1 << depth) - 1
    normals, thresholds = np.zeros((trees, inner, dim)), np.zeros((trees, inner))
    for t in range(trees):
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            own = rows.pop(node)
            line = np.zeros(dim)
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                line = sample[a] - sample[b]
            if not line.any():
                line = rng.normal(size=dim)
            line = line / np.abs(line).max()
            line = line / np.linalg.norm(line)
            along = np.einsum("ij,j->i", sample[own], line)
            normals[t, node], thresholds[t, node] = line, np.median(along) if len(own) else 0.0
            rows[2 * node + 1], rows[2 * node + 2] = own[along < thresholds[t, node]], own[along >= thresholds[t, node]]
    return Forest(normals, thresholds, depth)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of components: equal vectors give equal products wherever they stand."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


class Best:
    """The k best different candidates of each query that a task has met so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.ids, self.scores = k, {}, np.empty((0, k), dtype=np.int64), np.empty((0, k))

    def places(self, queries: np.ndarray) -> np.ndarray:
        at = np.array([self.rows.setdefault(q, len(self.rows)) for q in queries.tolist()], dtype=np.int64)
        if len(self.rows) > len(self.ids):
            more = max(len(self.rows), 2 * len(self.ids)) - len(self.ids)
            self.ids = np.concatenate([self.ids, np.zeros((more, self.k), dtype=np.int64)])
            self.scores = np.concatenate([self.scores, np.full((more, self.k), -np.inf)])
        return at

    def offer(self, at: np.ndarray, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        """Every query against every candidate: products of matrices leave those near the k best, whose products are then made exactly."""
        s = x @ y.T
        slack = 1e-12 * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()
        s[queries[:, None] == ids[None, :]] = -np.inf
        least = self.scores[at, -1]
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, c = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        if not len(q):
            return
        touched = np.unique(q)
        row = np.concatenate([q, np.repeat(touched, self.k)])
        score = np.concatenate([products(x[q], y[c]), self.scores[at[touched]].ravel()])
        ident = np.concatenate([ids[c], self.ids[at[touched]].ravel()])
        real = score > -np.inf
        row, score, ident = row[real], score[real], ident[real]
        order = np.lexsort((ident, -score, row))
        row, score, ident = row[order], score[order], ident[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (ident[1:] != ident[:-1])  # another tree's copy has the same score, so it stands next to it
        row, score, ident = row[new], score[new], ident[new]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.scores[at[touched]] = -np.inf
        self.scores[at[row[kept]], place[kept]] = score[kept]
        self.ids[at[row[kept]], place[kept]] = ident[kept]

    def drain(self) -> pa.RecordBatch:
        queries = np.fromiter(self.rows, dtype=np.int64, count=len(self.rows))
        n = len(queries)
        row, place = np.nonzero(self.scores[:n] > -np.inf)
        out = pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(self.ids[row, place]), pa.array(self.scores[row, place])], names=["query_id", "vec_id", "score"])
        self.__init__(self.k)
        return out


FOUND = "query_id long, vec_id long, score double"


def _exact(kept: DataFrame, queries: list[int], x: np.ndarray, k: int, forest: Forest) -> list:
    """The true k best of a few queries over all rows, with their leaves: each task passes on its k best a query."""
    names = np.array(queries, dtype=np.int64)

    def run(batches):
        best, seen = Best(k), {}
        at = best.places(names)
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype=np.int64)
            y = matrix(batch.column(1))
            for i in range(0, len(ids), TILE[1]):
                best.offer(at, names, x, ids[i : i + TILE[1]], y[i : i + TILE[1]])
            live = set(best.ids[best.scores > -np.inf].tolist())
            new = np.flatnonzero(np.isin(ids, list(live)))
            seen = {i: v for i, v in seen.items() if i in live} | dict(zip(ids[new].tolist(), forest.leaves(y[new]).tolist(), strict=True))
        out = best.drain()
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array([seen[i] for i in out.column(1).to_pylist()], type=pa.list_(pa.int32()))], names=["query_id", "vec_id", "score", "leaves"])

    found = kept.mapInArrow(run, FOUND + ", leaves array<int>").groupBy("query_id")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "leaves"))), 1, k)
    return found.agg(top.alias("top")).collect()  # k for each of a bounded number of queries


def near_neighbours(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    every: int = 20,
    trees: int = 8,
    leaf_rows: int = 4096,
    sample_per_leaf: int = 64,
    trial_queries: int = 128,
    recall: float = 0.95,
    least: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, its k best other rows by inner product.

    A tree of the forest has 64 leaves at least, so many that a leaf has some `leaf_rows` rows, and 4,096 at most; it is fitted on a bounded
    sample (`sample_per_leaf` rows a leaf, the smallest hashes of keys), and every row is filed in one leaf of each tree. A query takes
    leaves from one queue over all trees, nearest half spaces first, until it has met its budget of candidates. The budget is measured and
    not guessed: `trial_queries` queries are answered exactly over all rows, and it is the smallest with which the forest finds the share
    `recall` of their neighbours, `least` candidates at least. Candidates are reranked exactly, leaf by leaf: rows of a leaf and the
    queries that look into it meet in one task, large leaves in blocks of both, and a task passes on k candidates a query.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do rows without a key and vectors of another
    length than that of the smallest key. Of rows with one key the least vector counts. Equal scores go to the smaller key; a query with
    fewer other rows gets them all. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    given = vectors.select(quoted(key).cast("long").alias("id"), quoted(vector).alias("v")).where("id is not null").where(usable(F.col("v")))
    single = materialize(given.groupBy("id").agg(F.min("v").alias("v")), "vectors", 4000)
    first = single.orderBy("id").limit(1).select(F.size("v").alias("n")).collect()
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kept = single.where(F.size("v") == first[0]["n"])
    n = kept.count()
    depth = min(12, max(6, math.ceil(math.log2(max(1, n / leaf_rows)))))
    by_hash = kept.orderBy(F.xxhash64("id"), "id")
    forest = grow(matrix(by_hash.limit(sample_per_leaf << depth).toArrow().column("v")), trees, depth, seed)
    n_leaves = trees << depth

    def filed(batches):
        total = np.zeros(n_leaves, dtype=np.int64)
        for batch in batches:
            total += np.bincount(forest.leaves(matrix(batch.column(0))).ravel(), minlength=n_leaves)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["leaf", "n"])

    sizes = np.zeros(n_leaves, dtype=np.int64)
    for r in kept.select("v").mapInArrow(filed, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]

    queries = kept.where(F.col("id") % every == 0)
    trial = by_hash.where(F.col("id") % every == 0).limit(trial_queries).toArrow()
    budget = float(least)
    if trial.num_rows and n > 1:
        names, x = trial.column("id").to_pylist(), matrix(trial.column("v"))
        costs = []
        for r in _exact(kept, names, x, k, forest):
            i = names.index(r["query_id"])
            met = dict(zip(*forest.search(x[i : i + 1], sizes, math.inf)[0], strict=True))
            costs += [min(met[leaf] for leaf in c["leaves"]) for c in r["top"]]
        costs.sort()
        if costs:
            budget = max(budget, costs[math.ceil(recall * len(costs)) - 1])

    step = max(1, (1 << 20) // n_leaves)  # queries whose margins at all inner nodes are held together

    def look(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                probes = [leaves for leaves, _ in forest.search(matrix(part.column(1)), sizes, budget)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(probes, type=pa.list_(pa.int32()))], names=["id", "v", "leaves"])

    kind = kept.schema["v"].dataType
    probes = materialize(queries.mapInArrow(look, T.StructType([kept.schema["id"], kept.schema["v"], T.StructField("leaves", T.ArrayType(T.IntegerType()))])), "probes", 4000)
    asked = np.zeros(n_leaves, dtype=np.int64)
    for r in probes.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        asked[r["leaf"]] = r["count"]
    blocks, chunks = -(-sizes // BLOCK_ROWS), -(-asked // BLOCK_ROWS)

    def deal(side: int):
        """Rows of a side for every block of the other: side 0 are queries, which every block of their leaf sees; side 1 candidates."""
        own, other = (chunks, blocks) if side == 0 else (blocks, chunks)

        def run(batches):
            for batch in batches:
                leaves = batch.column(2)
                row = np.asarray(pc.list_parent_indices(leaves), dtype=np.int64)
                leaf = np.asarray(leaves.flatten(), dtype=np.int64)
                times = other[leaf]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, leaf = np.repeat(row, times), np.repeat(leaf, times)
                mixed = np.asarray(batch.column(3), dtype=np.int64)[row] % np.maximum(1, own[leaf])
                block, chunk = (part, mixed) if side == 0 else (mixed, part)
                for i in range(0, len(row), 4000):
                    at = pa.array(row[i : i + 4000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[i : i + 4000].astype(np.int32)), pa.array(block[i : i + 4000].astype(np.int32)), pa.array(chunk[i : i + 4000].astype(np.int32)), pa.array(np.full(len(at), side, dtype=np.int32)), batch.column(0).take(at), batch.column(1).take(at)],
                        names=["leaf", "block", "chunk", "side", "id", "v"],
                    )

        return run

    def file_rows(batches):
        for batch in batches:
            made = forest.leaves(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(made), type=pa.list_(pa.int32()))], names=["id", "v", "leaves"])

    filed_type = probes.schema
    dealt_type = T.StructType([T.StructField(c, T.IntegerType()) for c in ("leaf", "block", "chunk", "side")] + [kept.schema["id"], kept.schema["v"]])
    mixing = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("mix")
    members = kept.select("id", "v").mapInArrow(file_rows, filed_type)
    both = [df.select("id", "v", "leaves", mixing).mapInArrow(deal(side), dealt_type) for side, df in ((0, probes), (1, members))]
    group = ["leaf", "block", "chunk"]
    together = both[0].unionByName(both[1]).repartition(partitions(spark), *group).sortWithinPartitions(*group, "side")
    arrow_type = to_arrow_type(kind)

    def rerank(batches):
        best, now, names, vectors_, at = Best(k), None, [], [], None
        x = ids_of = None
        for batch in batches:
            g = np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1)
            side, ids = np.asarray(batch.column(3)), np.asarray(batch.column(4), dtype=np.int64)
            y = matrix(batch.column(5).cast(arrow_type))
            cuts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]).any(axis=1) | (side[1:] != side[:-1]), [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tuple(g[a]) != now:
                    now, names, vectors_, at = tuple(g[a]), [], [], None
                    if len(best.rows) > HELD_QUERIES:
                        yield best.drain()
                if side[a] == 0:
                    names.append(ids[a:b])
                    vectors_.append(y[a:b])
                elif names:
                    if at is None:
                        ids_of, x = np.concatenate(names), np.concatenate(vectors_)
                        at = best.places(ids_of)
                    for i in range(0, len(ids_of), TILE[0]):
                        for j in range(a, b, TILE[1]):
                            best.offer(at[i : i + TILE[0]], ids_of[i : i + TILE[0]], x[i : i + TILE[0]], ids[j : min(b, j + TILE[1])], y[j : min(b, j + TILE[1])])
        yield best.drain()

    found = together.mapInArrow(rerank, FOUND)
    top = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k)
    ranked = materialize(found.groupBy("query_id").agg(top.alias("top")), "neighbours", compact=True)
    discard(single, probes)
    ranked = ranked.select("query_id", F.posexplode("top").alias("rank", "best"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), "best.vec_id", (-F.col("best.far")).alias("score"))
