"""Approximate nearest neighbours by a hierarchical k-means tree (operator 9).

The tree is fitted on a documented, bounded sample (``SAMPLE`` rows, by hash of row number) and broadcast; every row is indexed: it descends to its leaf. A query walks the tree best bin
first: a priority queue holds the nodes seen, a leaf at the inner product of the query with its centre,
an inner node at the most that any leaf below it can have (its own product and its radius), so leaves
come off the queue in the order of their own products.

How many leaves a query visits is calibrated: for ``PROBES`` queries the exact neighbours are
found by brute force over all rows (in blocks, top lists per task), and the visits are widened
until the mean recall reaches ``RECALL``. A walk goes on beyond that number until its leaves hold the
neighbours asked for, or all rows. Leaves that are neighbours in the tree form groups, dealt in blocks
of about ``CHUNK`` rows, so a leaf that holds a third of all rows is many tasks' work. A query goes
once to each group that it visits, with the list of its leaves there; each block gives its best ``k``
per query, and the best ``k`` of those are the result. Scores are inner products of the original vectors in
double precision.

The share of rows that is scanned depends on the data: vectors in clusters are scanned in few leaves;
for directions without any structure in 64 dimensions (the test tables) the README gives the figures.
The sample bounds the number of leaves, so beyond it the rows of a leaf grow with the table.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without an id. Vectors of different widths have no inner product: each width is a
search of its own, those of at most ``SMALL`` rows all in one pass, each with a tree inside its group. Rows that repeat an id are candidates each, apart from the query's own id; as
queries they count once, with the smallest of their vectors; ties go to the smaller id; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import bounded_sample
from filigree.session import materialize

SAMPLE, BRANCH, LEAF, CHUNK, PROBES, RECALL, SEED = 16_384, 8, 8, 8192, 256, 0.95, 7
#: About so many groups of leaves.
GROUPS = 64

#: Rows up to which the vectors of one width, where there are several, are searched inside one group.
SMALL = 4096
FOUND = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.col("vec").isNotNull())
    rows = rows.filter(F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))))
    return rows.filter(F.exists("vec", lambda x: x != 0))


# ---- tree ---------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        at = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        count = np.bincount(at, minlength=k)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres, ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


class Tree:
    """centres[i] and children[i] (range of node numbers, empty for a leaf) of every node; node 0 is the root."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF):
        rng = np.random.default_rng(SEED)
        self.centres, self.children = [sample.mean(0)], [range(0)]
        todo = [(0, sample)]
        while todo:
            node, x = todo.pop()
            if len(x) <= leaf or (x == x[0]).all():
                continue
            centres, at = kmeans(x, min(branch, len(x)), rng)
            used = np.unique(at)
            if len(used) < 2:
                continue
            first = len(self.centres)
            self.children[node] = range(first, first + len(used))
            for c in used:
                self.centres.append(centres[c])
                self.children.append(range(0))
            todo += [(first + k, x[at == c]) for k, c in enumerate(used)]
        self.centres = np.array(self.centres)
        self.half = (self.centres**2).sum(1)
        self.radius = np.zeros(len(self.centres))  # distance to the farthest centre of a leaf below
        self.place = np.zeros(len(self.centres), dtype=np.int64)  # number of a leaf in the order of the tree
        below: dict[int, list[int]] = {}
        for node in range(len(self.centres) - 1, -1, -1):  # children come after their parent
            kids = self.children[node]
            below[node] = [x for kid in kids for x in below.pop(kid)] if len(kids) else [node]
            self.radius[node] = np.sqrt(((self.centres[below[node]] - self.centres[node]) ** 2).sum(1)).max()
        self.place[below[0]] = np.arange(len(below[0]))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row: at each level the nearest centre."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids) or not len(rows):
                out[rows] = node
                continue
            at = (self.half[kids.start : kids.stop][None] - 2 * x[rows] @ self.centres[kids.start : kids.stop].T).argmin(1)
            todo += [(kids.start + k, rows[at == k]) for k in range(len(kids))]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk, and more until they hold ``rows`` rows (``sizes`` per node)."""
        near = self.centres @ q
        reach = near + self.radius * np.sqrt(q @ q)
        heap, out, held = [(-reach[0], 0)], [], 0
        while heap and (len(out) < most or held < rows):
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if len(kids):
                for kid in kids:
                    heapq.heappush(heap, (-(reach if len(self.children[kid]) else near)[kid], kid))
            else:
                out.append(node)
                held += int(sizes[node]) if sizes is not None else 0
        return out

    @staticmethod
    def of(state: dict) -> Tree:
        """The tree with the given attributes: plain data, as broadcast."""
        tree = object.__new__(Tree)
        vars(tree).update(state)
        return tree

    def leaves(self) -> int:
        return sum(1 for c in self.children if not len(c))


def vectors_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


# ---- search -------------------------------------------------------------------------------


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the best ``k`` rows per query, of those ``allowed`` (queries x rows).

    The product of both sides finds who can be among them; their scores are summed anew row by
    row, so a pair's score is the same in any block.
    """
    near = queries @ x.T
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    if allowed is not None:
        near[~allowed] = -np.inf
    edge = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
    slack = 1e-9 * (1 + np.sqrt((queries**2).sum(1)) * np.sqrt((x**2).sum(1).max(initial=0.0)))
    at, row = np.nonzero((near >= (edge - slack)[:, None]) & (near > -np.inf))
    score = (x[row] * queries[at]).sum(axis=1)
    order = np.lexsort((ids[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return query_ids[at[keep]], ids[row[keep]], score[keep]


def found_batch(found: tuple) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t) for c, t in zip(found, kinds)], names=["query_id", "vec_id", "score"])


def merge(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the best ``k`` per query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries among all rows (vec_id, vec)."""
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            if batch.num_rows:
                yield found_batch(best_of(ids, x, batch.column(0).to_numpy(), vectors_of(batch.column(1)), k))

    return merge(rows.select("vec_id", "vec").mapInArrow(run, FOUND), k)


def calibrate(tree: Tree, indexed: DataFrame, probes: list, k: int, recall: float) -> int:
    """The least number of leaves whose visit finds the share ``recall`` of the probes' true neighbours; ``vec_id`` tells rows apart."""
    if not probes:
        return 1
    ids, x = np.array([r["vec_id"] for r in probes]), np.array([r["vec"] for r in probes])
    truth = brute_force(indexed, ids, x, k)
    truth = truth.join(indexed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()  # probes x k rows at most
    order = {int(i): {node: n for n, node in enumerate(tree.visits(q, tree.leaves()))} for i, q in zip(ids, x)}
    place = np.sort([order[r["query_id"]][r["leaf"]] + 1 for r in truth])
    return int(place[max(0, int(np.ceil(recall * len(place))) - 1)]) if len(place) else 1


def search(vectors: DataFrame, is_query, k: int = 20, sample: int = SAMPLE, recall: float = RECALL, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (a column of vec_id) holds for, its ``k`` nearest found."""
    rows = materialize(valid(vectors).withColumns({"rid": F.monotonically_increasing_id(), "w": F.size("vec")}), "vectors")
    widths = materialize(rows.groupBy("w").agg(F.count("*").alias("n")), "widths")
    if widths.limit(2).count() == 1:
        return search_width(rows.drop("w"), is_query, k, sample, recall, probes)
    # widths of few rows have a tree each inside one group; the others, one per SMALL rows at most, one after the other
    few = widths.filter(F.col("n") <= SMALL).select("w")
    out = merge(rows.join(few, "w").withColumn("asks", is_query).groupBy("w").applyInPandas(search_few(k), FOUND), k)
    for r in widths.filter(F.col("n") > SMALL).orderBy("w").toLocalIterator():
        out = out.unionByName(search_width(rows.filter(F.col("w") == r["w"]).drop("w"), is_query, k, sample, recall, probes))
    return out


def search_few(k: int):
    """The search among the at most ``SMALL`` vectors of a width: one tree, whose leaves are all visited, as they hold so little."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, vec = rows["vec_id"].to_numpy(), np.stack(rows["vec"].to_numpy())
        tree = Tree(vec)
        leaf = tree.assign(vec)
        asked = rows[rows["asks"].fillna(False).astype(bool)]
        asked = asked.assign(order=asked["vec"].map(tuple)).sort_values(["vec_id", "order"]).drop_duplicates("vec_id")
        if not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        q = np.stack(asked["vec"].to_numpy())
        visited = np.stack([np.isin(leaf, tree.visits(x, tree.leaves())) for x in q])
        query, vec_id, score = best_of(asked["vec_id"].to_numpy(), q, ids, vec, k, visited)
        return pd.DataFrame({"query_id": query, "vec_id": vec_id, "score": score}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search_width(rows: DataFrame, is_query, k: int, sample: int, recall: float, probes: int) -> DataFrame:
    """The search among vectors (vec_id, vec) of one width, one at least."""
    spark = rows.sparkSession
    fitted = bounded_sample(rows, "rid", sample).collect()  # by row: few ids may share all rows
    tree = Tree(np.array([r["vec"] for r in fitted]))
    shared = spark.sparkContext.broadcast(vars(tree))
    per_group = max(1, -(-tree.leaves() // GROUPS))

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.of(shared.value)
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(vectors_of(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(tree.place[leaf] // per_group)], names=["vec_id", "vec", "rid", "leaf", "grp"])

    indexed = materialize(rows.select("vec_id", "vec", "rid").mapInArrow(to_leaf, "vec_id long, vec array<double>, rid long, leaf long, grp long"), "indexed")
    # a repeated id asks once
    chosen = materialize(indexed.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("vec", "rid")).alias("one"), F.count("*").alias("own")).select("vec_id", "one.vec", "own", "one.rid"), "queries")
    by_row = indexed.select(F.col("rid").alias("vec_id"), "vec", "leaf")
    visits = calibrate(tree, by_row, bounded_sample(chosen, "vec_id", probes).select(F.col("rid").alias("vec_id"), "vec").collect(), k, recall)
    sizes = np.zeros(len(tree.children), dtype=np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row per leaf of the fitted tree
        sizes[r["leaf"]] = r["count"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.of(shared.value)
        for batch in batches:
            at, group, leaves = [], [], []
            for n, (q, own) in enumerate(zip(vectors_of(batch.column(1)), batch.column(2).to_pylist()) if batch.num_rows else []):
                nodes = np.array(tree.visits(q, visits, sizes, k + own))
                nodes = nodes[sizes[nodes] > 0]
                of = tree.place[nodes] // per_group
                for g in np.unique(of).tolist():
                    at.append(n)
                    group.append(g)
                    leaves.append(nodes[of == g].tolist())
            taken = batch.select(["vec_id", "vec"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(group, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "q", "grp", "leaves"])

    asked = materialize(chosen.mapInArrow(walk, "query_id long, q array<double>, grp long, leaves array<int>"), "walks")
    # both sides of a group are dealt in blocks of about CHUNK rows; each pair of blocks is one piece of work
    parts = indexed.groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    parts = F.broadcast(parts.join(asked.groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("askers")), "grp"))  # GROUPS rows
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = indexed.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).withColumn("asker", up_to("askers")).select("grp", "part", "asker", "vec_id", "vec", "leaf")
    theirs = asked.join(parts, "grp").withColumn("asker", F.pmod(F.xxhash64("query_id"), F.col("askers")).cast("int")).withColumn("part", up_to("parts")).select("grp", "part", "asker", "query_id", "q", "leaves")

    def block(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(x) and len(q):
            ids, vec, leaf = x["vec_id"].to_numpy(), np.stack(x["vec"].to_numpy()), x["leaf"].to_numpy()
            known, at = np.unique(leaf, return_inverse=True)
            for start in range(0, len(q), 512):
                some = q.iloc[start : start + 512]
                visited = np.zeros((len(some), len(known)), dtype=bool)
                for n, leaves in enumerate(some["leaves"]):
                    place = np.minimum(np.searchsorted(known, leaves), len(known) - 1)
                    visited[n, place[known[place] == leaves]] = True
                found.append(best_of(some["query_id"].to_numpy(), np.stack(some["q"].to_numpy()), ids, vec, k, visited[:, at]))
        cells = [np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cells))).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = mine.groupBy("grp", "part", "asker").cogroup(theirs.groupBy("grp", "part", "asker")).applyInPandas(block, FOUND)
    return merge(found, k)


def neighbours(vectors: DataFrame) -> DataFrame:
    """The query of operator 9: every row whose id is divisible by 20 against all rows."""
    return search(vectors, F.col("vec_id") % 20 == 0)
