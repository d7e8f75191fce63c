"""Approximate nearest neighbours by largest inner product: balanced posting lists behind a centroid graph.

Vectors are lifted by one coordinate to equal length, so that the largest inner product is the least
distance. Centroids are fitted on a bounded sample by k-means with a penalty on crowded clusters; every
vector of the input is then indexed: in its nearest list, and, if it lies near a boundary, in up to
``COPIES`` lists whose distance is within ``SPREAD`` of the nearest. The centroids are searched by an
in-memory neighbour graph (best first, for many vectors at once). A query reads its nearest lists, ``LEAST``
at least, until they surely hold ``SEVERAL`` times ``k + 1`` distinct vectors, beyond those that the graph finds if they
are too small, and of the lists that the graph finds those whose distance is within a ratio of the last
of these. So a query on a centroid reads as far as any other, and none returns less than there is.

Equal vectors are one class with its ``k + 1`` smallest ids (more can never be returned; Spark limits
them before the shuffle), so a vector that a third of the rows repeat is one entry of a list. Lists are
read in parts of at most ``PART`` vectors. Broadcast are the centroids and their graph, whose number
``MAX_LISTS`` bounds.

A list's products only choose candidates: those within the rounding error of the last one wanted are summed
again in the order of their components, and ties go to the smallest id, in each list and at the end.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of
another length than the most frequent one, nor rows with a null id. Rows of equal id and vector count
once. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, QUERY_EVERY = 20, 20
#: Distinct vectors that the centroids are fitted on.
SAMPLE = 20_000
#: Vectors a list on average, and most lists.
LIST, MAX_LISTS = 100, 8192
COPIES, SPREAD = 6, 1.12
#: Links of a centroid in the graph, breadth of its search, lists that a query takes from it, and their distance over the least read.
LINKS, BREADTH, PROBES, RATIO = 24, 200, 160, 1.5
#: Lists that a query reads at least, and times k + 1 distinct vectors that they hold at least.
LEAST, SEVERAL = 8, 8
#: Vectors of a list that one task compares at once, with so many queries.
PART, ASKED = 20_000, 128


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that brings each to the longest one's length."""
    rest = np.maximum(longest**2 - (vectors**2).sum(1), 0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], 1)


def fit(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 17) -> np.ndarray:
    """Balanced k-means: assignments pay for the crowd of a cluster, and empty clusters restart."""
    rng = np.random.Generator(np.random.PCG64(seed))
    lists = min(lists, len(sample))
    centers = sample[rng.choice(len(sample), lists, replace=False)].copy()
    crowd = np.full(lists, len(sample) / lists)
    for _ in range(rounds):
        owner = np.empty(len(sample), np.int64)
        weight = 0.1 * float(((sample - sample.mean(0)) ** 2).sum(1).mean()) * lists / len(sample)
        for a in range(0, len(sample), 4096):
            x = sample[a : a + 4096]
            far = (x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)
            owner[a : a + 4096] = (far + weight * (crowd - crowd.mean())).argmin(1)
        n = np.bincount(owner, minlength=lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, sample)
        full = n > 0
        centers[full] = sums[full] / n[full, None]
        if (~full).any():
            centers[~full] = sample[rng.choice(len(sample), int((~full).sum()))]
        crowd = 0.5 * crowd + 0.5 * n
    return centers


class CentroidGraph:
    """Neighbour graph over the centroids with a batched best-first search."""

    def __init__(self, centers: np.ndarray, links: int = LINKS) -> None:
        self.centers = centers
        n = len(centers)
        links = min(links, n - 1)
        self.links = np.zeros((n, max(1, 2 * links)), np.int64)
        near = np.zeros((n, links), np.int64)
        for a in range(0, n, 1024):
            far = self._far(centers[a : a + 1024], None)
            far[np.arange(len(far)), a + np.arange(len(far))] = np.inf
            near[a : a + 1024] = np.argsort(far, 1)[:, :links] if links else near[a : a + 1024]
        back: list[list[int]] = [[] for _ in range(n)]
        for i in range(n):
            for j in near[i]:
                if len(back[j]) < links:
                    back[j].append(i)
        for i in range(n):
            own = list(dict.fromkeys([*near[i].tolist(), *back[i]])) or [i]
            self.links[i] = (own * (self.links.shape[1] // len(own) + 1))[: self.links.shape[1]]
        rng = np.random.Generator(np.random.PCG64(2))
        #: Where searches begin: spread over the graph, so that every part of it is reached.
        self.starts = rng.choice(n, min(n, 48), replace=False)

    def _far(self, x: np.ndarray, which: np.ndarray | None) -> np.ndarray:
        """Squared distances to all centroids, or to those named for each row."""
        if which is None:
            return np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.centers.T + (self.centers**2).sum(1), 0)
        return ((self.centers[which] - x[:, None, :]) ** 2).sum(2)

    def search(self, x: np.ndarray, want: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of about the ``want`` nearest centroids of each row, nearest first."""
        n, breadth = len(self.centers), min(max(want, breadth), len(self.centers))
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), n), bool)
        best = np.broadcast_to(self.starts, (len(x), len(self.starts))).copy()
        seen[rows, best] = True
        far = self._far(x, best)
        done = np.zeros(best.shape, bool)
        while True:
            order = np.argsort(far, 1)[:, :breadth]
            best, far, done = best[rows, order], far[rows, order], done[rows, order]
            todo = np.where(done, np.inf, far)
            live = np.isfinite(todo.min(1))
            if not live.any():
                break
            # The four best places not yet left, of every row that has any.
            pick = np.argsort(todo, 1)[:, :4]
            leave = np.isfinite(todo[rows, pick])
            done[rows, pick] = True
            new = self.links[best[rows, pick]].reshape(len(x), -1)
            fresh = np.repeat(leave, self.links.shape[1], 1) & ~seen[rows, new]
            new_far = np.where(fresh, self._far(x, new), np.inf)
            # A centroid met twice in one step counts once.
            order = np.argsort(np.where(fresh, new, n), 1, kind="stable")
            twice = np.zeros(new.shape, bool)
            ordered = np.where(fresh, new, n)[rows, order]
            twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            new_far[rows, order] = np.where(twice, np.inf, new_far[rows, order])
            seen[rows, new] |= fresh
            best, far = np.concatenate([best, new], 1), np.concatenate([far, new_far], 1)
            done = np.concatenate([done, ~np.isfinite(new_far)], 1)
        return best[:, :want], far[:, :want]


def reach(graph: CentroidGraph, held: np.ndarray, x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and lists that each row of ``x`` reads; ``held`` entries a list, at least ``least`` entries a row if there are so many."""
    names, far = graph.search(x, PROBES, BREADTH)
    found = np.isfinite(far)
    sums = np.where(found, held[names], 0).cumsum(1)
    enough = sums[:, -1] >= least
    last = far[np.arange(len(x)), np.maximum((sums >= least).argmax(1), np.minimum(LEAST, found.sum(1)) - 1)]
    keep = found & enough[:, None] & (far <= RATIO**2 * last[:, None])
    row, col = np.nonzero(keep)
    rows, lists = [row], [names[row, col]]
    short = np.flatnonzero(~enough)
    if len(short):
        # The lists that the graph found are too small: all lists by distance, until they hold enough.
        order = np.argsort(graph._far(x[short], None), 1, kind="stable")
        sums = held[order].cumsum(1)
        at, col = np.nonzero(sums - held[order] < least)
        rows.append(short[at])
        lists.append(order[at, col])
    return np.concatenate(rows), np.concatenate(lists)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v of the rows that take part."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(finite)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0][0] if sizes else 0)).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of each query row, itself left out."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    classes = common.cut(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("least", F.col("ids")[0]).withColumn("class", F.xxhash64("v", "least")))
    n, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r[0] for r in classes.orderBy(F.xxhash64("class")).limit(SAMPLE).select("v").collect()])
    lists = int(min(MAX_LISTS, max(1, n // LIST)))
    graph = spark.sparkContext.broadcast(CentroidGraph(fit(lift(sample, longest), lists)))
    dim = sample.shape[1]

    def matrix(column: pa.ListArray) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def spread(held: Broadcast | None = None):
        schema = pa.schema([("list", pa.int64()), ("class", pa.int64()), ("least", pa.int64()), ("v", pa.list_(pa.float64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("v"))
                for a in range(0, len(x), 256):
                    part = x[a : a + 256]
                    if held is not None:
                        row, names = reach(graph.value, held.value, np.concatenate([part, np.zeros((len(part), 1))], 1), least)
                    else:
                        names, far = graph.value.search(lift(part, longest), COPIES, 4 * COPIES)
                        keep = far <= SPREAD**2 * far[:, :1]
                        keep &= np.isfinite(far)
                        row, col = np.nonzero(keep)
                        names = names[row, col]
                    take = pa.array(row + a)
                    yield common.batch_of(schema, list=names, **{"class": batch.column("class").take(take)}, least=batch.column("least").take(take), v=batch.column("v").take(take))

        return run

    places = "list long, class long, least long, v array<double>"
    common.small_batches(classes)
    postings = common.cut(classes.select("class", "least", "v").mapInArrow(spread(), places))
    asked = queries.select(F.col(id_col).cast("long").alias("query_id")).join(rows.withColumnRenamed("vec_id", "query_id"), "query_id").distinct()
    askers = common.cut(asked.join(classes.select("class", "least", "v"), "v").select("query_id", "class", "least", "v"))
    # A vector is in at most COPIES lists, so that many entries hold at least this many distinct vectors.
    least = COPIES * SEVERAL * (k + 1)
    sizes = np.zeros(lists, np.int64)
    for r in postings.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    probes = askers.select("class", "least", "v").dropDuplicates(["class"]).mapInArrow(spread(spark.sparkContext.broadcast(sizes)), places)
    parts = postings.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    left = probes.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "class", "v")
    right = postings.join(parts, "list").select("list", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"), "class", "least", "v")
    found_schema = pa.schema([("query", pa.int64()), ("class", pa.int64()), ("least", pa.int64()), ("near", pa.float64())])

    def compare(q: pa.Table, p: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if q.num_rows and p.num_rows:
            queries_, posted = (t["v"].combine_chunks() for t in (q, p))
            q_ids, p_ids, smallest = q["class"].to_numpy(), p["class"].to_numpy(), p["least"].to_numpy()
            x, y = matrix(queries_), matrix(posted)
            most = min(k + 1, len(y))
            # Twice what two sums of the same products, in any two orders, can differ by.
            slack = 8 * dim * np.finfo(float).eps * np.sqrt((x**2).sum(1) * (y**2).sum(1).max())
            for a in range(0, len(x), ASKED):
                near = x[a : a + ASKED] @ y.T
                last = np.partition(near, len(y) - most, 1)[:, len(y) - most]
                row, col = np.nonzero(near >= (last - slack[a : a + ASKED])[:, None])
                near = np.zeros(len(row))
                for d in range(dim):
                    near += x[a + row, d] * y[col, d]
                order = np.lexsort((smallest[col], -near, row))
                first = np.searchsorted(row, np.arange(len(x[a : a + ASKED])))
                best = order[np.arange(len(row)) - first[row] < most]
                for column, values in zip(out, (q_ids[a + row[best]], p_ids[col[best]], smallest[col[best]], near[best]), strict=True):
                    column.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(out, found_schema, strict=True)], schema=found_schema)

    pairs = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInArrow(compare, "query long, class long, least long, near double")
    # The same pair may come from several lists, each time with the same numbers.
    pairs = pairs.groupBy("query", "class").agg(F.max("near").alias("near"), F.min("least").alias("least"))
    pairs = pairs.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "least", "class"))).where(F.col("at") <= k + 1)
    exact = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    named = pairs.join(classes.select("class", "v", "ids"), "class").join(classes.select(F.col("class").alias("query"), F.col("v").alias("q")), "query")
    entry = F.struct((-exact).alias("minus"), F.col("id").alias("vec_id"))
    best = named.select("query", F.explode("ids").alias("id"), "q", "v").groupBy("query").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("best"))
    mine = askers.select("query_id", F.col("class").alias("query")).join(best, "query")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.minus")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
