"""Problem 4: most similar vectors by learned partitions (a balanced neighbour-graph partition and a classifier that routes)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrinium.durable import durable
from scrinium.sampling import bounded_sample

K = 5
DIMENSION = 64
#: A router is fitted on at most so many vectors (a uniform sample by hash); every vector is indexed.
SAMPLE = 16_384
#: Vectors a partition should hold, and sampled vectors it needs at least to be learned.
TARGET, LEARN = 2048, 32
#: Partitions that one router tells apart at most; beyond that each partition is partitioned again by a router of its own.
PARTS = 512
#: Neighbours in the graph of the sample.
DEGREE = 10
#: A query goes to so many of its most probable partitions, at every size of the table.
PROBES = 8
#: Bytes of vectors that a task of the comparison should get.
TASK_BYTES = 16_000_000
#: Rows of a partition that one task compares with as many queries; larger partitions are compared in blocks.
BLOCK = 16_384


def unit_rows(blobs: list[bytes | None], dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """Which blobs are valid vectors (right length, finite, not all zero), and those as unit rows."""
    right = np.fromiter((b is not None and len(b) == 4 * dimension for b in blobs), bool, len(blobs))
    rows = np.frombuffer(b"".join(b for b, ok in zip(blobs, right, strict=True) if ok), "<f4").reshape(-1, dimension).astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt((rows * rows).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    right[np.flatnonzero(right)[~good]] = False
    return right, (rows[good] / norm[good, None]).astype(np.float32)


def graph(rows: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The most similar ``degree`` other rows of each row, by blocks of brute force."""
    out = np.empty((len(rows), degree), np.int32)
    for a in range(0, len(rows), 512):
        near = rows[a : a + 512] @ rows.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 512] = np.argpartition(near, len(rows) - degree, axis=1)[:, len(rows) - degree :]
    return out


def balanced_partition(rows: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """A part of 0..parts-1 for each row, all of about one size, that keeps neighbours together.

    Recursive bisection: the rows, smoothed over their neighbours, are ordered along their main direction and cut in
    proportion; then equally many rows from each side are exchanged while that cuts fewer edges.
    """
    smooth = rows + rows[near].mean(1)
    label = np.zeros(len(rows), np.int32)
    side = np.zeros(len(rows), np.int8)
    todo = [(np.arange(len(rows)), 0, parts)]
    rng = np.random.default_rng(7)
    while todo:
        nodes, first, n = todo.pop()
        if n == 1 or len(nodes) < 2:
            label[nodes] = first
            continue
        x = smooth[nodes] - smooth[nodes].mean(0)
        way = rng.standard_normal(x.shape[1]).astype(np.float32)
        for _ in range(8):
            way = x.T @ (x @ way)
            way /= np.linalg.norm(way) + 1e-12
        order = np.argsort(x @ way, kind="stable")
        left = len(nodes) * (n // 2) // n
        side[nodes[order[:left]]], side[nodes[order[left:]]] = 1, -1
        for _ in range(10):
            gain = -side[nodes] * side[near[nodes]].sum(1)
            a, b = np.flatnonzero(side[nodes] == 1), np.flatnonzero(side[nodes] == -1)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            m = min(len(a), len(b))
            swaps = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2
            if not swaps:
                break
            side[nodes[a[:swaps]]], side[nodes[b[:swaps]]] = -1, 1
        mine = side[nodes]
        side[nodes] = 0
        todo += [(nodes[mine == 1], first, n // 2), (nodes[mine == -1], first + n // 2, n - n // 2)]
    return label


@dataclass
class Router:
    """A multinomial classifier of unit vectors: which partitions hold a vector's neighbours."""

    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = rows @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train_router(rows: np.ndarray, near: np.ndarray, label: np.ndarray, parts: int, epochs: int = 20, batch: int = 512) -> Router:
    """Fit by Adam; a row's target is half its own part, half the parts of its neighbours."""
    rng = np.random.default_rng(11)
    w, b = np.zeros((rows.shape[1], parts), np.float32), np.zeros(parts, np.float32)
    for p in range(parts):  # start from the parts' means
        if (own := label == p).any():
            w[:, p] = 10 * rows[own].mean(0)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    step = 0
    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            i = order[a : a + batch]
            p = Router(w, b).probabilities(rows[i])
            p[np.arange(len(i)), label[i]] -= 0.5
            np.add.at(p, (np.repeat(np.arange(len(i)), near.shape[1]), label[near[i]].ravel()), -0.5 / near.shape[1])
            step += 1
            for x, g, m, v in ((w, rows[i].T @ p / len(i), state[0], state[1]), (b, p.mean(0), state[2], state[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Router(w, b)


def fit(rows: np.ndarray, parts: int) -> Router:
    """Partition the sample ``rows`` into ``parts``, or as many as it can learn, and learn to route."""
    parts = max(1, min(parts, len(rows) // LEARN))
    if parts == 1:
        return Router(np.zeros((rows.shape[1], 1), np.float32), np.zeros(1, np.float32))
    near = graph(rows, min(DEGREE, len(rows) - 1))
    return train_router(rows, near, balanced_partition(rows, near, parts), parts)


@dataclass
class Index:
    """A router, and one more for each of its partitions where there are two levels; their partitions are the leaves."""

    top: Router
    below: list[Router] | None = None

    def __post_init__(self) -> None:
        sizes = [len(r.bias) for r in self.below] if self.below else [1] * len(self.top.bias)
        self.first = np.cumsum([0, *sizes])

    def visits(self, rows: np.ndarray, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home leaf of each row, row, leaf): where each row lies, and every visit of its search."""
        p = self.top.probabilities(rows)
        if self.below is None:
            best = _best(p, probes)
            return p.argmax(1), np.repeat(np.arange(len(rows)), best.shape[1]), best.ravel()
        parts = _best(p, probes)
        row, leaf, chance, home = [], [], [], np.zeros(len(rows), np.int64)
        own = p.argmax(1)
        for b in np.unique(parts):
            here = np.flatnonzero((parts == b).any(1))
            q = self.below[b].probabilities(rows[here])
            mine = own[here] == b
            home[here[mine]] = self.first[b] + q[mine].argmax(1)
            best = _best(q, probes)
            row.append(np.repeat(here, best.shape[1]))
            leaf.append(self.first[b] + best.ravel())
            chance.append((np.take_along_axis(q, best, 1) * p[here, b][:, None]).ravel())
        row, leaf, chance = np.concatenate(row), np.concatenate(leaf), np.concatenate(chance)
        order = np.lexsort((-chance, row))
        row, leaf = row[order], leaf[order]
        start = np.searchsorted(row, np.arange(len(rows)))
        kept = np.arange(len(row)) - start[row] < probes
        return home, row[kept], leaf[kept]


def _best(p: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most probable columns of each row."""
    most = min(most, p.shape[1])
    return np.argpartition(-p, most - 1, axis=1)[:, :most] if most < p.shape[1] else np.broadcast_to(np.arange(most), p.shape)


def _nearest(queries: np.ndarray, qid: np.ndarray, base: np.ndarray, bid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the k nearest base rows of each query but itself; id -1 where there are fewer."""
    ids, sims = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -2, np.float32)
    order = np.argsort(bid, kind="stable")
    base, bid = base[order], bid[order]
    take = min(k + 1, len(base))
    for a in range(0, len(queries), 1024):
        near = queries[a : a + 1024] @ base.T
        best = np.argpartition(-near, take - 1, axis=1)[:, :take] if take < len(base) else np.broadcast_to(np.arange(len(base)), near.shape)
        value, who = np.take_along_axis(near, best, 1), bid[best]
        value = np.where(who == qid[a : a + 1024, None], -3, value)
        pick = np.lexsort((who, -value), axis=1)[:, :k]
        value, who = np.take_along_axis(value, pick, 1), np.take_along_axis(who, pick, 1)
        ids[a : a + 1024, : pick.shape[1]], sims[a : a + 1024, : pick.shape[1]] = np.where(value > -2.5, who, -1), value
    return ids, sims


_VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType())])
_PLACES = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("b", "i", "j")), T.StructField("q", T.IntegerType()), *_VECTORS.fields])
_FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.LongType()), T.StructField("sim", T.FloatType())])


def valid_vectors(df: DataFrame, key: str = "id", vector: str = "vettore", dimension: int = DIMENSION) -> DataFrame:
    """(id, v): valid vectors as unit rows of float32; null, of another length, all zero and not finite ones are left out."""
    rows = df.filter(F.octet_length(vector) == 4 * dimension).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, unit = unit_rows(batch.column(1).to_pylist(), dimension)
            ids = batch.column(0).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in unit], pa.binary())], names=["id", "v"])

    return rows.filter("id IS NOT NULL").mapInArrow(work, _VECTORS)


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dimension)


def _sampled(rows: DataFrame, sizes: dict[int, int], part) -> DataFrame:
    """(part, v): of each part about ``SAMPLE`` rows, by hash; ``part`` numbers the rows of a matrix."""
    names = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("v", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column(1).to_pylist()
            at = part(np.frombuffer(b"".join(blobs), np.float32).reshape(batch.num_rows, -1))
            share = np.array([xxhash.xxh3_64_intdigest(x) for x in blobs]) / 2.0**64
            kept = np.flatnonzero(share < np.array([SAMPLE / sizes[int(b)] for b in at]))
            yield pa.RecordBatch.from_arrays([pa.array(at[kept].astype(np.int32)), batch.column(1).take(pa.array(kept))], names=["part", "v"])

    return rows.mapInArrow(work, names)


def fitted_index(distinct: DataFrame, total: int, dimension: int = DIMENSION, sample: int = SAMPLE, target: int = TARGET, parts: int = PARTS) -> Index:
    """The index of ``total`` distinct vectors (id, v).

    Up to ``target * parts`` vectors one router is enough.  Beyond that there are two levels, of the square root of the
    number of leaves each, so that leaves stay near ``target``; the routers of the second level are fitted side by side,
    each on a bounded sample of its own partition.  At most ``parts * parts`` leaves; what is over that makes them grow.
    """
    spark = distinct.sparkSession
    some = bounded_sample(distinct, "id", sample, total).toArrow() if total else None
    rows = _matrix(some.column("v"), dimension) if total else np.zeros((0, dimension), np.float32)
    leaves = max(1, -(-total // target))
    if leaves <= parts:
        return Index(fit(rows, leaves))
    top = fit(rows, min(parts, int(np.ceil(np.sqrt(leaves)))))
    n = len(top.bias)
    held = spark.sparkContext.broadcast(top)
    part = lambda m: held.value.probabilities(m).argmax(1)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n, np.int64)
        for batch in batches:
            if batch.num_rows:
                count += np.bincount(part(_matrix(batch.column(1), dimension)), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(count)], names=["b", "c"])

    sizes = {r.b: r.c for r in distinct.select("id", "v").mapInArrow(tally, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).collect()}

    def learn(group: pa.Table) -> pa.Table:
        b = group.column("part")[0].as_py()
        own = fit(_matrix(group.column("v").slice(0, 2 * SAMPLE), dimension), min(parts, -(-sizes[b] // target)))
        return pa.table({"part": group.column("part").slice(0, 1), "w": pa.array([own.weights.astype(np.float32).tobytes()], pa.binary()), "b": pa.array([own.bias.astype(np.float32).tobytes()], pa.binary())})

    learned = _sampled(distinct.select("id", "v"), sizes, part).groupBy("part").applyInArrow(learn, "part int, w binary, b binary").collect()
    below = [Router(np.zeros((dimension, 1), np.float32), np.zeros(1, np.float32)) for _ in range(n)]
    for r in learned:
        below[r.part] = Router(np.frombuffer(r.w, np.float32).reshape(dimension, -1), np.frombuffer(r.b, np.float32))
    return Index(top, below)


def nearest_vectors(df: DataFrame, key: str = "id", vector: str = "vettore", k: int = K, dimension: int = DIMENSION, sample: int = SAMPLE, target: int = TARGET, parts: int = PARTS, probes: int = PROBES) -> DataFrame:
    """(id, vicino, somiglianza): the k most similar other rows of each row with a valid vector, by cosine.

    Equal vectors are one vector with several ids, so a hot vector is no hot group.  The index is fitted on bounded
    samples and holds all; a row is compared with all rows of the ``probes`` leaves it is routed to, so each vector has
    about ``probes`` copies at any size of the table.  A leaf over ``BLOCK`` rows or visits is compared in blocks, each with
    each, so no task gets more than two blocks.  Ties go to the smaller id; rows repeated under one id count once; invalid
    and null vectors have no neighbours and are none.
    """
    spark = df.sparkSession
    vectors = valid_vectors(df, key, vector, dimension)
    # one row for equal vectors; partial aggregation runs before the shuffle
    distinct = durable(vectors.groupBy("v").agg(F.min("id").alias("id"), F.max("id").alias("last")))
    total = distinct.count()
    index = fitted_index(distinct.select("id", "v"), total, dimension, sample, target, parts)
    held = spark.sparkContext.broadcast(index)  # at most 4 * (dimension + 1) * parts * (parts + 1) bytes
    leaves = int(index.first[-1])

    # how many blocks a leaf needs, for those that need more than one: at most one for each BLOCK visits
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, leaves), np.int64)
        for batch in batches:
            if batch.num_rows:
                home, _, leaf = held.value.visits(_matrix(batch.column(1), dimension), probes)
                n[0] += np.bincount(home, minlength=leaves)
                n[1] += np.bincount(leaf, minlength=leaves)
        any_ = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(any_.astype(np.int32)), pa.array(n[0][any_]), pa.array(n[1][any_])], names=["b", "rows", "queries"])

    counts = distinct.select("id", "v").mapInArrow(tally, "b int, rows long, queries long").groupBy("b").agg(F.sum("rows").alias("rows"), F.sum("queries").alias("queries"))
    large = sorted((r.b, -(-r.rows // BLOCK), -(-r.queries // BLOCK)) for r in counts.filter((F.col("rows") > BLOCK) | (F.col("queries") > BLOCK)).collect())
    table = np.array(large, np.int64).reshape(-1, 3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, row, leaf = held.value.visits(_matrix(batch.column(1), dimension), probes)
            # a query to the leaf that it lies in is one row with its vector
            both = (leaf == home[row]) & ~np.isin(leaf, table[:, 0])
            alone = np.setdiff1d(np.arange(len(home)), row[both])
            at, b = np.concatenate([alone, row]), np.concatenate([home[alone], leaf])
            kind = np.concatenate([np.zeros(len(alone), np.int32), np.where(both, 2, 1)])
            asks = kind > 0
            own = np.zeros((2, len(at)), np.int64)
            other = np.ones((2, len(at)), np.int64)
            if len(table):
                k = np.minimum(np.searchsorted(table[:, 0], b), len(table) - 1)
                size = np.where((table[k, 0] == b)[:, None], table[k, 1:], 1)
                mixed = (batch.column(0).to_numpy().astype(np.uint64)[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = np.stack([mixed.astype(np.int64) % np.maximum(size[:, 0], 1), mixed.astype(np.int64) % np.maximum(size[:, 1], 1)])
                other = np.maximum(size.T, 1)
            # a row lies in its block i and meets all blocks j of queries; a query the other way round
            times = np.where(asks, other[0], other[1])
            many = np.repeat(np.arange(len(at)), times)
            turn = np.arange(len(many)) - np.repeat(np.cumsum(times) - times, times)
            i, j = np.where(asks[many], turn, own[0][many]), np.where(asks[many], own[1][many], turn)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (b[many], i, j)), pa.array(kind[many].astype(np.int32)), *(batch.column(c).take(pa.array(at[many])) for c in (0, 1))], names=_PLACES.names)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, total * (probes + 1) * (4 * dimension + 24) // TASK_BYTES))
    units = distinct.select("id", "v").mapInArrow(place, _PLACES).repartition(tasks, "b", "i", "j")

    def compare(group: pa.Table) -> pa.Table:
        kind = group.column("q").to_numpy()
        asks, lies = kind > 0, kind != 1
        ids, rows = group.column("id").to_numpy(), _matrix(group.column("v"), dimension)
        if not lies.any() or not asks.any():
            return pa.table({"id": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "sim": pa.array([], pa.float32())})
        who, sims = _nearest(rows[asks], ids[asks], rows[lies], ids[lies], k)
        got = who.ravel() >= 0
        return pa.table({"id": np.repeat(ids[asks], k)[got], "y": who.ravel()[got], "sim": sims.ravel()[got]})

    found = units.groupBy("b", "i", "j").applyInArrow(compare, _FOUND)
    # a query's results from all its partitions; a handful of rows each
    best = lambda n: F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("far"), F.col("y")))), 1, n)
    merged = found.groupBy("id").agg(best(k).alias("near"))
    return _expanded(vectors, distinct, merged, k)


def _expanded(vectors: DataFrame, distinct: DataFrame, merged: DataFrame, k: int) -> DataFrame:
    """From distinct vectors back to all ids: those with an equal vector come first, at most k + 1 of any vector are needed."""
    several = distinct.filter("last > id").select("v", F.col("id").alias("rep"))
    members = vectors.join(several, "v").select("rep", "id").distinct()
    first = members.withColumn("r", F.row_number().over(_by_rep())).filter(F.col("r") <= k + 1).select("rep", F.col("id").alias("other"))
    reach = merged.select("id", F.explode("near").alias("x")).select("id", F.col("x.y").alias("y"), F.col("x.far").alias("far"))
    reach = reach.join(first, reach.y == first.rep, "left").select("id", F.coalesce("other", "y").alias("y"), "far")
    reach = reach.unionByName(first.select(F.col("rep").alias("id"), F.col("other").alias("y"), F.lit(-1.0).cast("float").alias("far")))
    lists = reach.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "y"))), 1, k + 1).alias("near"))
    lists = lists.join(members.withColumnRenamed("id", "own"), lists.id == members.rep, "left").select(F.coalesce("own", "id").alias("id"), "near")
    rows = lists.select("id", F.explode(F.slice(F.filter("near", lambda x: x["y"] != F.col("id")), 1, k)).alias("x"))
    return rows.select("id", F.col("x.y").alias("vicino"), (-F.col("x.far")).alias("somiglianza"))


def _by_rep():
    from pyspark.sql import Window

    return Window.partitionBy("rep").orderBy("id")


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, where at least one is among the other's most similar."""
    return near.select(F.least("id", "vicino").alias("id_a"), F.greatest("id", "vicino").alias("id_b")).distinct()
