"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a neighbour graph is coarsened to communities, these are grown to partitions of nearly equal
size along their links, and single vertices moved under quotas. A softmax classifier over the vector and its closeness to
landmarks learns from each vector in which partitions its neighbours lie.
Every vector of the table goes to its most probable partition; a query goes to as many of its most probable ones as
queries kept out of the fit need, and as many more as it takes to hold enough
vectors; all vectors there are ranked exactly. Partitions are
worked on in blocks, so that one of any size is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakedupes.staging import stage
from lakedupes.unions import union

# Vectors that partitions and classifier are learned from, at most: a share of the table by a hash of vec_id.
SAMPLE_ROWS = 8_192
# The number of partitions follows the table, as far as the sample can tell them apart.
PARTITION_ROWS = 4_000
LEAST_PARTITIONS = 32
SAMPLE_PER_PARTITION = 32
BLOCK_ROWS = 4_096
GRAPH_DEGREE = 10
LANDMARKS = 256
# Sample vectors kept out of the fit, and the recall on them that the calibration asks for.
HELD_OUT = 512
RECALL = 0.97


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Router:
    """The classifier, and the number of partitions that a query visits."""

    weights: np.ndarray
    probes: int = 1
    landmarks: np.ndarray | None = None  # unit vectors, one per column
    floor: float = 0.0  # closeness to a landmark that counts as none

    def inputs(self, x: np.ndarray) -> np.ndarray:
        unit = _unit(x)
        close = [] if self.landmarks is None else [4 * np.maximum(0, unit @ self.landmarks - self.floor)]
        return np.column_stack([unit, *close, np.ones(len(x))])

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = self.inputs(x) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def routed(self, chances: np.ndarray, probes: int, held: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """Which partitions each query visits; further ones until those visited hold ``least`` of the rows ``held``."""
        order = np.argsort(-chances, axis=1, kind="stable")
        visit = np.broadcast_to(np.arange(chances.shape[1]) < probes, chances.shape).copy()
        if held is not None:
            visit |= np.cumsum(held[order], axis=1) - held[order] < least
        out = np.zeros(chances.shape, bool)
        np.put_along_axis(out, order, visit, 1)
        return out


def _near(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k other rows of ``x`` with the largest inner product, for each of ``rows``; in chunks."""
    found = []
    for at in range(0, len(rows), 64):
        own = rows[at:at + 64]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        found.append(np.argpartition(s, -k, axis=1)[:, -k:])
    return np.concatenate(found)


def _moved(label: np.ndarray, links: list[np.ndarray], most: float, rounds: int, random: np.random.Generator) -> np.ndarray:
    """Label propagation: each vertex takes the commonest label of its links that has room below ``most``."""
    label = label.copy()
    size = np.bincount(label)
    for _ in range(rounds):
        moved = 0
        for v in random.permutation(len(label)):
            names, votes = np.unique(label[links[v]], return_counts=True)
            own = label[v]
            room = (size[names] < most) | (names == own)
            if not room.any():
                continue
            names, votes = names[room], votes[room]
            best = int(votes.argmax())
            if names[best] != own and votes[best] > votes[names == own].sum():
                size[own] -= 1
                size[names[best]] += 1
                label[v] = names[best]
                moved += 1
        if moved < len(label) / 100:
            break
    return label


def _balanced(unit: np.ndarray, graph: np.ndarray, parts: int, random: np.random.Generator) -> np.ndarray:
    """A partition of the graph's vertices: communities, joined to parts along their links, refined under quotas."""
    n = len(unit)
    quota = 1.1 * n / parts
    to = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    at = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    order = np.argsort(at, kind="stable")
    links = np.split(to[order], np.cumsum(np.bincount(at, minlength=n))[:-1])
    _, community = np.unique(_moved(np.arange(n), links, max(2.0, quota / 4), 8, random), return_inverse=True)
    size = np.bincount(community)
    middle = np.zeros((len(size), unit.shape[1]))
    np.add.at(middle, community, unit)
    middle = _unit(middle + 1e-12)
    members = np.split(np.argsort(community, kind="stable"), np.cumsum(size)[:-1])
    part = np.full(len(size), -1)
    held = np.zeros(parts)
    for p in range(parts):
        free = part < 0
        if not free.any():
            break
        pull, c = np.zeros(len(size)), int(np.where(free, size, -1).argmax())
        total = np.zeros(unit.shape[1])
        while True:
            part[c], free[c] = p, False
            held[p] += size[c]
            total += size[c] * middle[c]
            pull += np.bincount(community[np.concatenate([links[v] for v in members[c]])], minlength=len(size))
            fits = free & (held[p] + size <= n / parts)
            if not fits.any():
                break
            # Communities without links to the part come by direction.
            score = pull / size + (middle @ total) / np.linalg.norm(total)
            c = int(np.where(fits, score, -np.inf).argmax())
    for c in np.flatnonzero(part < 0)[np.argsort(-size[part < 0], kind="stable")]:
        p = int(held.argmin())
        part[c] = p
        held[p] += size[c]
    return _moved(np.append(part[community], parts - 1), [*links, np.array([], int)], quota, 6, random)[:n]


def learn(x: np.ndarray, parts: int, k: int, total: int | None = None, recall: float = RECALL) -> Router:
    """The router from a sample of a table of ``total`` vectors.

    The sample is thinner than the table, so the ``k`` nearest of a query there are taken for its share of them.
    """
    random = np.random.default_rng(5)
    held = min(HELD_OUT, len(x) // 8)
    if parts < 2 or len(x) - held <= max(k, GRAPH_DEGREE) + 1:
        return Router(np.zeros((x.shape[1] + 1, 1)))
    mixed = random.permutation(len(x))
    fit, kept = x[mixed[held:]], mixed[:held]
    unit = _unit(fit)
    graph = _near(unit, np.arange(len(unit)), GRAPH_DEGREE)
    label = _balanced(unit, graph, parts, random)
    target = np.zeros((len(unit), parts))
    np.add.at(target, (np.arange(len(unit))[:, None], label[graph]), 1 / (2 * GRAPH_DEGREE))
    target[np.arange(len(unit)), label] += 0.5
    landmarks = unit[random.choice(len(unit), min(LANDMARKS, len(unit)), replace=False)].T
    floor = float(np.quantile(unit[:1024] @ landmarks, 0.8))
    router = Router(np.zeros((x.shape[1] + landmarks.shape[1] + 1, parts)), parts, landmarks, floor)
    step = spread = 0.0
    for i in range(1, 301):  # Adam
        rows = random.integers(len(fit), size=min(1024, len(fit)))
        slope = router.inputs(fit[rows]).T @ (router.chances(fit[rows]) - target[rows]) / len(rows)
        step, spread = 0.9 * step + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        router.weights = router.weights - 0.1 * (1 - i / 400) * (step / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.99**i)) + 1e-8)
    chances = router.chances(x)
    home = chances.argmax(axis=1)
    share = max(4, ceil(k * min(1.0, len(x) / (total or len(x)))))
    places = home[_near(x, kept, min(share, len(x) - 1))]
    rank = np.argsort(np.argsort(-chances[kept], axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, places, 1).ravel())
    router.probes = 1 + int(needed[ceil(recall * len(needed)) - 1])
    return router


def _proper(size: int) -> Column:
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        F.col("vec_id").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(-1)) == size) & finite
        & F.exists("embedding", lambda v: v != 0)
    )


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _best(queries: pa.Table, rows: pa.Table, size: int, k: int) -> pa.Table:
    """The k nearest of one block of vectors for each query of one block."""
    q_ids, r_ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
    q, r = _matrix(queries["embedding"], size), _matrix(rows["embedding"], size)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 256):
        scores = q[at:at + 256] @ r.T
        for i, s in enumerate(scores, at):
            s[r_ids == q_ids[i]] = -np.inf
            m = min(k, len(s))
            cut = np.partition(s, len(s) - m)[len(s) - m]
            # Sums in another order may differ in the last digits: take all that might belong, and decide exactly.
            near = np.flatnonzero((s >= cut - 1e-9 * max(1.0, abs(cut))) & np.isfinite(s))
            exact = (r[near] * q[i]).sum(axis=1)
            order = np.lexsort((r_ids[near], -exact))
            ids, exact = r_ids[near][order], exact[order]
            first = np.sort(np.unique(ids, return_index=True)[1])[:k]
            out.append((np.full(len(first), q_ids[i]), ids[first], exact[first]))
    names = ["query_id", "vec_id", "score"]
    if not out:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query among all rows but its own.

    ``vectors`` has vec_id and embedding. Rows without vec_id, and vectors that are null, zero, of another
    length than most, or hold null or non-finite components take no part. Rows of one vec_id are
    taken for the same vector: one of them, the least, counts. Only a table of fewer than ``k`` other vectors gives fewer; no
    proper row gives none. Equal scores go to the smaller vec_id.
    """
    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "query_id long, rank int, vec_id long, score double"
    usual = narrow.where("size(embedding) > 0").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = usual.size
    proper = narrow.where(_proper(size))
    repeated, again = stage(proper.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if again:
        one = proper.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        proper = union(proper.join(repeated, "vec_id", "left_anti"), one)
    total = proper.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], schema)
    picked = F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / total))
    sample = proper.where(picked).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample_rows)
    x = _matrix(sample.select("embedding").toArrow()["embedding"], size)
    parts = min(max(LEAST_PARTITIONS, ceil(total / PARTITION_ROWS)), max(1, len(x) // SAMPLE_PER_PARTITION))
    router = learn(x, parts, k, total)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                home = router.chances(_matrix(batch.column("embedding"), size)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], ["vec_id", "embedding", "part"])

    kind = "vec_id long, embedding array<double>, part int"
    index, _ = stage(proper.mapInArrow(place, kind))
    held = {r.part: r.n for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows_held = np.array([held.get(p, 0) for p in range(router.weights.shape[1])])

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                chances = router.chances(_matrix(batch.column("embedding"), size))
                # A query may lie in one of its partitions itself.
                row, part = np.nonzero(router.routed(chances, router.probes, rows_held, k + 1))
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part.astype(np.int32))], ["vec_id", "embedding", "part"])

    asked, _ = stage(index.drop("part").where(is_query).mapInArrow(route, kind))
    wanted = {r.part: r.n for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not wanted:
        return vectors.sparkSession.createDataFrame([], schema)

    def blocks(counts: dict[int, int], part: Column) -> Column:
        table = F.create_map(*[F.lit(v) for p in set(held) | set(wanted) for v in (p, max(1, ceil(counts.get(p, 0) / block_rows)))])
        return table[part]

    def block(counts: dict[int, int]) -> Column:
        return F.pmod(F.xxhash64("vec_id"), blocks(counts, F.col("part"))).cast("int")

    every = lambda counts: F.explode(F.sequence(F.lit(0), blocks(counts, F.col("part")) - 1))
    left = asked.where(F.col("part").isin(list(held))).select("*", block(wanted).alias("qb")).select("*", every(held).alias("rb"))
    right = index.where(F.col("part").isin(list(wanted))).select("*", block(held).alias("rb")).select("*", every(wanted).alias("qb"))
    keys = ["part", "qb", "rb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda q, r: _best(q, r, size, k), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
