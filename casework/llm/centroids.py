"""Clustering of integer vectors around moving centroids, exactly (k-means with ns-bounds).

The state of a vector is written once: its cluster, its exact distance to every centroid, and the
round in which these were taken.  All centroids of all rounds are kept on the driver (``K`` vectors
a round).  In a later round a stored distance is loosened by the length of the whole way that the
centroid has gone since that round, start to end, which is never longer than the sum of its steps.
A vector whose own centroid, so loosened, is still surely nearer than every other stays; the others
are measured again, in integers.  Sums of a cluster change only by the vectors that left or joined
it, so a round reads the table once and brings ``K`` rows of sums to the driver.

The state is written again only after a round in which more than ``REWRITE`` of the vectors had to
be measured; the older table is then removed.  When that happens decides the cost only.

Defined results: vectors that are null, have another number of components, or a null or non-finite
one, have no row.  A component beyond 2^27 after scaling counts as 2^27, so that every distance fits
a long.  Null ids come last among the first centroids, equal ids in the order of their vectors; equal
rows count each.  With fewer than ``K`` vectors each is a centroid; an empty table gives an empty
table; columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from casework.llm.work import dropped, stored, stored_at

K = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = "3"
#: Share of the vectors measured in a round beyond which the state is written again.
REWRITE = 0.1
#: Greatest component after scaling.
MOST = 1 << 27


def integers(rows: DataFrame, vec_id: str, embedding: str, dims: int) -> DataFrame:
    """``vec_id, vec`` of the vectors that count; ``vec`` has the components as 32-bit integers."""
    fit = (F.size(embedding) == dims) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.coalesce(fit, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(x * SCALE), -MOST, MOST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(whole.reshape(-1, dims))], names=["vec_id", "vec"])

    return kept.mapInArrow(run, f"vec_id {kind}, vec BINARY")


def _packed(values: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    width = values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 1), np.int64)


def distances(vecs: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to each centroid, in integers."""
    out = np.empty((len(vecs), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        away = vecs - c
        out[:, j] = np.einsum("ij,ij->i", away, away)
    return out


def unsure(cluster: np.ndarray, far: np.ndarray, taken: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Whether a vector may have left its cluster: stored distances ``far`` of round ``taken`` against the last centroids."""
    now = history[-1]
    way = np.array([np.sqrt(((now - then).astype(float) ** 2).sum(1)) for then in history])[taken]
    row, root = np.arange(len(cluster)), np.sqrt(far.astype(float))
    upper = (root[row, cluster] + way[row, cluster])[:, None]
    # Far above what rounding can do, so that a tie is never taken for sure.
    slack = 1e-9 * (root + way + upper + 1)
    sure = root - way - slack > upper
    sure[row, cluster] = True
    return ~sure.all(1)


def _first(state_kind: str, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(_matrix(batch.column(1), "<i4"), centroids)
            cluster = far.argmin(1).astype(np.int32)
            rows = [batch.column(0), batch.column(1), pa.array(cluster), pa.array(cluster), _packed(far), pa.array(np.zeros(len(far), np.int32))]
            yield pa.RecordBatch.from_arrays(rows, names=state_kind)

    return run


STATE = ["vec_id", "vec", "cluster", "was", "far", "taken"]


def _tested(batch: pa.RecordBatch, history: list[np.ndarray]) -> tuple:
    """Old and new cluster, stored distances, the rows measured again and their vectors and distances."""
    old, taken = (batch.column(STATE.index(c)).to_numpy() for c in ("cluster", "taken"))
    far = _matrix(batch.column(STATE.index("far")), "<i8").reshape(len(old), -1)
    again = np.flatnonzero(unsure(old, far, taken, history)) if len(old) else np.zeros(0, np.int64)
    vecs = _matrix(batch.column(STATE.index("vec")).take(pa.array(again)), "<i4")
    exact = distances(vecs, history[-1])
    new = old.copy()
    new[again] = exact.argmin(1) if len(again) else 0
    return old, new, far, again, vecs, exact


def _rewritten(history: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, new, far, again, _, exact = _tested(batch, history)
            far, taken = far.copy(), batch.column(STATE.index("taken")).to_numpy().copy()
            far[again], taken[again] = exact, len(history) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new), pa.array(old), _packed(far), pa.array(taken)], names=STATE)

    return run


def _partial(k: int, dims: int, changes):
    """Rows ``cluster, n, measured, sums`` of a task: what its vectors add to each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, measured = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for batch in batches:
            came, left, vecs, checked = changes(batch)
            measured += checked
            for clusters, sign in ((came, 1), (left, -1)):
                if clusters is not None and len(clusters):
                    for j in np.unique(clusters):
                        own = vecs[clusters == j]
                        n[j] += sign * len(own)
                        sums[j] += sign * own.sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array([measured] + [0] * (k - 1), pa.int64()), pa.array(sums.tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "measured", "sums"],
        )

    return run


def _totals(rows: DataFrame, k: int, dims: int, changes) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts and sums of all tasks, one row for each cluster on the driver."""
    parts = rows.mapInArrow(_partial(k, dims, changes), "cluster INT, n BIGINT, measured BIGINT, sums ARRAY<BIGINT>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    n, sums, measured = [0] * k, [[0] * dims for _ in range(k)], 0
    for r in total.collect():
        n[r.cluster], sums[r.cluster] = r.n, [r[f"s{i}"] for i in range(dims)]
        measured += r.measured
    return np.array(n, object), np.array(sums, object), measured


def _middle(before: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """New centroids; an empty cluster keeps its own."""
    out = before.copy()
    for j, count in enumerate(n):
        if count:
            out[j] = [s // count for s in sums[j]]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the least digests."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = vectors.select("vec", F.col("vec_id").isNull().alias("no_id"), mark.alias("mark")).orderBy("no_id", "mark", "vec").limit(k)
    rows = [np.frombuffer(bytes(r.vec), "<i4").astype(np.int64) for r in chosen.collect()]
    return np.array(rows, np.int64)


def clustered(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED, rewrite: float = REWRITE
) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """``vec_id, cluster, distance`` of every vector, the centroids of all rounds, and how many vectors each round measured."""
    spark = rows.sparkSession
    vectors, vectors_path = stored_at(integers(rows, vec_id, embedding, dims), "vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    history = [first_centroids(vectors, k, seed)]
    if not len(history[0]):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), history, []
    k = len(history[0])
    schema = f"vec_id {kind}, vec BINARY, cluster INT, was INT, far BINARY, taken INT"
    state, path = stored_at(vectors.mapInArrow(_first(STATE, history[0]), schema), "state")
    dropped(spark, vectors_path)

    def all_of(batch):
        return batch.column(2).to_numpy(), None, _matrix(batch.column(1), "<i4"), batch.num_rows

    total_n, total, measured = _totals(state, k, dims, all_of)
    # What the vectors add up to by the clusters in the table, and now.
    base_n, base = total_n, total
    looked = [measured]
    for _ in range(rounds):
        history.append(_middle(history[-1], total_n, total))
        if len(history) > rounds:
            break
        if measured > rewrite * sum(base_n):
            was, was_path = state, path
            state, path = stored_at(was.mapInArrow(_rewritten(history), schema), "state")
            dropped(spark, was_path)

            def changed(batch, now=len(history) - 1):
                old, new = batch.column(3).to_numpy(), batch.column(2).to_numpy()
                moved = np.flatnonzero(old != new)
                vecs = _matrix(batch.column(1).take(pa.array(moved)), "<i4")
                return new[moved], old[moved], vecs, int((batch.column(5).to_numpy() == now).sum())

            n, sums, measured = _totals(state, k, dims, changed)
            base_n, base = base_n + n, base + sums
            total_n, total = base_n, base
        else:

            def moves(batch, history=list(history)):
                old, new, _, again, vecs, _ = _tested(batch, history)
                moved = old[again] != new[again]
                return new[again][moved], old[again][moved], vecs[moved], len(again)

            n, sums, measured = _totals(state, k, dims, moves)
            total_n, total = base_n + n, base + sums
        looked.append(measured)

    last = history[-1]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, new, _, _, _, _ = _tested(batch, history)
            away = _matrix(batch.column(1), "<i4") - last[new]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new), pa.array(np.einsum("ij,ij->i", away, away))], names=["vec_id", "cluster", "distance"])

    found = stored(state.mapInArrow(assigned, f"vec_id {kind}, cluster INT, distance BIGINT"), "assigned")
    dropped(spark, path)
    return found, history, looked


def centroid_clusters(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", **options) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that counts."""
    spark: SparkSession = rows.sparkSession
    found, history, _ = clustered(rows, vec_id, embedding, **options)
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in history[-1]]
    own = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # One row for each centroid.
    facts = spark.createDataFrame([(j, own.get(j, 0), sum(own.values()), d) for j, d in enumerate(digests)], "cluster INT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
