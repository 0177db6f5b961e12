"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors become integers, floor(scale * x). Candidates are dealt by length, longest first, and packed into
buckets of similar length, which stay where they are. The queries come to them by broadcast, in passes of at most
PASS_BYTES, counted before. In each pass the bucket of longest vectors first gives every query a score that its k-th best
cannot fall below. From that score, the query's length and a bucket's greatest length comes a local threshold on the
cosine: above one, the query skips the bucket; where it is high, coordinate pruning keeps the vectors whose
largest query coordinates lie in the feasible range; else length pruning keeps the prefix of vectors that
are long enough. What is left is verified by exact integer products, in blocks.

Defined results: vectors that are null, hold a null, NaN or infinite component, or have a null id take no
part; a vector of another dimension than a query is no candidate of it; repeated rows count as rows;
ties go to the smaller id; fewer than k candidates give them all; an empty table gives no rows. Components and scores
beyond 64 bits stand at the nearest number of 64 bits; scores are compared before that, as whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.common import table, written

BUCKET = 2048
#: Queries of a pass, in bytes of their components; and queries that are multiplied together.
PASS_BYTES, BLOCK = 16_000_000, 64
MOST = np.iinfo(np.int64)
#: Local cosine threshold from which coordinates are looked at, and how many.
COORDINATE_FROM, COORDINATES = 0.5, 4
PACKED = "dim int, n int, longest double, payload binary"


def integer_vectors(vectors: DataFrame, scale: float, id_column: str, vector_column: str) -> DataFrame:
    chosen = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x"))
    finite = "id is not null and x is not null and size(x) > 0 and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('Infinity'))"
    whole = chosen.where(finite).withColumn("x", F.expr(f"transform(x, e -> floor(e * double({scale})))"))
    return whole.withColumn("len2", F.expr("aggregate(x, double(0), (a, e) -> a + double(e) * double(e))"))


def pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, x, len2), in order, as buckets of at most `most` vectors of one dimension."""

    def bucket(dim: int, rows: list[tuple]) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], dtype="<i8")
        x = np.array([r[1] for r in rows], dtype="<i8").reshape(len(rows), dim)
        longest = float(np.sqrt(max(r[2] for r in rows)))
        payload = ids.tobytes() + narrow(x).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([longest]), pa.array([payload], pa.binary())], ["dim", "n", "longest", "payload"])

    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for i, x, len2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = held.setdefault(len(x), [])
            rows.append((i, x, len2))
            if len(rows) == most:
                yield bucket(len(x), held.pop(len(x)))
    for dim, rows in held.items():
        yield bucket(dim, rows)


def narrow(x: np.ndarray) -> np.ndarray:
    """Four bytes a component where all fit."""
    small = not x.size or (x.min() >= -(1 << 31) and x.max() < 1 << 31)
    return x.astype("<i4") if small else x.astype("<i8")


def unpack(dim: int, n: int, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = (len(payload) - 8 * n) // max(1, n * dim)
    return np.frombuffer(payload, "<i8", n), np.frombuffer(payload, f"<i{wide}", n * dim, 8 * n).reshape(n, dim).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where every sum stays below 2**53, else in integers as long as need be."""
    largest = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if largest < 2**62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def survivors(q: np.ndarray, q_length: float, floor: float, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of bucket vectors that may score `floor` or more with q; lengths fall."""
    if floor <= 0 or q_length == 0:
        return np.arange(len(x)) if floor <= 0 else np.zeros(0, dtype=np.int64)
    local = floor / (q_length * lengths[0]) if lengths[0] else np.inf
    if local > 1 + 1e-9:
        return np.zeros(0, dtype=np.int64)
    long_enough = int(np.searchsorted(-lengths, -(floor / q_length) * (1 - 1e-9), side="right"))
    if local < COORDINATE_FROM:
        return np.arange(long_enough)
    unit = q / q_length
    kept = np.arange(long_enough)
    for f in np.argsort(-np.abs(unit))[:COORDINATES]:
        # an angle of at most arccos(local) from q leaves the angle to the axis within that of q's own
        spread = np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - unit[f] * unit[f]))
        low = -np.inf if unit[f] <= -local else unit[f] * local - spread - 1e-9
        high = np.inf if unit[f] >= local else unit[f] * local + spread + 1e-9
        c = x[kept, f] / lengths[kept]
        kept = kept[(c >= low) & (c <= high)]
    return kept


def best(queries: tuple[np.ndarray, np.ndarray], bucket: tuple[np.ndarray, np.ndarray], k: int, floors: list[int | None]) -> list[tuple[int, int, int, int]]:
    """(place of the query, vector id, score) of each query's k best in the bucket, but for those below its floor."""
    (q_ids, q), (ids, x) = queries, bucket
    lengths = np.sqrt(np.einsum("ij,ij->i", x.astype(float), x.astype(float)))
    order = np.lexsort((ids, -lengths))
    ids, x, lengths = ids[order], x[order], lengths[order]
    real, q_real = x.astype(float), q.astype(float)
    q_lengths = np.sqrt(np.einsum("ij,ij->i", q_real, q_real))
    bound = np.array([-np.inf if f is None else float(f) for f in floors])
    # no vector of the bucket can reach the floor: passed over before anything else is looked at
    open_ = np.flatnonzero(bound <= q_lengths * lengths[0] * (1 + 1e-9)) if len(x) else np.zeros(0, dtype=np.int64)
    out = []
    for a in range(0, len(open_), BLOCK):
        part = open_[a : a + BLOCK]
        kept = [survivors(q_real[n], q_lengths[n], bound[n], real, lengths) for n in part]
        union = np.unique(np.concatenate(kept))
        if not len(union):
            continue
        scores = products(q[part], x[union])
        for row, (n, mine) in enumerate(zip(part.tolist(), kept, strict=True)):
            s, c = scores[row, np.searchsorted(union, mine)], ids[mine]
            other = c != q_ids[n]
            s, c = s[other], c[other]
            if len(s) > k and s.dtype != object:
                near = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, c = s[near], c[near]
            for score, other_id in sorted(zip((-s).tolist(), c.tolist(), strict=True))[:k]:
                if floors[n] is None or -score >= floors[n]:
                    out.append((n, other_id, -score))
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding", bucket: int = BUCKET, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each whose id is divisible by `every`."""
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, scale, id_column, vector_column)
    # the id breaks ties of length, so a vector that a third of the rows share is still dealt evenly
    dealt = whole.repartitionByRange(F.col("len2").desc(), F.col("id")).sortWithinPartitions(F.col("len2").desc(), F.col("id"))
    buckets = written(dealt.mapInArrow(lambda batches: pack(batches, bucket), PACKED), "buckets")
    # of each dimension the bucket of the longest vectors
    first = buckets.groupBy("dim").agg(F.max_by(F.struct("n", "payload"), F.struct("longest", "n")).alias("b")).select("dim", "b.n", "b.payload")
    asked = whole.where(f"id % {int(every)} = 0").select("id", "x")
    size = asked.agg(F.sum(8 * (F.size("x") + 1))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    found = [one_pass(spark, asked.where(F.pmod(F.xxhash64("id", "x"), F.lit(passes)) == n), first, buckets, k) for n in range(passes)]
    if passes > 1:  # each pass has been a scan of its own by now
        found = [written(x, "pass") for x in found]
    return reduce(DataFrame.union, found)


def one_pass(spark: SparkSession, asked: DataFrame, first: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The k best of some queries, whose size the caller bounds."""
    by_dim: dict[int, list] = {}
    for r in asked.collect():
        by_dim.setdefault(len(r.x), []).append((r.id, r.x))
    held = {d: (np.array([i for i, _ in rows], dtype=np.int64), np.array([x for _, x in rows], dtype=np.int64)) for d, rows in by_dim.items()}
    queries = spark.sparkContext.broadcast(held)

    def meet(batches: Iterator[pa.RecordBatch], floors: dict[int, list]) -> Iterator[tuple[int, np.ndarray, list]]:
        for batch in batches:
            for row in batch.to_pylist():
                own = queries.value.get(row["dim"])
                if own is not None:
                    yield row["dim"], own[0], best(own, unpack(row["dim"], row["n"], row["payload"]), k, floors.get(row["dim"]) or [None] * len(own[0]))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, rows in meet(batches, {}):
            scores: dict[int, list[int]] = {}
            for n, _, s in rows:
                scores.setdefault(n, []).append(s)
            least = [(n, str(min(x))) for n, x in scores.items() if len(x) == k]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(least), pa.int32()), pa.array([n for n, _ in least], pa.int32()), pa.array([x for _, x in least], pa.string())], ["dim", "place", "floor"])

    least: dict[int, list] = {d: [None] * len(ids) for d, (ids, _) in held.items()}
    for r in first.mapInArrow(start, "dim int, place int, floor string").collect():  # a row for each query of the pass at most
        least[r.dim][r.place] = int(r.floor)
    floors = spark.sparkContext.broadcast(least)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, rows in meet(batches, floors.value):
            whose = [int(ids[n]) for n, _, _ in rows]
            capped = [min(max(s, MOST.min), MOST.max) for _, _, s in rows]
            # scores of any size are in order as text of their sign, number of digits and digits
            order = [order_of(s) for _, _, s in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(rows), pa.int32()), pa.array([n for n, _, _ in rows], pa.int32()), pa.array(whose, pa.int64()), pa.array([c for _, c, _ in rows], pa.int64()), pa.array(capped, pa.int64()), pa.array(order, pa.string())],
                ["dim", "place", "query_id", "vec_id", "score", "order"],
            )

    best_of = buckets.select("dim", "n", "payload").mapInArrow(verify, "dim int, place int, query_id long, vec_id long, score long, order string")
    ranked = best_of.withColumn("rank", F.row_number().over(W.partitionBy("dim", "place").orderBy(F.col("score").desc(), F.col("order").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def order_of(score: int) -> str:
    """Empty for scores of 64 bits; beyond, text in the order of the numbers."""
    if MOST.min < score < MOST.max:
        return ""
    shifted = score + (1 << 200)
    return f"{shifted:062d}"


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
