"""Vector code compression: product codes by Hamerly's form of Lloyd's rounds, in whole numbers.

Components become floor(scale * x) and a vector is cut into PARTS consecutive parts, each with a codebook of at most
ENTRIES entries, that start as the parts of the vectors of smallest id. With each vector go, from round to round, its
indexes and for each part an upper bound on the distance to its entry and a lower bound on that to the second nearest.
When entries move, the bounds move with them. Only where the upper is not strictly below the lower (or below half the
way from the entry to its nearest neighbour) is the distance to the own entry taken anew, and if that is not enough all
entries are looked at, in whole numbers; so equal distances always end at the lower index. Bounds are rounded outwards.

A round is one pass that assigns, written to the shared folder, and one that adds up parts by entry in each task; what
reaches the driver are the sums of PARTS * ENTRIES entries. Codebooks go to the tasks by broadcast: their size is that
of ENTRIES vectors, whatever the table has.

Defined results: a vector that is null or holds a null, NaN or infinite component is left out; so is one of another
dimension than the vector of smallest id. Dimensions that four does not divide are cut at i * dimension // 4. Rows of one id
are rows of their own, ordered by their components where the 256 smallest are taken; null ids come last. Fewer vectors
than entries make smaller codebooks. Components of any size are exact; an error beyond 64 bits stands at the largest
number of 64 bits. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import few, release, run_of_tables, small_batches, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to all entries are held together.
ROWS = 2048
MOST = (1 << 63) - 1
#: Room for the rounding of square roots and of sums of bounds.
WIDER = 1e-9


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python's own where these would not do."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not x.size or np.abs(scaled).max() < 2**53:
        return scaled.astype(np.int64)
    flat = [int(math.floor(v * scale)) if abs(v) < 2**43 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(x.shape)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry, exactly: in floating point while every sum stays below 2**53."""
    bound = x.shape[1] * (largest(x) + largest(entries)) ** 2
    if bound < 2**53:
        a, b = x.astype(float), entries.astype(float)
        squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
        return (squares - 2 * (a @ b.T)).astype(np.int64)
    kind = np.int64 if bound < 2**62 else object
    apart = x.astype(kind)[:, None, :] - entries.astype(kind)[None, :, :]
    return (apart * apart).sum(axis=2)


def own_distance(x: np.ndarray, entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    kind = np.int64 if x.shape[1] * (largest(x) + largest(entries)) ** 2 < 2**62 else object
    apart = x.astype(kind) - entries.astype(kind)[at]
    return (apart * apart).sum(axis=1)


def roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots, rounded outwards."""
    if squares.dtype == object:
        found = np.array([float(math.isqrt(int(s)) + up) for s in squares.ravel().tolist()]).reshape(squares.shape)
    else:
        found = np.sqrt(squares.astype(float))
    return found * (1 + WIDER if up else 1 - WIDER)


class Codebooks:
    """The entries of each part, how far each moved in the last round, and half the way to its nearest neighbour."""

    def __init__(self, entries: list[np.ndarray], before: list[np.ndarray] | None = None):
        self.entries = entries
        self.moved, self.half = [], []
        for k, now in enumerate(entries):
            every = np.arange(len(now))
            self.moved.append(roots(own_distance(before[k], now, every), True) if before else np.zeros(len(now)))
            near = distances(now, now).astype(object)
            near[every, every] = None
            self.half.append(np.array([math.inf if len(now) < 2 else float(roots(np.array([min(d for d in row if d is not None)], dtype=object), False)[0]) / 2 for row in near.tolist()]))

    def bounds(self) -> list[int]:
        return [0, *np.cumsum([e.shape[1] for e in self.entries]).tolist()]


def assign_part(x: np.ndarray, book: Codebooks, k: int, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Brings at, upper and lower of one part up to the moved entries, in place; the number of rows that were scanned in full."""
    entries, moved, half = book.entries[k], book.moved[k], book.half[k]
    # the farthest move of any entry but the own one
    first = int(np.argmax(moved))
    second = np.delete(moved, first).max(initial=0.0)
    upper += moved[at]
    upper *= 1 + WIDER
    lower -= np.where(at == first, second, moved[first])
    lower -= np.abs(lower) * WIDER
    lower[np.isnan(lower)] = -np.inf
    limit = np.maximum(lower, half[at])
    open_ = np.flatnonzero(~(upper < limit))
    if not len(open_):
        return 0
    upper[open_] = roots(own_distance(x[open_], entries, at[open_]), True)
    open_ = open_[~(upper[open_] < limit[open_])]
    for a in range(0, len(open_), ROWS):
        rows = open_[a : a + ROWS]
        apart = distances(x[rows], entries)
        best = np.argmin(apart, axis=1)  # the first of equal ones
        at[rows] = best
        upper[rows] = roots(apart[np.arange(len(rows)), best], True)
        lower[rows] = roots(np.sort(apart, axis=1)[:, 1], False) if len(entries) > 1 else np.inf
    return len(open_)


def vectors_of(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def packed(values: np.ndarray, kind: str) -> pa.Array:
    """Each row as bytes."""
    raw = np.ascontiguousarray(values.astype(kind))
    return pa.array([row.tobytes() for row in raw], pa.binary())


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).copy()


def assigned(state: DataFrame, books, scale: int) -> DataFrame:
    """state with its indexes and bounds brought up to the codebooks (a broadcast)."""
    names = [f.name for f in state.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        bounds = book.bounds()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(vectors_of(batch.column(2)), scale)
            at, near = unpacked(batch.column(3), "<i2").astype(np.int64), unpacked(batch.column(4), "<f8")
            for k in range(len(book.entries)):
                at_k, upper, lower = at[:, k].copy(), near[:, 2 * k].copy(), near[:, 2 * k + 1].copy()
                assign_part(x[:, bounds[k] : bounds[k + 1]], book, k, at_k, upper, lower)
                at[:, k], near[:, 2 * k], near[:, 2 * k + 1] = at_k, upper, lower
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed(at, "<i2"), packed(near, "<f8")], names)

    return state.mapInArrow(run, state.schema)


def moved(state: DataFrame, held, scale: int) -> list[np.ndarray]:
    """The entries at the floors of their parts' means; those that nothing is assigned to stay. held: a broadcast of Codebooks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = held.value
        bounds, sums = book.bounds(), [np.zeros(e.shape, dtype=object) for e in book.entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in book.entries]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(vectors_of(batch.column(2)), scale)
            at = unpacked(batch.column(3), "<i2").astype(np.int64)
            small = x.dtype != object and largest(x) * len(x) < 2**62
            for k, entries in enumerate(book.entries):
                here = np.zeros(entries.shape, dtype=np.int64 if small else object)
                np.add.at(here, at[:, k], x[:, bounds[k] : bounds[k + 1]])
                sums[k] += here
                counts[k] += np.bincount(at[:, k], minlength=len(entries))
        used = [(k, e) for k, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        columns = [[k for k, _ in used], [e for _, e in used], [int(counts[k][e]) for k, e in used], [[str(v) for v in sums[k][e].tolist()] for k, e in used]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "entry", "n", "sums"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].sum())
        means = [str(sum(map(int, column)) // n) for column in zip(*rows["sums"], strict=True)]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "entry": rows["entry"].iloc[:1], "means": [means]})

    # a row for each task and entry, whose sums are of any size
    each = state.mapInArrow(add, "part int, entry int, n long, sums array<string>").groupBy("part", "entry").applyInPandas(total, "part int, entry int, means array<string>")
    entries = [e.astype(object) for e in held.value.entries]
    for r in each.collect():  # PARTS * ENTRIES rows at most
        entries[r.part][r.entry] = [int(v) for v in r.means]
    return [narrow(e) for e in entries]


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if largest(x) < 2**53 else x


def errors(state: DataFrame, books, scale: int) -> DataFrame:
    """vec_id, label, code, error of the assigned state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        bounds = book.bounds()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(vectors_of(batch.column(2)), scale)
            at = unpacked(batch.column(3), "<i2").astype(np.int64)
            found = sum(own_distance(x[:, bounds[k] : bounds[k + 1]], e, at[:, k]).astype(object) for k, e in enumerate(book.entries))
            code = ["".join(f"{i:02x}" for i in row) for row in at.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array([min(int(v), MOST) for v in found], pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    return state.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error as a written table; the final codebooks)."""
    spark = vectors.sparkSession
    small_batches(spark)
    vector = F.col(f"`{vector_column}`")
    finite: Column = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{label_column}`").alias("label"), vector.alias("x")).where(finite)
    first = rows.select("vec_id", F.col("x").cast("array<double>").alias("x")).orderBy(F.col("vec_id").asc_nulls_last(), "x")
    smallest = first.limit(1).collect()
    if not smallest:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    dim = len(smallest[0].x)
    rows = rows.where(F.size("x") == dim)
    begun = whole(np.array([r.x for r in first.where(F.size("x") == dim).limit(entries).collect()], dtype=float), scale)
    cuts = [i * dim // parts for i in range(parts + 1)]
    book = Codebooks([narrow(begun[:, a:b]) for a, b in zip(cuts, cuts[1:])])
    # nothing is known before the first round: every bound fails
    unknown = np.array([[np.inf, -np.inf] * parts]).astype("<f8").tobytes()
    with run_of_tables() as made:
        state = rows.select("vec_id", "label", "x", F.lit(bytes(2 * parts)).alias("at"), F.lit(unknown).alias("bounds"))
        for _ in range(rounds):
            held = spark.sparkContext.broadcast(book)
            state = written(assigned(state, held, scale), "assigned")
            book = Codebooks(moved(state, held, scale), book.entries)
            release(spark, made, keep=1)
        held = spark.sparkContext.broadcast(book)
        coded = written(errors(assigned(state, held, scale), held, scale), "coded")
        release(spark, made, keep=1)
    return coded, book.entries


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for e in books for v in e.ravel().tolist()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    found = coded.join(few(labels), F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
