"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles. Distinct fingerprints that
may link share some pieces of their bits: with `pieces` pieces and radius r, two that differ in r bits
or fewer agree on at least pieces - r pieces, so each fingerprint is filed under every choice of that
many pieces. Within a file the bit planes are stored vertically, 64 fingerprints to a word; distances of
a whole block are kept as carry-save counters (three bits and an overflow), and a block is given up as
soon as every distance in it exceeds the radius. A file that has grown large is dealt again by its other bits; what
is large still is split by hash into chunks and compared chunk against chunk, so no file is one task. Per comparison only a spanning forest
of the links goes on, and components are found by star steps over written tables.

Defined results: null and empty texts have fingerprint zero and link like any other; copies share a
fingerprint and are never expanded into pairs; a null id is never a component's id, but its row is
returned; an empty table gives no rows; clashing extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import give_back, small_batches, table, written
from quayside.llm.components import components

SEED = 42
CHUNK = 512


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bits set in over half of the shingles' hashes; fewer words than width make one shingle, no words zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    if len(words) < width:
        shingles = [joined]
    else:
        shingles = map(joined.__getitem__, map(slice, starts, ends[width - 1 :]))
    total, n = np.zeros(64, dtype=np.int64), 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    for a in range(0, len(hashes), 1 << 14):
        part = hashes[a : a + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])
        give_back()

    chosen = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text")
    return chosen.mapInArrow(run, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values to a word."""
    wide = -len(values) % 64
    bits = np.unpackbits(np.concatenate([values, np.zeros(wide, dtype=np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, value) of all that differ in radius (at most 7) bits or fewer."""
    stored = planes(values)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    shape = (len(queries), stored.shape[1])
    c0, c1, c2, over = (np.zeros(shape, dtype=np.uint64) for _ in range(4))
    far = np.zeros(shape, dtype=np.uint64)
    for b in range(64):
        x = stored[b][None, :] ^ np.where((queries >> np.uint64(b)) & np.uint64(1), ones, np.uint64(0))[:, None]
        carry = c0 & x
        c0 ^= x
        carry, c1 = c1 & carry, c1 ^ carry
        carry, c2 = c2 & carry, c2 ^ carry
        over |= carry
        if b % 8 == 7:
            far = over | exceeds(c0, c1, c2, radius)
            over |= far
            if (far == ones).all():
                return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    near = np.unpackbits(np.ascontiguousarray(~far).view(np.uint8), axis=1, bitorder="little")[:, : len(values)]
    return np.nonzero(near)


def exceeds(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Bitwise: counter above the radius."""
    above, equal = np.zeros_like(c0), np.full_like(c0, np.uint64(0xFFFFFFFFFFFFFFFF))
    for counter, bit in ((c2, radius >> 2 & 1), (c1, radius >> 1 & 1), (c0, radius & 1)):
        if bit:
            equal &= counter
        else:
            above |= equal & counter
            equal &= ~counter
    return above


def forest(n: int, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Enough of the links to connect what they connect."""
    parent = list(range(n))
    kept = []
    for a, b in zip(left, right, strict=True):
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def pieces_for(n: int, radius: int) -> int:
    """Pieces so that a file of n fingerprints spread evenly holds a few hundred; each step files each one more often."""
    pieces = radius + 1
    while pieces < radius + 4 and n / 2 ** (64 * (pieces - radius) // pieces) > CHUNK:
        pieces += 1
    return pieces


def bit_masks(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - ((mask >> 63) << 64)


def files(distinct: DataFrame, radius: int, pieces: int, chunk: int) -> DataFrame:
    """fp, f: the files of each fingerprint, so that any two within the radius share one.

    Such two agree in pieces - radius pieces of their bits. A file that is large all the same is dealt again by the bits it
    was not dealt by: in radius + 1 parts of these, one is equal too. Files are known by a hash of all that.
    """
    bounds = [64 * i // pieces for i in range(pieces + 1)]
    keys, again = [], []
    for t, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        same = [b for i in chosen for b in range(bounds[i], bounds[i + 1])]
        rest = [b for b in range(64) if b not in same]
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(bit_masks(same))).alias("k")))
        parts = [rest[j :: radius + 1] for j in range(radius + 1)]
        again.append(F.array(*[F.lit(bit_masks(part)) for part in parts]))
    filed = distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.t", F.xxhash64("x.t", "x.k").alias("f"))
    sizes = filed.groupBy("f").count().where("count > 1")
    sized = filed.join(sizes, "f")
    small = sized.where(F.col("count") <= 4 * chunk).select("fp", "f")
    masks = F.element_at(F.array(*again), F.col("t") + 1)
    finer = F.transform(masks, lambda m, j: F.xxhash64(F.col("f"), j, F.col("fp").bitwiseAND(m)))
    return small.union(sized.where(F.col("count") > 4 * chunk).select("fp", F.explode(finer).alias("f")))


def near_links(distinct: DataFrame, radius: int = 4, pieces: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """u, v: links among distinct fingerprints (column fp) that connect all within the radius."""
    filed = files(distinct, radius, pieces or pieces_for(distinct.count(), radius), chunk)
    sizes = filed.groupBy("f").count().where("count > 1").withColumn("chunks", F.ceil(F.col("count") / chunk).cast("int"))
    filed = filed.join(sizes.drop("count"), "f").withColumn("c", F.expr("cast(pmod(xxhash64(fp), chunks) as int)"))
    # every pair of chunks of a file is one comparison; a chunk goes to those that it takes part in
    pairs = F.expr("transform(sequence(0, chunks - 1), j -> struct(least(c, j) as i, greatest(c, j) as j))")
    filed = filed.select("fp", "f", "c", F.explode(pairs).alias("p")).select("f", "p.i", "p.j", F.expr("c <> p.i").alias("second"), "fp")
    dealt = filed.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j", "second", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(block: list[np.ndarray]) -> list[tuple[int, int]]:
            i, j, second, fp = block[1][0], block[2][0], block[3], block[4].view(np.uint64)
            if i == j:
                queries = values = fp
                shift = 0
            else:
                shift = int(np.searchsorted(second, 1))
                queries, values = fp[:shift], fp[shift:]
            left, right = within(queries, values, radius) if len(queries) and len(values) else ([], [])
            right = np.asarray(right, dtype=np.int64) + shift
            left = np.asarray(left, dtype=np.int64)
            keep = left < right
            signed = block[4]
            return [(int(signed[a]), int(signed[b])) for a, b in forest(len(fp), left[keep].tolist(), right[keep].tolist())]

        def found(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

        for batch in batches:
            columns = [c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            change = np.zeros(len(columns[0]), dtype=bool)
            for c in columns[:3]:
                change[1:] |= c[1:] != c[:-1]
            bounds = [0, *np.flatnonzero(change).tolist()]
            rows = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                rows += links([c[a:b] for c in columns])
            held = [c[bounds[-1] :] for c in columns]  # the last comparison may go on in the next batch
            yield found(rows)
        if held:
            yield found(links(held))
        held = []
        give_back()

    return dealt.selectExpr("f", "i", "j", "cast(second as int) as second", "fp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest id that can be reached over links."""
    marked = written(fingerprints(docs, id_column, text_column, width), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # nodes are in the order of their ids, those without one last: so a component's smallest node has its id
    named = written(distinct.select("fp", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "fp").alias("node")), "nodes")
    links = near_links(named.select("fp"), radius)
    links = links.join(named.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(named.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    roots = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select("node.fp", F.col("root.id").alias("root")), "roots")
    # what links to nothing else is its own root
    ids = named.join(roots, "fp", "left").select("fp", F.coalesce("root", "node.id").alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
