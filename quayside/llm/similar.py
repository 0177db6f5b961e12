"""Near copies by the Jaccard similarity of five-word shingles: SimHash proposes links, exact sets decide.

Texts of equal shingle sets are one node. A node is filed under BANDS keys, each of ROWS minima of its shingles'
hashes; two nodes of similarity 0.8 share none of them with probability (1 - 0.8^5)^48 = 5e-9, more similar ones
with less. Within a file SimHash fingerprints over the same shingles are compared by bit slices in a RADIUS far
beyond the 10 bits that 0.8 comes to. These links only say which nodes have to meet: in each of their
components the shingle sets are compared, all against all but for those that are connected already, and what has
SIMILARITY or more is linked. So no link stands unchecked, and a wide radius costs time, not correctness.
Large files and components are split by hash into chunks and compared chunk against chunk.

Defined results: words are split at blanks and A-Z lower-cased; fewer words than five make one shingle; null and empty
texts have no shingles and are copies of each other; an empty table gives no rows; shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import give_back as trim, release, run_of_tables, small_batches, written
from quayside.llm.components import components
from quayside.llm.simhash import forest, planes

WIDTH, SEED = 5, 42
#: Similarity as a fraction, so that the comparison is one of whole numbers.
SIMILARITY = (4, 5)
RADIUS, BANDS, ROWS = 26, 48, 5
FILE_CHUNK, SET_CHUNK, FEW = 512, 256, 64

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_FLIP = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def give_back() -> None:
    """Arrow's pool keeps what it has freed; it goes back with the rest."""
    pa.default_memory_pool().release_unused()
    trim()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    pieces = map(joined.__getitem__, map(slice, (ends - sizes).tolist(), ends[width - 1 :].tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype=np.uint64))


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def keys(hashes: np.ndarray) -> np.ndarray:
    """The files of a set: one for each band of minima."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(low), 256):
        np.minimum(least, ((low[a : a + 256, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    key = ((least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND
    key ^= key >> np.uint64(32)
    return key * np.uint64(0x9E3779B97F4A7C15)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted distinct arrays, exactly, against SIMILARITY."""
    up, down = SIMILARITY
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * down >= (len(a) + len(b) - shared) * up


def within(queries: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, value) of all that differ in radius bits or fewer; bit slices with carry-save counters."""
    if len(queries) <= FEW and len(values) <= FEW:
        return np.nonzero(np.bitwise_count(queries[:, None] ^ values[None, :]) <= radius)
    stored = planes(values)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    shape = (len(queries), stored.shape[1])
    counters = [np.zeros(shape, dtype=np.uint64) for _ in range(radius.bit_length())]
    above, equal = np.zeros(shape, dtype=np.uint64), np.full(shape, ones)
    for b in range(64):
        x = stored[b][None, :] ^ np.where((queries >> np.uint64(b)) & np.uint64(1), ones, np.uint64(0))[:, None]
        for c in counters:
            carry = c & x
            c ^= x
            x = carry
        above |= x
    for bit, c in reversed(list(enumerate(counters))):
        if radius >> bit & 1:
            equal &= c
        else:
            above |= equal & c
            equal &= ~c
    near = np.unpackbits(np.ascontiguousarray(~above).view(np.uint8), axis=1, bitorder="little")[:, : len(values)]
    return np.nonzero(near)


def near_fingerprints(payload: pa.Array, shift: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius; shift: where the second chunk begins, 0 if there is one."""
    fp = payload.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    left, right = within(fp[:shift] if shift else fp, fp[shift:])
    keep = left < right + shift
    return forest(len(fp), left[keep].tolist(), (right[keep] + shift).tolist())


def similar_sets(payload: pa.Array, shift: int) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs."""
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in payload]
    parent, kept = list(range(len(sets))), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a in range(shift or len(sets)):
        for b in range(shift or a + 1, len(sets)):
            if top(a) != top(b) and similar(sets[a], sets[b]):
                parent[top(a)] = top(b)
                kept.append((a, b))
    return kept


def linked(filed: DataFrame, chunk: int, links: Callable[[pa.Array, int], list[tuple[int, int]]]) -> DataFrame:
    """u, v: in each file (k) of nodes with their payload, what links() finds among them, chunk by chunk."""
    kind = filed.schema["payload"].dataType.simpleString().replace("bigint", "long")
    sizes = filed.groupBy("k").count().where("count > 1").select("k", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    filed = filed.join(sizes, "k").withColumn("c", F.expr("cast(pmod(xxhash64(node), chunks) as int)"))
    # every pair of chunks of a file is one comparison; a chunk goes to those that it takes part in
    pairs = F.expr("transform(sequence(0, chunks - 1), j -> struct(least(c, j) as i, greatest(c, j) as j))")
    filed = filed.select("k", "c", "node", "payload", F.explode(pairs).alias("p")).select("k", "p.i", "p.j", F.expr("cast(c <> p.i as int)").alias("second"), "node", "payload")
    dealt = filed.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "second", "node")
    pair_of_longs = kind == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one comparison, which may go on in the next batch
        last = None

        def row(u: list, v: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        def block(rows: list[pa.RecordBatch]) -> tuple[list, list]:
            one = rows[0] if len(rows) == 1 else pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            i, j = one.column(1)[0].as_py(), one.column(2)[0].as_py()
            node, second = one.column(4).to_numpy(), one.column(3).to_numpy()
            shift = int(np.searchsorted(second, 1)) if i != j else 0
            if i != j and not 0 < shift < len(node):
                return [], []
            found = links(one.column(5), shift)
            return [int(node[a]) for a, _ in found], [int(node[b]) for _, b in found]

        for batch in batches:
            if not batch.num_rows:
                continue
            k, i, j = (batch.column(x).to_numpy() for x in range(3))
            change = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            starts = np.concatenate([[0], change, [len(k)]])
            us, vs = [], []
            first = (int(k[0]), int(i[0]), int(j[0]))
            if held and first != last:
                u, v = block(held)
                us += u
                vs += v
                held = []
            a, end = 0, len(starts) - 2
            sizes = np.diff(starts)
            if pair_of_longs:  # most files have two nodes: these are compared at once
                two = starts[:-1][(sizes == 2) & (i[starts[:-1]] == j[starts[:-1]])]
                two = two[(two < starts[end]) & ((two > 0) | (not held))]
                node, fp = batch.column(4).to_numpy(), batch.column(5).to_numpy().view(np.uint64)
                near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
                us += node[near].tolist()
                vs += node[near + 1].tolist()
                done = set(two.tolist())
            else:
                done = set()
            for a in range(end):
                begin = int(starts[a])
                if begin in done or (sizes[a] < 2 and not (a == 0 and held)):
                    continue
                u, v = block([*(held if a == 0 else []), batch.slice(begin, int(sizes[a]))])
                us += u
                vs += v
            tail = batch.slice(int(starts[end]), int(sizes[end]))
            held = [*held, tail] if end == 0 else [tail]
            last = (int(k[-1]), int(i[-1]), int(j[-1]))
            yield row(us, vs)
        if held:
            yield row(*block(held))
        held = batch = None
        give_back()

    return dealt.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """node, least, component: the distinct shingle sets, each with its first row and its group of near copies.

    least is a struct of no_id, doc_id and row, the hash of the row's text; component is a node, the same for the whole group.
    """
    small_batches(docs.sparkSession)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, files = [], [], []
            for x in batch.column(2):
                hashes = shingles(x.as_py())
                node.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                fp.append(simhash(hashes))
                files.append(keys(hashes).view(np.int64))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            offsets = np.cumsum([0, *map(len, files)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*files, np.zeros(0, dtype=np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(node), signed(fp), lists], ["doc_id", "row", "node", "fp", "keys"])
        give_back()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingles(x.as_py()).tobytes() for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["k", "node", "payload"])
        give_back()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("row"), F.col(text_column).alias("text"))
    marked = rows.mapInArrow(marks, "doc_id long, row long, node long, fp long, keys array<long>")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")
    with run_of_tables() as made:
        nodes = written(marked.groupBy("node").agg(least, F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
        filed = nodes.select(F.explode("keys").alias("k"), "node", F.col("fp").alias("payload"))
        meeting = written(components(linked(filed, FILE_CHUNK, near_fingerprints)), "meeting")
        release(docs.sparkSession, made, keep=1, first=1)
        chosen = nodes.join(meeting, "node").select(F.col("root").alias("k"), "node", F.col("least.doc_id").alias("id"), F.col("least.row").alias("of"))
        texts = rows.join(chosen, (F.col("row") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("k", "node", "text")
        held = texts.mapInArrow(sets, "k long, node long, payload binary").dropDuplicates(["k", "node"])
        groups = written(components(linked(written(held, "sets"), SET_CHUNK, similar_sets)), "groups")
        release(docs.sparkSession, made, keep=1, first=1)  # the shingle sets and all links
    return nodes.select("node", "least").join(groups, "node", "left").select("node", "least", F.coalesce("root", "node").alias("component"))
