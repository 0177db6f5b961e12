"""MinHash near-duplicates by an inverted join of signature coordinates.

Equal shingle sets are one node. A node's signature has COORDINATES minima of its shingles' hashes, and the node is posted
under every pair of coordinate and value. A counting join finds the pairs that more than one node is posted under. In the
order of rarity, two nodes that agree in MATCHES coordinates share one of the first COORDINATES - MATCHES + 1 of each
(the prefix), so only these are looked up, and what few share comes first: texts of one template that agree in less
than that do not meet at all. What nobody else has is the rarest, so a node that shares fewer than MATCHES pairs is out.

Links are found in steps. In each turn the postings of the prefix in which several components meet name a leader (first the
node whose coordinates are the most common ones, which lies in the middle of its copies; then another node of the largest
component), and each node proposes itself to the leader that it collides with most often; whole sets decide. So a group of n near
copies takes about n comparisons, not n * n. What is open after TURNS turns is settled completely: the postings in which several
components meet are merged in chunks. The long lists beyond the prefix are not merged: their collisions are counted on a byte
of each of WIDE coordinates, in steps, and a pair is skipped as soon as what is left of them cannot bring it to WIDE_MATCHES.
A pair is told in the least of the postings that both prefixes have, and skipped in the others.
A node of the smaller component and the larger component that are left meet once, whatever number of pairs they have:
blocks of such nodes are held as one sorted list of shingles, which the sets of the component pass through, until one is similar.

Two texts of similarity 0.85 agree in fewer than 80 of 128 coordinates, or 180 of 256, with probability 4e-9, more similar ones
with less; such a pair is missed unless others connect it. No link stands unchecked.

Defined results: null texts and texts without words have no shingles, are linked with nothing and are kept; fewer words
than `width` make one shingle; copies share a node and are never expanded into pairs; a row is a document, so repeated rows are
copies; a null id is never a component's id, a component without ids has none, and its rows are kept; an empty table gives no
rows; other columns are ignored. Shingles and nodes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import few, release, run_of_tables, small_batches, table, written
from quayside.llm.components import components
from quayside.llm.similar import SEED, give_back, linked, shingles

WIDTH = 3
#: Similarity as a fraction of whole numbers.
SIMILARITY = (85, 100)
COORDINATES, MATCHES = 128, 80
#: Coordinates of the wider signature that open pairs are counted on, a byte each.
WIDE, WIDE_MATCHES = 256, 180
PREFIX = COORDINATES - MATCHES + 1
#: Nodes of a posting that are merged together; partners of a leader that are compared in one task.
CHUNK, PARTNERS = 512, 512
#: Turns of proposals; nodes and bytes of a block that a component passes, and members of the component that pass it in one task.
TURNS, BLOCK, BLOCK_BYTES, MEMBERS = 3, 256, 32 << 20, 1024
#: Coordinates that are compared before pairs are skipped.
STEP = 32

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 32, WIDE, dtype=np.uint32) | np.uint32(1)
_FLIP = _random.integers(0, 1 << 32, WIDE, dtype=np.uint32)


def signature(hashes: np.ndarray, wide: int = COORDINATES) -> np.ndarray:
    """The minimum of each coordinate's permutation of the upper 32 bits of the hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(wide, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(low), 256):
        np.minimum(least, ((low[a : a + 256, None] ^ _FLIP[:wide]) * _TIMES[:wide]).min(axis=0), out=least)
    return least


def similar(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sorted distinct arrays is share or more, exactly."""
    up, down = share
    if not len(a) or not len(b) or min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * down >= (len(a) + len(b) - shared) * up


def mergeable(payload: pa.Array, shift: int) -> list[tuple[int, int]]:
    """(a, b): node a agrees with some node of b's component in WIDE_MATCHES bytes or more, as those with so many equal coordinates do.

    b stands for its component, which is larger than a's, or as large and of greater number. Pairs that meet in a lesser posting
    are left to that. A payload: the component, its size, this posting and the PREFIX postings of the node, filled up with -1 (8 bytes
    each), then a byte a coordinate.
    """
    numbers = 3 + PREFIX
    raw = np.frombuffer(b"".join(payload.to_pylist()), dtype=np.uint8).reshape(len(payload), 8 * numbers + WIDE)
    whole = np.ascontiguousarray(raw[:, : 8 * numbers]).view("<i8")
    component, size, here, lists = whole[:, 0], whole[:, 1], whole[0, 2], whole[:, 3:]
    sig = raw[:, 8 * numbers :]
    if (component == component[0]).all():
        return []
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for a in range(shift or len(raw)):
        first = shift or a + 1
        others = first + np.flatnonzero(component[first:] != component[a])
        count = np.zeros(len(others), dtype=np.int64)
        for part in range(0, WIDE, STEP):
            count += (sig[others, part : part + STEP] == sig[a, part : part + STEP]).sum(axis=1)
            open_ = count + (WIDE - part - STEP) >= WIDE_MATCHES
            others, count = others[open_], count[open_]
            if not len(others):
                break
        lesser = lists[a][(lists[a] >= 0) & (lists[a] < here)]
        if len(lesser) and len(others):
            others = others[~np.isin(lists[others], lesser).any(axis=1)]
        for b in others.tolist():
            x, y = (a, b) if (size[a], component[a]) < (size[b], component[b]) else (b, a)
            found.setdefault((x, int(component[y])), (x, y))
    return list(found.values())


def confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar. u's set goes once to each PARTNERS of its partners."""
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("chunks"))
    seconds = pairs.join(many, "u").join(sets, F.col("v") == F.col("node")).select("u", F.expr("cast(pmod(xxhash64(v), chunks) as int)").alias("c"), "v", "payload")
    firsts = many.join(sets, F.col("u") == F.col("node")).select("u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), F.lit(None).cast("long").alias("v"), "payload")
    dealt = firsts.union(seconds).repartition("u", "c").sortWithinPartitions("u", "c", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, of = np.zeros(0, dtype=np.uint64), None
        for batch in batches:
            us, vs = [], []
            for u, c, v, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                own = np.frombuffer(payload.as_buffer(), dtype=np.uint64)
                if not v.is_valid:
                    first, of = own.copy(), (u.as_py(), c.as_py())
                elif of == (u.as_py(), c.as_py()) and similar(first, own, share):
                    us.append(u.as_py())
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
        give_back()

    return dealt.mapInArrow(run, "u long, v long")


def nodes_of(docs: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, row (the text's hash), node, n (size of the set), sig; node and sig are null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, sig = [], [], []
            for text in batch.column(2):
                hashes = shingles(text.as_py(), width)
                n.append(len(hashes))
                node.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0)
                sig.append(signature(hashes).view(np.int32).tolist() if len(hashes) else None)
            empty = np.array(n, dtype=np.int64) == 0
            signed = pa.array(np.array(node, dtype=np.uint64).view(np.int64), mask=empty)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed, pa.array(n, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "row", "node", "n", "sig"])
        give_back()

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_column}`")).alias("row"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, node long, n long, sig array<int>")


def prefixes(nodes: DataFrame) -> DataFrame:
    """node, p, weight: the postings of each node's prefix; weight adds up how many nodes share each of its coordinates."""
    pair = F.shiftleft(F.col("value").cast("long"), 7).bitwiseOR(F.col("at").cast("long"))
    posted = nodes.select("node", F.posexplode("sig").alias("at", "value")).select("node", pair.alias("p"))
    shared = posted.groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    lists = posted.join(shared, "p").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "p"))).alias("list"), F.sum("n").alias("weight"))  # COORDINATES at most
    # what nobody shares is rarest, so it fills the prefix first; of the shared postings all but the last MATCHES - 1 are in it
    inside = lists.where(F.size("list") >= MATCHES).select("node", "weight", F.explode(F.expr(f"slice(list, 1, size(list) - {MATCHES - 1})")).alias("x"))
    return inside.select("node", "x.p", "weight")


def rooted(prefix: DataFrame, known: DataFrame) -> DataFrame:
    """prefix with root and size, of the component that the node is known to be in (known: node, root)."""
    sized = known.join(known.groupBy("root").agg(F.count("*").alias("size")), "root")
    return prefix.join(sized, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("size", F.coalesce("size", F.lit(1)))


def proposals(postings: DataFrame, turn: int) -> DataFrame:
    """u, v: each node v with the leader u that it collides with most often, of those its postings name. postings: as of rooted()."""
    worth = F.col("weight") if turn == 0 else F.xxhash64("node", F.lit(turn))
    leader = F.max(F.struct("size", worth.alias("worth"), F.col("node").alias("u"), F.col("root").alias("of"))).alias("leader")
    several = postings.groupBy("p").agg(leader, F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("p", "leader.u", "leader.of")
    met = postings.join(several, "p").where("root <> of").groupBy("node", "u").agg(F.count("*").alias("n"))
    return met.groupBy(F.col("node").alias("v")).agg(F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v")


def joined_roots(known: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after more links between nodes; known has the nodes that were linked before."""
    root = lambda end: known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    between = links.join(root("u"), "u", "left").join(root("v"), "v", "left")
    ends = between.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    now = written(components(ends), "roots")
    moved = known.withColumnRenamed("root", "was").join(now.select(F.col("node").alias("was"), F.col("root").alias("is")), "was", "left").select("node", F.coalesce("is", "was").alias("root"))
    return written(moved.union(now.join(known.select("node"), "node", "left_anti").select("node", "root")), "known")


def open_meetings(postings: DataFrame, wide: DataFrame) -> DataFrame:
    """u, root: nodes that may be similar to one of a larger component. postings: as of rooted(); wide: node, wide."""
    several = postings.groupBy("p").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("p")
    lists = postings.groupBy("node").agg(F.sort_array(F.collect_list("p")).alias("list"))  # PREFIX at most

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            numbers = np.full((n, 3 + PREFIX), -1, dtype="<i8")
            for i, c in enumerate((2, 3, 0)):
                numbers[:, i] = batch.column(c).to_numpy()
            for row, listed in zip(numbers, batch.column(4), strict=True):
                row[3 : 3 + len(listed)] = listed.values.to_numpy()
            rows = [x.tobytes() + w.as_py() for x, w in zip(numbers, batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["k", "node", "payload"])

    held = postings.join(several, "p", "left_semi").join(lists.join(wide, "node"), "node").select(F.col("p").alias("k"), "node", "root", "size", "list", "wide")
    found = linked(held.mapInArrow(payloads, "k long, node long, payload binary"), CHUNK, mergeable)
    roots = postings.select(F.col("node").alias("v"), "root").distinct()
    return found.distinct().join(roots, "v").select("u", "root").distinct()


def settled(meetings: DataFrame, known: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """u, v: for each meeting (u, root) with a similar pair one link at least."""
    own = sets.select(F.col("node").alias("u"), F.col("payload"))
    asked = meetings.join(own.select("u", F.octet_length("payload").alias("bytes")), "u")
    many = asked.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    members = sets.select(F.col("node").alias("v"), "payload").join(known.select(F.col("node").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v")).join(many, "root")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = members.join(sizes, "root").select("root", F.expr("cast(pmod(xxhash64(v), parts) as int)").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.col("v").alias("node"), "payload")
    asking = meetings.join(many, "root").join(sizes, "root").join(own, "u").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.expr("cast(pmod(xxhash64(u), blocks) as int)").alias("block"), F.lit(0).alias("kind"), F.col("u").alias("node"), "payload")
    dealt = asking.union(members).repartition("root", "part", "block").sortWithinPartitions("root", "part", "block", "kind", "node")
    up, down = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, index = None, [], None
        for batch in batches:
            us, vs = [], []
            for root, part, number, kind, node, payload in zip(*batch.columns, strict=True):
                place = (root.as_py(), part.as_py(), number.as_py())
                if place != at:
                    at, block, index = place, [], None
                own_set = np.frombuffer(payload.as_buffer(), dtype=np.uint64)
                if kind.as_py() == 0:
                    block.append((node.as_py(), own_set.copy()))
                    continue
                if not block:
                    continue
                if index is None:
                    index = Block(block)
                for u in index.similar_to(own_set, up, down):
                    us.append(u)
                    vs.append(node.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
        give_back()

    return dealt.select("root", "part", "block", "kind", "node", "payload").mapInArrow(run, "u long, v long")


class Block:
    """Sets held as one sorted list of their shingles, each with its owner; one that has found a similar set is done with."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        self.nodes = [n for n, _ in sets]
        self.sizes = np.array([len(x) for _, x in sets])
        every = np.concatenate([x for _, x in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.keys, self.owner = every[order], owner[order]
        self.open = np.ones(len(sets), dtype=bool)

    def similar_to(self, other: np.ndarray, up: int, down: int) -> list[int]:
        fit = self.open & (np.minimum(self.sizes, len(other)) * down >= np.maximum(self.sizes, len(other)) * up)
        if not fit.any():
            return []
        first, last = np.searchsorted(self.keys, other, "left"), np.searchsorted(self.keys, other, "right")
        runs = last - first
        total = int(runs.sum())
        if not total:
            return []
        places = np.arange(total) + np.repeat(first - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs)
        shared = np.bincount(self.owner[places], minlength=len(self.sizes))
        near = fit & (shared * down >= (self.sizes + len(other) - shared) * up)
        self.open &= ~near
        return [self.nodes[i] for i in np.flatnonzero(near).tolist()]


def near_duplicates(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = written(nodes_of(docs, width, id_column, text_column), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), width) for x in batch.column(1)]
            wide = [signature(x, WIDE).astype(np.uint8).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(wide, pa.binary())], ["node", "payload", "wide"])
        give_back()

    with run_of_tables() as made:
        nodes = written(marked.where("node is not null").groupBy("node").agg(least, F.first("sig").alias("sig")), "nodes")
        prefix = written(prefixes(nodes), "prefixes")
        wanted = nodes.join(prefix.select("node").distinct(), "node").select("node", F.col("least.doc_id").alias("id"), F.col("least.row").alias("of"))
        rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_column}`")).alias("row"), F.col(f"`{text_column}`").alias("text"))
        chosen = rows.join(few(written(wanted, "wanted")), (F.col("row") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
        sets_of = written(chosen.mapInArrow(sets, "node long, payload binary, wide binary").dropDuplicates(["node"]), "sets")
        whole = sets_of.select("node", "payload")
        known = whole.select("node", F.col("node").alias("root")).limit(0)
        for turn in range(TURNS):
            named = written(proposals(rooted(prefix, known), turn), "proposals")
            if named.isEmpty():
                break
            known = joined_roots(known, written(confirmed(named, whole, share), "links"))
        postings = rooted(prefix, known)
        links = written(settled(written(open_meetings(postings, sets_of.select("node", "wide")), "meetings"), known, whole, share), "links")
        groups = joined_roots(known, links)
        release(spark, made, keep=1, first=1)
    named = nodes.select("node", F.col("least.doc_id").alias("id")).join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("node", "component_id")
    full = marked.where("node is not null").join(ids, "node").select("doc_id", "n", "component_id")
    empty = marked.where("node is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.union(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
