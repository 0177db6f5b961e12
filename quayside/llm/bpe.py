"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The pre-tokens that are frequent in the table, found by a grouped aggregation over all documents, are encoded once for
the whole corpus: an inverted index maps each mergeable pair to the positions in the words where it stands; the pairs are
replayed in rank order, and a merge updates only its two neighbours' entries. Their ids are broadcast, a table of
bounded size. All other pre-tokens, a few in a hundred by occurrence, are replayed in the same way where they stand, the
new ones of a group of texts together: dealing them to shards too, and their ids back, was built and moves more
than the input (figures in the README). A document is then a join of look-ups.

Defined results: a null text is the empty text (no tokens, digests of nothing); texts of any length
are taken whole; repeated rows and repeated or null ids each give their own row; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import give_back, small_batches, table, written
from quayside.llm.pretokens import HOT, Cutter, counted, crosses, frequent, table_of

#: Pre-tokens that are replayed together.
TOGETHER = 20_000
#: Merges up to this rank stand at many places at once and are replayed as arrays, later ones place by place.
COMMON = 1500
#: Pre-tokens that a table of a task proposes as frequent.
LEADING = 1 << 16
#: Entries of a task's tables of stretches and rare pre-tokens, some 100 MB, which are emptied beyond; this changes no result.
KEPT = 400_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def load_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(read_file(path))


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each word: the adjacent pair of lowest rank, leftmost first, is merged until none is left.

    Positions are bytes of all words laid end to end, each word closed by a gap, so one index serves all.
    """
    text = b"\0".join(words) + b"\0"
    size = len(text)
    owner_end = []
    after = list(range(1, size + 1))  # where the piece that begins here ends
    before = list(range(-1, size - 1))  # where the piece on the left begins
    pair = [-1] * size  # rank of the piece that begins here with the next one
    index: dict[int, list[int]] = defaultdict(list)
    word_of: list[int] = []
    at = 0
    get = ranks.get
    for n, word in enumerate(words):
        end = at + len(word)
        owner_end.append(end)
        word_of.extend([n] * (len(word) + 1))
        if word:
            before[at] = -1
        if word not in ranks:
            for i in range(at, end - 1):
                rank = get(text[i : i + 2], -1)
                if rank >= 0:
                    pair[i] = rank
                    index[rank].append(i)
        at = end + 1
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank, None)
        if not places:
            continue
        places.sort()
        held: list[int] = []
        waiting = -1  # a word in which a lower rank has come up
        for i in places:
            if pair[i] != rank:
                continue
            word = word_of[i]
            if word == waiting:
                held.append(i)
                continue
            middle = after[i]
            end = after[middle]
            after[i] = end
            pair[middle] = -1
            last = owner_end[word]
            if end < last:
                before[end] = i
                new = get(text[i : after[end]], -1)
                pair[i] = new
                if new >= 0:
                    if new not in index:
                        heapq.heappush(queue, new)
                    index[new].append(i)
                    if new < rank:
                        waiting = word
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                new = get(text[left:end], -1)
                pair[left] = new
                if new >= 0:
                    if new not in index:
                        heapq.heappush(queue, new)
                    index[new].append(left)
                    if new < rank:
                        waiting = word
        if held:
            if rank not in index:
                heapq.heappush(queue, rank)
            index[rank].extend(held)
    out = []
    at = 0
    for word in words:
        whole = get(word)
        if whole is not None:
            out.append([whole])
        else:
            i, end, ids = at, at + len(word), []
            while i < end:
                ids.append(ranks[text[i : after[i]]])
                i = after[i]
            out.append(ids)
        at += len(word) + 1
    return out


class Merges:
    """The ranks with every pair of pieces that makes a piece, for look-ups by array and one by one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs: dict[int, int] = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))[order], -1)
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)


def leftmost(at: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Of places that overlap the next one, every second from the left."""
    kept, last = [], -1
    for i, m in zip(at.tolist(), middle.tolist(), strict=True):
        if i != last:
            kept.append(i)
            last = m
    return np.array(kept, dtype=np.int64)


def replay_all(words: list[bytes], merges: Merges) -> list[bytes]:
    """The packed ids of each word, all merges of a rank at a time over the words laid end to end.

    A word in which a merge brings up a pair of lower rank is done again by replay(), one merge at a time.
    """
    ranks, pairs = merges.ranks, merges.pairs
    out: list[bytes | None] = [None] * len(words)
    rest = []
    for n, word in enumerate(words):
        rank = ranks.get(word)
        if rank is None:
            rest.append(n)
        else:
            out[n] = rank.to_bytes(4, "little")
    if not rest:
        return out
    sizes = np.array([len(words[n]) for n in rest], dtype=np.int64) + 1
    data = np.frombuffer(b"\0".join([words[n] for n in rest]) + b"\0", dtype=np.uint8)
    size = len(data)
    closed = np.cumsum(sizes) - 1  # the gap after each word
    owner = np.repeat(np.arange(len(rest)), sizes)
    token = merges.byte_ids[data]
    token[closed] = -1
    after = np.arange(1, size + 1)
    before = np.arange(-1, size - 1)
    pair = np.full(size, -1, dtype=np.int64)
    here = np.flatnonzero((token[:-1] >= 0) & (token[1:] >= 0))
    pair[here] = merges.look(token[here], token[here + 1])
    here = here[pair[here] >= 0]
    order = here[np.argsort(pair[here], kind="stable")]
    firsts = np.flatnonzero(np.diff(pair[order], prepend=-2))
    index: dict[int, list[int]] = {int(pair[part[0]]): part.tolist() for part in np.split(order, firsts[1:]) if len(part)}
    queue = list(index)
    heapq.heapify(queue)
    odd: set[int] = set()

    def put(rank: int, place: int) -> None:
        held = index.get(rank)
        if held is None:
            index[rank] = [place]
            heapq.heappush(queue, rank)
        else:
            held.append(place)

    while queue and queue[0] <= COMMON:
        rank = heapq.heappop(queue)
        at = np.unique(np.array(index.pop(rank)))
        at = at[pair[at] == rank]
        middle = after[at]
        if (middle[:-1] == at[1:]).any():  # a run such as aaa: the first of each two stands
            at = leftmost(at, middle)
            middle = after[at]
        end = after[middle]
        joined = np.flatnonzero(end[:-1] == at[1:])
        if len(joined):
            passing = merges.look(np.full(len(joined), rank), token[at[joined + 1]])
            odd.update(owner[at[joined[(passing >= 0) & (passing < rank)]]].tolist())
        after[at], token[at], pair[middle], before[end] = end, rank, -1, at
        left = before[at]
        some = left >= 0
        left, right = left[some], at[some]
        place, other = np.concatenate([at, left]), np.concatenate([end, right])
        new = np.where((token[other] >= 0) & (token[place] >= 0), merges.look(token[place], token[other]), -1)
        pair[place] = new
        found = new >= 0
        new, place = new[found], place[found]
        odd.update(owner[place[new < rank]].tolist())
        for r, p in zip(new.tolist(), place.tolist(), strict=True):
            put(r, p)
    after, before, token, pair, owner = after.tolist(), before.tolist(), token.tolist(), pair.tolist(), owner.tolist()
    get = pairs.get
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank)
        places.sort()
        for i in places:
            if pair[i] != rank:
                continue
            middle = after[i]
            end = after[middle]
            after[i], token[i], pair[middle], before[end] = end, rank, -1, i
            new = get(rank << 32 | token[end], -1) if token[end] >= 0 else -1
            pair[i] = new
            if new >= 0:
                put(new, i)
                if new < rank:
                    odd.add(owner[i])
            left = before[i]
            if left >= 0 and token[left] >= 0:
                pair[left] = new = get(token[left] << 32 | rank, -1)
                if new >= 0:
                    put(new, left)
                    if new < rank:
                        odd.add(owner[left])
    after, token = np.array(after), np.array(token)
    # the pieces that are left begin where the one before ends
    marks = np.flatnonzero(token >= 0)
    kept = np.zeros(size, dtype=bool)
    starts = np.concatenate([[0], closed[:-1] + 1])
    live = starts[starts < closed]
    while len(live):
        kept[live] = True
        live = after[live]
        live = live[token[live] >= 0]
    marks = marks[kept[marks]]
    packed = token[marks].astype("<u4").tobytes()
    bounds = np.searchsorted(marks, np.append(starts, size)).tolist()
    for k, n in enumerate(rest):
        out[n] = packed[4 * bounds[k] : 4 * bounds[k + 1]]
    if odd:
        again = [rest[k] for k in sorted(odd)]
        for n, ids in zip(again, replay([words[n] for n in again], ranks), strict=True):
            out[n] = np.array(ids, dtype="<u4").tobytes()
    return out


class Encoder:
    """Encodes texts, group by group; ids come as bytes, little-endian unsigned 32-bit each.

    The frequent pre-tokens' ids are given. The others of a group that were not met before are replayed together.
    """

    def __init__(self, merges: Merges, hot: dict[str, bytes], cutter: Cutter, kept: int = KEPT):
        self.merges, self.hot, self.cutter, self.kept = merges, hot, cutter, kept
        self.rare: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.hot and w not in self.rare)
        self.rare.update(zip(new, replayed(new, self.merges), strict=True))

    def ids(self, words: list[str]) -> bytes:
        hot, rare = self.hot, self.rare
        return b"".join([hot[w] if w in hot else rare[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.tails) > self.kept or len(self.rare) > self.kept:
            self.tails, self.rare = {}, {}
        find, after_space = self.cutter.find, self.cutter.after_space
        whole = [find(text) if crosses(text) else None for text in texts]
        split = [text.split(" ") if words is None else None for text, words in zip(texts, whole, strict=True)]
        heads = [find(parts[0]) if parts else words for parts, words in zip(split, whole, strict=True)]
        new: set[str] = set()
        for parts in split:
            if parts:
                new.update(parts[1:])
        cut = {x: after_space(x) for x in new.difference(self.tails)}
        self.learn({w for words in [*cut.values(), *heads] for w in words})
        for x, words in cut.items():
            self.tails[x] = self.ids(words)
        look = self.tails.__getitem__
        return [self.ids(head) + (b"".join(map(look, parts[1:])) if parts else b"") for head, parts in zip(heads, split, strict=True)]


def replayed(words: list[str], merges: Merges) -> list[bytes]:
    """The packed ids of distinct words, TOGETHER at a time."""
    out: list[bytes] = []
    for a in range(0, len(words), TOGETHER):
        out += replay_all([w.encode() for w in words[a : a + TOGETHER]], merges)
    return out


def groups(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in groups of about `most` characters; a longer text is a group of its own."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of the ids and of the decoded bytes, and the ids if asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    # the vocabulary's file has a fixed size; what is built from it lives in a task only, not in the worker
    ranks = spark.sparkContext.broadcast(read_file(vocabulary))
    cutter = lambda: Cutter(pattern)
    # what is frequent in a task's texts; the counts of all tasks together name the frequent ones of the table
    leading = written(counted(docs, cutter, text_column, leading=LEADING), "leading")

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(parse_ranks(ranks.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replayed(batch.column(0).to_pylist(), merges), pa.binary())], ["word", "value"])
        merges = None
        give_back()

    corpus = frequent(leading, hot).select("word").repartition("word").mapInArrow(value, "word string, value binary")
    known = spark.sparkContext.broadcast(table_of(corpus))  # at most `hot` short words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many strings are held, none in cycles
        merges = Merges(parse_ranks(ranks.value))
        encoder = Encoder(merges, known.value, cutter())
        pieces = {v: k for k, v in merges.ranks.items()}
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]
        for batch in batches:
            for first, texts in groups(batch.column(1).to_pylist()):
                packed = encoder.encode(texts)
                back = [b"".join(map(pieces.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in packed]
                columns = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                ]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, dtype="<u4").tolist() for x in packed], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)
        merges = encoder = pieces = None
        give_back()

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(run, SCHEMA + ", ids array<long>" * with_ids)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the bytes that the ids (array<long>) stand for; null ids are none."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {v: k for k, v in parse_ranks(ranks.value).items()}.__getitem__
        for batch in batches:
            found = [b"".join(map(look, ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
