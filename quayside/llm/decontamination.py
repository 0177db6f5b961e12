"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased; shingles are five words,
an item of fewer words being one shingle of all of them. Items are partitioned by their number of shingles; in
each class a document is searched in windows of twice the class's largest size, half overlapping, so a short item
faces a window of its own order of size however long the document is. Signatures are one-permutation MinHash:
the least hash in each of BINS bins. A document is a candidate for an item when a window shares a signature value
with it; the windows' minima are computed where an item's value turns up and nowhere else, which gives the same
candidates. Candidates are verified by the share of the item's distinct shingles in the whole document.

Items are broadcast in passes of at most PASS_BYTES of their text, counted before; a larger benchmark takes more
passes over the documents. Defined results: null and wordless texts, of items or documents, take no part;
repeated rows of either give a result each; a null id stays null; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import give_back, small_batches, table
from quayside.llm.hashing import ALNUM, Words, blocks

WIDTH, THRESHOLD = 5, 0.8
BINS = 256
PASS_BYTES = 16_000_000
SCHEMA = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def shingles_of(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return set(zip(*[words[i:] for i in range(width)], strict=False))


class Index:
    """Signature values of the items, by width of their shingles."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int, bins: int):
        self.ids, self.shingles, self.width_of, self.size_class = [], [], [], []
        values: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k = min(width, len(words))
            found = Words(*_single(b" ".join(words)), word_bytes=ALNUM, lower=True).grams(k)[0]
            n = len(self.ids)
            own = shingles_of(words, k)
            self.ids.append(item_id)
            self.shingles.append(own)
            self.width_of.append(k)
            self.size_class.append(1 << max(0, len(own) - 1).bit_length())
            hashes = np.unique(found)
            bin_of = hashes % np.uint64(bins)
            order = np.lexsort((hashes, bin_of))
            least = order[np.unique(bin_of[order], return_index=True)[1]]
            for h in hashes[least].tolist():
                values.setdefault(k, []).append((h, n))
        self.by_width = {}
        for k, pairs in values.items():
            pairs.sort()
            hashes = np.array([h for h, _ in pairs], dtype=np.uint64)
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_width[k] = (hashes, np.array([n for _, n in pairs]), maybe)


def _single(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)])


def least_in_window(hashes: np.ndarray, place: int, size: int, bins: int) -> bool:
    """Whether the hash is the least of its bin in a window of its document that covers it."""
    block = place // size
    for start in {max(0, block - 1) * size, block * size}:
        window = hashes[start : start + 2 * size]
        if window[window % np.uint64(bins) == hashes[place] % np.uint64(bins)].min() == hashes[place]:
            return True
    return False


def search(data: np.ndarray, offsets: np.ndarray, index: Index, bins: int) -> set[tuple[int, int]]:
    """Candidate (row, item) pairs of a block of texts."""
    words = Words(data, offsets, word_bytes=ALNUM, lower=True)
    pairs: set[tuple[int, int]] = set()
    for k, (values, owners, maybe) in index.by_width.items():
        hashes, whole = words.grams(k)
        if not len(hashes):
            continue
        places = np.flatnonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)] & whole)
        low = np.searchsorted(values, hashes[places], side="left")
        high = np.searchsorted(values, hashes[places], side="right")
        for place, a, b in zip(places[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            row = int(words.row[place])
            first, end = int(words.first[row]), int(words.first[row + 1]) - k + 1
            for item in owners[a:b].tolist():
                if (row, item) not in pairs and least_in_window(hashes[first:end], place - first, index.size_class[item], bins):
                    pairs.add((row, item))
    return pairs


def passes_for(items: DataFrame, text_column: str, most: int) -> int:
    size = items.agg(F.sum(F.octet_length(F.col(text_column)))).first()[0] or 0
    return max(1, -(-size // most))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bins: int = BINS, pass_bytes: int = PASS_BYTES, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles (distinct, of the item), n_shared, containment of at least the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text")
    items = items.select(F.col(item_id_column).cast("long").alias("item_id"), F.col(item_text_column).alias("text"))
    passes = passes_for(items, "text", pass_bytes)
    out = None
    for n in range(passes):
        # of bounded size: a pass's share of the items
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n).collect()
        held = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part], width, bins))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                rows = []
                for first, _, data, offsets in blocks(texts):
                    found: dict[int, list[int]] = {}
                    for row, item in search(data, offsets, index, bins):
                        found.setdefault(row, []).append(item)
                    for row, candidates in sorted(found.items()):
                        words = WORD.findall(data[offsets[row] : offsets[row + 1]].tobytes().lower())
                        by_width = {k: shingles_of(words, k) for k in {index.width_of[i] for i in candidates}}
                        for item in sorted(candidates):
                            own = index.shingles[item]
                            shared = len(own & by_width[index.width_of[item]])
                            if shared >= threshold * len(own):
                                rows.append((ids[first + row].as_py(), index.ids[item], len(own), shared, shared / len(own)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])
            give_back()

        found = chosen.mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
