"""Substring dedup: suffix automata of reference shards give matching statistics; long repeats are removed.

A window is `length` consecutive words. Which windows can repeat at all is found by minimisers: a window's anchor
is the shingle of ANCHOR words in it with the least hash, so equal windows have equal anchors at the same place.
All windows of one anchor occurrence form a passage. Passages are dealt by the anchor's hash; anchors that occur
once are done. Of passages with the same words the first stays as reference and the others are covered whole. An
anchor with several different passages is a reference shard: its passages, in order of document and place, are
streamed through the shard's suffix automaton, and each window at whose end the matching statistic reaches
`length` starts earlier too; then the passage joins the automaton. The words under such windows are removed.

The automata are not broadcast: a shard meets only the passages that share its anchor, because broadcasting all
shards to all documents is neither of bounded size nor linear. An anchor with more than MOST passages (a shared
passage's edge, with other words around each copy) is judged window by window with the same first-stays rule, so
no task gets one hot shard; and within each Arrow batch only the first of equal passages is dealt by hash at all.

Words are maximal runs without the six ASCII blanks. Passages are told apart by 64-bit hashes of their words;
within a shard the automaton compares the words' hashes. Defined results: null text has no words; rows alike in
id and text are treated alike, rows that share only the id are ordered by a hash of the text; a null id comes
after all others; texts shorter than a window lose nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import small_batches, table, written
from quayside.llm.hashing import STEP, Words, blocks, mix, powers

LENGTH, ANCHOR = 20, 8
MOST = 200
LAST = np.iinfo(np.int64).max
#: kind 0: dealt by anchor; 1: covered, known within the batch. at: first word; n: windows; shift: anchor's place.
PASSAGE = "key long, words long, id long, twin long, at int, n int, shift int, kind int"
NAMES = ["key", "words", "id", "twin", "at", "n", "shift", "kind"]
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())


class SuffixAutomaton:
    """Online suffix automaton over any hashable symbols; separate() starts a new passage in the same automaton."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.last = 0

    def separate(self) -> None:
        self.last = 0

    def add(self, symbol) -> None:
        next_, link, size = self.next, self.link, self.size
        p = self.last
        if symbol in next_[p]:  # only after separate(): the state may be there already
            q = next_[p][symbol]
            self.last = q if size[q] == size[p] + 1 else self._split(p, q, symbol)
            return
        new = len(size)
        next_.append({})
        size.append(size[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in next_[p]:
            next_[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = next_[p][symbol]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, q, symbol)
        self.last = new

    def _split(self, p: int, q: int, symbol) -> int:
        next_, link, size = self.next, self.link, self.size
        copy = len(size)
        next_.append(dict(next_[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and next_[p].get(symbol) == q:
            next_[p][symbol] = copy
            p = link[p]
        return copy

    def statistics(self, symbols) -> list[int]:
        """At each symbol the length of the longest stretch ending there that the automaton holds."""
        next_, link, size = self.next, self.link, self.size
        state = matched = 0
        out = []
        for s in symbols:
            while state and s not in next_[state]:
                state = link[state]
                matched = size[state]
            if s in next_[state]:
                state = next_[state][s]
                matched += 1
            else:
                matched = 0
            out.append(matched)
        return out


def stretches(hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the words from each place on, of the given number."""
    inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(STEP, len(hashes)), out=sums[1:])
    return mix((sums[at + size] - sums[at]) * powers(inverse, len(hashes) + 1)[at] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def passages(words: Words, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(first word, number of windows, anchor's place in the first window, anchor's hash, passage's hash) of a block."""
    grams, _ = words.grams(anchor)
    wide = length - anchor + 1
    n = len(words) - length + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    least = np.arange(n)
    value = grams[:n].copy()
    for j in range(1, wide):  # the leftmost of equal hashes stands
        other = grams[j : j + n]
        smaller = other < value
        value[smaller] = other[smaller]
        least[smaller] = (np.arange(n) + j)[smaller]
    starts = np.flatnonzero(words.row[:n] == words.row[length - 1 :])
    if not len(starts):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(starts) != 1) | (least[starts[1:]] != least[starts[:-1]])
    at = starts[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    shift = least[at] - at
    passage = stretches(words.hash, at, count + length - 1)
    return at, count, shift, grams[least[at]].view(np.int64), mix(passage + shift.astype(np.uint64)).view(np.int64)


def first_of_equal(batch: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Passages of one batch: of equal ones all but the first are covered, and dealt anywhere."""
    order = np.lexsort((batch["at"], batch["twin"], batch["id"], batch["words"]))
    b = {k: v[order] for k, v in batch.items()}
    same = np.zeros(len(order), dtype=bool)
    same[1:] = b["words"][1:] == b["words"][:-1]
    # rows alike are one occurrence
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    alike = (b["id"] == b["id"][head]) & (b["twin"] == b["twin"][head]) & (b["at"] == b["at"][head])
    covered = same & ~alike
    b["kind"] = covered.astype(np.int32)
    spread = mix(b["id"].view(np.uint64) + b["at"].astype(np.uint64) * STEP).view(np.int64)
    b["key"] = np.where(covered, spread, b["key"])
    keep = ~(same & alike)
    return pa.RecordBatch.from_arrays([pa.array(b[k][keep], t) for k, t in zip(NAMES, KINDS, strict=True)], NAMES)


def blank_batch() -> dict[str, list[np.ndarray]]:
    return {k: [] for k in NAMES[:-1]}


def joined(parts: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in parts.items()}


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def judged(dealt: DataFrame, most: int) -> DataFrame:
    """id, twin, at, n, verdict (0 covered, 1 to be judged in its shard, 2 window by window), key, from dealt passages."""
    rows = dealt.repartition("key").sortWithinPartitions("key", "kind", "id", "twin", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def verdicts(c: list[np.ndarray]) -> pa.RecordBatch:
            key, words, id_, twin, at, n, shift, kind = c
            order = np.lexsort((at, twin, id_, words, kind, key))
            key, words, id_, twin, at, n, shift, kind = (x[order] for x in (key, words, id_, twin, at, n, shift, kind))
            size = len(key)
            verdict = np.full(size, -1)
            verdict[kind == 1] = 0
            new = np.ones(size, dtype=bool)
            new[1:] = (words[1:] != words[:-1]) | (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(size), 0))
            alike = (id_ == id_[head]) & (twin == twin[head]) & (at == at[head])
            verdict[(kind == 0) & ~alike] = 0
            # different passages of one anchor
            whole = np.ones(size, dtype=bool)
            whole[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
            shard = np.cumsum(whole) - 1
            different = np.bincount(shard, weights=new)[shard] if size else np.zeros(0)
            firsts = new & (kind == 0)
            verdict[firsts & (different > 1)] = 1
            verdict[firsts & (different > most)] = 2
            keep = verdict >= 0
            columns = (id_, twin, at, n, verdict, key)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x[keep], t) for x, t in zip(columns, kinds, strict=True)], ["id", "twin", "at", "n", "verdict", "key"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            bound = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on
            if bound:
                yield verdicts([c[:bound] for c in columns])
            held = [c[bound:] for c in columns]
        if held:
            yield verdicts(held)

    return rows.mapInArrow(run, "id long, twin long, at int, n int, verdict int, key long")


def per_document(rows: DataFrame) -> DataFrame:
    """id, twin and a list of structs (at, n, verdict, key) of each document."""
    return rows.groupBy("id", "twin").agg(F.collect_list(F.struct("at", "n", "verdict", "key")).alias("marks"))


def with_marks(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    return texts.join(marks, ["id", "twin"], how)


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space; and these words if asked for."""
    small_batches(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(int(LAST))).alias("id"),
        F.xxhash64(F.col(text_column)).alias("twin"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = ids_of(batch.column(0)), ids_of(batch.column(1))
            parts = blank_batch()
            for first, _, data, offsets in blocks(batch.column(2)):
                words = Words(data, offsets)
                at, n, shift, key, passage = passages(words, length, anchor)
                row = words.row[at] if len(at) else at
                for k, v in (("key", key), ("words", passage), ("id", ids[first + row]), ("twin", twins[first + row]), ("at", at - words.first[row]), ("n", n), ("shift", shift)):
                    parts[k].append(v)
            yield first_of_equal(joined(parts))

    verdicts = written(judged(texts.select("id", "twin", "text").mapInArrow(deal, PASSAGE), most), "verdicts")
    asked = per_document(verdicts.where("verdict > 0"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of passages to be judged; windows of hot anchors as passages of their own (hot: 1)."""
        for batch in batches:
            ids, twins, marks = ids_of(batch.column(0)), ids_of(batch.column(1)), batch.column(3).to_pylist()
            hot = blank_batch()
            out: list[list] = [[], [], [], [], []]
            for first, end, data, offsets in blocks(batch.column(2)):
                words = Words(data, offsets)
                for row in range(first, end):
                    base = int(words.first[row - first])
                    for m in marks[row]:
                        start = base + m["at"]
                        if m["verdict"] == 1:
                            for column, value in zip(out, (m["key"], ids[row], twins[row], m["at"], words.hash[start : start + m["n"] + length - 1].tobytes()), strict=True):
                                column.append(value)
                        else:
                            at = np.arange(start, start + m["n"])
                            window = stretches(words.hash, at, np.full(m["n"], length)).view(np.int64)
                            for k, v in (("key", window), ("words", window), ("id", np.full(len(at), ids[row])), ("twin", np.full(len(at), twins[row])), ("at", at - base), ("n", np.ones(len(at), dtype=np.int64)), ("shift", np.zeros(len(at), dtype=np.int64))):
                                hot[k].append(v)
            one = first_of_equal(joined(hot))
            none = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.array(out[0], dtype=np.int64), one.column(0).to_numpy()])),
                    pa.concat_arrays([pa.nulls(none, pa.int64()), one.column(1)]),
                    pa.array(np.concatenate([np.array(out[1], dtype=np.int64), one.column(2).to_numpy()])),
                    pa.array(np.concatenate([np.array(out[2], dtype=np.int64), one.column(3).to_numpy()])),
                    pa.array(np.concatenate([np.array(out[3], dtype=np.int32), one.column(4).to_numpy()]), pa.int32()),
                    pa.concat_arrays([pa.nulls(none, pa.int32()), one.column(5)]),
                    pa.concat_arrays([pa.nulls(none, pa.int32()), one.column(6)]),
                    pa.concat_arrays([pa.nulls(none, pa.int32()), one.column(7)]),
                    pa.array(out[4] + [None] * len(one), pa.binary()),
                ],
                [*NAMES, "symbols"],
            )

    fetched = written(with_marks(texts.select("id", "twin", "text"), asked, "inner").mapInArrow(fetch, PASSAGE + ", symbols binary"), "passages")
    windows = judged(fetched.where("symbols is null").drop("symbols"), 1 << 62).where("verdict = 0")
    shards = fetched.where("symbols is not null").select("key", "id", "twin", "at", "symbols").repartition("key").sortWithinPartitions("key", "id", "twin", "at")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, last = None, SuffixAutomaton(), None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for k, id_, twin, at, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, id_, twin, at) == last:  # of a row alike
                    continue
                last = (k, id_, twin, at)
                if k != key:
                    key, automaton = k, SuffixAutomaton()
                symbols = np.frombuffer(symbols, dtype=np.uint64).tolist()
                found = [i - length + 1 for i, m in enumerate(automaton.statistics(symbols)) if m >= length]
                run_ = None
                for w in found:  # consecutive windows are one span
                    if run_ and w == run_[0] + run_[1]:
                        run_[1] += 1
                    else:
                        if run_:
                            out.append((id_, twin, at + run_[0], run_[1]))
                        run_ = [w, 1]
                if run_:
                    out.append((id_, twin, at + run_[0], run_[1]))
                automaton.separate()
                for s in symbols:
                    automaton.add(s)
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "twin", "at", "n"])

    spans = shards.mapInArrow(stream, "id long, twin long, at int, n int")
    columns = ["id", "twin", "at", "n"]
    covered = verdicts.where("verdict = 0").select(columns).union(windows.select(columns)).union(spans)
    covered = per_document(covered.withColumn("verdict", F.lit(0)).withColumn("key", F.lit(0).cast("long"))).withColumn("marks", F.expr("transform(marks, m -> struct(m.at as at, m.n as n))"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2).to_pylist()
            columns: list[list] = [[], [], [], []]
            for text, found in zip(batch.column(1), marks, strict=True):
                words = text.as_py().encode().split()
                n = len(words)
                if found:
                    change = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(change, [m["at"] for m in found], 1)
                    np.add.at(change, [m["at"] + m["n"] + length - 1 for m in found], -1)
                    gone = np.cumsum(change)[:n] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                for column, value in zip(columns, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    column.append(value)
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(columns[3], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return with_marks(texts, covered, "left").select("doc_id", "text", "marks").mapInArrow(cut, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
