"""The distinct pre-tokens of a corpus: cut, counted, the frequent ones, and a value for each.

counted() cuts all texts and counts pre-tokens by a grouped aggregation; lexicon() gives each distinct one a value once,
in the task that the shuffle deals it to. frequent() picks, by a histogram of the counts, at most HOT of them, so that
a table of bounded size can be broadcast; callers join all others by the pre-token itself. So no pre-token is
valued twice, a frequent one is not shuffled document by document, and no part of the corpus is left out.

A text is first split at single spaces; a stretch between two of them is cut by the pattern with its space. Texts in
which a pre-token may cross a space (white space on both sides of it) are cut whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import give_back, small_batches, written

#: Frequent pre-tokens that are broadcast, and the length up to which one may be among them.
HOT, HOT_CHARS = 1 << 18, 64
#: Entries of a task's tables, which are emptied beyond; this changes no result.
KEPT, COUNTED = 150_000, 400_000
#: White space on both sides of a space: there a pre-token may cross the space.
_CROSSING, _MAYBE = re.compile(r"\s (?:\s|\Z)").search, re.compile(r" (?:\s|\Z)").search
#: Letters, all of them such by any version of Unicode, and perhaps one mark.
LETTERS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)").fullmatch
#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def crosses(text: str) -> bool:
    return _MAYBE(text) is not None and _CROSSING(text) is not None


class Cutter:
    """Cuts texts into pre-tokens; special strings stand for themselves and divide a text."""

    def __init__(self, pattern: str, specials: tuple[str, ...] = ()):
        self.find = regex.compile(pattern).findall
        #: whether a run of letters with the space before it is one pre-token, and a mark behind it another
        self.plain = pattern == PATTERN
        longest = sorted(specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if longest else None

    def after_space(self, x: str) -> list[str]:
        """The pre-tokens of a space and the stretch behind it."""
        if self.plain and (m := LETTERS(x)):
            return [" " + m[1], m[2]] if m[2] else [" " + x]
        return self.find(" " + x)

    def parts(self, text: str | None) -> tuple[list[str], int]:
        """(the texts between special strings, number of these)."""
        text = text or ""
        if self.special is None or not self.special.search(text):
            return [text], 0
        found = self.special.split(text)
        return found, len(found) - 1

    def add(self, text: str, tails: Counter, words: Counter) -> None:
        """Add a text's stretches that follow a space, and the pre-tokens of all the rest."""
        if crosses(text):
            words.update(self.find(text))
        else:
            head, *rest = text.split(" ")
            tails.update(rest)
            words.update(self.find(head))


def _strings(batch: pa.RecordBatch, column: int) -> Iterator[str | None]:
    for x in batch.column(column):
        yield x.as_py()


def counted(docs: DataFrame, cutter: Callable[[], Cutter], text_column: str = "text", leading: int | None = None) -> DataFrame:
    """word, n: every distinct pre-token with its number of occurrences in all texts.

    leading: of each table of a task only so many of the most frequent ones, for finding what is frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter()
        tails: Counter = Counter()
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            for x, n in tails.items():
                for w in cut.after_space(x):
                    words[w] += n
            some = dict(words if leading is None else words.most_common(leading))
            found = pa.RecordBatch.from_arrays([pa.array(some.keys(), pa.string()), pa.array(some.values(), pa.int64())], ["word", "n"])
            tails.clear()
            words.clear()
            return found

        for batch in batches:
            for text in _strings(batch, 0):
                for part in cut.parts(text)[0]:
                    cut.add(part, tails, words)
                if len(tails) > COUNTED or len(words) > COUNTED:
                    yield out()
        yield out()
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(text_column).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, cutter: Callable[[], Cutter], valued: Callable[[], Callable[[list[str]], list]], kind: str, text_column: str = "text") -> DataFrame:
    """word, n, value: each distinct pre-token of the texts, valued once; kind is the value's type."""
    to = pa.binary() if kind == "binary" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_of = valued()
        for batch in batches:
            values = value_of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, to)], ["word", "n", "value"])
        value_of = None
        give_back()

    return written(counted(docs, cutter, text_column).mapInArrow(run, f"word string, n long, value {kind}"), "lexicon")


def frequent(words: DataFrame, most: int = HOT) -> DataFrame:
    """The rows of the most frequent words (word, n), at most `most` of them and none longer than HOT_CHARS."""
    short = words.where(F.length("word") <= HOT_CHARS)
    # sixteen steps for each doubling of the count: a histogram of at most some hundred rows
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = short.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect()
    held, least = 0, None
    for r in sizes:
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    return short.where(F.lit(False) if least is None else step >= least)


def table_of(words: DataFrame) -> dict:
    """word -> value, of a table whose size is bounded by frequent()."""
    return {r.word: r.value if isinstance(r.value, int) else bytes(r.value) for r in words.select("word", "value").toLocalIterator()}
