"""Token counts: pieces are counted once per distinct pre-token and summed over its frequencies.

The distinct pre-tokens of all documents are found by a grouped aggregation and each is counted once by the library's
merges. The counts of the frequent ones are broadcast (a bounded table) and summed where a document is read; a
document's other pre-tokens go on as rows (document, pre-token, frequency), are joined to the counts by pre-token and
summed by document. Ids are not built for documents. Special strings in a text count one each and divide it.

Defined results: a null text is empty (0 bytes, 0 tokens); texts are whole whatever their length;
repeated rows give a row each; an empty table gives no rows; further columns are ignored. A tokenizer that
is not byte-level, or normalizes texts, raises an error, since its pre-tokens depend on the text around them.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import give_back, table, written
from quayside.llm.pretokens import HOT, KEPT, PATTERN, Cutter, frequent, lexicon, table_of

def ranked(definition: dict) -> tiktoken.Encoding | None:
    """The same merges as ranks, which are faster on short strings; None unless each merge's id follows its place.

    With ids in the order of the merges, the lowest rank is the earliest merge, so both take the same steps.
    """
    model, cut = definition["model"], definition.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or definition.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("ignore_merges"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
    rest = [b for b in range(256) if b not in plain]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {x["content"] for x in definition.get("added_tokens", [])}
    vocabulary, last = model["vocab"], -1
    merged = set()
    for merge in model["merges"]:
        piece = "".join(merge.split(" ") if isinstance(merge, str) else merge)
        if vocabulary[piece] <= last:
            return None
        last = vocabulary[piece]
        merged.add(piece)
    pieces = {x: i for x, i in vocabulary.items() if x not in added}
    if any(len(x) > 1 and x not in merged for x in pieces):
        return None
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in x): i for x, i in pieces.items()}, special_tokens={})


def counter(definition: str):
    """A function from distinct pre-tokens to the library's number of pieces of each."""
    merges = ranked(json.loads(definition))
    if merges is not None:
        encode = merges.encode_ordinary
        return lambda words: [len(encode(w)) for w in words]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = plain(definition)
    return lambda words: list(map(len, tokenizer.encode_batch_fast(words, add_special_tokens=False)))


def plain(definition: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def specials(definition: str) -> tuple[str, ...]:
    """The strings that the library takes out of a text before it cuts it; each is one token."""
    cut = json.loads(definition)
    step = cut.get("pre_tokenizer") or {}
    if cut.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True):
        raise ValueError("only byte-level pre-tokenizers without a normalizer give the same pre-tokens in every text")
    added = cut.get("added_tokens", [])
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added):
        raise ValueError("special strings that depend on their neighbours are not supported")
    return tuple(x["content"] for x in added)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens are over the limit."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    definition = spark.sparkContext.broadcast(text)  # a vocabulary, of fixed size
    apart = specials(text)
    cutter = lambda: Cutter(PATTERN, apart)
    words = lexicon(docs, cutter, lambda: counter(definition.value), "long", text_column)
    known = spark.sparkContext.broadcast(table_of(frequent(words, hot)))  # at most `hot` short words

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's tokens in frequent pre-tokens, and the frequencies of all others."""
        cut, counts, kept = cutter(), known.value, {}
        row = TaskContext.get().partitionId() << 40

        def learn(x: str) -> tuple[int, tuple[str, ...]]:
            found = cut.after_space(x)
            return sum([counts.get(w, 0) for w in found]), tuple([w for w in found if w not in counts])

        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for x in batch.column(1):
                text = x.as_py() or ""
                parts, n = cut.parts(text)
                tails: Counter = Counter()
                rest: Counter = Counter()
                for part in parts:
                    cut.add(part, tails, rest)
                rare: Counter = Counter()
                for w, f in rest.items():
                    if w in counts:
                        n += counts[w] * f
                    else:
                        rare[w] += f
                for t, f in tails.items():
                    found = kept.get(t)
                    if found is None:
                        found = kept[t] = learn(t)
                    n += found[0] * f
                    for w in found[1]:
                        rare[w] += f
                if len(kept) > KEPT:
                    kept.clear()
                for column, value in zip(columns, (len(text.encode()), n, list(rare), list(rare.values())), strict=True):
                    column.append(value)
            size = batch.num_rows
            rows = pa.array(np.arange(row, row + size))
            row += size
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["row", "doc_id", "n_bytes", "n", "words", "times"])
        cut = counts = kept = None
        give_back()

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    partly = written(chosen.mapInArrow(tally, "row long, doc_id long, n_bytes long, n long, words array<string>, times array<long>"), "tallies")
    asked = partly.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    more = asked.join(words.select("word", "value"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
    whole = F.col("n") + F.coalesce("more", F.lit(0))
    return partly.select("row", "doc_id", "n_bytes", "n").join(more, "row", "left").select("doc_id", "n_bytes", whole.alias("n_tokens"), (whole > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
