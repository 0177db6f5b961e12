"""BPE and token counts against the tokenizer libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

import pytest

from quayside.llm.bpe import Merges, decode, encode, load_ranks, replay, replay_all
from quayside.llm.token_counts import ranked, specials, token_counts

PARTS = [" ", "  ", "\n", " \n", "a", "the", "é", "\t", "12", "!!", "'s", "　", "\xa0", "\x1c", "ß", "你好", "🙂", "<|endoftext|>", ".", "aaaa", "_", "İ", "\x85", "'S"]
RANKS = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", " ", "x" * 3000, "word " * 3000]


@pytest.mark.parametrize("hot", [0, 40, 1 << 17])
def test_encoded_tables_match_library(spark, hot):
    """With no, some or all pre-tokens broadcast, repeated rows and clashing columns included."""
    rows = list(enumerate(texts())) + [(0, texts()[0])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int").repartition(5)
    got = sorted((r.doc_id, r.ids) for r in encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=True, hot=hot).collect())
    assert got == sorted((i, LIBRARY.encode_ordinary(x)) for i, x in rows)


@pytest.mark.parametrize("hot", [0, 40, 1 << 17])
def test_counts_match_library(spark, hot):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = list(enumerate(texts())) + [(0, texts()[0])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs, P.path("byte_bpe_50k.json"), hot=hot).collect())
    assert got == sorted((i, len(x.encode()), len(library.encode(x, add_special_tokens=False))) for i, x in rows)
    assert token_counts(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_lower_rank_that_comes_up_late_is_merged_first():
    # abc ranks below ab, and bc is no piece: merging ab brings up a pair of lower rank
    ranks = {bytes([b]): i for i, b in enumerate(b"abcd")} | {b"abc": 4, b"ab": 5, b"abcab": 6, b"cd": 7}
    words = [b"abcabc", b"ababcd", b"abcdabcd", b"aab"]
    merges = Merges(ranks)
    merges.byte_ids[merges.byte_ids < 0] = 0
    slow = replay(words, ranks)
    fast = [np.frombuffer(x, "<u4").tolist() for x in replay_all(words, merges)]
    assert fast == slow
    core = tiktoken.Encoding("tiny", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    assert slow == [core.encode_ordinary(w.decode()) for w in words]


def test_encode_table(spark):
    rows = [(1, "the ünïcode text", "x"), (1, "the ünïcode text", "x"), (2, None, None), (None, "", "y"), (3, "<|endoftext|> end", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    full = encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=True)
    got = sorted((tuple(r) for r in full.collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=str)
    back = sorted(str(bytes(r.decoded).decode()) for r in decode(full, P.path("byte_bpe_multi_50k.tiktoken")).collect())
    assert back == sorted(t or "" for _, t, _ in rows)
    assert encode(docs.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_merges_in_order_of_rank_only():
    import json

    assert ranked(json.load(open(P.path("byte_bpe_50k.json")))) is not None
    assert ranked(json.load(open(P.path("word_bpe_49k.json")))) is None
    with pytest.raises(ValueError):
        specials(open(P.path("word_bpe_49k.json")).read())


def test_count_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "é " * 2000), (None, "<|endoftext|>")], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got[1, 3] == (2, False) and got[2, 0] == (0, False) and got[None, 13] == (1, False) and got[2, 6000][1] is True


def test_stretches_of_a_task_are_replayed_once(monkeypatch):
    from quayside.llm import bpe
    from quayside.llm.pretokens import PATTERN, Cutter

    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: letters[i // 17576] + letters[i // 676 % 26] + letters[i // 26 % 26] + letters[i % 26]
    done, replayed = [], bpe.replayed
    monkeypatch.setattr(bpe, "replayed", lambda words, merges: done.append(len(words)) or replayed(words, merges))
    encoder = bpe.Encoder(bpe.Merges({bytes([i]): i for i in range(256)}), {}, Cutter(PATTERN))
    texts = [" ".join(map(word, range(a, a + 90_000))) for a in (0, 90_000, 0)]
    first, _, again = (encoder.encode([text])[0] for text in texts)
    assert first == again and sum(done) < 181_000
