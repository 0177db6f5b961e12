import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from quayside.llm.bpe import load_ranks


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("the", "and", "wat", "hou", "lig", "ste") for b in ("er", "se", "ht", "am", "ing", "")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(40)
    rows = [(i, text(120) + "\n" + text(50), "en", f"s{i % 12}", 0) for i in range(60)]
    notice = "All rights reserved by somebody"
    rows = [(i, t + "\n" + notice if i < 24 else t, k, s, n) for i, t, k, s, n in rows]
    rows += [(100, rows[30][1], "en", "s1", 0), (101, text(60) + " " + item + " " + text(60), "en", "s2", 0), (102, "12 34 !!", "en", "s3", 0), (103, None, None, None, None), (104, notice, "en", "s4", 0)]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return rows, notice, str(root)


def test_stages_take_effect(spark, made):
    rows, notice, root = made
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, root).collect()}
    # rejected: no letters, no text; boilerplate only; a copy; a leak
    assert set(got) == set(range(60))
    core = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, text, *_ in rows[:60]:
        kept = text if i == 0 else text.replace("\n" + notice, "")
        ids = core.encode_ordinary(kept)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_columns_and_empty_input(spark, made):
    docs = spark.read.parquet(f"{made[2]}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, made[2])
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS


def test_run_removes_what_it_is_done_with(spark, made):
    import os

    from quayside.llm.common import scratch_dir

    there = set(os.listdir(scratch_dir(spark)))
    corpus_pipeline.run(spark, made[2])
    new = set(os.listdir(scratch_dir(spark))) - there
    assert len(new) == 1 and new.pop().startswith("byte-level-bpe")
