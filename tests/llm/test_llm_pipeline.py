"""The pipeline against its stages computed plainly from one another."""

import os
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from encoscope.llm import decontam, quality
from encoscope.llm.common import written
from test_llm_dedup import plain_classes, plain_fingerprint, plain_matches, plain_repeats
from test_llm_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "stage"))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text").collect())


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert [df.schema.simpleString() for df in stages[:-1]] == [stages[0].schema.simpleString()] * 5


def test_quality_stage(spark, stages):
    scored = quality.score_documents(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in scored.collect() if r["predicted"] == 0}
    assert bad and rows(stages[1]) == [r for r in rows(stages[0]) if r[0] not in bad]


def test_near_duplicate_stage(stages):
    given = rows(stages[1])
    classes = plain_classes([plain_fingerprint(t) for _, t in given], [i for i, _ in given])
    assert rows(stages[2]) == [r for r, c in zip(given, classes) if r[0] == c]


def test_repeat_stage(stages):
    given = rows(stages[2])
    want = [(i, p[4]) for (i, _), p in zip(given, plain_repeats([t for _, t in given]))]
    assert rows(stages[3]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_decontamination_stage(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    given = rows(stages[3])
    index = decontam.ItemIndex(items)
    kept = [r for r in given if not index.matches(r[1])]
    assert rows(stages[4]) == kept
    for text in [t for _, t in given][:60]:
        assert {m[0] for m in index.matches(text)} == set(plain_matches(text, items))


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    pieces = stages[5].collect()
    bins = check_packing(rows(stages[4]), pieces, 4096, tokenizer, 1)
    assert bins <= 1.02 * sum(r["length"] for r in pieces) / 4096 + 1


def test_run_gives_the_last_stage(spark, stages):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.select(names).collect()) == sorted(stages[5].select(names).collect())


def test_everything_is_registered():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
