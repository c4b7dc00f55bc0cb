import hashlib
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import bpe, mixing, toxicity
from terrane.llm.common import materialise, table

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [table(spark, SF, "documents")]
    for _, f in corpus_pipeline.STAGES:
        out.append(materialise(f(spark, out[-1], SF)))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    for s in stages[:-1]:
        assert s.columns == stages[0].columns


def test_toxicity_stage(spark, stages):
    model = toxicity.fit(stages[0], table(spark, SF, "labels"))
    good = {r.doc_id for r in toxicity.score(stages[0], model).where("predicted = 0").collect()}
    assert {r.doc_id for r in stages[1].collect()} == good


def test_near_duplicate_stage(stages):
    before = sorted(rows(stages[1].select("doc_id", "text")))
    up = list(range(len(before)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in brute.jaccard_links([t for _, t in before], 0.8):
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert sorted(rows(stages[2].select("doc_id", "text"))) == [r for k, r in enumerate(before) if find(k) == k]


def test_repeats_stage(stages):
    before = rows(stages[2].select("doc_id", "text"))
    data = [(t or "").encode() for _, t in before]
    seen = defaultdict(int)
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] += 1
    want = []
    for (i, _), d in zip(before, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want.append((i, bytes(b for b, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore")))
    assert sorted(rows(stages[3].select("doc_id", "text"))) == sorted(want)


def test_mix_stage(stages):
    plan = {r.doc_id: (r.size, r.copies) for r in mixing.mix(stages[3]).collect()}
    got = defaultdict(int)
    for r in stages[4].collect():
        got[r.doc_id] += 1
    assert got == {i: 1 if n == 0 else c for i, (n, c) in plan.items() if n == 0 or c}


def test_encoding_stage(stages):
    vocab = bpe.read_ranks(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes())
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocab)}, special_tokens={})
    want = []
    for r in stages[4].collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(rows(stages[5])) == sorted(want)


def test_run_is_the_stages(spark, stages):
    assert sorted(rows(corpus_pipeline.run(spark, SF))) == sorted(rows(stages[5]))


def nasty(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near, "en", "a", 5), (1, near, "en", "a", 5), (2, near + " x", "en", None, None), (None, None, None, None, None), (None, "", "de", "b", 0), (3, " ", "en", "b", 1)]
    rows += [(None, near, "en", "a", 5), (7, "y" * 2_000_000, "en", "c", 2_000_000), (8, "z " * 500, "en", "c", 1000), (8, "other words", "en", "c", 11)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_nulls_repeats_and_an_extra_column(spark):
    """Every stage takes what the one before it kept; no row without words is lost before the last one."""
    docs = nasty(spark).withColumn("rid", F.lit("own")).withColumn("copies", F.lit(1))
    bare = docs.where("trim(coalesce(text, '')) = ''").count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert out.where("rid <> 'own' or copies <> 1").count() == 0
        assert out.where("trim(coalesce(text, '')) = ''").count() >= bare, name
        if name == "n-gram Jaccard join":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.where("text like 'w0%'").collect()) == [(False, 1)]
        docs = out
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids.count() == docs.count()


def test_stages_on_an_empty_table(spark):
    docs = nasty(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if "n_tokens" in out.columns else out
