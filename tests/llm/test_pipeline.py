"""The pipeline's stages against brute force, each on its own input, and the whole run."""

import re

import pytest

import corpus_pipeline as P
from reachlake.llm import quality
from reachlake.llm.common import keep
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, f in P.STAGES:
        docs = keep(f(spark, docs, SF), f"test-{name}")
        seen.append(docs)
    return seen


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing_to_weights"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality_stage(spark, stages):
    want = {r.doc_id for r in quality.quality_verdicts(stages[0]).where("kept").collect()}
    assert dict(pairs(stages[1])) == {k: t for k, t in pairs(stages[0]) if k in want}


def test_line_stage(stages):
    want = brute.line_dedup(pairs(stages[1]))
    assert {k: brute.sha(t) for k, t in pairs(stages[2])} == {k: v[2] for k, v in want.items()}


def shingles(t):
    w = brute.WS.findall(brute.low(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_stage(stages):
    """Of every pair at similarity 0.85 or more one document goes; every document that goes is like one that is there."""
    before, after = pairs(stages[2]), dict(pairs(stages[3]))
    sets = {k: shingles(t) for k, t in before}
    assert all(after[k] == t for k, t in before if k in after)
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if like(a, b) >= 0.85:
                assert a not in after
    for k in ids:
        assert k in after or any(like(k, o) >= 0.55 for o in ids if o != k)
    assert len(after) < len(before)


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = pairs(stages[3])
    hit = brute.decontamination(before, items)
    assert dict(pairs(stages[4])) == {k: t for k, t in before if not hit[k][-1]}


def test_mixing_stage_and_run(spark, stages):
    size = {k: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for k, t in pairs(stages[4])}
    rows = stages[5].collect()
    assert {r.doc_id: r.size for r in rows} == size
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].source_size == sum(r.size for r in own)
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, rows))
