"""The pipeline's near-duplicate stage links by fingerprints and anchors first, then by shingles."""

import random

import corpus_pipeline
from casegraph.llm import neardup


def test_stage_goes_through_the_anchors(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for i in range(12):
        w = [f"w{r.randrange(10**6)}" for _ in range(300)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w[:-1], "end"])), (3 * i + 2, " ".join([*w[:-30], *(f"x{i}y{j}" for j in range(30))]))]
    asked, given = [], neardup.links
    monkeypatch.setattr(neardup, "links", lambda distinct, *a: asked.append({x["fp"] for x in distinct.collect()}) or given(distinct, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.deduplicate(spark, docs, "").collect()) == [3 * i for i in range(12)]  # the third by its shingles
    fp = {neardup.fingerprint(t, 5) for _, t in rows}
    assert asked == [{x - (1 << 64) if x >> 63 else x for x in fp}]
