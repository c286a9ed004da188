"""Long texts that share a passage meet under it in pairs; all but the similar ones go by their wide sketches, before shingle sets are made."""

import random

import numpy as np

from casegraph.llm import neardup


def _texts():
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    lines = [words(40) for _ in range(15)]  # in two texts each
    texts = [" ".join([*words(1500 + i), *lines[i // 2], *words(900)]) for i in range(30)]
    base = words(1022)  # 1018 shingles; its copy has more than 1024, and so twice the classes
    copy = [*base[:500], *words(20), *base[500:]]
    return [*texts, " ".join(base), " ".join(copy)]


def test_wide_sketches_bound_the_difference():
    rnd = np.random.default_rng(3)
    for n, m in ((600, 600), (1000, 1100), (3000, 2500), (600, 400)):
        both = rnd.integers(0, 1 << 62, 300).astype("<u8")
        x, y = (np.unique(np.concatenate([both, rnd.integers(0, 1 << 62, k - 300).astype("<u8")])) for k in (n, m))
        bits = neardup.apart(neardup.wide(x.tobytes()), neardup.wide(y.tobytes()))
        assert bits <= len(np.setxor1d(x, y)) and (bits > 0) == (min(n, m) > 64 * neardup.SKETCH)


def test_pairs_of_long_texts_are_not_verified(spark, monkeypatch):
    seen, verified = [], neardup.verified

    def counted(pairs, sets, least):
        seen.append(pairs.count())
        return verified(pairs, sets, least)

    monkeypatch.setattr(neardup, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.similar_clusters(docs).collect()}
    assert found == {i: i for i in range(31)} | {31: 30}
    assert sum(seen) <= 2
