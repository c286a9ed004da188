"""Decontamination against all item-sized windows: reordered, split, interleaved and repeated passages."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from casegraph.llm import decontam


def best_share(words, item, least):
    k = min(5, len(item))
    need = Counter(tuple(item[i : i + k]) for i in range(len(item) - k + 1))
    best = 0.0
    for s in range(max(1, len(words) - len(item) + 1)):
        w = words[s : s + len(item)]
        have = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        best = max(best, sum(min(n, have[x]) for x, n in need.items()) / sum(need.values()))
    return best


def altered(r, item):
    kind = r.randrange(7)
    w = list(item)
    if kind == 0:  # halves in the other order
        cut = r.randrange(1, len(w)) if len(w) > 1 else 0
        return w[cut:] + w[:cut]
    if kind == 1:  # words put in between
        for _ in range(r.randrange(1, 4)):
            w.insert(r.randrange(len(w) + 1), f"in{r.randrange(99)}")
        return w
    if kind == 2:  # words changed
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = f"ch{r.randrange(99)}"
        return w
    if kind == 3:  # split by a run of other words
        cut = r.randrange(len(w))
        return w[:cut] + [f"gap{i}" for i in range(r.randrange(1, 12))] + w[cut:]
    if kind == 4:  # a part only
        return w[r.randrange(len(w) // 4 + 1) : len(w) - r.randrange(len(w) // 4 + 1)]
    if kind == 5:  # twice, the first time damaged
        return w[: len(w) // 2] + w
    return w


@pytest.mark.parametrize("seed", range(4))
def test_all_windows(seed):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(30 if seed % 2 else 400)]
    items = [[r.choice(pool) for _ in range(r.choice((1, 2, 4, 5, 6, 9, 20, 60, 100)))] for _ in range(25)]
    ix = decontam.index([(i, " ".join(x)) for i, x in enumerate(items)])
    texts = []
    for _ in range(90):
        w = [r.choice(pool) for _ in range(r.choice((0, 3, 40, 300)))]
        for _ in range(r.randrange(1, 3)):
            w += altered(r, r.choice(items)) + [r.choice(pool) for _ in range(r.choice((0, 3, 40, 300)))]
        texts.append(w)
    found = {(row, ix.ids[y]): share for row, y, share, _ in decontam.matches(pa.array([" ".join(t) for t in texts]), ix, 0.8)}
    passed = 0
    for row, t in enumerate(texts):
        have = set(t)
        for i, item in enumerate(items):
            share = best_share(t, item, 0.8) if len(have.intersection(item)) >= 0.5 * len(set(item)) else 0.0
            assert ((row, i) in found) == (share >= 0.8 - 1e-9), (t, item, share)
            if share >= 0.8 - 1e-9:
                passed += 1
                assert found[row, i] <= share + 1e-9
    assert passed > 60


def test_halves_in_the_other_order():
    item, pad = [f"i{j}" for j in range(100)], [f"p{j}" for j in range(600)]
    ix = decontam.index([(1, " ".join(item))])
    got = decontam.matches(pa.array([" ".join(pad[:300] + item[50:] + item[:50] + pad[300:])]), ix, 0.8)
    assert [(m[0], round(m[2], 3), m[3]) for m in got] == [(0, 0.958, 300)]


def test_items_beyond_the_radius_are_kept():
    r = random.Random(3)
    ix = decontam.index([(0, " ".join(f"x{j}" for j in range(14)))])
    for _ in range(1500):  # just the threshold's share: 8 of 10 shingles
        w = [f"x{j}" for j in range(12)] + [f"o{r.randrange(10**9)}", f"o{r.randrange(10**9)}"]
        assert len(decontam.matches(pa.array([" ".join(w)]), ix, 0.8)) == 1


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids_of_any_type_and_repeated_items(spark, kind):
    ids = ["", "a", None, "b"] if kind == "string" else [0, 5, None, 7]
    texts = {i: " ".join(f"t{k}x{j}" for j in range(12)) for k, i in enumerate(ids)}
    items = spark.createDataFrame([(i, texts[i], 1) for i in ids for _ in range(3)], f"item_id {kind}, text string, doc_id int")
    docs = spark.createDataFrame([(f"d{k}", "intro " + texts[i] + " end") for k, i in enumerate(ids)] * 2, "doc_id string, text string")
    want = Counter((f"d{k}", i) for k, i in enumerate(ids) for _ in range(6))
    for most in (400, 5, 1):
        got = decontam.contaminated(docs, items, most_items=most).collect()
        assert Counter((x["doc_id"], x["item_id"]) for x in got) == want and {x["start_word"] for x in got} == {1}
    assert decontam.clean(docs, items, most_items=5).count() == 0
