"""License identity, and the aligner and the scan against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from casegraph.llm import licenses

KNOWN = licenses.prepared(licenses.rules())


def found(*texts):
    got = licenses.scan(pa.array(list(texts)), KNOWN, 0.8)
    return [[p[0] for p in got.get(i, [])] for i in range(len(texts))]


def test_each_template_names_its_own_license_only():
    rules = licenses.rules()
    for pad in ("", "some words before it "):
        for rule, names in zip(rules, found(*(pad + r.text + " and words after" for r in rules)), strict=True):
            assert names == [rule.license], rule.text
    assert len({r.license for r in rules}) > 25


def test_every_ordered_pair_of_notices():
    """A notice of one license stands before that of another: both are told, and nothing else."""
    rules = list({r.license: r for r in licenses.rules() if len(r.text.split()) < licenses.LONG}.values())
    pairs = [(a, b) for a in rules for b in rules]
    for (a, b), names in zip(pairs, found(*(f"First part. {a.text}. Then other words of the text stand here as filler. {b.text}. The end" for a, b in pairs)), strict=True):
        assert names == [a.license, b.license], (a.text, b.text)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Released under the BSD License.", ["BSD"]),
        ("Released under the GPL License.", ["GPL"]),
        ("Released under the MIT License.", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
        ("Licensed under CC BY-ND 2.0", []),
        ("Licensed under the GNU Lesser General Public License version 2", []),
        ("Licensed under the Python License", []),
        ("We do not talk of a license here, under the bridge by the river.", []),
    ],
)
def test_near_names_are_told_apart(text, names):
    assert found(text, "Intro words here. " + text + " More words") == [names, names]


def brute_increasing(pairs):
    return max((n for n in range(len(pairs) + 1) for c in combinations(pairs, n) if all(x[1] < y[1] for x, y in zip(c, c[1:]))), default=0)


def test_patience_takes_the_longest_increasing_subsequence():
    r = random.Random(2)
    for _ in range(300):
        n = r.randrange(9)
        pairs = list(enumerate(r.sample(range(n), n)))
        got = licenses._increasing(pairs)
        assert len(got) == brute_increasing(pairs) and all(x[1] < y[1] for x, y in zip(got, got[1:]))


def brute_aligned(a, b):
    """Patience alignment as its definition says, by recursion."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + brute_aligned(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + brute_aligned(a[:-1], b[:-1])
    ca, cb = Counter(a), Counter(b)
    anchors = [(i, b.index(x)) for i, x in enumerate(a) if ca[x] == cb[x] == 1]
    if not anchors:
        return 0
    best = {}
    for k, (i, j) in enumerate(anchors):
        best[k] = 1 + max((best[q] for q in range(k) if anchors[q][1] < j), default=0)
    return max(best.values())


def test_alignment_holds_its_anchors():
    r = random.Random(4)
    for _ in range(500):
        a, b = [r.randrange(9) for _ in range(r.randrange(12))], [r.randrange(9) for _ in range(r.randrange(12))]
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) >= brute_aligned(a, b)
    assert licenses.aligned(list("aXbYc"), list("aQbRc")) == [(0, 0), (2, 2), (4, 4)]


def test_scan_is_that_of_all_windows():
    """Of all windows that end at a word of the template."""
    r = random.Random(6)
    pool = [f"w{i}" for i in range(12)]
    rules = [licenses.Rule(f"L{k}", " ".join(r.choice(pool) for _ in range(n))) for k, n in enumerate((3, 5, 8, 13))]
    known = licenses.prepared(rules)
    texts = []
    for _ in range(300):
        w = [r.choice(pool) for _ in range(r.randrange(25))]
        if r.random() < 0.6:
            t = r.choice(rules).text.split()
            for _ in range(r.randrange(3)):
                t.insert(r.randrange(len(t) + 1), r.choice(pool))
            w[r.randrange(len(w) + 1) : 0] = t
        texts.append(" ".join(w))
    got = licenses.scan(pa.array(texts), known, 0.8)
    for row, text in enumerate(texts):
        words = licenses._hashes(text) if text else []
        for t in known:
            most = max((len(licenses.aligned(words[max(0, e - t.span) : e], t.words)) for e in range(1, len(words) + 1) if words[e - 1] in t.counts), default=0) / len(t.words)
            mine = [p for p in licenses._places(np.flatnonzero(np.isin(words, t.words)), [x for x in words if x in t.counts], np.array(words, np.uint64), t, 0.8)]
            assert bool(mine) == (most >= 0.8 - 1e-9), (text, t.name, most)
        assert bool(got.get(row)) == any(max((len(licenses.aligned(words[max(0, e - t.span) : e], t.words)) for e in range(1, len(words) + 1) if words[e - 1] in t.counts), default=0) >= 0.8 * len(t.words) - 1e-9 for t in known)
        places = got.get(row, [])
        assert all(a[3] <= b[2] for a, b in zip(places, places[1:]))


def test_long_texts_with_lines_in_between(spark):
    words = re.findall(r"\S+", licenses.TEXTS["MIT"][0])
    mixed = [x for i, w in enumerate(words) for x in ([w, "line"] if i % 2 else [w])]
    df = spark.createDataFrame([("a", "word " * 50_000 + " ".join(mixed), 1), ("a", None, 2), ("b", "", 3), ("b", "", 3)], "doc_id string, text string, license int")
    got = [(x["doc_id"], x["license"], x["n_licenses"]) for x in licenses.scanned(df).collect()]
    assert Counter(got) == Counter([("a", "MIT", 1), ("a", None, 0), ("b", None, 0), ("b", None, 0)])
