"""Similar names against a comparison of all pairs."""

import random

import pytest

from casegraph.functions.similarity import weighted_ratio
from casegraph.plans import names

FIRST = ("Ravi", "Rohan", "Anita", "A", "Mohd", "Jean-Luc", "Élodie", "K L", "Xu")
LAST = ("Kumar", "Kumari", "Sharma", "Verma", "de Souza", "D'Souza", "Li", "Rao", "Khan", "Blue Star Traders", "Silver Line Exports Private Limited")


def altered(r, s):
    for _ in range(r.randrange(0, 3)):
        i, kind = r.randrange(len(s) + 1), r.randrange(4)
        if kind == 0:
            s = s[:i] + r.choice("abekr ") + s[i:]
        elif kind == 1:
            s = s[: max(0, i - 1)] + s[i:]
        elif kind == 2:
            w = s.split(" ")
            r.shuffle(w)
            s = " ".join(w)
        else:
            s = s + r.choice([" Ltd", " Kumar", "  x", " and Sons"])
    return s


@pytest.mark.parametrize("least", [88.0, 92.0])
def test_no_pair_is_lost(spark, least):
    r = random.Random(int(least))
    base = [f"{a} {b}" for a in FIRST for b in LAST] + ["a b c rao", "a b c rxo", "a b c d", "abcdefghij", "Ravi Ravi Kumar", "xx", "x"]
    x = [(i, altered(r, r.choice(base))) for i in range(220)] + [(900, None), (901, " "), (902, "Ravi Kumar")]
    y = [(1000 + i, altered(r, r.choice(base))) for i in range(220)] + [(1900, ""), (1901, "Ravi Kumar"), (1901, "Ravi Kumar")]
    want = {(a, p, b, q) for a, p in x for b, q in y if p and q and p.strip() and q.strip() and weighted_ratio(p, q) >= least}
    got = names.similar(*(spark.createDataFrame(t, "id long, name string") for t in (x, y)), least)
    assert {(t.a, t.la, t.b, t.lb) for t in got.collect()} == want and len(want) > 200


def test_few_pairs_meet(spark):
    r = random.Random(1)
    make = lambda n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) + " " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)]
    x, y = (spark.createDataFrame(list(enumerate(make(400))), "id long, name string") for _ in range(2))
    assert names.candidates(x, y, 92.0).count() < 0.15 * 400 * 400
    assert names.similar(x.limit(0), y, 92.0).count() == 0
    with pytest.raises(ValueError):
        names.candidates(x, y, 80.0)
