"""Names of random letters hardly ever meet in the index, and similar ones always do."""

import random

from casegraph.plans import names


def test_random_names_do_not_meet(spark):
    r = random.Random(4)
    make = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(2))
    x = [(i, make()) for i in range(600)]
    y = [(i, n) for i, n in x[:100]] + [(i, " ".join(n.split()[::-1])) for i, n in x[100:200]] + [(i, n[:-1]) for i, n in x[200:300]]
    met = names.candidates(*(spark.createDataFrame(t, "id long, name string") for t in (x, y)), 88.0)
    got = {(t.a, t.b) for t in met.select("a", "b").collect()}
    assert {(i, i) for i in range(300)} <= got and len(got) < 0.005 * 600 * 300
