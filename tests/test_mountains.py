"""The append-only log against trees that are built anew."""

import pytest

from casegraph.plans import ledger, mountains


def plain_root(leaves):
    level = list(leaves)
    while len(level) > 1:
        level = [ledger.digest(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    return level[0] if level else ledger.ZERO


def test_appends_proofs_and_consistency(spark, tmp_path):
    folder, leaves, sizes = str(tmp_path / "log"), [ledger.digest(str(i)) for i in range(23)], []
    assert mountains.length(spark, folder) == 0
    for a, b in ((0, 1), (1, 6), (6, 6), (6, 13), (13, 23)):
        part = spark.createDataFrame([(i, leaves[i]) for i in range(a, b)][::-1], "at long, hash string")
        assert mountains.append(part, folder, ["at"]) == b
        sizes.append(b)
        assert mountains.root(spark, folder) == plain_root(leaves[:b])
    assert mountains.root(spark, folder, 6) == plain_root(leaves[:6])
    new = plain_root(leaves)
    for i in (0, 12, 22):
        proof = mountains.inclusion(spark, folder, i)
        assert len(proof) == 5 and ledger.proven(leaves[i], proof, new) and not ledger.proven(ledger.digest("x"), proof, new)
    for before in (1, 13):
        proof = mountains.consistency(spark, folder, before)
        old = plain_root(leaves[:before])
        assert mountains.consistent(before, old, new, proof)
        assert not mountains.consistent(before, plain_root(leaves[1 : before + 1]), new, proof) and not mountains.consistent(before + 1, old, new, proof)
    with pytest.raises(ValueError):
        mountains.inclusion(spark, folder, 23)


def test_edge_is_the_root_of_any_length():
    leaves = [ledger.digest(str(i)) for i in range(40)]
    for n in range(41):
        peaks = {(h, i): plain_root(leaves[i << h : (i + 1) << h]) for h, i in mountains._peaks(n)}
        assert mountains._edge(n, peaks)[1] == plain_root(leaves[:n])
