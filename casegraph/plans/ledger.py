"""The hash-chained ledger: append, parallel verification, Merkle root and proofs."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.store import written

ZERO = "0" * 64
FIELDS = ("index", "timestamp", "actor", "action", "subject_type", "subject_id", "payload_hash", "previous_hash", "detail")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str, ensure_ascii=False)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def entry_hash(entry: dict) -> str:
    return digest(canonical({k: entry[k] for k in FIELDS}))


def append(entries: list[dict], last: dict | None) -> list[dict]:
    """A batch chained to the last entry. Appending is serial by definition; a batch is what one request brings."""
    out, before = [], last["entry_hash"] if last else ZERO
    index = (last["index"] if last else -1) + 1
    for e in entries:
        row = {**{k: e.get(k, "") for k in FIELDS}, "index": index, "previous_hash": before, "payload_hash": digest(canonical(e.get("payload", {}))), "detail": str(e.get("detail", ""))[:2000]}
        before = row["entry_hash"] = entry_hash(row)
        out.append(row)
        index += 1
    return out


def content_hash(index: str = "index"):
    """The entry hash as a Column, over entries whose texts need no JSON escapes beyond quotes and backslashes."""
    esc = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [F.concat(F.lit(f'"{k}":'), F.col(index).cast("string") if k == "index" else esc(k)) for k in sorted(FIELDS)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def broken(ledger: DataFrame, check_content: bool = True) -> DataFrame:
    """(index, why) of each entry whose link or content is broken; an empty table is a whole chain. The predecessor comes by an
    equi-join on index - 1, so verification runs in parallel and no window holds the chain."""
    before = ledger.select((F.col("index") + 1).alias("index"), F.col("entry_hash").alias("was"))
    j = ledger.join(before, "index", "left")
    link = F.col("previous_hash") != F.coalesce("was", F.lit(ZERO))
    why = F.when(link, "link")
    if check_content:
        why = why.when(content_hash() != F.col("entry_hash"), "content")
    return j.select("index", why.alias("why")).where("why is not null")


def first_break(ledger: DataFrame) -> DataFrame:
    return broken(ledger).groupBy().agg(F.min("index").alias("index"), F.min_by("why", "index").alias("why"))


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables (i, hash) from the leaves to the root: parents hash the joined hex texts, an odd last one is joined with itself."""
    n = leaves.count()
    levels = [leaves.select("i", "hash")]
    while n > 1:
        up = levels[-1].groupBy(F.floor(F.col("i") / 2).cast("long").alias("i")).agg(F.min_by("hash", "i").alias("x"), F.max_by("hash", "i").alias("y"))
        levels.append(written(up.select("i", F.sha2(F.concat("x", "y"), 256).alias("hash")), "merkle"))
        n = -(-n // 2)
    return levels


def merkle_root(leaves: DataFrame) -> str:
    levels = merkle_levels(leaves)
    top = levels[-1].head()
    return top["hash"] if top else ZERO


def inclusion_proof(leaves: DataFrame, index: int) -> list[tuple[str, str]]:
    """(side, hash) of the siblings from the leaf up: one row of each level."""
    proof = []
    for level in merkle_levels(leaves)[:-1]:
        sibling = index ^ 1
        rows = {r["i"]: r["hash"] for r in level.where(F.col("i").isin(sibling, index)).collect()}
        proof.append(("left" if sibling < index else "right", rows.get(sibling, rows[index])))
        index //= 2
    return proof


def proven(leaf: str, proof: list[tuple[str, str]], root: str) -> bool:
    for side, h in proof:
        leaf = digest(h + leaf if side == "left" else leaf + h)
    return leaf == root


def stats(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("action").agg(F.count("*").alias("n"), F.max("index").alias("last"))


def anchor(ledger: DataFrame) -> dict:
    """Head and Merkle root, to be kept elsewhere."""
    head = ledger.orderBy(F.desc("index")).limit(1).head()
    leaves = ledger.select(F.col("index").alias("i"), F.col("entry_hash").alias("hash"))
    return {"index": head["index"] if head else -1, "head": head["entry_hash"] if head else ZERO, "root": merkle_root(leaves)}


# --- Ed25519 (RFC 8032) ---

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n, p):
    q = (0, 1, 1, 0)
    while n:
        if n & 1:
            q = _add(q, p)
        p, n = _add(p, p), n >> 1
    return q


def _x(y, sign):
    x2 = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(x2, (_P + 3) // 8, _P)
    if (x * x - x2) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - x2) % _P:
        return None
    return _P - x if x & 1 != sign else x


_Y = 4 * pow(5, -1, _P) % _P
_G = (_x(_Y, 0), _Y, 1, _x(_Y, 0) * _Y % _P)


def _packed(p) -> bytes:
    z = pow(p[2], -1, _P)
    return (p[1] * z % _P | (p[0] * z % _P & 1) << 255).to_bytes(32, "little")


def _point(b: bytes):
    n = int.from_bytes(b, "little")
    y, sign = n & (1 << 255) - 1, n >> 255
    x = _x(y, sign) if y < _P else None
    return None if x is None else (x, y, 1, x * y % _P)


def _h(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(key: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(key).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(key: bytes) -> bytes:
    return _packed(_times(_secret(key)[0], _G))


def sign(key: bytes, message: bytes) -> bytes:
    a, prefix = _secret(key)
    public = _packed(_times(a, _G))
    r = _h(prefix, message) % _L
    big_r = _packed(_times(r, _G))
    return big_r + ((r + _h(big_r, public, message) * a) % _L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    x, y = _times(s, _G), _add(r, _times(_h(signature[:32], public, message) % _L, a))
    return (x[0] * y[2] - y[0] * x[2]) % _P == 0 and (x[1] * y[2] - y[1] * x[2]) % _P == 0


def bad_signatures(ledger: DataFrame, public: bytes) -> DataFrame:
    """(index) of entries whose signature (hex, over the entry hash's text) does not verify, checked in parallel."""
    @F.pandas_udf("boolean")
    def ok(hashes: pd.Series, signatures: pd.Series) -> pd.Series:
        return pd.Series([s is not None and verify(public, h.encode(), bytes.fromhex(s)) for h, s in zip(hashes, signatures)])

    return ledger.where(~ok("entry_hash", "signature")).select("index")
