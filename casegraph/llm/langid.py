"""Language of the words of a text by a linear-chain conditional random field.

A sentence is a chain. A word's emission is the sum of learned weights of its hashed features: the whole word (the
lexicon), prefixes and suffixes of one to three bytes, and its inner three-byte windows. Learned transitions join
neighbouring words; forward-backward gives each word's posterior, so code-switched text gets a language per word. The
language of a text is that of the largest posterior mass. Training chains mix runs of words of different languages, so that
the transitions learn switches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._words import SPACE, Words, sliced

BITS = 16
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ASCII = _LETTER.copy()
_ASCII[128:] = False
_WORD = ~SPACE
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # float32[1 << BITS, languages]
    transitions: np.ndarray  # from, to


def _features(w: Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of each feature of the byte ranges."""
    n, size, shift = np.arange(len(start)), end - start, np.uint64(64 - BITS)
    at, h = [n], [w.hash(start, end)]
    for k in (1, 2, 3):
        long = np.flatnonzero(size > k)
        at += [long, long]
        h += [w.hash(start[long], start[long] + k) ^ np.uint64(k * 0x51ED27 << 30), w.hash(end[long] - k, end[long]) ^ np.uint64(k * 0x7A3D49 << 32)]
    inner = np.maximum(size - 2, 0)
    which = np.repeat(n, inner)
    pos = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + np.repeat(start, inner)
    at.append(which)
    h.append(w.hash(pos, pos + 3) ^ np.uint64(0x1234567 << 33))
    return np.concatenate(at), (np.concatenate(h) >> shift).astype(np.int64)


def _chains(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words that have a letter: their stripped start, end, row and the chain they are in."""
    letter = np.concatenate([[0], np.cumsum(_LETTER[w.raw])])
    has = np.flatnonzero(letter[w.end] > letter[w.start])
    # without what stands before the first and after the last letter
    mark = np.flatnonzero(_LETTER[w.raw])
    first = mark[np.searchsorted(mark, w.start[has])]
    last = mark[np.searchsorted(mark, w.end[has]) - 1] + 1
    row = w.row[has]
    stop = np.concatenate([[0], np.cumsum(_ENDS[w.raw])])
    new = np.ones(len(has), bool)
    new[1:] = (row[1:] != row[:-1]) | (stop[first[1:]] > stop[last[:-1]])
    return first, last, row, np.cumsum(new) - 1, has


def posteriors(emission: np.ndarray, chain: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Posterior of each label of each word by forward-backward, scaled at every step; with `pairs` also the expected
    transitions and the log-partition. Chains run side by side, the longest first."""
    n, labels = emission.shape
    if not n:
        return (np.zeros((0, labels)), np.zeros((labels, labels)), 0.0) if pairs else np.zeros((0, labels))
    count = np.bincount(chain)
    order = np.argsort(-count, kind="stable")
    begin = (np.cumsum(count) - count)[order]
    size = count[order]
    top = emission.max(1)
    e = np.exp(emission - top[:, None])
    t = np.exp(transitions)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    forward, scale = np.empty_like(e), np.empty(n)
    a = None
    for step, k in enumerate(active):
        at = begin[:k] + step
        a = e[at] / labels if a is None else (a[:k] @ t) * e[at]
        c = a.sum(1)
        a = a / c[:, None]
        forward[at], scale[at] = a, c
    backward = np.ones_like(e)
    expected = np.zeros_like(t)
    for step in range(len(active) - 1, 0, -1):
        at = begin[: active[step]] + step
        right = e[at] * backward[at] / scale[at][:, None]
        backward[at - 1] = right @ t.T
        if pairs:
            expected += forward[at - 1].T @ right
    out = forward * backward
    out /= out.sum(1, keepdims=True)
    return (out, expected * t, float(np.log(scale).sum() + top.sum())) if pairs else out


def fit_rows(texts: list[str], langs: list[str], steps: int = 40, rate: float = 0.15, l2: float = 1.0, run_words: int = 8, seed: int = 11) -> Model:
    """Penalised maximum likelihood by Adam over the whole sample. Chains are made of runs of about `run_words` words, drawn
    from all languages in turn; every word of a text carries the text's language."""
    languages = sorted(set(langs))
    if not texts:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    gold_of = np.array([languages.index(x) for x in langs])
    labels = len(languages)
    w = next(iter(sliced(pa.array(texts, pa.large_string()), _WORD, 1 << 62)))[2]  # the sample is bounded
    start, end, row, _, _ = _chains(w)
    n = len(start)
    if not n:
        return Model(languages, np.zeros((1 << BITS, labels), np.float32), np.zeros((labels, labels)))
    # runs in a drawn order: half of the neighbouring runs keep their order, so staying and switching are both seen
    run = np.cumsum(np.concatenate([[True], row[1:] != row[:-1]]) | (np.arange(n) % run_words == 0)) - 1
    rng = np.random.default_rng(seed)
    place = np.arange(run[-1] + 1)
    move = np.flatnonzero(rng.random(len(place)) < 0.5)
    place[move] = rng.permutation(place[move])
    order = np.lexsort((np.arange(n), place[run]))
    start, end, gold = start[order], end[order], gold_of[row[order]]
    chain = np.arange(n) // (4 * run_words)
    unique, first, word = np.unique(w.hash(start, end), return_index=True, return_inverse=True)
    at, feature = _features(w, start[first], end[first])
    used, col = np.unique(feature, return_inverse=True)
    size = len(used) * labels
    theta, m1, m2 = np.zeros(size + labels * labels), 0.0, 0.0
    gold_pairs = np.zeros((labels, labels))
    inside = chain[1:] == chain[:-1]
    np.add.at(gold_pairs, (gold[:-1][inside], gold[1:][inside]), 1)
    for step in range(1, steps + 1):
        v, t = theta[:size].reshape(-1, labels), theta[size:].reshape(labels, labels)
        of_word = np.stack([np.bincount(at, weights=v[col, k], minlength=len(unique)) for k in range(labels)], axis=1)
        p, expected, _ = posteriors(of_word[word], chain, t, True)
        p[np.arange(n), gold] -= 1
        off = np.stack([np.bincount(word, weights=p[:, k], minlength=len(unique)) for k in range(labels)], axis=1)
        g = np.stack([np.bincount(col, weights=off[at, k], minlength=len(used)) for k in range(labels)], axis=1)
        gradient = np.concatenate([(g + l2 * v).ravel(), (expected - gold_pairs + l2 * t).ravel()]) / n
        m1 = 0.9 * m1 + 0.1 * gradient
        m2 = 0.99 * m2 + 0.01 * gradient**2
        theta = theta - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros((1 << BITS, labels), np.float32)
    weights[used] = theta[:size].reshape(-1, labels)
    return Model(languages, weights, theta[size:].reshape(labels, labels))


def fit(docs: DataFrame, where: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 120, longest: int = 50_000, **options) -> Model:
    """Fits on a bounded sample of the rows where `where` holds: about `per_language` documents of each language, drawn by a
    hash of their id among those of at most `longest` bytes. Null languages and texts are left out."""
    known = docs.where(where).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, min(1.0, per_language / n)).otherwise(share)
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    rows = sorted(known.where((unit < share) & (F.octet_length("text") <= longest)).collect(), key=lambda r: (r["id"] is None, r["id"], r["text"]))
    return fit_rows([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def word_languages(text: str, model: Model) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word of one text that has a letter."""
    out = []
    for _, _, w in sliced(pa.array([text], pa.large_string()), _WORD):
        start, end, _, p = _labelled(w, model)
        best = p.argmax(1)
        out += [(bytes(w.raw[a:b]).decode(), model.languages[k], float(p[i, k])) for i, (a, b, k) in enumerate(zip(start, end, best, strict=True))]
    return out


def _labelled(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, row, chain, _ = _chains(w)
    if not len(start):
        return start, end, row, np.zeros((0, len(model.languages)))
    unique, first, word = np.unique(w.hash(start, end), return_index=True, return_inverse=True)
    at, feature = _features(w, start[first], end[first])
    order = np.argsort(at, kind="stable")
    of_word = np.add.reduceat(model.weights[feature[order]], np.searchsorted(at[order], np.arange(len(unique))), axis=0)
    return start, end, row, posteriors(of_word[word].astype(np.float64), chain, model.transitions)


def predicted(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., lang_pred, score, n_words) of every row; score is the language's share of the posterior mass of all
    words of the whole text. Null texts, texts without a letter, and all texts if no language was learned: und, score 0.
    Equal texts fare alike; an empty table gives an empty one."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 ** BITS weights a language
    own = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        labels = len(model.languages)
        for b in batches:
            mass, plain = np.zeros((b.num_rows, max(labels, 1))), np.zeros(b.num_rows, bool)
            for base, last, w in sliced(b.column(b.num_columns - 1), _WORD):
                if labels:
                    letters = np.concatenate([[0], np.cumsum(_ASCII[w.raw])])
                    plain[base:last] = letters[w.bounds[1:]] > letters[w.bounds[:-1]]
                    _, _, row, p = _labelled(w, model)
                    mass[base:last] = np.stack([np.bincount(row, weights=p[:, k], minlength=last - base) for k in range(labels)], axis=1)
            total, best = mass.sum(1), mass.argmax(1)
            found = total > 0
            for r in np.flatnonzero(found & ~plain):  # nothing but signs beyond ASCII, or letters of another script?
                found[r] = any(map(str.isalpha, b.column(b.num_columns - 1)[int(r)].as_py()))
            names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), found.tolist(), strict=True)]
            score = np.where(found, mass.max(1) / np.where(found, total, 1), 0.0)
            columns = [*b.columns[:-1], pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.rint(total).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(run, schema)
