"""BPE encoding and decoding by forced boundaries: pairs of symbols that no token holds mark certain cuts.

A merge joins two neighbours into a token, so across a pair of symbols that stands inside no token nothing is ever merged. Words are cut at
such pairs, each fragment is encoded by itself, and the ids are put together again. Where the tokenizer drops white space, no token holds
any, so texts are cut there first and equal pieces are encoded once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a text that are cut into pieces at once, and of the values that one Arrow batch holds before it is passed on.
SLICE, BATCH = 1 << 20, 1 << 22
#: Pieces and fragments that a worker remembers, each of at most so many bytes; the memory is turned over when it is full.
KNOWN, LONGEST = 150_000, 96
SPACE = re.compile(rb"[ \t-\r]")


def inner_pairs(merges: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """The pairs of symbols that stand side by side inside some token. Every token of more than one symbol comes from a merge, and a merge
    adds one pair to those of its halves: the left half's last symbol and the right half's first."""
    first: dict[str, str] = {}
    last: dict[str, str] = {}
    pairs = set()
    for a, b in merges:
        pairs.add((last.get(a, a), first.get(b, b)))
        first[a + b], last[a + b] = first.get(a, a), last.get(b, b)
    return pairs


class Known(dict):
    """Values by piece, computed when first asked for; pieces of more than LONGEST are not kept. When it is full, what it has stays at hand as the
    older generation, and what is asked for again moves back."""

    def __init__(self, compute):
        self.compute, self.older = compute, {}

    def __missing__(self, piece):
        value = self.older.get(piece)
        if value is None:
            value = self.compute(piece)
            if len(piece) > LONGEST:
                return value
        if len(self) >= KNOWN:
            self.older = self.copy()
            self.clear()
        self[piece] = value
        return value


def _ids(tokenizer, fragment: str) -> bytes:
    return np.array([t.id for t in tokenizer.model.tokenize(fragment)], "<u4").tobytes()


class Codec:
    """Encodes and decodes texts as the tokenizers library does with add_special_tokens=False and without truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only BPE without dropout, subword prefix and whole-word shortcuts has forced boundaries")
        if model.get("unk_token") is not None or model.get("byte_fallback"):
            raise ValueError("a vocabulary with an unknown token or byte fallback is not cut")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens have to be matched in the raw text as they stand")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.whole = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.inside = inner_pairs(merges)
        self.inner, self.last = {a + b for a, b in self.inside}, {a + b[0] for a, b in self.inside if b[1:] == self.suffix}  # the last symbol of a word has the suffix
        # a fragment that ends its word carries the suffix, one that is cut off from what follows does not
        self.ending = Tokenizer(BPE(model["vocab"], merges, **({"end_of_word_suffix": self.suffix} if self.suffix else {})))
        self.open = Tokenizer(BPE(model["vocab"], merges))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.decodes = spec["decoder"] is not None
        self.names = {i: t.encode() for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        held = {symbol[0] for pair in self.inside for symbol in pair}
        spaces = {s for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(" \t\n") for s in w} if self.whole.pre_tokenizer else {" "}
        self.drops_space = not self.whole.encode(" \t\n\r\x0b\x0c", add_special_tokens=False).ids and not spaces & held
        self.ends, self.opens, self.pieces = Known(partial(_ids, self.ending)), Known(partial(_ids, self.open)), Known(self._piece)
        self.plain = self._plain(spec)

    @staticmethod
    def _plain(spec: dict) -> tuple[regex.Pattern, bool] | None:
        """The words' pattern and whether to lower the case, where printable ASCII without white space needs no more than these: a tokenizer that
        composes, lowers, splits by one pattern and maps bytes to characters. None for others, whose every piece goes through the library."""
        norm, pre = ((spec[k] or {}).get(inner) for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if not norm or not pre or len(pre) != 2 or not {n["type"] for n in norm} <= {"NFC", "Replace", "Lowercase"}:
            return None
        spaces = all(n["type"] != "Replace" or n["pattern"] == {"Regex": r"\s+"} for n in norm)
        split, level = pre
        if not spaces or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True) or (level["type"], level["add_prefix_space"], level["use_regex"]) != ("ByteLevel", False, False):
            return None
        return regex.compile(split["pattern"]["Regex"]), any(n["type"] == "Lowercase" for n in norm)

    def cut(self, word: str) -> list[int]:
        """Where a word is cut: before symbols that no token has after the one before."""
        end = len(word) - 1
        cuts = [i for i in range(1, end) if word[i - 1 : i + 1] not in self.inner]
        return cuts if not end or word[end - 1 :] in self.last else [*cuts, end]

    def _words(self, text: str) -> list[str]:
        if self.plain and text.isascii() and text.isprintable() and " " not in text:
            pattern, lower = self.plain
            return pattern.findall(text.lower() if lower else text)
        text = self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text
        return [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)] if self.whole.pre_tokenizer else [text]

    def _piece(self, piece: bytes) -> bytes:
        text, out = piece.decode("utf-8", "replace"), []
        for part in self.mark.split(text) if self.mark else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
                continue
            for word in self._words(part):
                if word:
                    start = 0
                    for i in self.cut(word):
                        out.append(self.opens[word[start:i]])
                        start = i
                    out.append(self.ends[word[start:]])
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8, as little-endian unsigned 32-bit integers."""
        if not self.drops_space:
            return self._piece(text)
        out, at = [], 0
        while at < len(text):
            m = SPACE.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = m.start() if m else len(text)
            out.append(b"".join(map(self.pieces.__getitem__, text[at:end].split())))  # bytes.split() cuts at ASCII white space only
            at = end
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, special tokens included, in UTF-8; ids beyond the vocabulary have none, as in the library."""
        numbers = np.frombuffer(ids, "<u4")
        if self.decodes:
            return self.whole.decode(numbers.tolist(), skip_special_tokens=False).encode()
        parts = []
        for at in range(0, len(numbers), SLICE):
            some = numbers[at : at + SLICE].tolist()
            try:
                named = [*map(self.names.__getitem__, some)]
            except KeyError:
                named = [self.names[i] for i in some if i in self.names]
            if named:
                parts.append(b" ".join(named))
        return b" ".join(parts)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a tokenizer file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _mapped(df: DataFrame, source: str, path: str, what: str, kind: T.DataType, keep: list[str]) -> DataFrame:
    """The columns `keep` of `df` and `_out`, made of the binary column `source` by a method of the codec, in batches of bounded size."""
    at, kept, binary = df.columns.index(source), [df.columns.index(c) for c in keep], isinstance(kind, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = getattr(codec(path), what)
        for b in batches:
            values, start, held = [], 0, 0
            for i, x in enumerate(b.column(at), 1):
                values.append(work(x.as_buffer().to_pybytes() if x.is_valid else b""))
                held += len(values[-1])
                if held >= BATCH or i == b.num_rows:
                    made = pa.array(values, pa.binary() if binary else pa.string())
                    part = b.slice(start, i - start)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), made], names=[*keep, "_out"])
                    values, start, held = [], i, 0

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[k] for k in kept), T.StructField("_out", kind)]))


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of each row: ids are little-endian unsigned 32-bit integers, in the order of the whole text. path: a BPE file
    of the tokenizers library, readable by every executor; ValueError where its model has no certain cuts.

    Null and empty texts have no ids. Texts may be of any length: they are cut at white space in slices of a MB. doc_id may be of
    any type, null or repeated (a row each); an empty table gives an empty one; other columns are not read. Nothing is shuffled.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.col(text).cast("string"), "UTF-8").alias("_text"))
    out = _mapped(own, "_text", path, "encode", T.BinaryType(), ["doc_id"])
    return out.select("doc_id", (F.octet_length("_out") / 4).cast("long").alias("n_tokens"), F.col("_out").alias("ids"))


def decoded(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`tokens` with decoded, the text of the ids with special tokens, instead of any column so named; null ids give an empty text."""
    own = tokens.select(*(F.col(f"`{c}`") for c in tokens.columns if c.lower() != "decoded"))
    return _mapped(own, ids, path, "decode", T.StringType(), own.columns).withColumnRenamed("_out", "decoded")
