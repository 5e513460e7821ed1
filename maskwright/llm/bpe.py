"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a pre-token there is exactly one token that can end its BPE encoding. An automaton over the
vocabulary, with suffix links, gives the tokens that end at a position, longest first. The first of them
that starts at 0, or whose pair with the unique last token of the prefix before it is compatible (BPE leaves the two as
they are), is the one. Back-pointers from the end give the ids.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, real_id, table, tidy

#: The pattern that byte-level pre-tokenizers of this kind cut by (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker remembers, in each of two generations, and the longest one remembered.
REMEMBERED, LONGEST = 400_000, 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def check_spec(spec: dict) -> None:
    """Raises ValueError for a tokenizer file that asks for anything that isn't done here, rather than giving other ids than it."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    wrong = [
        name for name, bad in {
            "model": model.get("type", "BPE") != "BPE", "normalizer": spec.get("normalizer") is not None,
            "pre_tokenizer": pre.get("type") != "ByteLevel" or not pre.get("use_regex", True), "add_prefix_space": bool(pre.get("add_prefix_space")),
            "dropout": bool(model.get("dropout")), "ignore_merges": bool(model.get("ignore_merges")), "continuing_subword_prefix": bool(model.get("continuing_subword_prefix")),
            "end_of_word_suffix": bool(model.get("end_of_word_suffix")), "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
            "added_tokens": any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])),
        }.items() if bad
    ]
    if wrong:
        raise ValueError(f"unsupported in the tokenizer file: {', '.join(wrong)}")


class Bpe:
    """path: a tokenizer file of the tokenizers library with a byte-level BPE model and no normalizer."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        check_spec(spec)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        id_of = {t: i for i, t in self.bytes_of.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        text_id = spec["model"]["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = text_id[a], text_id[b]
            self.rank[key], self.joined[key] = k, text_id[a + b]
            if text_id[a + b] not in self.parts:
                self.parts[text_id[a + b]], self.born[text_id[a + b]] = key, k
        self.decoded = self.bytes_of | {i: t.encode() for t, i in self.added.items()}
        # A token that BPE never makes of its own bytes can't be in any encoding.
        self.alone = {i for i, t in self.bytes_of.items() if len(t) == 1 or self._merge(list(map(id_of.__getitem__, (t[k : k + 1] for k in range(len(t)))))) == [i]}
        self.automaton = ahocorasick.Automaton()
        for i in self.alone:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.automaton.make_automaton()
        self.length = {i: len(t) for i, t in self.bytes_of.items()}
        del self.joined
        self.remembered = REMEMBERED
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.new: dict[str, tuple[int, str, bytes, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes, bytes]] = {}

    def _merge(self, ids: list[int]) -> list[int]:
        """Merges by rank, for single tokens when the tables are built."""
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda k: (self.rank.get((ids[k], ids[k + 1]), 1 << 60), k))
            if (ids[best], ids[best + 1]) not in self.rank:
                break
            ids[best : best + 2] = [self.joined[ids[best], ids[best + 1]]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes is just the two. It undoes the later merge of the two, step by step, and
        looks for a merge across the cut that would have come first; ties go to the one further left."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self._compatible(a, b)
            if len(self.pairs) > 5 * self.remembered:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit, rank, born, parts = 1 << 60, self.rank, self.born, self.parts
        while True:
            r = rank.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = born.get(a, -1), born.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the left one was made last: before that, its right part met b
                limit, a = ra, parts[a][1]
                r = rank.get((a, b))
                if r is not None and r < limit:
                    return False
            else:  # a merge at the cut of equal rank lies further left than b's own, and so comes first
                limit, b = rb + 1, parts[b][0]
                r = rank.get((a, b))
                if r is not None and r < limit:
                    return False

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        text, n = piece.decode("latin-1"), len(piece)
        last = [-1] * (n + 1)  # by prefix length, the unique last token
        pairs, length, done = self.pairs, self.length, -1
        for at, (token, size) in self.automaton.iter(text):
            if at == done:
                continue
            start = at + 1 - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[at + 1], done = token, at
        out, at = [], n
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def piece(self, text: str) -> tuple[int, str, bytes, bytes]:
        """Number of ids, the ids in decimal, each with a comma after it, what they decode to, and the ids in 4 bytes each."""
        got = self.new.get(text) or self.old.get(text)
        if got is None:
            ids = self.encode_piece(text.encode())
            got = len(ids), "".join(f"{i}," for i in ids), b"".join(map(self.decoded.__getitem__, ids)), struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= LONGEST:
            if len(self.new) >= self.remembered:
                self.old, self.new = self.new, {}
            self.new[text] = got
        return got

    def pieces(self, text: str) -> list[tuple[int, str, bytes, bytes]]:
        """Added tokens are cut out first; the rest is cut by the pattern."""
        out, known = [], self.new
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                i = self.added[part]
                out.append((1, f"{i},", self.decoded[i], struct.pack("<I", i)))
            elif part:
                for p in self.pattern.findall(part):
                    got = known.get(p)
                    if got is None:
                        got = self.piece(p)
                        known = self.new
                    out.append(got)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _, _ in self.pieces(text) for i in ids.split(",")[:-1]]

    def decode(self, ids: list[int]) -> str:
        """As the library does with skip_special_tokens=False; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")


_MODELS: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remembered: int = REMEMBERED, forget: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and, if
    asked for, ids. remembered: pre-tokens that a worker remembers; forget: a task leaves nothing
    of them to the next. Both are for jobs whose other stages need the memory. Null texts are empty texts: no ids. Rows are independent, so nothing is shuffled; an empty table gives an empty result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        bpe.remembered = remembered
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                pieces = bpe.pieces(text)
                listed = "".join([p[1] for p in pieces])[:-1]
                n.append(sum([p[0] for p in pieces]))
                ids_sha.append(hashlib.sha256(listed.encode()).hexdigest())
                text_sha.append(hashlib.sha256(b"".join([p[2] for p in pieces]).decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    ids.append(b"".join([p[3] for p in pieces]))
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            last = pa.RecordBatch.from_pydict(out | ({"ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))} if with_ids else {}))
            del ids
            yield last
        if forget:
            _MODELS.clear()
            del bpe
            tidy()

    found = keyed(docs, id_col, text_col).mapInArrow(run, _OUT + ", ids array<int>" * with_ids)
    return found.withColumn("doc_id", real_id())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents, with the byte-level vocabulary; null texts are empty. An empty table gives no rows."""
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
