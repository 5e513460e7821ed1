"""Token ids in binary shards: independent zstandard frames, a trailing seek table, a checksum per frame.

A shard holds documents in ascending id order:
  frame 0..n-1   a zstandard frame per document: its ids as little-endian unsigned integers of 2 or 4 bytes
  index          a skippable frame (0x184D2A50): bytes per id, then a zstandard frame of the documents' ids (signed 64-bit)
  seek table     a skippable frame (0x184D2A5E) in the public zstandard seekable format: per frame compressed size,
                 decompressed size and the low 32 bits of its xxh64; frame count, flags (checksums: 0x80), 0x8F92EAB1
The index is the last frame that the seek table lists. Any zstandard reader can read the frames; a reader of one document reads the tail and its frame.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, real_id, scratch_path, shuffle_partitions, table, write_once

SKIPPABLE, SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 3
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 800_000
#: Bytes of texts that are encoded together.
BLOCK = 4_000_000


# --- format -------------------------------------------------------------------------------------

class ShardWriter:
    def __init__(self, out, width: int) -> None:
        if width not in (2, 4):
            raise ValueError("2 or 4 bytes per id")
        self.out, self.width, self.entries, self.ids = out, width, [], []
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, doc_id: int, raw: bytes) -> None:
        """raw: the ids as little-endian integers of self.width bytes."""
        frame = self.zip.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        raw = np.array(self.ids, "<i8").tobytes()
        body = bytes([self.width]) + self.zip.compress(raw)
        frame = struct.pack("<II", SKIPPABLE, len(body)) + body
        self.out.write(frame)
        entries = [*self.entries, (len(frame), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = np.array(entries, "<u4").tobytes() + struct.pack("<IBI", len(entries), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK, len(body)) + body)


class ShardReader:
    """Reads the tail, then only the frames that are asked for. A wrong checksum raises ValueError."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size() if hasattr(source, "size") and callable(source.size) else source.seek(0, 2)
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a shard with a seek table")
        at = size - 9 - 12 * count
        kind, length = struct.unpack("<II", self._at(at - 8, 8))
        if kind != SEEK or length != 12 * count + 9:
            raise ValueError("damaged seek table")
        self.entries = np.frombuffer(self._at(at, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.entries[:, 0])]
        index = self._at(int(self.starts[-2]), int(self.entries[-1, 0]))
        self.width, self.zip = index[8], zstandard.ZstdDecompressor()
        self.ids = np.frombuffer(self.zip.decompress(index[9:]), "<i8")

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, k: int) -> np.ndarray:
        raw = self.zip.decompress(self._at(int(self.starts[k]), int(self.entries[k, 0])))
        if len(raw) != self.entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k}: wrong checksum")
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")

    def document(self, doc_id: int) -> np.ndarray:
        k = int(np.searchsorted(self.ids, doc_id))
        if k == len(self.ids) or self.ids[k] != doc_id:
            raise KeyError(doc_id)
        return self.read(k)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that executors share and pyarrow can write: file, hdfs, s3, gs."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# --- encoding -----------------------------------------------------------------------------------

def check_spec(spec: dict) -> None:
    """Raises ValueError for a tokenizer that may keep white space, or look beyond it: its words can't be encoded one by one."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    drops = first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (first.get("type") == "Split" and first.get("behavior") == "Removed")
    parts = spec.get("normalizer") or {}
    kinds = {n.get("type") for n in parts.get("normalizers", [parts] if parts else [])}
    prefix = any(p.get("add_prefix_space") for p in [pre, *pre.get("pretokenizers", [])])
    marked = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    if not drops or prefix or marked or kinds & {"Strip", "Prepend", "Precompiled"} or (spec.get("model") or {}).get("dropout"):
        raise ValueError("unsupported: a tokenizer file whose words can't be encoded apart")


class WordEncoder:
    """Exact ids of a tokenizer that drops white space and never merges across it: words are encoded by the library
    once, and remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; the library's thread pool would take all of the machine's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        check_spec(json.loads(self.tokenizer.to_str()))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # An added token cuts the text before anything else happens to it, so words around one are encoded as if alone.
        self.mark = next(iter(self.tokenizer.get_added_tokens_decoder().items()), None)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 2**16 else 4
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> None:
        """In texts of 200 words, with the mark between them; words that hold a mark themselves are alone."""
        kind, mark = ("<u2" if self.width == 2 else "<u4"), self.mark
        inner = mark[1].content if mark else None
        plain = [w for w in words if inner and inner not in w]
        alone = words if not inner else [w for w in words if inner in w]
        groups = [plain[k : k + 200] for k in range(0, len(plain), 200)]
        got = self.tokenizer.encode_batch_fast([inner.join(g) for g in groups], add_special_tokens=False) if groups else []
        for g, e in zip(groups, got):
            ids = np.array(e.ids, kind)
            raw, cut = ids.tobytes(), np.flatnonzero(ids == mark[0]) * self.width
            starts, ends = [0, *(cut + self.width).tolist()], [*cut.tolist(), len(raw)]
            for w, a, b in zip(g, starts, ends, strict=True):
                self.new[w] = raw[a:b]
        for w in alone:
            self.new[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, kind).tobytes()

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of different words, remembered or new."""
        new, old = self.new, self.old
        missing = []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    missing.append(w)
        if missing:
            self._encode_words(missing)
        out = [new[w] for w in words]
        if len(new) > REMEMBERED:
            self.old, self.new = new, {}
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Splits at the 6 ASCII white-space characters (an empty word has no ids) and looks up each different word of the texts once."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        known = self._ids_of(coded.dictionary.to_pylist()).__getitem__
        codes, cuts = coded.indices.to_numpy().tolist(), words.offsets.to_numpy().tolist()
        return [b"".join(map(known, codes[a - cuts[0] : b - cuts[0]])) for a, b in zip(cuts, cuts[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again in blocks of about BLOCK bytes, or of one slice where that is larger."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 250):
            held.append(batch.slice(k, 250))
            size += held[-1].nbytes
            if size >= BLOCK:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


_MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def write_token_shards(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends end_id, writes shards in ascending id order and returns their manifest
    (shard, path, n_docs, n_tokens). Shards of ascending number hold ascending ids.

    Null and empty texts are just the end id. Null ids sort first. Rows that repeat an id are all written, in the order of their texts.
    An empty table writes no shard. A task's file has a name of its own, and only files of successful attempts
    get into the manifest, so tasks may be repeated.
    """
    rows = keyed(docs, id_col, text_col)
    n = shuffle_partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _store(folder)
        shard, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        end = np.array([end_id], "<u2" if encoder.width == 2 else "<u4").tobytes()
        out = writer = path = None
        total = 0
        for part in _blocks(batches):
            if writer is None:
                store.create_dir(base, recursive=True)
                path = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok.zst"
                out = store.open_output_stream(f"{base}/{path}", compression=None)  # else it goes by the name
                writer = ShardWriter(out, encoder.width)
            for i, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                writer.add(i, raw + end)
                total += len(raw) // encoder.width + 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{path}"], "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    return write_once(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, path = _store(uri)
            with store.open_input_file(path) as source:
                shard = ShardReader(source)
                n, crc = [], []
                for k in range(len(shard)):
                    ids = shard.read(k)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            counts = np.array(n, np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.ids), "start": pa.array(start + np.cumsum(counts) - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    The sums over shards run over the manifest, a row per file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    return placed.repartition(shuffle_partitions(manifest.sparkSession), "path").mapInArrow(_read, _READ)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents, written to files and read back; null texts are empty. An empty table gives no rows."""
    manifest = write_token_shards(
        table(spark, sf_dir, "documents"), scratch_path(spark, "token-shards"),
        tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1,
    )
    return read_token_shards(manifest).withColumn("doc_id", real_id())
