"""Token-ID files of independent zstandard frames with a trailing seek table.

A shard holds one zstandard frame for each document, in ascending doc_id order, then two skippable
frames: the document index (doc_ids) and the seek table of the public "zstd seekable format", with each
frame's compressed size, size and checksum (low 32 bits of XXH64 over the frame's raw bytes). A reader
fetches the tail, then decompresses only the frames of the documents it wants, and verifies each.

Texts are spread by a range over (doc_id, text hash), so that shards in partition order are in doc_id
order even where one doc_id repeats often, and each task streams its rows into one file. Every attempt
writes a file of its own name; only files named by the manifest (rows of tasks that succeeded) count.

Strings of special tokens in a text become their ids unless `special_as_text` is set.

Defined cases: a null text is an empty one and yields the end id alone; null doc_ids come first;
repeated doc_ids keep all their rows, in order of the text's hash; an empty table yields no shard.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_dir, open_fs
from .pieces import PieceCache, parts

# Fixed values of the public zstd seekable format.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

SHARD = "shard int, path string, n_docs long, n_tokens long"
CACHED = 600_000
LINE = 256  # pieces that the library encodes in one string

_encoders: dict[tuple[str, bool], PieceEncoder] = {}


class PieceEncoder:
    """A tokenizer of the tokenizers library behind a bounded cache of blank-led pieces.

    Strings of special tokens in a text are what the library makes of them: their ids or, with `special_as_text`,
    ordinary text. A tokenizer whose added tokens hold or take white space gets whole texts.
    """

    def __init__(self, file: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        self.tok = Tokenizer.from_file(file)
        self.tok.encode_special_tokens = special_as_text
        self.starts = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.starts[i] = token[0] == "Ġ"
        added = self.tok.get_added_tokens_decoder().values()
        self.whole = any(t.lstrip or t.rstrip or not t.content.isprintable() or " " in t.content for t in added)
        self.cache = PieceCache(self.alone, self._led, CACHED)

    def alone(self, texts: list[str]) -> list[bytes]:
        """Ids of each string by itself, as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _led(self, pieces: list[str]) -> list[bytes]:
        """Ids of a blank and each piece, of LINE pieces in one string; a piece begins at each token that begins with a
        blank."""
        out, groups = [], [pieces[k : k + LINE] for k in range(0, len(pieces), LINE)]
        for group, raw in zip(groups, self.alone([" " + " ".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")])
            if len(at) != len(group):
                out += self.alone([" " + p for p in group])
                continue
            cuts = [*(at * 4).tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text."""
        return self.alone(texts) if self.whole else self.cache.encode(texts)

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of whole texts (null: empty), and the number of ids before each text and after the last."""
        if not self.whole:
            return self.cache.ids(texts)
        raw = self.alone([t or "" for t in texts.to_pylist()])
        return np.frombuffer(b"".join(raw), "<i4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)


def encoder(file: str, special_as_text: bool = False) -> PieceEncoder:
    """One encoder for each worker process, kept over tasks."""
    key = (file, special_as_text)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def write_shard(out, docs: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write one file; (documents, ids) in it."""
    import xxhash
    import zstandard

    pack = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True)
    table, ids, n = [], [], 0
    for doc_id, raw in docs:
        frame = pack.compress(raw)
        out.write(frame)
        table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        ids.append(struct.pack("<?q", doc_id is not None, doc_id or 0))
        n += len(raw) // 4
    index, seek = b"".join(ids), b"".join(table) + struct.pack("<IBI", len(table), 0x80, SEEKABLE_MAGIC)
    out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
    out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(seek)) + seek)
    return len(table), n


class ShardReader:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        fs, path = open_fs(uri)
        self.file, self.uri = fs.open_input_file(path), uri
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri}: no seek table")
        tail = self.file.read_at(21 * n + 25, size - 21 * n - 25)
        index = np.frombuffer(tail, np.dtype([("set", "?"), ("id", "<i8")]), n, 8)
        self.doc_ids = [int(i) if s else None for s, i in index.tolist()]
        self.table = np.frombuffer(tail, np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")]), n, 16 + 9 * n)
        self.at = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])

    def read(self, k: int, frame: bytes | None = None) -> bytes:
        """The raw ids of the k-th document; only its frame is read and decompressed."""
        import xxhash
        import zstandard

        packed, size, check = (int(x) for x in self.table[k])
        raw = zstandard.ZstdDecompressor().decompress(frame or self.file.read_at(packed, int(self.at[k])), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"{self.uri}: frame {k} is damaged")
        return raw

    def scan(self, chunk: int = 1 << 22) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, read in blocks of about chunk bytes."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            to = max(k + 1, int(np.searchsorted(self.at, self.at[k] + chunk, "right")) - 1)
            block = self.file.read_at(int(self.at[to] - self.at[k]), int(self.at[k]))
            for i in range(k, to):
                yield self.doc_ids[i], self.read(i, block[int(self.at[i] - self.at[k]) : int(self.at[i + 1] - self.at[k])])
            k = to


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Encode docs (doc_id, text) into shards. Returns the manifest: shard, path, n_docs, n_tokens, start.

    Strings of special tokens become their ids, as the library's call does by itself; `special_as_text` keeps such
    ids out of the files."""
    folder = new_dir(docs.sparkSession, "tokens")

    def write(batches):
        ids, end = encoder(tokenizer, special_as_text), np.array([end_id], "<u4").tobytes()
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok.zst"

        def rows():
            for batch in batches:
                for b in parts(batch, 1):
                    flat, ends = ids.ids(b.column("text"))
                    raw, cuts = memoryview(flat.tobytes()), (ends * 4).tolist()
                    yield from zip(b.column("doc_id").to_pylist(), (bytes(raw[x:y]) + end for x, y in zip(cuts, cuts[1:], strict=False)), strict=True)

        import pyarrow as pa

        first = next(it := rows(), None)
        if first is None:
            return
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            n_docs, n = write_shard(out, (x for part in ([first], it) for x in part))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n]})

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    spread = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest = materialise(spread.mapInArrow(write, SHARD), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the manifest's shards: doc_id, start, n_tokens, ids_crc32, ids."""

    def read(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            for uri, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                got, held = [], 0
                for doc_id, raw in ShardReader(uri).scan():
                    got.append((doc_id, start, len(raw) // 4, zlib.crc32(raw), raw))
                    start, held = start + len(raw) // 4, held + len(raw)
                    if held > 8 << 20:
                        yield _rows(got)
                        got, held = [], 0
                if got:
                    yield _rows(got)

    def _rows(got):
        import pyarrow as pa

        a, s, n, c, r = zip(*got, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    spread = manifest.select("shard", "path", "start").repartition(max(1, manifest.count()), "shard")
    return spread.select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
