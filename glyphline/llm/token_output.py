"""Token-id output in a plane-shuffled binary format.

Ids are cut into blocks of ``BLOCK`` ids, each block is transposed into byte
planes (or bit planes), every plane is compressed with zstandard on its own, and
a chunk index at the end of the file names the place of every block, so that any
range of ids can be read without the rest.

File layout (little endian)::

    b"GPZ1"  blocks...  documents  footer(JSON)  footer length (u32)  b"GPZ1"

The footer holds the chunk index ``[offset, first id, number of ids, [plane
lengths]]``. ``documents`` are the ids, null flags and token counts of the documents.

One file holds one range of ascending doc_id (null ids first, ties by the hash of
the text, then the text), so the files in the order of their names are the corpus
in order. A task writes its file under a name of its own attempt; the manifest (one row a file,
all that reaches the driver) names the attempt that ended, so nothing is renamed or written over
when a task is repeated.

A null text counts as empty: the end id alone. Equal ids and repeated rows are written each. A very long text
is encoded whole and cut into blocks. Only the id and text columns are read, whatever others are called. An empty
table makes a manifest without files and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphline.llm.common import cut as checkpointed
from glyphline.llm.common import fresh_dir, remove_dir, shuffle_partitions
from glyphline.llm.token_counts import PieceSplitter, byte_symbols, tokenizer_path

MAGIC, BLOCK, LEVEL = b"GPZ1", 1 << 16, 3
#: Pieces whose ids a worker keeps (some 200 bytes each), the longest of them, and texts that are encoded at once.
CACHE_PIECES, CACHE_LENGTH, SLICE = 1_500_000, 64, 64


# -- planes -------------------------------------------------------------------
def to_planes(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """Planes of a block, lowest first; planes above the largest id are left out."""
    top = int(ids.max()) if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        n = max(1, (top.bit_length() + 7) // 8)
        return [raw[:, i].tobytes() for i in range(n)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(max(1, top.bit_length()))]


def from_planes(parts: list[bytes], n: int, planes: str = "byte") -> np.ndarray:
    if planes == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(parts):
            raw[:, i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(parts):
            bits[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file; memory holds one block and 17 bytes a document."""

    def __init__(self, sink, planes: str = "byte", block: int = BLOCK):
        self.sink, self.planes, self.block = sink, planes, block
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.index: list[list] = []
        self.docs: list[int | None] = []
        self.lens: list[int] = []
        self.sink.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lens.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            rest = np.concatenate(self.waiting)
            while len(rest) >= self.block:
                self._block(rest[: self.block])
                rest = rest[self.block :]
            self.waiting, self.held = [rest], len(rest)

    def _write(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        at = self.at
        lengths = [self._write(self.zstd.compress(p)) for p in to_planes(ids, self.planes)]
        self.index.append([at, self.n_ids, len(ids), lengths])
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        at = self.at
        parts = [
            np.array([d or 0 for d in self.docs], "<i8").tobytes(),
            np.array([d is None for d in self.docs], np.uint8).tobytes(),
            np.array(self.lens, "<i8").tobytes(),
        ]
        lengths = [self._write(self.zstd.compress(p)) for p in parts]
        footer = json.dumps({"planes": self.planes, "n_ids": self.n_ids, "n_docs": len(self.docs), "chunks": self.index, "docs": [at, lengths]}).encode()
        self.sink.write(footer + struct.pack("<I", len(footer)) + MAGIC)


class PlaneReader:
    """Random access to a file by its chunk index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, magic = struct.unpack("<I4s", self._at(size - 8, 8))
        if magic != MAGIC:
            raise ValueError("not a plane file, or cut short")
        self.footer = json.loads(self._at(size - 8 - n, n))
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _parts(self, at: int, lengths: list[int]) -> list[bytes]:
        data, out = self._at(at, sum(lengths)), []
        for n in lengths:
            out.append(self.zstd.decompress(data[:n]))
            data = data[n:]
        return out

    def block(self, k: int) -> np.ndarray:
        at, _, n, lengths = self.footer["chunks"][k]
        return from_planes(self._parts(at, lengths), n, self.footer["planes"])

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, null, lens = self._parts(*self.footer["docs"])
        return np.frombuffer(ids, "<i8"), np.frombuffer(null, np.uint8), np.frombuffer(lens, "<i8")

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from position ``first`` of the file; reads only the blocks that hold them."""
        out = [
            self.block(k)[max(0, first - start) : max(0, first + n - start)]
            for k, (_, start, size, _) in enumerate(self.footer["chunks"])
            if start < first + n and start + size > first
        ]
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def stream(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's position, ids) for each document; one block at a time in memory."""
        docs, null, lens = self.documents()
        held, k, at = np.zeros(0, "<u4"), 0, 0
        for d, is_null, n in zip(docs.tolist(), null.tolist(), lens.tolist(), strict=True):
            if len(held) < n:
                got, parts = len(held), [held]
                while got < n:
                    parts.append(self.block(k))
                    got, k = got + len(parts[-1]), k + 1
                held = np.concatenate(parts)
            yield None if is_null else d, at, held[:n]
            held, at = held[n:], at + n


# -- encoding -----------------------------------------------------------------
class Encoder:
    """Ids by the tokenizers library for one JSON file.

    With a plain byte-level vocabulary a text is cut into the pieces that the library
    merges on their own, and the library encodes each distinct piece once: its ids
    are kept as bytes in a bounded table. Any other vocabulary encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; the library would start a thread for each of the machine's
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        try:
            self.splitter = PieceSplitter(path)
        except ValueError:
            self.splitter = None
        else:
            self.special = {t: np.array([i], "<u4").tobytes() for t, i in self.splitter.special.items()}
            vocab, space = self.splitter.spec["model"]["vocab"], byte_symbols()[32]
            self.leads = np.zeros(max(vocab.values(), default=0) + 1, bool)
            self.leads[[i for t, i in vocab.items() if t.startswith(space)]] = True

    def _learn(self, words: list[str]) -> bool:
        """Encodes words that begin with a space and go on in letters many at a time, since the library cuts texts where they meet.

        Only a word's first token begins with a space. False, and nothing learned, if those aren't as many as the words.
        """
        parts = ["".join(words[k : k + 256]) for k in range(0, len(words), 256)]
        raw = b"".join(array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(parts, add_special_tokens=False))
        start = np.flatnonzero(self.leads[np.frombuffer(raw, "<u4")])
        if len(start) != len(words):
            return False
        at = [*(4 * start).tolist(), len(raw)]
        self.known.update(zip(words, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        return True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.splitter is None:
            return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        split = self.splitter
        cut = [[split.pieces(p) if k % 2 == 0 else p for k, p in enumerate(split.parts(t))] for t in texts]
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        new = set().union(*[words for parts in cut for words in parts[::2]]).difference(known)
        words = [w for w in new if w[0] == " " and w[1:].isalpha()]
        if not self._learn(words):
            words = []
        rest = list(new.difference(words))
        for w, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
        out = []
        for parts in cut:
            ids = b"".join(self.special[p] if k % 2 else b"".join(map(known.__getitem__, p)) for k, p in enumerate(parts))
            out.append(np.frombuffer(ids, "<u4"))
        for w in new:
            if len(w) > CACHE_LENGTH:
                del known[w]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# -- files --------------------------------------------------------------------
def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_plane_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    path: str | None = None, planes: str = "byte", block: int = BLOCK, partitions: int | None = None,
) -> list[dict]:
    """Encodes every text, appends ``end_id`` and writes one file a partition below ``folder``.

    ``folder`` must be seen by all executors (a URI or a shared path). Returns
    the manifest in file order: name, n_docs, n_ids and start (ids in the files
    before it); it is stored as ``manifest.json`` too. A null text counts as empty.
    """
    spark = docs.sparkSession
    tie = F.xxhash64(F.col(text_col))
    dealt = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
        .repartitionByRange(partitions or shuffle_partitions(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = writer = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows and writer is None:
                enc = encoder(tokenizer_path(path, "byte_bpe_50k.json"))
                store, at = _fs(folder)
                store.create_dir(at, recursive=True)
                name = f"ids-{part:06d}-{TaskContext.get().taskAttemptId()}.gpz"
                sink = store.open_output_stream(f"{at}/{name}")
                writer = PlaneWriter(sink, planes, block)
            for i in range(0, batch.num_rows, SLICE):
                ids, texts = (batch.column(k).slice(i, SLICE).to_pylist() for k in (0, 1))
                for doc_id, own in zip(ids, enc.encode([t or "" for t in texts]), strict=True):
                    writer.add(doc_id, np.append(own, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    rows = sorted(dealt.mapInArrow(write, "part long, name string, n_docs long, n_ids long").collect())
    manifest, start = [], 0
    for r in rows:
        manifest.append({"name": r["name"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "start": start})
        start += r["n_ids"]
    store, at = _fs(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps({"n_ids": start, "files": manifest}).encode())
    return manifest


def read_plane_files(spark: SparkSession, folder: str, manifest: list[dict] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    if manifest is None:
        store, at = _fs(folder)
        with store.open_input_file(f"{at}/manifest.json") as f:
            manifest = json.loads(f.read())["files"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                store, at = _fs(folder)
                out: list[tuple] = []
                with store.open_input_file(f"{at}/{manifest[k]['name']}") as f:
                    for doc, first, ids in PlaneReader(f).stream():
                        out.append((doc, manifest[k]["start"] + first, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())))
                        if len(out) == 8192:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    n = max(1, len(manifest))
    return spark.range(0, len(manifest), 1, n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, end_id: int = 2, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` and reads them back; without a ``folder`` they lie in the shared one and are removed then."""
    spark = docs.sparkSession
    own = folder or fresh_dir(spark, "token-ids")
    back = read_plane_files(spark, own, write_plane_files(docs, own, end_id=end_id, path=path))
    if folder is None:
        back = checkpointed(back)
        remove_dir(spark, own)
    return back
