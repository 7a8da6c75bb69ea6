"""Token ids in Arrow files of fixed-size-list batches.

Documents are range-partitioned by doc_id and sorted within each range; a task encodes its range and writes one Arrow
IPC file: ``sequence`` is a fixed-size list of ``seq_len`` 16-bit ids (the vocabulary is checked to fit), ``mask`` a
fixed-size list of bits, false for padding after the last document.  Every row has the same length, so sequence ``i``
lies at ``i * seq_len`` of a batch's buffer and its mask at bit ``i * seq_len``: readers memory-map the file and take
both as views, without a copy.  A second file holds the index (doc_id, start in the file, n_tokens), written batch by
batch.  A task writes under a name of its own attempt and renames it when complete, so a lost or repeated task leaves
whole files only; the manifest names the files of finished tasks.  Ranges are cut so that a file comes from about
``FILE_BYTES`` of text, whatever the corpus; an id that many rows share is split over ranges by a hash of its texts.

The tokenizer is applied to whole texts.  Texts of common Latin characters go by pieces (see ``pieces``), other texts
through the library whole.  Both give the ids of ``Tokenizer.encode``.

Defined results: null and empty texts have only the end id; a very long text is encoded by parts that end between
pieces, with the ids of the whole; repeated and null ids are rows of their own (null first; ties by a hash of the text,
then the text); an empty table writes no file and gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W
from pyspark.taskcontext import TaskContext

from .common import durable, scratch_path, small_batches, table
from .pieces import CHUNK, Pieces, chunks, plain

END_ID = 2
SEQ_LEN = 1024
ROWS_PER_BATCH = 1024
FILE_BYTES = 128 << 20
READ_ROWS = 8192


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The library's tokenizer, its pieces (none if it doesn't cut as they do) and a pattern of its added tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    if tok.get_vocab_size() > 1 << 16:
        raise ValueError("the vocabulary doesn't fit 16-bit ids")
    spec = tok.pre_tokenizer
    by_bytes = type(spec).__name__ == "ByteLevel" and tok.normalizer is None and not spec.add_prefix_space and spec.use_regex
    added = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or r"(?!)")
    return tok, Pieces(tok, END_ID) if by_bytes else None, added


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit ids of all texts in a row, the end id after each text, and the number of ids of each."""
    tok, pieces, added = _tokenizer(path)
    out, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            ids, n = pieces.encode("\0".join(held) + "\0")
            out.append(ids)
            counts.append(n)
        held.clear()
        size = 0

    for text in texts:
        if pieces is None or added.search(text) or not plain(text):
            flush()
            ids = np.array([*tok.encode(text, add_special_tokens=False).ids, END_ID], dtype=np.uint16)
        elif len(text) > CHUNK:
            flush()
            parts = [pieces.encode(part + "\0")[0][:-1] for part in chunks(text)]
            ids = np.append(np.concatenate(parts), np.uint16(END_ID))
        else:
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                flush()
            continue
        out.append(ids)
        counts.append(np.array([len(ids)], dtype=np.int64))
    flush()
    return np.concatenate(out), np.concatenate(counts)


def _schema(seq_len: int) -> pa.Schema:
    return pa.schema([("sequence", pa.list_(pa.uint16(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """Packs ids into sequences and writes batches as they fill, and the index beside them."""

    def __init__(self, fs, path: str, seq_len: int):
        self.seq_len, self.parts, self.held, self.total, self.docs = seq_len, [], 0, 0, 0
        self.sinks = [fs.open_output_stream(path), fs.open_output_stream(path + "i")]
        self.data, self.index = pa.ipc.new_file(self.sinks[0], _schema(seq_len)), pa.ipc.new_file(self.sinks[1], _INDEX)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        ends = self.total + np.cumsum(counts)
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(ends - counts), pa.array(counts)], schema=_INDEX))
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.docs += len(counts)
        full = self.seq_len * ROWS_PER_BATCH
        if self.held >= full:
            flat = np.concatenate(self.parts)
            for at in range(0, len(flat) - full + 1, full):
                self._batch(flat[at : at + full], full)
            rest = flat[len(flat) // full * full :].copy()
            self.parts, self.held = [rest], len(rest)

    def _batch(self, ids: np.ndarray, size: int) -> None:
        padded = np.zeros(size, dtype="<u2")
        padded[: len(ids)] = ids
        mask = np.arange(size) < len(ids)
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (padded, mask)]
        self.data.write_batch(pa.record_batch(cols, schema=_schema(self.seq_len)))

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.parts), -(-self.held // self.seq_len) * self.seq_len)
        for x in (self.data, self.index, *self.sinks):
            x.close()


def write_tokens(docs: DataFrame, tokenizer: str, out_dir: str, seq_len: int = SEQ_LEN, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files under ``out_dir``; returns the manifest (part, path, n_docs, n_tokens), one row for each file."""
    if seq_len % 8:
        raise ValueError("masks are whole bytes: seq_len must be a multiple of 8")
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        for b in batches:
            if b.num_rows and writer is None:
                fs, base = file_system(out_dir)
                fs.create_dir(base, recursive=True)
                tmp = f"{base}/_{uuid.uuid4().hex}"
                writer = _Writer(fs, tmp, seq_len)
            if b.num_rows:
                writer.add(b.column(0), *encode_texts(tokenizer, [t or "" for t in b.column(1).to_pylist()]))
        if writer is None:
            return
        writer.close()
        name = f"part-{part:06d}"
        fs.move(tmp + "i", f"{base}/{name}.index.arrow")
        fs.move(tmp, f"{base}/{name}.arrow")
        row = {"part": [part], "path": [f"{out_dir}/{name}"], "n_docs": [writer.docs], "n_tokens": [writer.total]}
        yield pa.RecordBatch.from_pydict(row)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    # the row number only parts equal rows, so the order of ids doesn't depend on it
    ranged = rows.repartitionByRange(parts, *order, "row").sortWithinPartitions(*order, "text").select("doc_id", "text")
    return durable(ranged.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-manifest")


def unpacked(mask: np.ndarray) -> np.ndarray:
    """Booleans of a packed mask."""
    return np.unpackbits(mask, axis=-1, bitorder="little").astype(bool)


class TokenFile:
    """Zero-copy random access to the sequences and masks of one file."""

    def __init__(self, path: str):
        fs, base = file_system(path)
        opened = (lambda p: pa.memory_map(p)) if type(fs).__name__ == "LocalFileSystem" else fs.open_input_file
        self._data = pa.ipc.open_file(opened(base + ".arrow"))
        self._index = pa.ipc.open_file(opened(base + ".index.arrow"))
        self.seq_len = self._data.schema.field("sequence").type.list_size
        self.n_batches = self._data.num_record_batches

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Views of the mapped file: (rows, seq_len) ids, and (rows, seq_len / 8) bytes whose bits, lowest first, are the mask."""
        ids, mask = (self._data.get_batch(k).column(i).flatten() for i in (0, 1))
        bits = np.frombuffer(mask.buffers()[1], np.uint8, len(mask) // 8, mask.offset // 8)
        return ids.to_numpy(zero_copy_only=True).reshape(-1, self.seq_len), bits.reshape(-1, self.seq_len // 8)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // ROWS_PER_BATCH)
        return ids[i % ROWS_PER_BATCH], mask[i % ROWS_PER_BATCH]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) in order, holding a batch and one document at a time."""
        held, k = np.zeros(0, dtype="<u2"), 0
        for b in range(self._index.num_record_batches):
            rows = self._index.get_batch(b).to_pydict()
            for doc, start, n in zip(rows["doc_id"], rows["start"], rows["n_tokens"], strict=True):
                parts, have = [held], len(held)
                while have < n:
                    ids, mask = self.batch(k)
                    k += 1
                    parts.append(ids[unpacked(mask)])
                    have += len(parts[-1])
                flat = np.concatenate(parts) if len(parts) > 1 else held
                yield doc, start, flat[:n]
                held = flat[n:]


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts over all files."""
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                found = ((d, base + s, len(ids), zlib.crc32(ids.astype("<u4"))) for d, s, ids in TokenFile(path).documents())
                for rows in batched(found, READ_ROWS):
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each file: the window is over the manifest, and files are then dealt out again
    spread = based.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return spread.select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_tokens(table(spark, sf_dir, "documents"), str(path), scratch_path(spark, "tokens"))
    return read_tokens(manifest)
