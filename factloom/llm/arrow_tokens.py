"""Token ids in Arrow stream files of equal-length sequences, for zero-copy random access.

A file holds the ids of a run of documents in ascending order. Its first stream
is made of record batches of ``ROWS`` sequences each: ``ids``, a fixed-size list
of ``SEQUENCE`` unsigned numbers of 16 bits, or of 32 where the vocabulary needs them,
and ``mask``, a fixed-size list of as many bits, set where there is a token and
not behind the file's last one. All batches but the
last are of one length in bytes, so a sequence's bytes are found by arithmetic,
and a memory map gives them without a copy. A second stream behind it, in the
same file, is the index of documents: id, start in the file, number of tokens.

Documents are range-partitioned and sorted by id; each task writes its file
under a name of its own attempt and renames it, so that a lost executor or a
second attempt leaves one whole file. Files are numbered by partition, which
rise with the ids, and the starts of files are sums of the counts before them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import give_back, materialise, scratch_path, small_table
from factloom.llm.tokenizing import tokenizer

SEQUENCE, ROWS = 2048, 64
END_ID = 1
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "file long, path string, n_docs long, n_tokens long"


def token_schema(vocabulary_size: int) -> pa.Schema:
    number = pa.uint16() if vocabulary_size <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(number, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])


def open_store(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


class FileWriter:
    """Writes whole batches as they fill, and the rest and the index at the end."""

    def __init__(self, sink, vocabulary_size: int = 1 << 32):
        self.sink = sink
        self.schema = token_schema(vocabulary_size)
        self.number = self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.waiting: list[bytes] = []
        self.held = self.n_tokens = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // SEQUENCE)
        padded = np.zeros(rows * SEQUENCE, self.number)
        padded[:len(ids)] = ids
        mask = np.arange(rows * SEQUENCE) < len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), SEQUENCE) for x in (padded, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, self.n_tokens, n))
        self.n_tokens += n
        self.waiting.append(ids)
        self.held += n
        full = SEQUENCE * ROWS
        if self.held >= full:
            ids = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(ids) // full * full
            for k in range(0, whole, full):
                self._batch(ids[k:k + full])
            self.waiting, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        if self.held:
            self._batch(np.frombuffer(b"".join(self.waiting), "<u4"))
        self.stream.close()
        with pa.ipc.new_stream(self.sink, INDEX) as index:
            columns = zip(*self.docs) if self.docs else ([], [], [])
            index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=INDEX))
        self.sink.close()


class FileReader:
    """A file's sequences by number and its tokens by place, read where they lie."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        self.batches: list[pa.RecordBatch] = []
        stream = pa.ipc.open_stream(source)
        self.batches = list(stream)  # of a memory map: references, no bytes are read here
        self.index = pa.ipc.open_stream(source).read_all()

    @classmethod
    def open(cls, url: str) -> FileReader:
        store, path = open_store(url)
        return cls(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence k, views of the file's bytes."""
        b = self.batches[k // ROWS]
        at = k % ROWS * SEQUENCE
        return b.column(0).values.to_numpy(zero_copy_only=True)[at:at + SEQUENCE], b.column(1).values.slice(at, SEQUENCE)

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the n ids from a place on, batch after batch."""
        full = SEQUENCE * ROWS
        while n > 0:
            k, at = divmod(start, full)
            part = self.batches[k].column(0).values.to_numpy(zero_copy_only=True)[at:at + n]
            yield part
            start, n = start + len(part), n - len(part)


def _writing(folder: str, vocabulary: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = tokenizer(vocabulary), None
        store, root = open_store(folder)
        number = TaskContext.get().partitionId()
        part, path = f"{root}/.{number:06d}-{uuid.uuid4().hex}", f"{root}/tokens-{number:06d}.arrows"
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode.many(some.column(1).to_pylist())):
                    writer = writer or FileWriter(store.open_output_stream(part), encode.size)
                    writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            store.move(part, path)
            scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
            yield pa.RecordBatch.from_pydict(
                {"file": [number], "path": [scheme + path], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_tokens]}
            )
        give_back()

    return run


def write_tokens(df: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, files: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest (file, path, n_docs, n_tokens, start) of the files written; start counts the ids of all files before.

    Null ids come first, null texts are empty, every document ends with
    ``end_id``, and rows that repeat an id follow each other in the order of
    their texts. Other columns aren't read. An empty table gives no file.
    """
    spark = df.sparkSession
    store, root = open_store(folder)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(root)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = files or max(1, df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialise(dealt.mapInArrow(_writing(folder, vocabulary, end_id), MANIFEST), "token-files")
    counts = manifest.orderBy("file").collect()  # a row for each file
    starts, at = [], 0
    for r in counts:
        starts.append((r.file, r.path, r.n_docs, r.n_tokens, at))
        at += r.n_tokens
    return small_table(spark, starts, MANIFEST + ", start long")


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            reader = FileReader.open(row["path"])
            for part in reader.index.to_batches(max_chunksize=10_000):
                sums = []
                for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    crc = 0
                    for ids in reader.pieces(start, n):
                        crc = zlib.crc32(ids.astype("<u4"), crc)
                    sums.append(crc)
                starts = pa.array(np.asarray(part.column(1)) + row["start"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), starts, part.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; a task for each file."""
    rows = manifest.select("path", "start")
    n = max(1, rows.count())
    return rows.repartition(n, "path").mapInArrow(_reading, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, vocabulary: str, **names) -> DataFrame:
    """Write the documents' ids in a folder of the shared scratch area and read them back."""
    folder = scratch_path(df.sparkSession, "tokens")
    return read_documents(write_tokens(df, vocabulary, folder, **names))
