"""Token ids in Arrow files of equal-length sequences.

A folder holds part-NNNNN.arrow (IPC file format: record batches of ROWS sequences; columns `ids`,
fixed-size list of unsigned integers, and `mask`, fixed-size list of booleans, true where an id
stands) and part-NNNNN.docs.arrow (doc_id, first, n_tokens of each document in order). All batches
but a file's last are full, so sequence s is row s % ROWS of batch s // ROWS, read by a memory map
without a copy; only a file's last sequence is padded. Parts follow each other in ascending id order.

Documents are dealt by ranges of their id, into files of about FILE_BYTES of text, however large the
corpus, so one file is one task's work; the driver sees one row per file. A file appears by a rename, so
a task that is lost or run twice leaves one whole file. The folder must be in a store that pyarrow opens
too: file, hdfs (with libhdfs), s3 (also as s3a) or gs.

Defined results: null text encodes to the end id alone; null ids come first; repeated ids stay, in
the order of their text's hash; very long texts are encoded whole and run over as many batches as they
need; an empty table writes no file; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm import common, tokens

ROWS = 64
CHUNK = 256
#: Bytes of text for a file, where the session's number of partitions makes files no smaller.
FILE_BYTES = 128 << 20


def _store(uri: str):
    """The file system and path of a URI, under the name that pyarrow knows."""
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest)


def _type(n_ids: int) -> np.dtype:
    return np.dtype("<u2") if n_ids <= 1 << 16 else np.dtype("<u4")


class _Writer:
    """Appends ids to one file; holds ROWS sequences at most."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        item = pa.from_numpy_dtype(dtype)
        self.length, self.dtype = length, dtype
        self.schema = pa.schema({"ids": pa.list_(item, length), "mask": pa.list_(pa.bool_(), length)})
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_all = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_all += len(ids)
        full = ROWS * self.length
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            for a in range(0, len(flat) - full + 1, full):
                self._batch(flat[a : a + full])
            rest = flat[len(flat) - len(flat) % full :]
            self.held, self.n_held = [rest], len(rest)

    def _batch(self, flat: np.ndarray) -> None:
        pad = -len(flat) % self.length
        mask = np.ones(len(flat) + pad, bool)
        mask[len(flat) :] = False
        flat = np.concatenate([flat, np.zeros(pad, self.dtype)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._batch(np.concatenate(self.held))
        self.file.close()


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        at, path = _store(uri)
        source = pa.memory_map(path) if isinstance(at, pafs.LocalFileSystem) else at.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._flat = -1, None

    def sequence(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (a view) and the mask of sequence s."""
        batch, row = self.file.get_batch(s // ROWS), s % ROWS
        ids = batch.column("ids").values.to_numpy(zero_copy_only=True)
        mask = batch.column("mask").values.slice(row * self.length, self.length).to_numpy(zero_copy_only=False)
        return ids[row * self.length : (row + 1) * self.length], mask

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from position first of the file's stream."""
        size, parts = ROWS * self.length, []
        while n > 0:
            k, a = divmod(first, size)
            if k != self._at:
                self._at, self._flat = k, self.file.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)
            part = self._flat[a : a + n]
            if not len(part):
                raise EOFError("past the end of the file")
            parts.append(part)
            first, n = first + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def write(docs: DataFrame, at: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 0) -> DataFrame:
    """Write the ids of docs below the URI at. Returns a row per file: part, n_docs, n_tokens, start."""
    spark = docs.sparkSession
    common.ship(spark)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, folder = _store(at)
        encoder = tokens.encoder(tokenizer)
        names = [f"{folder}/.{uuid.uuid4().hex}-{part}{x}" for x in ("", ".docs")]
        final = [f"{folder}/part-{part:05d}{x}.arrow" for x in ("", ".docs")]
        writer = index = None
        end, sinks, n_docs = np.array([end_id], "<u4"), [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                some = batch.slice(a, CHUNK)
                if writer is None:
                    store.create_dir(folder, recursive=True)
                    sinks = [store.open_output_stream(x) for x in names]
                    writer = _Writer(sinks[0], length, _type(encoder.library.get_vocab_size()))
                    index = pa.ipc.new_file(sinks[1], pa.schema({"doc_id": pa.int64(), "first": pa.int64(), "n_tokens": pa.int64()}))
                firsts, sizes = [], []
                for raw in encoder.encode(some.column(1).to_pylist()):
                    ids = np.concatenate([np.frombuffer(raw, "<u4"), end])
                    firsts.append(writer.n_all)
                    sizes.append(len(ids))
                    writer.add(ids)
                n_docs += some.num_rows
                index.write_batch(pa.record_batch([some.column(0).cast(pa.int64()), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "first", "n_tokens"]))
        if writer is not None:
            writer.close()
            index.close()
            for sink, name, to in zip(sinks, names, final):
                sink.close()
                store.move(name, to)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([writer.n_all], pa.int64())})

    order = [F.col("_id").asc_nulls_first(), F.col("_h")]
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_t"), F.xxhash64(F.col(text)).alias("_h"))
        .repartitionByRange(n_files, *order)
        .sortWithinPartitions(*order)
        .select("_id", "_t")
    )
    files = sorted(dealt.mapInArrow(run, "part long, n_docs long, n_tokens long").collect())  # a row per file
    starts = np.cumsum([0, *(f.n_tokens for f in files)]).tolist()
    return spark.createDataFrame([(*f, s) for f, s in zip(files, starts)], "part long, n_docs long, n_tokens long, start long")


def read(files: DataFrame, at: str) -> DataFrame:
    """Each document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                base = f"{at}/part-{row['part']:05d}"
                file = TokenFile(f"{base}.arrow")
                store, path = _store(f"{base}.docs.arrow")
                with store.open_input_file(path) as source:
                    docs = pa.ipc.open_file(source)
                    for k in range(docs.num_record_batches):
                        some = docs.get_batch(k)
                        first, n = some.column("first").to_pylist(), some.column("n_tokens").to_pylist()
                        crc = [tokens.crc32(file.ids(a, b).astype("<u4").tobytes()) for a, b in zip(first, n)]
                        start = pa.array([a + row["start"] for a in first], pa.int64())
                        yield pa.RecordBatch.from_arrays([some.column("doc_id"), start, some.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "start").repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
