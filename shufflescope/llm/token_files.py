"""Token ids in flat binary files with 64-bit document offsets.

A dataset is a folder of shards in ascending order of doc_id (nulls first; equal ids by a hash of the text, so that
rows of one id, or without any, are dealt over several shards like all others; equal rows anyhow).  A shard is two files:
``part-N-*.ids`` has the ids as little-endian unsigned integers of 16 bits if the vocabulary allows, else 32, and
``part-N-*.idx`` has, as little-endian 64-bit integers, the number of documents, then their doc_ids (smallest 64-bit
integer: null), then one more offset than documents, counted in ids from the shard's begin.  The manifest, one row a
shard, adds the base of each shard: the prefix sum of the sizes of the shards before it, all that the driver ever sees.
Readers map the files into memory.  A task writes under a name of its own and only names in the manifest count, so
tasks that run twice do no harm.

Null texts count as empty: one end id.  Repeated rows are all written.  An empty table gives no shards and no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_batches, documents, partitions, record_batch, shared_dir, text_rows
from .encoders import byte_encoder, path_of

END_ID = 2
_NULL = np.iinfo(np.int64).min
_SHARD = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _where(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _local(uri: str) -> str:
    """file:///a, file:/a and /a are one place."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents; returns the manifest (shard, path, n_docs, n_ids, base)."""
    spark = docs.sparkSession
    file, folder = vocabulary or path_of("byte_bpe_50k.json"), _local(folder)
    n = max(partitions(spark), docs.rdd.getNumPartitions())
    # the number of the row parts equal rows; it only orders what is the same
    keyed = text_rows(docs).withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "_text", "_row"]
    rows = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        encoder = byte_encoder(file)
        kind = "<u2" if encoder.library.get_vocab_size() <= 1 << 16 else "<u4"
        shard, store, out = TaskContext.get().partitionId(), None, None
        doc_ids, sizes, end = [], [], np.array([end_id], kind).tobytes()
        for ids, texts in doc_batches(batches):
            if store is None:
                store, root = _where(folder)
                store.create_dir(root, recursive=True)
                name = f"{root}/part-{shard:06d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{name}.ids")
            for t in texts:
                got = np.frombuffer(encoder.encode(t), "<u4").astype(kind, copy=False)
                out.write(got.tobytes() + end)
                sizes.append(len(got) + 1)
            doc_ids += [_NULL if i is None else i for i in ids]
        if out is not None:
            out.close()
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            with store.open_output_stream(f"{name}.idx") as index:
                index.write(np.concatenate(([len(doc_ids)], doc_ids, offsets)).astype("<i8").tobytes())
            yield record_batch(_SHARD, [shard], [name], [len(doc_ids)], [int(offsets[-1])])

    shards = sorted(tuple(r) for r in rows.mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect())  # one row a shard
    bases = np.concatenate(([0], np.cumsum([s[3] for s in shards]))).tolist()
    scheme = folder.partition("://")[0] if "://" in folder else "file"
    kind = "<u2" if byte_encoder(file).library.get_vocab_size() <= 1 << 16 else "<u4"
    manifest = [(k, f"{scheme}://{p}", d, i, b, kind) for (k, p, d, i), b in zip(shards, bases, strict=False)]
    return spark.createDataFrame(manifest, "shard long, path string, n_docs long, n_ids long, base long, kind string")


class _Ranges:
    """ids of a shard on a store that can't be mapped: a slice reads its own bytes only."""

    def __init__(self, file, kind: str):
        self.file, self.kind = file, np.dtype(kind)

    def __getitem__(self, at: slice) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at(int(at.stop - at.start) * width, int(at.start) * width), self.kind)


def open_shard(uri: str, kind: str):
    """doc_ids, offsets and ids of a shard: memory maps on a local or mounted file system, else ids are read by ranges."""
    store, path = _where(uri)
    if isinstance(store, fs.LocalFileSystem):
        index, ids = np.memmap(f"{path}.idx", "<i8", "r"), np.memmap(f"{path}.ids", kind, "r")
    else:
        index, ids = np.frombuffer(store.open_input_file(f"{path}.idx").read(), "<i8"), _Ranges(store.open_input_file(f"{path}.ids"), kind)
    n = int(index[0])
    return index[1 : n + 1], index[n + 1 :], ids


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    spark = manifest.sparkSession

    def read(batches):
        for batch in batches:
            for path, base, kind in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "kind")), strict=True):
                doc_ids, offsets, ids = open_shard(path, kind)
                for at in range(0, len(doc_ids), 4096):
                    upto = min(at + 4096, len(doc_ids))
                    part = ids[offsets[at] : offsets[upto]].astype("<u4")
                    cuts = (offsets[at : upto + 1] - offsets[at]).tolist()
                    crcs = [zlib.crc32(part[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    known = [None if i == _NULL else i for i in doc_ids[at:upto].tolist()]
                    yield record_batch(_DOCS, known, (offsets[at:upto] + base).tolist(), np.diff(cuts).tolist(), crcs)

    n = max(1, manifest.count())
    return manifest.repartition(min(n, partitions(spark)), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_tokens(documents(spark, sf_dir), shared_dir(spark, "token-files")))
