"""Packed exchanges between chunks of documents and buckets of keys.

Documents are dealt into chunks by a hash of their id and text, and equal rows of a batch to chunks
after one another, so neither a null or repeated id nor a repeated row fills a chunk.  A chunk sends *cells*, one row for each
bucket it has something for, whose arrays are in an order that the chunk can compute again; a
bucket answers each cell with bits or bytes in that order.  So an answer names neither documents
nor keys.  Within a chunk equal keys are merged before they are sent, so however frequent a key
is, a bucket gets it once from each chunk.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null doc_id inside operators; it sorts before every other id.
NULL_ID = -(2**63)
#: Input bytes, as Spark estimates them, for each chunk and each bucket.
CHUNK_BYTES = 3 << 20
#: Bytes of rows that a task deals at a time, for an exchange and for a table that is written in the same task.
PASS, TABLE_PASS = 48 << 20, 32 << 20
#: As many buckets as a table may have by default.
MOST_BUCKETS = 100_000
CELL = "chunk int, bucket int, body binary"
BODIES = "chunk int, body binary"


def size_hint(df: DataFrame) -> int:
    """Spark's estimate of the bytes of a plan; where it has none, the texts are measured."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 50 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def pieces(df: DataFrame, each: int = CHUNK_BYTES, least: int = 4) -> int:
    """How many parts of about ``each`` bytes the input has."""
    return int(min(max(least, math.ceil(size_hint(df) / each)), 1 << 24))


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; where the session names none, a temporary one, which only a local session can use."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(conf or os.path.join(tempfile.gettempdir(), "detectra-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame written as a table in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here and survives lost executors."""
    return stored(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def id_and_text() -> list[F.Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")]


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(*id_and_text())


def real_id(name: str = "doc_id") -> F.Column:
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


def seal(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unseal(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def repeats(x: np.ndarray) -> np.ndarray:
    """For each number, how many equal ones come before it."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    starts = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return out


def chunked(docs: DataFrame, chunks: int, carry: bool = False, by_id: bool = False, most: int = PASS) -> DataFrame:
    """(chunk, body): documents dealt by id and text and compressed; ids may be NULL_ID, null texts stay null.

    With ``carry`` a struct ``rest`` of all columns but text goes along.  With ``by_id`` documents are
    dealt by id alone, so they can be looked up, and of rows of one id that one pass of a task holds
    only the one of the least text is kept, null if none has one.
    """

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterable[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            x = t.column("print").to_numpy()
            if by_id:
                rows = pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")]).to_numpy()
                ids = t.column("doc_id").to_numpy()[rows]
                rows = rows[np.append(True, ids[1:] != ids[:-1])]
                c = x[rows] % chunks
            else:
                rows, c = np.arange(len(x)), (x % chunks + repeats(x)) % chunks
            order = np.argsort(c, kind="stable")
            t, c = t.select(names).take(pa.array(rows[order])), c[order]
            cuts = np.flatnonzero(np.diff(c, prepend=-1))
            for s, e in zip(cuts, [*cuts[1:], len(c)]):
                yield pa.record_batch({"chunk": pa.array([c[s]], pa.int32()), "body": pa.array([seal(t.slice(s, e - s))], pa.binary())})

        for batch in batches:
            step = max(1, batch.num_rows * (most // 2) // max(1, batch.nbytes))
            for b in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                held.append(b)
                size += b.nbytes
                if size > most:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    names = ["doc_id", "text", *["rest"] * carry]
    rows = ids_and_texts(docs) if not carry else docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), *id_and_text())
    tagged = rows.withColumn("print", F.xxhash64("doc_id", *["text"] * (not by_id)))
    return tagged.mapInArrow(deal, BODIES)


def dealt_table(docs: DataFrame, chunks: int, carry: bool = False, by_id: bool = False) -> DataFrame:
    """Chunks of documents as a bucketed table in the shared folder, which several jobs read without a shuffle."""
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    rows = chunked(docs, chunks, carry, by_id, TABLE_PASS).repartition(chunks, "chunk")
    rows.write.bucketBy(min(chunks, MOST_BUCKETS), "chunk").option("path", f"{shared_dir(spark)}/{name}").option("compression", "uncompressed").saveAsTable(name)
    return spark.table(name)


def chunk_table(bodies: pa.ChunkedArray) -> pa.Table:
    """A chunk's rows in a fixed order: by id, then text."""
    t = pa.concat_tables([unseal(b.as_py()) for b in bodies])
    return t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()


def open_chunk(bodies: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(ids, texts) of a chunk."""
    t = chunk_table(bodies)
    text = t.column("text")
    return np.asarray(t.column("doc_id"), np.int64), text.chunk(0) if text.num_chunks == 1 else pa.concat_arrays(text.chunks)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the smallest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one body: of each a type letter and a length, then the bytes."""
    head = [f"{a.dtype.str}:{len(a)}" for a in arrays]
    text = ",".join(head).encode()
    return len(text).to_bytes(4, "little") + text + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(body: bytes) -> list[np.ndarray]:
    n = int.from_bytes(body[:4], "little")
    out, at = [], 4 + n
    for x in body[4:at].decode().split(","):
        kind, _, length = x.rpartition(":")
        t = np.dtype(kind)
        out.append(np.frombuffer(body, t, int(length), at))
        at += int(length) * t.itemsize
    return out


def cells(chunk: int, bucket: np.ndarray, *arrays: np.ndarray) -> pa.Table:
    """One row for each bucket; arrays must be sorted by bucket."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(bucket))
    return pa.table(
        {
            "chunk": pa.array(np.full(len(cuts), chunk, np.int32)),
            "bucket": pa.array(bucket[cuts].astype(np.int32)),
            "body": pa.array([pack(*(a[s:e] for a in arrays)) for s, e in zip(cuts, ends)], pa.binary()),
        }
    )


def empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.table({n: pa.array([], kinds[t]) for n, t in (x.split() for x in schema.split(", "))})


def each_chunk(docs: DataFrame, f: Callable[[int, np.ndarray, pa.Array], pa.Table], schema: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        return f(t.column("chunk")[0].as_py(), *open_chunk(t.column("body")))

    return docs.groupBy("chunk").applyInArrow(run, schema)


def each_chunk_with(docs: DataFrame, answers: DataFrame, f: Callable[[int, np.ndarray, pa.Array, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """f gets a chunk and the answers it was given, by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty(schema)
        got = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist()))
        return f(left.column("chunk")[0].as_py(), *open_chunk(left.column("body")), got)

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def each_bucket(sent: DataFrame, f: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> DataFrame:
    """f gets the unpacked cells of a bucket and returns what to answer each of them."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        out = f([unpack(b.as_py()) for b in t.column("body")])
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "body": pa.array([pack(*x) if isinstance(x, (list, tuple)) else pack(x) for x in out], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, CELL)


def runs_of(rows: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of all rows of each value of the keys, like a grouped map but without its cost for each small group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(b.column(k)) for k in keys]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for s, e in zip(starts, starts[1:]):
                own = tuple(int(c[s]) for c in cols)
                if held and own != last:
                    yield from f(pa.Table.from_batches(held)).to_batches()
                    held = []
                last = own
                held.append(b.slice(s, e - s))
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def by_cell(bucket: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
    """Answers of bits, put together again for entries sorted by bucket."""
    out = np.zeros(len(bucket), bool)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for s, e in zip(cuts, [*cuts[1:], len(bucket)]):
        body = got.get(int(bucket[s]))
        if body is not None:
            out[s:e] = np.unpackbits(unpack(body)[0], count=e - s).astype(bool)
    return out
