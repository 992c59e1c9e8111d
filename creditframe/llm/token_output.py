"""Token-id output: Huffman-coded blocks of ids in document order.

1. ``tokenize``: one narrow pass; ids per row, written once.
2. ``id_counts``: global counts, pre-aggregated per task; at most one row per
   vocabulary entry reaches the driver, which derives the code book from it.
3. ``write``: rows are range-partitioned and sorted by id, packed into blocks
   of about ``BLOCK`` ids (whole documents), and every block is encoded on
   its own with bit-offset checkpoints.
4. ``read``: blocks decode independently through a table.

File format, below one folder: ``codes`` (id, length) is the code book, the
canonical codes follow from it; ``blocks`` has one record per block: part,
block, first (ids before it in the part), ids and sizes of its documents,
bit offsets, bit stream.  The place of a part is the sum of the parts before.

Edge cases: null text is empty and still gets its end id; null document ids
come first; rows that share an id are ordered by content; an empty table
writes an empty code book and no blocks; other columns are not written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import huffman
from .common import per_worker, tokenizer_file
from .pretokens import Encoder

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Ids of a block; a longer document is a block of its own.
BLOCK = 1 << 20
_BLOCKS = ("part int, block int, first long, n_ids long, doc_ids array<{id}>, sizes array<int>, "
           "offsets binary, stream binary")


def id_type(vocabulary: str, end_id: int) -> str:
    """Little-endian unsigned integers that hold every id."""
    from tokenizers import Tokenizer
    most = max(Tokenizer.from_file(tokenizer_file(vocabulary)).get_vocab_size() - 1, end_id)
    return "<u2" if most < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
             end_id: int = END_ID, kind: str = "<u4") -> DataFrame:
    """(id, ids) per row; ids as integers of ``kind``."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    file = tokenizer_file(vocabulary)

    def run(batches):
        encoder = per_worker((file, end_id), lambda: Encoder(file, end_id))
        for b in batches:
            ids = [x.astype(kind).tobytes() for x in encoder.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary")


def id_counts(tokens: DataFrame, kind: str = "<u4") -> DataFrame:
    """(id, n) over all ``tokens``."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=len(total))
            n[:len(total)] += total
            total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used.astype(np.int64), "n": total[used]})

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
          end_id: int = END_ID, block: int = BLOCK) -> None:
    """Encode ``docs`` into files below ``path``."""
    spark = docs.sparkSession
    at = scratch_path(spark, "tokens")
    kind = id_type(vocabulary, end_id)
    tokens = tokenize(docs, id, text, vocabulary, end_id, kind)
    tokens.write.option("compression", "zstd").parquet(at)
    tokens = spark.read.schema(tokens.schema).parquet(at)
    counts = {r.id: r.n for r in id_counts(tokens, kind).collect()}  # at most the vocabulary
    n = np.zeros(max(counts, default=-1) + 1, np.int64)
    n[list(counts)] = list(counts.values())
    length = huffman.lengths(n)
    book = [(int(i), int(length[i])) for i in np.flatnonzero(length)]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast(length)

    def encode(batches):
        length, code = shared.value, huffman.codes(shared.value)
        part = TaskContext.get().partitionId()
        held, size, done, first = [], 0, 0, 0

        def flush():
            nonlocal held, size, done, first
            ids = np.concatenate([i for _, i in held])
            stream, offsets = huffman.pack(ids, length, code)
            row = {"part": [part], "block": [done], "first": [first], "n_ids": [len(ids)],
                   "doc_ids": [[d for d, _ in held]], "sizes": [[len(i) for _, i in held]],
                   "offsets": [offsets.astype("<i8").tobytes()], "stream": [stream]}
            held, size, done, first = [], 0, done + 1, first + len(ids)
            return pa.RecordBatch.from_pydict(row, schema)

        for b in batches:
            schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()),
                                ("n_ids", pa.int64()), ("doc_ids", pa.list_(b.schema.field(0).type)),
                                ("sizes", pa.list_(pa.int32())), ("offsets", pa.binary()), ("stream", pa.binary())])
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(ids, kind)
                if held and size + len(ids) > block:
                    yield flush()
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield flush()

    dealt = (tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange("id", "tie")
             .sortWithinPartitions("id", "tie", "ids").drop("tie"))
    shape = _BLOCKS.format(id=tokens.schema["id"].dataType.simpleString())
    dealt.mapInArrow(encode, shape).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) per document, decoded from the files."""
    book = spark.read.schema("id int, length int").parquet(f"{path}/codes").collect()  # at most the vocabulary
    length = np.zeros(max((r.id for r in book), default=-1) + 1, np.uint8)
    length[[r.id for r in book]] = [r.length for r in book]
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect())  # one row per part
    before, place = 0, []
    for part, n in parts:
        place.append((part, before))
        before += n
    shared = spark.sparkContext.broadcast((length, dict(place)))
    kind = blocks.schema["doc_ids"].dataType.elementType

    def decode(batches):
        length, place = shared.value
        table = huffman.decode_table(length)
        for b in batches:
            for r in b.to_pylist():
                ids = huffman.unpack(r["stream"], r["n_ids"], np.frombuffer(r["offsets"], "<i8"), table).astype("<u4")
                sizes = np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                each = [ids[e - s:e] for s, e in zip(sizes, ends)]
                out = {"id": pa.array(r["doc_ids"], b.schema.field("doc_ids").type.value_type),
                       "start": place[r["part"]] + r["first"] + ends - sizes, "n_tokens": sizes,
                       "ids_crc32": np.array([zlib.crc32(x.tobytes()) for x in each], np.int64)}
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    shape = f"id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.mapInArrow(decode, shape).withColumnRenamed("id", id)
