"""Token-id files: whole texts as ids in range-coded frames, in ascending document order.

Documents are range-partitioned and sorted by id, encoded by a public tokenizer, and written as frames
of about ``frame_tokens`` ids (see ``codec``: independent, checksummed blocks).  A file row holds its
part, the frame's number in the part and the frame's bytes, so the order of the documents does not
depend on file names, and any row can be read alone.  The position of a document among all ids follows
from the sums of the parts and frames before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.llm.codec import decode_frame, encode_frame
from seqspark.llm.common import WordTokenizer, shared_path, sliced

END_ID = 2
FRAME_TOKENS = 4 << 20
FILE_SCHEMA = "part int, frame int, n_tokens long, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id",
                      text_col: str = "text", frame_tokens: int = FRAME_TOKENS) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the frames under ``path``.

    Null ids come first; rows of equal id are ordered by text; other columns are ignored; an empty
    table writes no frame.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        words, part, frame = WordTokenizer(tokenizer), TaskContext.get().partitionId(), 0
        docs_held, ids_held, size = [], [], 0

        def flush():
            ids = np.concatenate(ids_held)
            data = encode_frame(docs_held, ids, np.array([len(x) for x in ids_held], np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([data], pa.binary())], ["part", "frame", "n_tokens", "data"])

        for b in sliced(batches):
            flat, bounds = words.encode(b.column(1).to_pylist())
            for i, doc in enumerate(b.column(0).to_pylist()):
                ids_held.append(np.append(flat[bounds[i]:bounds[i + 1]], np.uint32(end_id)))
                docs_held.append(doc)
                size += len(ids_held[-1])
                if size >= frame_tokens:
                    yield flush()
                    docs_held, ids_held, size, frame = [], [], 0, frame + 1
        if docs_held:
            yield flush()

    dealt.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the documents in the files; checksums are verified."""
    schema = "doc_id long, part int, frame int, inside long, n_tokens long, ids_crc32 long" + (
        ", ids array<int>" if with_ids else "")
    frames = spark.read.schema(FILE_SCHEMA).parquet(path)

    def run(batches):
        for b in batches:
            for part, frame, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                docs, lengths, ids = decode_frame(data)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                cols = [pa.array(docs, pa.int64()), pa.array([part] * len(docs), pa.int32()),
                        pa.array([frame] * len(docs), pa.int32()), pa.array(ends - lengths), pa.array(lengths),
                        pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "frame", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    bounds = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    found = frames.select("part", "frame", "data").mapInArrow(run, schema)
    # Sums before a part, and before a frame inside its part; neither table holds documents.
    sizes = frames.select("part", "frame", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before_part = parts.select("part", F.coalesce(F.sum("_n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    before_frame = sizes.select("part", "frame", F.coalesce(F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_f"))
    offsets = before_frame.join(before_part, "part").select("part", "frame", (F.col("_p") + F.col("_f")).alias("_off"))
    return found.join(offsets, ["part", "frame"]).select(
        "doc_id", (F.col("_off") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def op1_range_coder(spark, sf_dir):
    import public_tokenizers

    from seqspark.llm.common import table
    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, with_ids=False)
