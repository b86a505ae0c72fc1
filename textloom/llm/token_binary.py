"""Token ids in flat binary files with 64-bit document offsets.

Each partition of the input writes two files into the shared folder: ids as
unsigned 16-bit (or 32-bit, for large vocabularies) little-endian integers, one
document after the other, and n + 1 signed 64-bit offsets of its n documents.
Both can be memory-mapped.  A partition's base, the number of tokens in all
partitions before it, is a prefix sum over the partitions' totals, so a
document's place in the whole corpus is base + local offset.

Files appear under their final names only when whole, by a rename, and their
content depends on the partition alone; a task that runs again replaces a file
by its equal.

Defined results.  A null or empty text is a document of zero tokens with its
place in the order.  Texts of any length are encoded whole.  Repeated rows are
stored again.  An empty table gives an empty index.  Other columns aren't read.
Ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import filesystem, need, qualified, saved, shared_folder, tuned, type_of
from textloom.llm.kit import pieces, text_array
from textloom.llm.tokenizer import DEFAULT_TOKENIZER, tokenizer


def _writer(folder: str, path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{part:06d}"
        temporary = f"{root}/_tmp-{part:06d}-{attempt}"
        codec = tokenizer(path)
        total, ends = 0, [np.zeros(1, np.int64)]
        with fs.open_output_stream(f"{temporary}.bin") as out:
            for batch in batches:
                for lo, hi, some in pieces(batch["text"], 1 << 20):
                    ids, bounds = codec.encode_rows(some)
                    out.write(ids.astype(ids.dtype.newbyteorder("<"), copy=False).tobytes())
                    ends.append(total + bounds[1:])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["doc_id"].slice(lo, hi - lo),
                            pa.array(np.full(hi - lo, part, np.int32)),
                            pa.array(total + bounds[:-1]),
                            pa.array(np.diff(bounds)),
                        ],
                        ["doc_id", "part", "local_start", "n_tokens"],
                    )
                    total += int(bounds[-1])
        with fs.open_output_stream(f"{temporary}.idx") as out:
            out.write(np.concatenate(ends).astype("<i8").tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{temporary}.{kind}", f"{name}.{kind}")

    return write


def write_tokens(docs: DataFrame, folder: str | None = None, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Write the files and return the index: doc_id, part, start (the document's
    first token's place in the whole corpus) and n_tokens.

    The texts are encoded once: the narrow index is saved to the shared folder,
    and bases are added to it there.
    """
    spark = tuned(docs.sparkSession)
    folder = qualified(spark, folder) if folder else shared_folder(spark)
    rows = need(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    local = saved(rows.mapInArrow(_writer(folder, path), f"doc_id {type_of(docs, 'doc_id')}, part int, local_start long, n_tokens long"))
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return (
        local.join(bases, F.col("part") == F.col("p"))
        .select("doc_id", "part", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")
    )


class TokenFile:
    """Memory-mapped part in a local or mounted folder, named by a path or file: URI."""

    def __init__(self, folder: str, part: int, dtype=np.uint16):
        root = filesystem(folder)[1] if folder.startswith("file:") else folder
        name = f"{root}/part-{part:06d}"
        self.offsets = np.memmap(f"{name}.idx", "<i8", "r")
        self.ids = np.memmap(f"{name}.bin", dtype, "r") if self.offsets[-1] else np.zeros(0, dtype)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, doc: int) -> np.ndarray:
        return self.ids[self.offsets[doc] : self.offsets[doc + 1]]


__all__ = ["TokenFile", "text_array", "write_tokens"]
