"""Token ids as flat binary files with 64-bit document offsets.

A file set is a folder of parts. Part k has `<name>.ids`, the unsigned ids of its documents one after
another in the narrowest width that holds the vocabulary, `<name>.offsets`, one 64-bit number more
than it has documents, and `<name>.docs`, the documents' ids. Parts follow one another in ascending
doc_id; a part's base, the number of ids in all parts before it, is a prefix sum over the parts.

A task writes under a name of its own and reports it; only names that a finished task reported are in
the manifest, so a lost or repeated task leaves no half-written part behind. The manifest has a row
per part, never a row per document.

Null texts count as empty. Equal doc_ids are all written, in the order of their texts' hashes. An
empty table gives no parts. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.wordids import by_bytes, word_encoder
from tessella.storage import local_path, materialize

#: Documents to a row batch when files are read.
READ_DOCS = 4096
#: Ids to a row batch when files are read.
READ_IDS = 4 << 20


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    #: (name of the part, its documents, its ids), in order
    parts: tuple[tuple[str, int, int], ...]
    dtype: str

    def bases(self) -> list[int]:
        return [0, *accumulate(n for _, _, n in self.parts)][:-1]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, partitions: int | None = None) -> TokenFiles:
    """Encode every text, append end_id, and write the parts below folder, which all executors must share."""
    spark = docs.sparkSession
    where = local_path(folder)
    os.makedirs(where, exist_ok=True)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        encoder = word_encoder(tokenizer_path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        at = f"{where}/{name}"
        total = documents = 0
        with open(f"{at}.ids", "wb") as ids, open(f"{at}.offsets", "wb") as offsets, open(f"{at}.docs", "wb") as names:
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                for part in by_bytes(batch, "text"):
                    flat, counts = encoder.encode(part.column("text"))
                    ends = np.cumsum(counts)
                    ids.write(np.insert(flat, ends, np.array(end_id, flat.dtype)).tobytes())
                    offsets.write((total + ends + np.arange(1, len(ends) + 1)).astype("<u8").tobytes())
                    names.write(part.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    total += int(ends[-1]) + len(ends)
                    documents += len(ends)
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "name": name, "documents": documents, "ids": total, "dtype": encoder.dtype.str}])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    manifest = materialize(ordered.mapInArrow(run, "part long, name string, documents long, ids long, dtype string"), "token-manifest")
    parts = sorted(tuple(r) for r in manifest.where("documents > 0").collect())
    return TokenFiles(folder, tuple((name, d, i) for _, name, d, i, _ in parts), parts[0][4] if parts else "<u2")


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the memory-mapped parts."""
    where, dtype = local_path(files.folder), np.dtype(files.dtype)

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids = np.memmap(f"{where}/{name}.ids", dtype, "r")
                offsets = np.memmap(f"{where}/{name}.offsets", "<u8", "r").astype(np.int64)
                names = np.fromfile(f"{where}/{name}.docs", "<i8")
                a = 0
                while a < len(names):
                    b = max(a + 1, min(a + READ_DOCS, int(np.searchsorted(offsets, offsets[a] + READ_IDS, "right")) - 1))
                    data = ids[offsets[a] : offsets[b]].astype("<u4")
                    cuts = ((offsets[a : b + 1] - offsets[a]) * 4).astype(np.int32)
                    binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                    none = pa.array(names[a:b] == -(2**63))
                    doc_id = pa.array(names[a:b], mask=none.to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(base + offsets[a:b]), pa.array(np.diff(offsets[a : b + 1])), binary], names=["doc_id", "start", "n_tokens", "ids"])
                    a = b

    rows = [(name, base) for (name, _, _), base in zip(files.parts, files.bases(), strict=True)]
    listed = spark.createDataFrame(rows, "name string, base long")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
