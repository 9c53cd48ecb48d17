"""Many contents in few files, found again by byte ranges.

Each task appends its rows to one file of its own and returns where each begins and how long it is. That table drives
reading: any task reads any span without the rest of its file. A file's name is new for every attempt of a task and the
table names the files of the attempts that counted, so a repeated task leaves no wrong bytes behind a span.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from tessella.storage import local_path, materialize, new_folder


def write_spans(rows: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """(keys, path, start, length) of rows whose binary content was written to files in the shared folder.

    A null content is as an empty one. No rows give no files. The folder must be mounted on every machine.
    """
    import os
    import uuid

    import pandas as pd

    where = local_path(new_folder(rows.sparkSession, "spans"))
    os.makedirs(where, exist_ok=True)
    kept = rows.select(*keys, content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keys)]) + ", path string, start long, length long"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, at = os.path.join(where, uuid.uuid4().hex + ".bin"), 0
        out = None
        try:
            for pdf in batches:
                if not len(pdf):
                    continue
                out = out or open(path, "xb")
                starts, lengths = [], []
                for data in pdf[content]:
                    data = bytes(data) if data is not None else b""
                    out.write(data)
                    starts.append(at)
                    lengths.append(len(data))
                    at += len(data)
                out.flush()
                yield pdf[list(keys)].assign(path=path, start=starts, length=lengths)
        finally:
            if out:
                out.close()

    return materialize(kept.mapInPandas(write, schema), "spans-index")


def read_spans(spans: DataFrame) -> DataFrame:
    """spans (path, start, length and other columns) with the `content` of each; a span that its file does not hold is an error."""
    import pandas as pd

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path, rows in pdf.groupby("path", sort=False):
                with open(path, "rb") as f:
                    for at, start, length in zip(rows.index, rows["start"], rows["length"]):
                        f.seek(int(start))
                        data = f.read(int(length))
                        if len(data) != length:
                            raise ValueError(f"{path} ends before byte {int(start) + int(length)}")
                        found.append((at, data))
            yield pdf.assign(content=pd.Series(dict(found), dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema) + ", content binary"
    return spans.mapInPandas(read, schema)
