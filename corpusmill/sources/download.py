"""Files fetched over HTTP by tasks, one after the other, each put in place whole or not at all."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetched(url: str, folder: str, name: str, attempts: int = 5, pause: float = 5.0, timeout: float = 60.0, chunk: int = 1 << 20, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, int]:
    """(state, bytes, tries): 'there' if the file is there and not empty, else 'fetched', else 'failed'.

    The body streams to name.part, which becomes name once it is whole; a length that the server tells must be met. After the k-th failure the next try
    waits k times pause seconds. Any file system that Arrow knows by its URI will do.
    """
    store, base = fs.FileSystem.from_uri(folder)
    path, part = f"{base}/{name}", f"{base}/{name}.part"
    now = store.get_file_info(path)
    if now.type == fs.FileType.File and now.size:
        return "there", now.size, 0
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    for k in range(1, attempts + 1):
        try:
            n = 0
            with urllib.request.urlopen(url, timeout=timeout) as body, store.open_output_stream(part) as out:
                while block := body.read(chunk):
                    out.write(block)
                    n += len(block)
                told = body.headers.get("Content-Length")
            if told is not None and int(told) != n:
                raise OSError(f"{n} of {told} bytes")
            store.move(part, path)
            return "fetched", n, k
        except OSError:
            if k < attempts:
                sleep(k * pause)
    if store.get_file_info(part).type == fs.FileType.File:
        store.delete_file(part)
    return "failed", 0, attempts


def download(files: DataFrame, folder: str, attempts: int = 5, pause: float = 5.0, tasks: int = 8) -> DataFrame:
    """name, url, state, n_bytes, tries for files(name, url), which are fetched into folder when this is run; `tasks` bounds how many at once.

    A task that is run again finds what is there and goes on; two runs of one task at a time are safe as far as the file system renames at once. Names are
    paths below folder and distinct. Nothing but the outcome comes back.
    """

    def run(batches):
        for b in batches:
            got = [fetched(u, folder, n, attempts, pause) for n, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32())))], names=["name", "url", "state", "n_bytes", "tries"])

    return files.select("name", "url").repartition(tasks, F.col("name")).mapInArrow(run, "name string, url string, state string, n_bytes long, tries int")


def outcome(downloads: DataFrame) -> DataFrame:
    """state, files, n_bytes over download()'s rows."""
    return downloads.groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.sum("n_bytes").alias("n_bytes"))
