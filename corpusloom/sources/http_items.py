"""Explicit items of an HTTP origin, fetched to a spool that all executors share.

Origins can't be listed, so items are named, each with the size and digest that are expected of it.
"""

from __future__ import annotations

import hashlib
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import dealt
from corpusloom.sources.documents import scan_documents
from corpusloom.sources.token_chunks import file_digest, resolve

READ = 1 << 20

#: Opens a url from a byte on.  It is sent to the tasks, so it must be picklable.
Fetch = Callable[[str, int], BinaryIO]


def url_open(url: str, start: int) -> BinaryIO:
    """From ``start`` on by a range request; an origin that ignores it is an error, as its bytes would be others."""
    answer = urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={start}-"} if start else {}), timeout=60)
    if start and answer.status != 206:
        answer.close()
        raise OSError(f"{url}: no range requests")
    return answer


def item_url(base_url: str, name: str) -> str:
    """Url of an item: each segment of its name is percent-encoded, so that no two names share a url."""
    parts = urllib.parse.urlsplit(base_url)
    if parts.scheme not in ("http", "https") or not parts.netloc or parts.query or parts.fragment or any(c <= " " or c == "\x7f" for c in base_url):
        raise ValueError(f"no plain http url: {base_url!r}")
    segments = name.split("/")
    if any(s in ("", ".", "..") for s in segments) or any(c < " " or c in "\\\x7f" for c in name):
        raise ValueError(f"no safe name: {name!r}")
    return "/".join([base_url.rstrip("/"), *(urllib.parse.quote(s, safe="") for s in segments)])


def fetch_item(fetch: Fetch, url: str, size: int, sha256: str, store: fs.FileSystem, path: str, temp: str, retries: int, wait_s: float) -> int:
    """Fetch one item to ``path`` by way of ``temp``; the number of requests it took (0: it was there).

    A connection that breaks is taken up where it broke, up to ``retries`` times without a byte in between.  More or other bytes
    than expected are no accident and fail at once, and nothing is left.
    """
    if store.get_file_info(path).type != fs.FileType.NotFound:
        if file_digest(store, path) != sha256:
            raise ValueError(f"{path} is there with other content")
        return 0
    digest, at, requests, idle = hashlib.sha256(), 0, 0, 0
    try:
        with store.open_output_stream(temp) as out:
            while at < size or not requests:
                requests += 1
                before = at
                try:
                    with fetch(url, at) as source:
                        while data := source.read(READ):
                            at += len(data)
                            if at > size:
                                raise ValueError(f"{url} has more than {size} bytes")
                            digest.update(data)
                            out.write(data)
                    broken = None if at == size else f"{url} ends after {at} of {size} bytes"
                except OSError as error:
                    broken = f"{url}: {error}"
                if broken is None:
                    break
                idle = 0 if at > before else idle + 1
                if idle > retries:
                    raise ValueError(broken)
                time.sleep(wait_s * 2**idle)
        if digest.hexdigest() != sha256:
            raise ValueError(f"{url} has another digest than expected")
        store.move(temp, path)
        return requests
    except BaseException:
        if store.get_file_info(temp).type != fs.FileType.NotFound:
            store.delete_file(temp)
        raise


def fetch_items(items: DataFrame, base_url: str, spool: str, fetch: Fetch = url_open, retries: int = 3, wait_s: float = 0.5) -> DataFrame:
    """Fetch ``name, size, sha256`` items to ``spool``: ``name, path, bytes, requests``.

    Items that are there with the expected digest are kept, so a fetch that was lost goes on.  Sizes and digests must be
    given (null is an error); names must be relative, without empty or dotted segments.
    """

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = resolve(spool)
        for batch in batches:
            for name, size, sha256 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size is None or sha256 is None:
                    raise ValueError(f"{name}: size and sha256 must be given")
                path = f"{base}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                temp = f"{path.rpartition('/')[0]}/.{name.rpartition('/')[2]}-{TaskContext.get().taskAttemptId()}"
                n = fetch_item(fetch, item_url(base_url, name), size, sha256, store, path, temp, retries, wait_s)
                yield pa.record_batch([pa.array([name]), pa.array([f"{spool.rstrip('/')}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["name", "path", "bytes", "requests"])

    item_url(base_url, "x")
    listed = items.select("name", F.col("size").cast("long").alias("size"), F.lower("sha256").alias("sha256"))
    return dealt(listed, listed.count(), 1).mapInArrow(fetched, "name string, path string, bytes long, requests long")


def scan_http_items(spark: SparkSession, base_url: str, items: DataFrame, spool: str, fetch: Fetch = url_open, retries: int = 3, wait_s: float = 0.5) -> DataFrame:
    """``crawl, doc_id, text, item_name`` of explicit ``.jsonl`` and ``.parquet`` items.

    Items are fetched first, all of them or none is scanned; names (one per file) come back to the driver.
    """
    paths = [r["path"] for r in fetch_items(items, base_url, spool, fetch, retries, wait_s).select("path").collect()]
    return scan_documents(spark, sorted(paths), resolve(spool)[1])
