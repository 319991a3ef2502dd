"""WARC archives: writing, reading back, and resolving records of equal payload to revisits.

Archives live under a folder that all executors see (any store that pyarrow.fs opens). Each is a row of gzip
members, one per record, written under a task's own name and then renamed, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofold.llm.common import drop_durable, durable, new_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, path string, ordinal long"
MANIFEST = "path string, records long"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def fresh(out: str, what: str) -> str:
    """A record id that no other folder of archives has for `what`, and that a task that runs again gives again."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{out}#{what}"))


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _member(fields: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(f"{head}Content-Length: {len(block)}\r\n\r\n".encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _response(page: str | None, url: str | None, record: str, digest: str, payload: bytes, date: str, level: int) -> bytes:
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{record}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Page-ID", page), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    return _member(fields, _http(len(payload)) + payload, level)


def _revisit(page: str | None, url: str | None, record: str, digest: str, size: int, of: dict, date: str, level: int) -> bytes:
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{record}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Page-ID", page), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{of['new_id']}>"), ("WARC-Refers-To-Target-URI", of["url"]), ("WARC-Refers-To-Page-ID", of["page"]), ("Content-Type", "application/http; msgtype=response")]
    return _member(fields, _http(size), level)


class _Archives:
    """Appends records to archives of about `roll` bytes, a warcinfo record at the start of each, and says what it wrote."""

    def __init__(self, out: str, date: str, roll: int, level: int):
        task = TaskContext.get()
        self.fs, self.base = _store(out)
        self.fs.create_dir(self.base, recursive=True)
        self.out, self.date, self.roll, self.level, self.part, self.attempt = out, date, roll, level, task.partitionId(), task.taskAttemptId()
        self.done: list[tuple[str, int]] = []
        self.file, self.records, self.size = None, 0, 0

    def place(self) -> tuple[str, int]:
        """The archive and the ordinal that the next record gets."""
        if self.file is None:
            self.name = f"part-{self.part:05d}-{len(self.done):04d}.warc.gz"
            self.file = self.fs.open_output_stream(f"{self.base}/.{self.name}.{self.attempt}", compression=None)
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{fresh(self.out, self.name)}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self.file.write(_member(fields, b"software: cytofold\r\nformat: WARC File Format 1.1\r\n", self.level))
        return f"{self.out}/{self.name}", self.records

    def add(self, member: bytes) -> None:
        self.file.write(member)
        self.records += 1
        self.size += len(member)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.fs.move(f"{self.base}/.{self.name}.{self.attempt}", f"{self.base}/{self.name}")
            self.done.append((f"{self.out}/{self.name}", self.records))
            self.file, self.records, self.size = None, 0, 0


def _records(path: str, step: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each gzip member of an archive but the warcinfo record, read in steps; memory holds one record."""
    fs, name = _store(path)
    with fs.open_input_stream(name, compression=None) as f:
        rest = b""
        while rest or (rest := f.read(step)):
            z, parts = zlib.decompressobj(31), []
            while True:
                parts.append(z.decompress(rest))
                if z.eof:
                    rest = z.unused_data
                    break
                if not (rest := f.read(step)):
                    raise ValueError(f"{path}: the last record is cut off")
            head, _, block = b"".join(parts).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            if fields["WARC-Type"] != "warcinfo":
                yield fields, block[: int(fields["Content-Length"])]


def _header(path: str, ordinal: int, fields: dict[str, str], block: bytes) -> tuple:
    number = lambda x: None if x is None else int(x)
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{path}, record {ordinal}: the payload isn't what its digest says")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1])
    return number(fields.get("WARC-Page-ID")), size, digest, kind, number(fields.get("WARC-Refers-To-Page-ID")), fields.get("WARC-Target-URI"), fields["WARC-Record-ID"][10:-1], path, ordinal


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {x.split()[0]: "Int64" for x in schema.split(", ") if x.endswith("long")}
    return pd.DataFrame(rows, columns=names).astype(kinds)


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None, roll: int = 32 << 20, level: int = 1) -> DataFrame:
    """Writes a response record per row and returns the manifest (path, records). Null payload: empty. Null url or id: no such field. The date, if none is given, is that of the call. Other columns are left out.

    A very long payload is one record, so an archive may be longer than `roll`. Repeated rows are a record each. No rows: no records.
    """
    date = date or now()

    def write(batches):
        to = _Archives(out, date, roll, level)
        for batch in batches:
            for page, url, html in zip(batch["page"], batch["url"], batch["html"], strict=True):
                payload = (html or "").encode()
                path, k = to.place()
                to.add(_response(page, url, fresh(path, str(k)), hashlib.sha256(payload).hexdigest(), payload, date, level))
        to.close()
        yield _frame(to.done, MANIFEST)

    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    return durable(rows.mapInPandas(write, MANIFEST), "warc-manifest")


def _each(manifest: DataFrame) -> DataFrame:
    """One archive to a task, as far as the slots go."""
    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.repartition(n)


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row of header fields per record; payloads are checked against their digests and not returned."""

    def read(batches):
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for k, (fields, block) in enumerate(_records(path)):
                    rows.append(_header(path, k, fields, block))
                    if len(rows) == 5000:
                        yield _frame(rows, HEADERS)
                        rows = []
                yield _frame(rows, HEADERS)

    return _each(manifest.select("path")).mapInPandas(read, HEADERS)


def resolve(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Of records with equal payloads of at least min_bytes, all but the one of smallest page id (nulls last, then by place), each with what it refers to.

    Repeated ids are records of their own. No headers: no rows. Payloads, however long, aren't read.

    Only headers are shuffled, by digest. Originals are a min() combined per task before the exchange, and the join
    back is an equi-join whose hot digests AQE splits.
    """
    own = headers.where(F.col("payload_bytes") >= min_bytes)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "ordinal", "record_id", "url")
    first = own.groupBy("payload_digest").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return own.join(first, "payload_digest").where("path <> o.path or ordinal <> o.ordinal").select("path", "ordinal", F.struct(F.col("o.page_id").cast("string").alias("page"), F.col("o.record_id").alias("record_id"), F.col("o.url").alias("url")).alias("of"))


def rewrite(manifest: DataFrame, revisits: DataFrame, out: str, date: str | None = None, roll: int = 32 << 20, level: int = 1) -> DataFrame:
    """Writes each archive again, revisit records in place of the payloads that another record holds. A task holds one record and the revisits of one archive.

    Headers are fresh: records get new ids, made of the folder and the old ids so that a revisit's reference is to the new id of what it refers to, and the date of the call if none is given.
    """
    date = date or now()

    def write(batches):
        to = _Archives(out, date, roll, level)
        for batch in batches:
            for path, of in zip(batch["path"], batch["revisits"], strict=True):
                known = {} if of is None else {x["ordinal"]: x["of"] for x in of}
                for k, (fields, block) in enumerate(_records(path)):
                    page, url, record, digest = fields.get("WARC-Page-ID"), fields.get("WARC-Target-URI"), fresh(out, fields["WARC-Record-ID"][10:-1]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload = block.partition(b"\r\n\r\n")[2]
                    to.place()
                    to.add(_revisit(page, url, record, digest, len(payload), {**known[k], "new_id": fresh(out, known[k]["record_id"])}, date, level) if k in known else _response(page, url, record, digest, payload, date, level))
        to.close()
        yield _frame(to.done, MANIFEST)

    by_path = revisits.groupBy("path").agg(F.collect_list(F.struct("ordinal", "of")).alias("revisits"))
    both = manifest.select("path").join(by_path, "path", "left")
    return durable(both.repartition(max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))).mapInPandas(write, MANIFEST), "warc-manifest")


def deduplicated(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 100, **names) -> DataFrame:
    """pages written as archives, revisits resolved, deduplicated archives written under `folder`; their manifest."""
    raw = new_dir(spark, "warc-raw")
    first = write_archives(pages, raw, **names)
    headers = durable(read_archives(first), "warc-headers")
    second = rewrite(first, resolve(headers, min_bytes), folder or new_dir(spark, "warc"))
    first._durable_path, gone = raw, first._durable_path
    drop_durable(first)
    first._durable_path = gone
    drop_durable(first)
    drop_durable(headers)
    return second


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_archives(deduplicated(spark, pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
