"""WARC archives: written in a global order that doesn't depend on the run, and read back.

Records are compressed one by one, so an archive is their bytes one after the other and the compressed size of each is
known before any file is begun. Sizes are added up in the order of (page_id, row); archives roll where that sum passes a
multiple of the wished size. So which records a file holds, and each of its bytes, follow from the pages alone. Each file
is written by one task under a temporary name of its attempt; the names are a table that Spark commits, from which a
second job moves the files of the attempts that counted to their final names. A manifest written last names all files
with their sizes and digests; readers open nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.operators.graph import shared_dir

from .common import in_arrow, lookup, materialize, read_table, text_of

#: Compressed bytes of an archive, more if there were over FILES of them.
ROLL, FILES = 16_000_000, 20_000
#: Bytes read or written at once.
CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SAFE_URL = "!#$%&'()*+,/:;=?@[]-._~"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share."""
    return arrow_fs.FileSystem.from_uri(uri) if ":/" in uri else (arrow_fs.LocalFileSystem(), uri)


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def squeezed(data: bytes) -> bytes:
    """A gzip member without a time or name, so equal records are equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {row}')}>"


def page_record(page_id: int | None, row: int, url: str | None, payload: bytes, first: tuple[int | None, int] | None, date: str) -> bytes:
    """A response, or a revisit of the record that `first` (page_id, row) names."""
    digest = digest_of(payload)
    headers = [("WARC-Record-ID", record_id(page_id, digest, row)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, SAFE_URL)))
        headers.append(("X-Url", quote(url, "")))  # as it was
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0], digest, first[1]))]
        if first[0] is not None:
            headers.append(("X-Refers-To-Page", str(first[0])))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if first else "response", headers, http if first else http + payload)


def archive_info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return squeezed(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block))


def prepared(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, row, url, html, first_page, first_row): `first` is set where an earlier page has the same payload of at least `least_bytes`."""
    html, size = text_of("html"), F.octet_length(text_of("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), F.col("url").cast("string").alias("url"), html.alias("html"), F.when(size >= least_bytes, F.concat(F.sha2(html, 256), F.sha1(html), size.cast("string"))).alias("content"))
    at = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("row").alias("nth"))
    firsts = rows.where("content is not null").groupBy("content").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("content", F.col("first.id").alias("first_page"), F.col("first.nth").alias("first_row")), "warc-firsts")
    found = lookup(rows, firsts, ["content"], F.col("row"))
    other = F.col("row") != F.col("first_row")
    return found.select("page_id", "row", "url", "html", F.when(other, F.col("first_page")).alias("first_page"), F.when(other, F.col("first_row")).alias("first_row"))


def members_of(pages: DataFrame, least_bytes: int, date: str) -> DataFrame:
    """(page_id, row, size, member): each page's record, compressed."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = zip(*[part.column(i).to_pylist() for i in range(6)], strict=True)
                made = [squeezed(page_record(p, r, u, h.encode("utf-8", "surrogatepass"), None if fr is None else (fp, fr), date)) for p, r, u, h, fp, fr in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(m) for m in made], pa.int64()), pa.array(made, pa.binary())], ["page_id", "row", "size", "member"])

    return materialize(in_arrow(prepared(pages, least_bytes), compress, "page_id long, row long, size long, member binary"), "warc-members")


def first_keys(members: DataFrame, roll: int) -> list[tuple[bool, int, int]]:
    """The key (null, page_id, row) that each archive begins with; at most FILES and one of them reach the driver."""
    key = [F.col("page_id").isNull(), F.col("page_id"), F.col("row")]
    total = members.agg(F.sum("size")).first()[0] or 0
    roll = max(roll, math.ceil(total / FILES))
    ranges = materialize(members.select("page_id", "row", "size").repartitionByRange(*key).withColumn("range", F.spark_partition_id()), "warc-sizes")
    sums = ranges.groupBy("range").agg(F.sum("size").alias("all"))
    starts = sums.select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    so_far = F.sum("size").over(Window.partitionBy("range").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = ranges.withColumn("so_far", so_far).join(F.broadcast(starts), "range").select(F.floor((F.col("start") + F.col("so_far")) / F.lit(roll)).alias("file"), F.struct(*[c.alias(n) for c, n in zip(key, ("none", "id", "nth"), strict=True)]).alias("at"))
    firsts = placed.groupBy("file").agg(F.min("at").alias("at")).orderBy("file").collect()
    return [(r.at.none, r.at.id or 0, r.at.nth) for r in firsts]


def filed(members: DataFrame, bounds: list[tuple[bool, int, int]]) -> DataFrame:
    """`members` with their file number."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            files = [bisect_right(bounds, (p is None, p or 0, r)) - 1 for p, r in keys]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), *batch.columns], ["file", *batch.schema.names])

    return in_arrow(members, number, "file int, page_id long, row long, size long, member binary")


def write_warc(pages: DataFrame, folder: str, *, roll: int = ROLL, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Writes `pages` (page_id, url, html) to `folder`; returns the manifest (file, name, records, bytes, sha256) as a table of that folder.

    The payload is the html in UTF-8, null as empty. Of equal payloads (by two hashes and size) of `least_bytes` or more the page with the smallest
    page_id is the response, others are revisits; null ids come after all others, equal ids by row. Smaller payloads are
    all responses. Null ids and urls leave their header out; any characters of a url are kept. A page of any size is one
    record, held whole by one task; other columns, whatever their names, aren't written. An empty table gives an empty
    manifest. `pages` must read the same each time (a table of files does).
    """
    spark = pages.sparkSession
    members = members_of(pages, least_bytes, date)
    bounds = first_keys(members, roll)
    parts = max(1, len(bounds))
    dealt = filed(members, bounds).repartition(parts, "file").sortWithinPartitions("file", F.col("page_id").isNull(), "page_id", "row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        attempt, out, open_ = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}", [], None

        def close() -> None:
            open_["stream"].close()
            out.append((open_["file"], open_["name"], open_["temporary"], open_["records"], open_["bytes"], open_["sha"].hexdigest()))

        def put(data: bytes) -> None:
            open_["stream"].write(data)
            open_["sha"].update(data)
            open_["bytes"] += len(data)

        store.create_dir(f"{path}/_temporary", recursive=True)
        for batch in batches:
            for i, file in enumerate(batch.column("file").to_pylist()):
                if open_ is None or open_["file"] != file:
                    if open_:
                        close()
                    name, temporary = f"part-{file:06d}.warc.gz", f"_temporary/{file:06d}-{attempt}"
                    open_ = {"file": file, "name": name, "temporary": temporary, "records": 0, "bytes": 0, "sha": hashlib.sha256(), "stream": store.open_output_stream(f"{path}/{temporary}", compression=None, buffer_size=CHUNK)}
                    put(archive_info(name, date))
                put(batch.column("member")[i].as_py())
                open_["records"] += 1
        if open_:
            close()
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "name", "temporary", "records", "bytes", "sha256"])

    written = materialize(in_arrow(dealt, write, "file int, name string, temporary string, records long, bytes long, sha256 string"), "warc-attempts")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Moves files to their names; a file that an earlier attempt of this task moved is left."""
        store, path = place(folder)
        for batch in batches:
            for name, temporary, size in zip(*[batch.column(c).to_pylist() for c in ("name", "temporary", "bytes")], strict=True):
                if store.get_file_info(f"{path}/{temporary}").type == arrow_fs.FileType.File:
                    store.move(f"{path}/{temporary}", f"{path}/{name}")
                elif store.get_file_info(f"{path}/{name}").size != size:
                    raise OSError(f"{name}: neither written nor committed")
            yield batch.select([c for c in batch.schema.names if c != "temporary"])

    schema = written.drop("temporary").schema
    in_arrow(written, commit, schema).write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    store, path = place(folder)
    if store.get_file_info(f"{path}/_temporary").type == arrow_fs.FileType.Directory:
        store.delete_dir(f"{path}/_temporary")  # what attempts that didn't count have left
    return spark.read.schema(schema).parquet(f"{folder}/manifest.parquet")


def unpacked_records(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    data = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = data or stream.read(CHUNK)
            if not data:
                if parts or unpacker.unconsumed_tail:
                    raise ValueError("archive ends within a record")
                return
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
        yield b"".join(parts)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; lengths and digests that don't hold are errors."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(headers["content-length"])
    block = rest[:size]
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def page_of(headers: dict[str, str], block: bytes) -> tuple:
    """The columns of RECORDS; a revisit has no payload but its size and digest."""
    http, _, body = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    size, digest = int(fields["Content-Length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    kept = headers["warc-type"] == "response"
    if kept and (len(body) != size or digest_of(body) != digest):
        raise ValueError(f"damaged payload {headers['warc-record-id']}")
    number = lambda k: int(headers[k]) if k in headers else None
    url = unquote(headers["x-url"]) if "x-url" in headers else None
    return number("x-page-id"), url, headers["warc-type"], size, digest, None if kept else number("x-refers-to-page"), body if kept else None


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of RECORDS of all archives that the manifest of `folder` names; a task holds one record and some columns at a time."""
    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    archives = manifest.select("name", "bytes", "records")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in RECORDS.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for name, records in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(f"{path}/{name}", compression=None, buffer_size=CHUNK) as stream:
                    for raw in unpacked_records(stream):
                        headers, block = parsed(raw)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        rows.append(page_of(headers, block))
                        held, seen = held + len(block), seen + 1
                        if len(rows) == 1000 or held > 16 * CHUNK:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)
                if seen != records:
                    raise ValueError(f"{name}: {seen} records, {records} in the manifest")

    return in_arrow(archives.repartition(max(1, min(FILES, manifest.count())), "name"), read, RECORDS)


def op12_warc_archives(spark, sf_dir):
    """All of `pages`, written as archives and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(read_table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i * 5 + 1, 5))::INT >> (15 - 5 * j)::INT) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '')"

SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""
