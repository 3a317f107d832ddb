"""WARC archives, index first.

Pages are written as gzip-per-record archives into the shared folder; each record's archive,
offset, length, URL and digest go into an index table. Reading starts from index rows: they are
dealt out by archive and stretch of it, sorted by offset, and near ranges are fetched in one read.

Records with equal payloads of at least MIN_REVISIT bytes are one response, that of the largest
page id, and revisits that refer to it. A payload's group may hold any share of the pages, so its
rows are dealt over SALTS tasks; only groups of two or more are joined.

A task that runs again writes a new archive; the index, which only committed tasks write, names
the archives that count.

Defined results: null html is an empty payload; a page without URL gets an empty target; rows that
repeat a page id with an equal payload are responses alike.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settled, work_path

MIN_REVISIT, SALTS = 1000, 32
#: An archive is closed at so many bytes; ranges with smaller gaps are read together, up to so many bytes at once.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
#: The date of all records of a run: results must not depend on the clock.
DATE = "2024-01-01T00:00:00Z"

INDEX = "archive string, offset long, length long, url string, digest string, page_id {id}, record_type string"


def revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, html, payload_digest, refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("payload_digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= MIN_REVISIT)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("payload_digest", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["payload_digest", "salt"], "left")
    refers = F.when(F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    return joined.select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


def record(page: object, url: str, payload: bytes, digest: str, refers: object) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the head of the response alone."""
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{base32}",
        "Page-ID": "" if page is None else str(page),
    }
    if refers is None:
        block += payload
    else:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>"
        fields["Refers-To-Page-ID"] = str(refers)
    fields["Content-Type"] = "application/http; msgtype=response"
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages(page_id, url, html) into archives in a folder that all executors share; returns the index, not yet run."""
    rows = revisits(pages)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, path, offset = None, "", 0
        try:
            for batch in batches:
                types = batch.schema.field("page_id").type
                for start in range(0, batch.num_rows, 512):
                    index: dict[str, list] = {c: [] for c in ("archive", "offset", "length", "url", "digest", "page_id", "record_type")}
                    for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True):
                        if out is None or offset >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            store.create_dir(root, recursive=True)
                            path, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{root}/{path}", compression=None)
                        member = gzip.compress(record(page, url, html.encode(), digest, refers), 3, mtime=0)
                        out.write(member)
                        for c, v in zip(index, (path, offset, len(member), url, digest, page, "response" if refers is None else "revisit"), strict=True):
                            index[c].append(v)
                        offset += len(member)
                    yield pa.RecordBatch.from_arrays([pa.array(index["archive"], pa.string()), pa.array(index["offset"], pa.int64()), pa.array(index["length"], pa.int64()), pa.array(index["url"], pa.string()), pa.array(index["digest"], pa.string()), pa.array(index["page_id"], types), pa.array(index["record_type"], pa.string())], names=list(index))
        finally:
            if out is not None:
                out.close()

    return rows.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, INDEX.format(id=kind))


def coalesced(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(archive, start, end, [(offset, length)]) from rows sorted by archive and offset."""
    now: tuple[str, int, int, list[tuple[int, int]]] | None = None
    for archive, offset, length in rows:
        if now and now[0] == archive and offset - now[2] <= GAP_BYTES and offset + length - now[1] <= READ_BYTES:
            now = (archive, now[1], max(now[2], offset + length), now[3] + [(offset, length)])
        else:
            if now:
                yield now
            now = (archive, offset, offset + length, [(offset, length)])
    if now:
        yield now


READ = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def read_records(selected: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of index rows, read back; a response whose payload does not have its digest is an error."""
    kind = selected.schema["page_id"].dataType
    dealt = selected.select("archive", "offset", "length", F.floor(F.col("offset") / READ_BYTES).alias("part")).repartition(partitions(selected), "archive", "part").sortWithinPartitions("archive", "offset").drop("part")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        number = lambda v: int(v) if v else None
        source, opened = None, ""
        for batch in batches:
            for archive, start, end, parts in coalesced(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                if archive != opened:
                    if source is not None:
                        source.close()
                    source, opened = store.open_input_file(f"{root}/{archive}"), archive
                data = source.read_at(end - start, start)
                out: list[list] = [[] for _ in names]
                for offset, length in parts:
                    fields, http, payload = parse(gzip.decompress(data[offset - start : offset - start + length]))
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record at {archive}:{offset}")
                    made = [number(fields["Page-ID"]), fields["WARC-Target-URI"], int(http["Content-Length"]), digest, fields["WARC-Type"], number(fields.get("Refers-To-Page-ID"))] + [payload] * with_payload
                    for column, v in zip(out, made, strict=True):
                        column.append(v)
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    schema = READ.format(id="long") + ", payload binary" * with_payload
    out = dealt.mapInArrow(run, schema)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, keep the index as a table beside the archives, and read every record back."""
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")
    index = settled(write_archives(pages, folder), "warc-index")
    return read_records(index, folder)
