"""Web archives packed in ZIP files, and their reader.

The writer stores WARC records in ZIP members that are not compressed, next to an index of
them.  Of records with equal payloads that with the smallest id is a response; the others
are revisits that refer to it and carry no payload.  The reader finds the central directory
from the end of the file, in the old form or as ZIP64, locates the stored members and the
indexes, and fetches runs of records by their range; nothing is extracted.  A member
without an index is read through from its start.

A null payload is empty.  Rows without an id are records without an id, never the first of
others that have one.  Of rows that agree in id and payload one is the first.  An empty
table gives no archive.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.llm.common import LAST_ID, Scratch
from cashtide.llm.files import listed, new_file, open_range

#: Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the time of capture is not known
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
RUN_BYTES = 4 << 20  # records are fetched in runs of about this size
#: Rows of shared payloads (an id and two digests each) that are broadcast; beyond, payloads are shuffled.
MOST_BROADCAST = 300_000
DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"

READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the head of the response, which tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    lines += [f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{'' if first is None else first}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def _urn(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_records(raw: bytes) -> Iterator[dict]:
    """The records in bytes that start and end at records; a wrong digest is an error."""
    at = 0
    while at < len(raw):
        split = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:split].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        body = raw[split + 4 : split + 4 + int(head["Content-Length"])]
        at = split + 4 + len(body) + 4
        http, _, payload = body.partition(b"\r\n\r\n")
        length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != length or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
        yield {
            "page_id": _urn(head["WARC-Record-ID"]),
            "payload_bytes": length,
            "payload_digest": digest,
            "record_type": head["WARC-Type"],
            "refers_to": _urn(head["WARC-Refers-To"]) if revisit else None,
            "url": head["WARC-Target-URI"],
            "payload": None if revisit else payload,
        }


def stored_members(file, size: int) -> dict[str, tuple[int, int]]:
    """Where the bytes of each member that is stored as it is lie: offset and length."""

    def read(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(EOCD)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        mark, _, where, _ = struct.unpack("<4sIQI", read(tail_at + at - 20, 20))
        if mark != LOCATOR64:
            raise ValueError("no locator of the ZIP64 directory")
        end = read(where, 56)
        if end[:4] != EOCD64:
            raise ValueError("no ZIP64 directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, found, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, packed, whole, name_n, extra_n, note_n, offset = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        at += 46 + name_n + extra_n + note_n
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # the wide values of the fields that are full, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        if method == 0:
            local = read(offset, 30)
            if local[:4] != LOCAL:
                raise ValueError(f"no member at byte {offset}")
            found[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return found


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Write a record per row into archives below ``folder``; returns path and records of each.

    Payloads meet by digest without their bytes: the first id of each is a map-side minimum,
    kept only where several rows share it, and is joined back to ids alone, where a hot
    digest can be split.  What comes of that goes to the rows where they are, if it is
    counted and small, and each task that reads pages writes an archive; only rows that
    repeat an id and its payload are brought together.  If it is large, the payloads are
    shuffled once, to the archives.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    rows = rows.withColumn("place", F.coalesce("page_id", F.lit(LAST_ID)))
    keyed = rows.filter(F.length("payload") >= min_bytes).select("place", "sha1")
    shared = scratch.store(
        keyed.groupBy("sha1").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    later = keyed.join(shared, "sha1").groupBy("place", "sha1").agg(F.min("first").alias("first"), (F.count("*") > 1).alias("again"))
    later = scratch.store(later)
    known, again = later.agg(F.count("*"), F.bool_or("again")).first()

    def told(rows: DataFrame, by: DataFrame) -> DataFrame:
        columns = ["page_id", "url", "payload", "sha1"]
        first = [F.nullif("first", F.lit(LAST_ID)).alias("first"), F.col("first").isNotNull().alias("shared")]
        return rows.join(by, ["place", "sha1"], "left").select(*columns, *first, F.coalesce("again", F.lit(False)).alias("again"))

    def together(rows: DataFrame) -> DataFrame:
        """Rows that agree in id and payload, one after the other in one task."""
        return rows.sortWithinPartitions("page_id", "sha1", "url").drop("again")

    if known <= MOST_BROADCAST:
        found = told(rows, F.broadcast(later))
        joined = found.filter("not again").drop("again")
        if again:
            joined = joined.unionByName(together(found.filter("again").repartition("page_id", "sha1")))
    else:
        joined = together(told(rows.repartition("place", "sha1"), later))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.wacz"
        index, at, last = [], 0, None
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        with new_file(path) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as archive:
            with archive.open(DATA, "w", force_zip64=True) as data:
                while batch is not None:
                    for row in batch.to_pylist():
                        key = (row["page_id"], row["sha1"])
                        revisit = row["shared"] and (row["page_id"] != row["first"] or key == last)
                        last = key
                        digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                        raw = record(row["page_id"], row["url"], row["payload"], digest, row["first"], revisit)
                        data.write(raw)
                        index.append(f"{'' if row['page_id'] is None else row['page_id']} {json.dumps({'offset': at, 'length': len(raw)})}")
                        at += len(raw)
                    batch = next(batches, None)
            with archive.open(INDEX, "w", force_zip64=True) as out:
                out.write("\n".join(index).encode())
        yield pa.RecordBatch.from_pylist([{"path": path, "n_records": len(index)}])

    return scratch.store(joined.mapInArrow(write, "path string, n_records bigint"))


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives: ``page_id``, ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to`` (and ``url`` and ``payload``, null for revisits)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = []
                with open_range(path) as file:
                    members = stored_members(file, size)
                    for name, (offset, length) in sorted(members.items()):
                        if not name.startswith("archive/"):
                            continue
                        index = members.get(INDEX) if name == DATA else None
                        if index is None:
                            found.append((offset, length))
                            continue
                        file.seek(index[0])
                        for line in file.read(index[1]).decode().splitlines():
                            place = json.loads(line.split(" ", 1)[1])
                            a, n = offset + place["offset"], place["length"]
                            if found and found[-1][0] + found[-1][1] == a and found[-1][1] + n <= RUN_BYTES:
                                found[-1] = (found[-1][0], found[-1][1] + n)
                            else:
                                found.append((a, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(found), pa.string()),
                        pa.array([a for a, _ in found], pa.int64()),
                        pa.array([n for _, n in found], pa.int64()),
                    ],
                    ["path", "offset", "length"],
                )

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if with_payload:
        names, kinds = [*names, "url", "payload"], [*kinds, pa.string(), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_range(row["path"]) as file:
                    file.seek(row["offset"])
                    found = list(parse_records(file.read(row["length"])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names
                )

    places = listed(spark, folder, "*.wacz").mapInArrow(runs, "path string, offset bigint, length bigint")
    schema = READ + ", url string, payload binary" * with_payload
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few bytes a run would be coalesced
    return places.repartition(tasks, "path", "offset").mapInArrow(parse, schema)
