"""WARC: a deterministic sharded writer of web pages, and a reader."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import choose, new_path, stage

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Bytes of payload in a shard, and compressed bytes at which a shard goes on in the next file.
SHARD, ROLL = 32 << 20, 16 << 20
#: Most shards; beyond them shards grow.
SHARDS = 1 << 16
#: All records carry this date, as the tables have none.
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
_CRLF = "\r\n"


def _store(path: str):
    """The file system of a URI, and the path in it. Works for local and object stores that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_id(page: str, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}/{nth}')}>"


def _clean(value: str) -> str:
    """One line for a header; line ends in urls are spelled out."""
    return value.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def record(page: str | None, url: str | None, payload: bytes, digest: str, nth: int, refers: tuple[str | None, str] | None) -> bytes:
    """One record, compressed on its own. refers: the page that is revisited and its record id."""
    http = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(payload)}{_CRLF}{_CRLF}".encode()
    block = http if refers else http + payload
    name = "null" if page is None else page
    headers = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id(name, digest, nth)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _clean(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers[1])] if refers else []),
        *([("Page-Refers-To", quote(refers[0]))] if refers and refers[0] is not None else []),
        *([("Page-ID", quote(page))] if page is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = f"WARC/1.1{_CRLF}" + "".join(f"{k}: {v}{_CRLF}" for k, v in headers) + _CRLF
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)  # 31: with a gzip header, whose time stays 0
    return gz.compress(head.encode() + block + b"\r\n\r\n") + gz.flush()


def plan(pages: DataFrame, shard: int, page_id: str = "page_id", html: str = "html") -> tuple[DataFrame, list]:
    """keep per page, and the first page of each shard.

    Pages in order of id are cut where the payload so far passes a multiple of
    the shard size. The cuts depend on the table alone, not on partitions.
    """
    data = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    known = (F.col(page_id).alias("page_id"), F.col(page_id).isNull().alias("_none"))
    rows = stage(pages.select(*known, F.sha2(data, 256).alias("digest"), F.length(data).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("_n")), "pages")
    kept = choose(rows.where(F.col("bytes") >= LEAST), "digest", ("_none", "page_id", "_n"), largest=False, every=False)
    revisits = kept.where(~F.col("first")).select("page_id", "digest", F.col("keep.page_id").alias("refers_to"))
    return revisits, _cuts(rows, shard)


def _cuts(rows: DataFrame, shard: int) -> list:
    """First page_id of each shard but the first, by exact prefix sums of bytes in order of id."""
    sizes = rows.where("page_id is not null").groupBy("page_id").agg(F.sum("bytes").alias("bytes"))
    ordered = stage(sizes.repartitionByRange("page_id").withColumn("part", F.spark_partition_id()), "sizes")
    parts = sorted(ordered.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.min("page_id").alias("lo")).collect(), key=lambda r: r["lo"])
    total = sum(r["bytes"] for r in parts)
    shard = max(shard, -(-total // SHARDS))
    before, at = {}, 0
    for r in parts:
        before[r["part"]] = at
        at += r["bytes"]
    if not parts:
        return []
    spark = rows.sparkSession
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "part int, before long"))
    upto = Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = ordered.join(starts, "part").withColumn("at", F.col("before") + F.sum("bytes").over(upto) - F.col("bytes"))
    firsts = begins.groupBy(F.expr(f"at div {shard}").alias("shard")).agg(F.min("page_id").alias("page_id"))
    return sorted(r["page_id"] for r in firsts.where("shard > 0").collect())  # at most SHARDS rows


def write(pages: DataFrame, path: str, shard: int = SHARD, roll: int = ROLL, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per page under `path` and returns the manifest: file, records, bytes, sha256.

    Pages are sorted by id, then digest, and cut into shards by exact prefix
    sums; a shard rolls to a further file when one has `roll` compressed
    bytes. So equal tables give equal files, whatever the partitions. Tasks
    write under temporary names of their own; only files that a finished task
    reports are renamed, and the manifest is written last. A task that runs
    again, or a commit that is repeated, changes nothing.

    Of equal payloads of at least 100 bytes the page with the smallest id is
    the response and the others revisit it; of repeated rows of that page one
    is. Null html counts as empty, null urls are left out. Pages without an id
    sort first and are responses only among themselves. Other columns are
    ignored; an empty table gives no files.
    """
    spark = pages.sparkSession
    revisits, cuts = plan(pages, shard, page_id, html)
    kind = pages.schema[page_id].dataType.simpleString()
    temporary = f"{path}/_temporary/{uuid.uuid4().hex}"

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bounds = np.array(cuts)
        for b in batches:
            ids = b.column(0)
            filled = ids.fill_null(cuts[0] if cuts else 0).to_numpy(zero_copy_only=False)
            number = np.searchsorted(bounds, filled, "right") if len(cuts) else np.zeros(b.num_rows, np.int64)
            number = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64())], [*b.schema.names, "shard"])

    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
        F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast(kind).alias("refers_to"),
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    # A marker precedes its page's rows, so the payloads are shuffled once and joined with nothing.
    markers = revisits.groupBy("page_id", "digest", "refers_to").count().select(
        "page_id", F.col("count").cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to"
    )
    fields = f"page_id {kind}, url string, html string, digest string, refers_to {kind}"
    sharded = rows.select("page_id", "url", "html", "digest", "refers_to").unionByName(markers).mapInArrow(placed, fields + ", shard long")
    # A task for each shard.
    ordered = sharded.repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", F.col("html").isNotNull(), "html", "url")

    def written(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        store, folder = _store(temporary)
        store.create_dir(folder, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, done, now, part = None, [], None, 0
        name, records, size, sha = "", 0, 0, None
        key, nth, marks, refers = None, 0, 0, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{attempt}-{name}", name, records, size, sha.hexdigest()))
                out = None

        for b in batches:
            for k in range(0, b.num_rows, 64):
                for r in b.slice(k, 64).to_pylist():
                    if (r["page_id"], r["digest"]) != key:
                        key, nth, marks, refers = (r["page_id"], r["digest"]), 0, 0, None
                    if r["html"] is None:
                        marks, refers = int(r["url"]), r["refers_to"]
                        continue
                    if r["shard"] != now:
                        close()
                        now, part = r["shard"], 0
                    if out is None:
                        name, records, size, sha = f"pages-{now:06d}-{part:05d}.warc.gz", 0, 0, hashlib.sha256()
                        out = store.open_output_stream(f"{folder}/{attempt}-{name}", compression=None)
                        part += 1
                    page = None if r["page_id"] is None else str(r["page_id"])
                    target = None if refers is None else str(refers)
                    # If this page holds the response, its first row is that; its other rows revisit it.
                    revisit = marks and (target != page or nth > 0)
                    to = (target, record_id("null" if target is None else target, r["digest"], 0)) if revisit else None
                    data = record(page, r["url"], r["html"].encode(), r["digest"], nth, to)
                    nth += 1
                    out.write(data)
                    sha.update(data)
                    records, size = records + 1, size + len(data)
                    if size >= roll:
                        close()
        close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["temporary", "file", "records", "bytes", "sha256"])

    files = stage(ordered.mapInArrow(written, "temporary string, file string, records long, bytes long, sha256 string"), "files")

    def committed(batches: Iterator) -> Iterator:
        from pyarrow import fs

        store, folder = _store(path)
        _, hidden = _store(temporary)
        for b in batches:
            for r in b.to_pylist():
                if store.get_file_info(f"{hidden}/{r['temporary']}").type != fs.FileType.NotFound:
                    store.move(f"{hidden}/{r['temporary']}", f"{folder}/{r['file']}")
            yield b.select(["file", "records", "bytes", "sha256"])

    manifest = stage(files.mapInArrow(committed, "file string, records long, bytes long, sha256 string"), "manifest")
    store, hidden = _store(temporary)
    if store.get_file_info(hidden).type.name == "Directory":
        store.delete_dir(hidden)  # what failed attempts left
    manifest.coalesce(1).sortWithinPartitions("file").write.mode("overwrite").json(f"{path}/_manifest")
    return manifest


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives that the manifest under `path` lists, or none if it lists none.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to and
    the html (null for a revisit). Files are read as streams, record by
    record; a response's digest and length are computed from its payload, and
    a file or record that doesn't agree with what is stated is an error.
    """
    fields = "file string, records long, bytes long, sha256 string"
    files = spark.read.schema(fields).json(f"{path}/_manifest")
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string"

    def parsed(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        store, folder = _store(path)
        for b in batches:
            for f in b.to_pylist():
                rows, held, count = [], 0, 0
                with store.open_input_stream(f"{folder}/{f['file']}", compression=None) as stream:
                    for head, block in records(stream):
                        http, _, body = block.partition(b"\r\n\r\n")
                        stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        length = int(dict(x.split(": ", 1) for x in http.decode().split(_CRLF)[1:])["Content-Length"])
                        response = head["WARC-Type"] == "response"
                        if response and (hashlib.sha256(body).hexdigest() != stated or len(body) != length):
                            raise ValueError(f"{f['file']}: record {head['WARC-Record-ID']} is damaged")
                        page, to = ((v if (v := head.get(h)) is None else unquote(v)) for h in ("Page-ID", "Page-Refers-To"))
                        rows.append((page, head.get("WARC-Target-URI"), length, stated, head["WARC-Type"], to, body.decode() if response else None))
                        count, held = count + 1, held + len(block)
                        if held > 1 << 20:
                            yield _batch(pa, rows)
                            rows, held = [], 0
                if count != f["records"]:
                    raise ValueError(f"{f['file']}: {count} records of {f['records']}")
                if rows:
                    yield _batch(pa, rows)

    spread = files.repartition(max(1, min(files.count(), 4096)), "file")
    return spread.mapInArrow(parsed, schema)


def _batch(pa, rows: list[tuple]):
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream with a member per record."""
    gz, data, rest = zlib.decompressobj(31), bytearray(), b""
    while True:
        raw = rest or stream.read(1 << 18)
        if not raw:
            if data:
                raise ValueError("the archive ends inside a record")
            return
        data += gz.decompress(raw)
        rest = b""
        if gz.eof:
            rest, gz = gz.unused_data, zlib.decompressobj(31)
            head, _, block = bytes(data).partition(b"\r\n\r\n")
            lines = head.decode().split(_CRLF)
            headers = dict(x.split(": ", 1) for x in lines[1:])
            length = int(headers["Content-Length"])
            if not lines[0].startswith("WARC/") or block[length:] != b"\r\n\r\n":
                raise ValueError("malformed record")
            yield headers, block[:length]
            data = bytearray()


def round_trip(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Writes pages to archives in the shared folder, reads these and returns what they say of each page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, page_id=page_id)
    kind = pages.schema[page_id].dataType.simpleString()
    return read(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
