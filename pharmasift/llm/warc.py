"""WARC archives: writing records from a table and reading archives back.

Every record is a gzip member of its own. Tasks write one archive each through the file
system of the shared folder, under a name no other attempt uses; the table of finished
archives, which Spark commits, says which files count.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmasift.llm.common import fresh_path, need, stored

#: Equal payloads shorter than this are stored again rather than referred to.
REVISIT_BYTES = 100
READ_BYTES = 256 * 1024
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"


def planned(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for a response).

    Equal payloads are told by SHA-256. The first page of a payload is its smallest id; only
    (digest, id) pairs are grouped, combined before the shuffle.
    """
    need(pages, id, url, html)
    rows = pages.select(
        F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("payload")
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    joined = rows.join(stored(first, "first-pages"), "digest", "left")  # a hot digest's pages can be split
    # a row without id cannot be the smallest, so it revisits; rows that repeat the smallest id stay responses
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def header_uri(url: str) -> str:
    """The URL as it is, but for blanks, control and other characters that no header may hold: these are percent-encoded."""
    return "".join(c if "!" <= c <= "~" else urllib.parse.quote(c) for c in url)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One uncompressed record: response with the whole payload, or revisit without it.

    The block is an HTTP message whose Content-Length is that of the full payload.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", header_uri(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    fields.append(("Content-Length", str(len(block))))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(plan: DataFrame, folder: str) -> DataFrame:
    """Writes the planned records; returns the stored table of archives (path, records)."""

    def archive(batches):
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        store, inner = _file_system(name)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        records = 0
        with store.open_output_stream(inner, compression=None) as out:
            for batch in batches:
                page, url, payload, digest, refers = batch.columns
                payload = payload.cast(pa.binary())
                for i in range(batch.num_rows):
                    data = record_bytes(page[i].as_py(), url[i].as_py(), payload[i].as_py(), digest[i].as_py(), refers[i].as_py())
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(pack.compress(data))
                    out.write(pack.flush())
                    records += 1
        if records:
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([records], pa.int64())})
        else:
            store.delete_file(inner)

    return stored(plan.mapInArrow(archive, "path string, records long"), "archives")


class Damaged(ValueError):
    """An archive that is cut off, or whose lengths don't fit."""


def members(chunks: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The decompressed bytes of each gzip member in turn, in pieces of bounded size."""
    rest, ended = b"", False

    def more() -> bool:
        nonlocal rest, ended
        while not rest and not ended:
            rest = next(chunks, b"")
            ended = not rest
        return bool(rest)

    while more():
        unpack = zlib.decompressobj(31)

        def body(unpack=unpack):
            nonlocal rest
            held = False  # whether the last call may have left output behind
            while not unpack.eof:
                if not held and not more():
                    raise Damaged("the last member is cut off")
                out = unpack.decompress(rest, READ_BYTES)
                held = len(out) == READ_BYTES
                rest = unpack.unconsumed_tail or unpack.unused_data
                if out:
                    yield out

        part = body()
        yield part
        for _ in part:  # what the caller left
            pass


class Framed:
    """Lines and counted bytes of a stream of pieces."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, b""

    def line(self) -> bytes:
        while b"\r\n" not in self.held:
            part = next(self.parts, None)
            if part is None:
                raise Damaged("a header has no end")
            self.held += part
        line, _, self.held = self.held.partition(b"\r\n")
        return line

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = next(self.parts, b"")
                if not self.held:
                    raise Damaged(f"{n} bytes are missing")
            got, self.held = self.held[:n], self.held[n:]
            n -= len(got)
            yield got

    def header(self) -> dict[str, str]:
        fields = {}
        while line := self.line():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        return fields


def read_record(parts: Iterator[bytes]) -> dict:
    """One record: framed by its lengths, digests computed over the pieces as they come."""
    stream = Framed(parts)
    if stream.line() != VERSION:
        raise Damaged("no WARC record")
    warc = stream.header()
    block, whole = hashlib.sha256(), Framed(stream.take(int(warc["content-length"])))
    pieces = whole.parts

    def seen():
        for piece in pieces:
            block.update(piece)
            yield piece

    whole.parts = seen()
    whole.line()
    http = whole.header()
    declared = int(http["content-length"])
    payload, got = hashlib.sha256(), 0
    revisit = warc["warc-type"] == "revisit"
    for piece in () if revisit else whole.take(declared):
        payload.update(piece)
        got += len(piece)
    if next(whole.parts, None) or whole.held or b"".join(stream.take(4)) != b"\r\n\r\n":
        raise Damaged("a record is longer than it says")
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    page, refers = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
    uri = warc.get("warc-target-uri")
    return {
        "page_id": None if page is None else int(page),
        "url": uri,
        "payload_bytes": declared,
        "payload_digest": digest if revisit else payload.hexdigest(),
        "record_type": warc["warc-type"],
        "refers_to": None if refers is None else int(refers),
        "verified": warc["warc-block-digest"] == f"sha256:{block.hexdigest()}" and (revisit or payload.hexdigest() == digest),
    }


def read(archives: DataFrame) -> DataFrame:
    """One row per record of the archives (column path), in one sequential pass each.

    Memory holds one piece of a member, never a whole record. `verified` says whether block and
    payload digests agree; a cut or misframed archive raises `Damaged`.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

    def records(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = _file_system(path)
                with store.open_input_stream(inner, compression=None) as source:
                    found = []
                    for parts in members(iter(lambda: source.read(READ_BYTES), b"")):
                        found.append(read_record(parts))
                        if len(found) == 1000:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found = []
                    yield pa.RecordBatch.from_pylist(found, schema)

    tasks = max(1, archives.count())  # an archive is read by one task
    dealt = archives.select("path").repartitionByRange(tasks, "path")
    return dealt.mapInArrow(records, RECORD).select(*names)


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Pages to archives and back: one row per page, as read from its record.

    Null html is an empty payload, null url is left out, a null id stays null. Rows that
    repeat an id are records of their own; those that share the smallest id of a payload are
    all responses. An empty table writes no archive.
    """
    spark: SparkSession = pages.sparkSession
    return read(write(planned(pages, id, url, html), folder or fresh_path(spark, "warc")))
