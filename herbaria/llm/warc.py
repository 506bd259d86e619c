"""WARC archives compressed with Zstandard: writer and reader.

An archive begins with a skippable frame that holds a dictionary; then each
record is one Zstandard frame made with that dictionary. The reader loads the
dictionary from the leading frame, decodes one frame per record, and checks the
headers and lengths. Archives are files in one folder, written by tasks (a
temporary name, then a rename, so a task that runs again leaves whole files)
and read with Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herbaria.llm.common import cut, small_batches, with_row_key

#: Frame numbers of the format.
SKIPPABLE_DICTIONARY = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"

MIN_REVISIT = 100
#: Payload bytes after which a task closes an archive; one record always fits whole.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
ISO_DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("row_key long, page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
          "record_type string, refers_to long, refers_row long, archive string")


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def _header_value(text: str | None) -> str:
    """A URL as a header value: control characters cannot stand in a header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in text or "")


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record; a revisit has no block, its header keeps the full payload's length and
    names its response by that record's WARC-Record-ID, as any reader expects, and by its page."""
    body = b"" if row["record_type"] == "revisit" else row["payload"]
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:x-row:{row['row_key']}>"), ("WARC-Date", ISO_DATE)]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _header_value(row["url"])))
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", str(row["page_id"])))
    fields += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("X-Payload-Length", str(row["payload_bytes"]))]
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:x-row:{row['refers_row']}>"),
                   ("X-Refers-To-Page", str(row["refers_to"]))]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8") + body + b"\r\n\r\n"


def archive_bytes(records: list[bytes]) -> bytes:
    """Dictionary in a skippable frame, then one frame per record."""
    samples = [r[:DICTIONARY_BYTES] for r in records]
    try:
        trained = zstd.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=3).as_bytes()
    except zstd.ZstdError:  # too little to train on: an empty dictionary frame
        trained = b""
    zdict = zstd.ZstdCompressionDict(trained) if trained else None
    packer = zstd.ZstdCompressor(level=3, dict_data=zdict, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE_DICTIONARY, len(trained)), trained, *map(packer.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """Decoded records of one archive, one frame each."""
    view = memoryview(data)
    if len(view) < 8:
        raise WarcError("no leading dictionary frame")
    magic, size = struct.unpack_from("<II", view)
    if magic != SKIPPABLE_DICTIONARY or 8 + size > len(view):
        raise WarcError("no whole dictionary in the leading skippable frame")
    raw = bytes(view[8:8 + size])
    if raw[:4] == FRAME:
        raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
    if raw and raw[:4] != DICTIONARY:
        raise WarcError("the leading frame holds no dictionary")
    unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw)) if raw else zstd.ZstdDecompressor()
    at = 8 + size
    while at < len(view):
        if bytes(view[at:at + 4]) != FRAME:
            raise WarcError(f"no frame at byte {at}")
        frame = unpacker.decompressobj()
        step, out, end = 1 << 16, [], at
        while not frame.eof:
            if end >= len(view):
                raise WarcError(f"frame at byte {at} is cut off")
            out.append(frame.decompress(view[end:end + step]))
            end = min(end + step, len(view))
        at = end - len(frame.unused_data)
        yield b"".join(out)


def parse_record(data: bytes) -> dict:
    """Check one record and take it apart."""
    cut_at = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.1\r\n") or cut_at < 0:
        raise WarcError("no WARC header")
    fields = {}
    for line in data[10:cut_at].decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(": ")
        if not colon:
            raise WarcError(f"header line without a value: {line!r}")
        fields[name] = value
    try:
        kind, length, full = fields["WARC-Type"], int(fields["Content-Length"]), int(fields["X-Payload-Length"])
        algorithm, _, digest = fields["WARC-Payload-Digest"].partition(":")
        key = int(fields["WARC-Record-ID"].removeprefix("<urn:x-row:").removesuffix(">"))
    except (KeyError, ValueError) as e:
        raise WarcError(f"header is missing or wrong: {e}") from e
    body = data[cut_at + 4:-4]
    if not data.endswith(b"\r\n\r\n") or len(body) != length or cut_at + 8 + length != len(data):
        raise WarcError(f"block has {len(body)} bytes, header says {length}")
    if algorithm != "sha256" or kind not in ("response", "revisit"):
        raise WarcError(f"unknown digest or type: {algorithm}, {kind}")
    if kind == "response" and (full != length or hashlib.sha256(body).hexdigest() != digest):
        raise WarcError("payload does not match its length or digest")
    refers, page = fields.get("WARC-Refers-To"), fields.get("X-Refers-To-Page")
    if (kind == "revisit") != (refers is not None) or kind == "revisit" and length:
        raise WarcError("a revisit names its response and has no block")
    return {"row_key": key, "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
            "url": fields.get("WARC-Target-URI"), "payload": body if kind == "response" else None, "payload_bytes": full,
            "payload_digest": digest, "record_type": kind,
            "refers_to": int(page) if page else None,
            "refers_row": int(refers.removeprefix("<urn:x-row:").removesuffix(">")) if refers else None}


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def plan_records(pages: DataFrame) -> DataFrame:
    """Payload, digest, type and response of every page.

    Null html is the empty payload. Of equal payloads of at least ``MIN_REVISIT``
    bytes the rows with the smallest page_id are responses, others revisits; rows
    without an id are responses only if no equal payload has an id. Digests are
    counted with partial aggregation; only repeated digests enter the join.
    """
    sized = with_row_key(pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")), "row_key")
    sized = sized.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = (sized.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy(F.col("payload_digest").alias("_digest"))
             .agg(F.min("page_id").alias("first_id"), F.min_by("row_key", "page_id").alias("first_row"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    named = sized.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return named.withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"),
        "refers_to": F.when(again, F.col("first_id")), "refers_row": F.when(again, F.col("first_row"))}).drop("_digest", "first_id", "first_row")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per page to Zstandard archives in ``folder``; returns (archive, n_records).

    A record longer than ``ARCHIVE_BYTES`` makes an archive of its own; repeated rows
    are records each; an empty table makes no archive."""
    small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        fs, root = _filesystem(folder)

        def close() -> pa.RecordBatch:
            nonlocal held, size
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/_{name}.tmp") as out:  # names with _ are not read
                out.write(archive_bytes(held))
            fs.move(f"{root}/_{name}.tmp", f"{root}/{name}")
            done = pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(held)]})
            held, size = [], 0
            return done

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record_bytes(row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    _filesystem_on_driver(pages.sparkSession, folder)
    return plan_records(pages).mapInArrow(write, "archive string, n_records long")


def _filesystem_on_driver(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Records of the archives that ``manifest`` (archive, n_records) names.

    An archive that a lost or repeated task left behind is not in the manifest
    and is not read; a broken one raises ``WarcError``.
    """
    small_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, want in zip(*(batch.column(c) for c in ("archive", "content", "n_records"))):
                rows, seen = [], 0
                for record in read_archive(data.as_py()):
                    rows.append(parse_record(record) | {"archive": name.as_py()})
                    seen += 1
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows = []
                if seen != want.as_py():
                    raise WarcError(f"{name.as_py()}: {seen} records, manifest says {want.as_py()}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return named.join(manifest, "archive").mapInArrow(read, RECORD)


_SCHEMA = pa.schema([("row_key", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("refers_row", pa.int64()), ("archive", pa.string())])


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` and read the records back.

    One row per page, repeated rows each; a null html is the empty payload, a payload
    of any length is one record; columns other than page_id, url and html are left
    out; an empty table gives no archive and no rows.
    """
    manifest = cut(write_warc(pages, folder), "manifest")
    if manifest.isEmpty():
        return pages.sparkSession.createDataFrame([], RECORD)
    return read_warc(pages.sparkSession, folder, manifest)
