r"""WARC archives in Zstandard frames with a shared dictionary (operator 5).

*Writing.* Pages become WARC/1.1 records; of pages with one payload (100 bytes and
more) the smallest id is the response and the others revisit it.  Records are dealt
over archives of at most ``ARCHIVE_RECORDS`` records; payloads of more than ``LARGE``
bytes go to archives of their own, with as many records as keep ``ARCHIVE_BYTES`` of
payload however long they are.  The dictionary is trained on the first ``SAMPLE_BYTES``
bytes of at most ``SAMPLE_ROWS`` payloads; what is read back does not depend on it.  An
archive begins with a
skippable frame (magic 0x184D2A5D) that holds the dictionary, and each record is a
frame of its own.  Spark's text writer puts the frames into files, with an empty
skippable frame between two records as its line separator: so archives land in any
file system Spark writes to, under its commit protocol, and a lost executor's
half-written files never show.

*Reading.* The dictionary is loaded from the leading skippable frame (stored plain
or itself compressed), frames are walked by their block headers, and each record
frame is decoded alone.  The reader checks the version line, the mandatory headers,
the content length against the block, the closing line ends, and the payload's
digest; an archive that fails is named with the offset.

Defined cases: a null html is an empty payload; null ids and urls have no header and
read back as null, and a null id is never the smallest; rows that share the smallest
id are all responses; control bytes in a url are percent-encoded; an empty table
gives no records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MB, hash_sample, new_path

ARCHIVE_RECORDS = 10_000
LARGE = 64 * 1024
ARCHIVE_BYTES = 1 << 30
LEAST_SHARED = 100
DICTIONARY_BYTES = 64 * 1024
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 16 * 1024
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the Zstandard and WARC formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII, so it can be a separator.
SEPARATOR = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "archive string, offset long, record_type string, record_id string, page_id string, url string, refers_to string, payload_bytes long, payload_digest string"


def _record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record(kind: str, page_id: str | None, url: str | None, digest: str, refers_to: str | None, payload: bytes, size: int) -> bytes:
    """One WARC record.  A revisit has an empty block and its payload's length and
    digest in its headers."""
    block = b"" if kind == "revisit" else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {size}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; ``ValueError`` where it breaks the format."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of headers")
    lines = head.decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC version: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name} header")
    if not fields["content-length"].isdigit():
        raise ValueError("content length is not a number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"content length {length} does not fit {len(rest)} bytes")
    kind, payload = fields["warc-type"], rest[:length]
    digest = fields.get("warc-payload-digest", "")
    algorithm, _, value = digest.partition(":")
    if kind == "response":
        own = hashlib.sha256(payload).hexdigest()
        if algorithm == "sha256" and value != own:
            raise ValueError("payload digest does not match")
        value, size = own, length
    elif kind == "revisit":
        if "warc-refers-to" not in fields or algorithm != "sha256" or not fields.get("x-payload-length", "").isdigit():
            raise ValueError("a revisit names no payload")
        size = int(fields["x-payload-length"])
    else:
        value, size = value or None, length
    return {
        "record_type": kind,
        "record_id": fields["warc-record-id"],
        "page_id": fields.get("x-page-id"),
        "url": fields.get("warc-target-uri"),
        "refers_to": fields.get("x-refers-to-page-id"),
        "payload_bytes": size,
        "payload_digest": value,
        "payload": payload,
    }


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at ``at``, from its header and block headers."""
    import zstandard

    head = bytes(data[at : at + 18])
    checksum = bool(head[4] & 4) if len(head) > 4 else False
    end = at + zstandard.frame_header_size(head)
    while True:
        if end + 3 > len(data):
            raise ValueError("a frame is cut short")
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * checksum
    if end > len(data):
        raise ValueError("a frame is cut short")
    return end - at


def read_archive(data: bytes) -> Iterator[tuple[int, bytes]]:
    """``(offset, record bytes)`` of an archive's record frames."""
    import zstandard

    view, at, decoder = memoryview(data), 0, None
    while at < len(view):
        if at + 8 > len(view):
            raise ValueError(f"offset {at}: a frame is cut short")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise ValueError(f"offset {at}: a skippable frame is cut short")
            if at == 0 and magic == DICTIONARY_MAGIC:
                held = bytes(view[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = zstandard.ZstdDecompressor().decompress(held)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"offset {at}: neither a frame nor a skippable frame")
        if decoder is None:
            raise ValueError("no dictionary in a leading skippable frame")
        try:
            length = frame_length(view, at)
            yield at, decoder.decompressobj().decompress(view[at : at + length])
        except (zstandard.ZstdError, ValueError) as e:
            raise ValueError(f"offset {at}: {e}") from e
        at += length


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        plain = b"".join(samples)[-DICTIONARY_BYTES:]
        return plain + record("response", "0", "https://", "0" * 64, None, b"", 0)


def _frames(dictionary: bytes, records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        count = 0  # the text writer begins a new file at the same records
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                out = []
                for kind, page_id, url, digest, refers_to, payload, size in zip(*(batch.column(i).slice(s, 256).to_pylist() for i in range(7))):
                    # The reader walks frames, so a separator inside one does no harm.
                    frame = encoder.compress(record(kind, page_id, url, digest, refers_to, payload, size))
                    out.append(frame if count % records else lead + frame)
                    count += 1
                yield pa.record_batch([pa.array(out, pa.binary())], names=["frame"])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as archives into the folder ``path``."""
    base = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload"))
    least = base.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("id").alias("least"))
    rows = base.join(least, "digest", "left")
    again = F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))
    rows = rows.select(
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.col("id").cast("string").alias("page_id"),
        "url",
        "digest",
        F.when(again, F.col("least")).cast("string").alias("refers_to"),
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        "size",
    )
    picked = hash_sample(base.select("digest", "id"), ["digest", "id"], SAMPLE_ROWS, 1).select("digest").distinct()
    samples = base.join(F.broadcast(picked), "digest", "left_semi").dropDuplicates(["digest"])
    samples = samples.select("digest", F.substring("payload", 1, SAMPLE_BYTES).alias("start")).collect()
    dictionary = make_dictionary([bytes(r["start"]) for r in sorted(samples, key=lambda r: r["digest"])])
    longest = pages.agg(F.max(F.octet_length(F.col(html_col).cast("string"))).alias("n")).first()["n"] or 0
    parts = [(rows.where(F.col("size") <= LARGE), ARCHIVE_RECORDS)]
    if longest > LARGE:
        parts.append((rows.where(F.col("size") > LARGE), min(ARCHIVE_RECORDS, max(1, ARCHIVE_BYTES // longest))))
    for part, records in parts:
        frames = part.mapInArrow(_frames(dictionary, records), "frame binary").select(F.col("frame").cast("string").alias("frame"))
        frames.write.mode("append").option("lineSep", SEPARATOR).option("maxRecordsPerFile", records).text(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives under ``path``; with their payloads if asked."""
    names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), *[pa.binary()] * payload]

        def out(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                try:
                    for offset, raw in read_archive(content.as_buffer()):
                        found = {"archive": archive, "offset": offset, **parse_record(raw)}
                        rows.append([found[n] for n in names])
                        size += len(raw) if payload else 300
                        if size > 4 * MB:
                            yield out(rows)
                            rows, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{archive}: {e}") from e
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD + ", payload binary" * payload)


def archived(pages: DataFrame, id_col: str = "page_id", path: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back: a row per record, ids in their own type."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, id_col)
    kind = pages.schema[id_col].dataType
    found = read_archives(spark, path)
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
