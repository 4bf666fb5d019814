"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task writes one archive. It trains a dictionary on its first records, puts it (compressed) into a
skippable frame, and writes each record as a frame of its own with content size and checksum. The bytes go out through
Spark's own text writer and committer, so any store Spark writes to will do and a lost executor leaves nothing behind;
the separator that this writer puts after each row is itself an empty skippable frame, so the file is a valid sequence
of frames. Payloads that an earlier record holds are written as revisits without the payload.

Reading: whole archives come in as binary files (they are as large as a task's share of the input, compressed). The
frames' extents are found from their block headers; the dictionary is loaded from the leading skippable frame, plain or
compressed; every frame must hold exactly one record with complete headers, the stated lengths and, for responses, the
stated digest. Records that fail are returned with what is wrong, not dropped.

Defined cases: a null payload is empty; a null page id is a record with an empty id, read back as null, and is never the
one that others refer to unless its whole group has none; rows repeated are records each, and of equal rows with the
largest id each is a response; an empty table makes no records; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Payloads from this size on are written once; records a dictionary is trained on, their bytes read for it, its size.
REVISIT_BYTES, DICT_RECORDS, DICT_SAMPLE, DICT_BYTES, LEVEL = 1000, 96, 8192, 16_384, 3
#: Magic numbers of the Zstandard and WARC-in-Zstandard formats.
FRAME, SKIPPABLE, DICT_SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D, 0xEC30A437
#: An empty skippable frame; all its bytes are ASCII, so it can be the text writer's separator.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "struct<page_id:bigint,payload_bytes:bigint,payload_digest:string,record_type:string,refers_to:bigint,url:string,payload:binary,error:string>"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; of a revisit the block is the HTTP header alone."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive: the dictionary's, if one can be trained, then one for each record."""
    first = list(islice(records, DICT_RECORDS))
    if not first:
        return
    trained = None
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, [r[:DICT_SAMPLE] for r in first])
    except zstandard.ZstdError:  # too few or too small samples: an archive without a dictionary
        pass
    if trained is not None:
        raw = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        yield struct.pack("<II", DICT_SKIPPABLE, len(raw)) + raw
        trained.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
    for r in first:
        yield packer.compress(r)
    for r in records:
        yield packer.compress(r)


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """(magic, begin, end) of all frames of an archive, found from their headers alone."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("cut off within a frame's header")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME:
            end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
            last = 0
            while not last:
                if end + 3 > len(data):
                    raise ValueError("cut off within a frame")
                head = int.from_bytes(data[end : end + 3], "little")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * zstandard.get_frame_parameters(bytes(data[at : at + 18])).has_checksum
        else:
            raise ValueError(f"no frame at byte {at}")
        if end > len(data):
            raise ValueError("cut off within a frame")
        yield magic, at, end
        at = end


def parsed(data: bytes) -> dict:
    """A record's fields; ValueError where headers or lengths are wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in field:
            raise ValueError(f"no {name}")
    if len(field) != len(lines) or not field["content-length"].isdigit():
        raise ValueError("a header twice or a length that is none")
    size = int(field["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is not the stated one")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    stated = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or len(stated) != 1 or not stated[0].isdigit():
        raise ValueError("no HTTP header with one length")
    kind, digest = field["warc-type"], field["warc-payload-digest"]
    if kind not in ("response", "revisit") or not digest.startswith("sha1:"):
        raise ValueError("another type of record or digest")
    raw = base64.b32decode(digest[5:])
    if kind == "response" and (len(payload) != int(stated[0]) or hashlib.sha1(payload).digest() != raw):
        raise ValueError("the payload is not the stated one")
    if kind == "revisit" and (payload or "warc-refers-to" not in field):
        raise ValueError("a revisit with a payload or without a reference")
    number = lambda name: int(x) if (x := field.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number("warc-record-id"), "payload_bytes": int(stated[0]), "payload_digest": raw.hex(), "record_type": kind,
        "refers_to": number("warc-refers-to"), "url": field.get("warc-target-uri"), "payload": payload if kind == "response" else None, "error": None,
    }


def records_of(data: bytes) -> Iterator[dict]:
    """The records of an archive; what cannot be read gives a row with its error."""
    view, dictionary = memoryview(data), None
    unpacker = zstandard.ZstdDecompressor()
    try:
        for magic, begin, end in frames(view):
            if magic == DICT_SKIPPABLE and begin == 0:
                raw = bytes(view[8:end])
                if struct.unpack_from("<I", raw)[0] == FRAME:
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                if struct.unpack_from("<I", raw)[0] != DICTIONARY:
                    raise ValueError("the leading frame holds no dictionary")
                dictionary = zstandard.ZstdCompressionDict(raw)
                unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
            if magic != FRAME:
                continue
            try:
                yield parsed(unpacker.decompress(view[begin:end]))
            except (ValueError, zstandard.ZstdError) as e:
                yield {"error": f"record at byte {begin}: {e}"}
    except (ValueError, struct.error, zstandard.ZstdError) as e:
        yield {"error": str(e)}


def write(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` (page_id, url, payload, refers_to, revisit) under ``path``, one for each task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (record(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held, size = [], 0
        for frame in archive(rows):
            held.append(frame)
            size += len(frame)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    asked = pages.select("page_id", F.coalesce("url", F.lit("")), F.col("payload").cast("binary"), "refers_to", "revisit")
    packed = asked.mapInArrow(pack, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "error"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.columns[0]:
                held, size = [], 0
                for r in records_of(content.as_buffer().to_pybytes()):
                    held.append(r)
                    size += len(r.get("payload") or b"") + 200
                    if size >= 4 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    def batch(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in zip(names, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(unpack, RECORD[7:-1].replace(":", " "))


def _digest(payload: Column) -> Column:
    """The digest of a payload that is long enough to be written once; else null."""
    return F.when(F.octet_length(payload) >= REVISIT_BYTES, F.sha1(payload.cast("binary")))


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) for the pages and payloads that another page's record holds, each once."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    each = C.materialize(pages.select("page_id", _digest(payload).alias("digest")).where("digest is not null"), "payloads")
    shared = each.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 and keep is not null")
    shared = C.materialize(shared.select("digest", "keep"), "shared-payloads")
    found = C.attach(each, shared, "digest", C.materialize(C.heavy_keys(each, "digest"), "heavy-payloads"))
    found = found.where("keep is not null and not (page_id <=> keep)")
    return C.materialize(found.select("page_id", "digest", F.col("keep").alias("refers_to")).distinct(), "revisits")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back: all fields of ``read``."""
    again = C.small(marked(pages).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to"))
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    # by id and digest: rows without an id, or repeated with one, may have different payloads
    same = rows["page_id"].eqNullSafe(F.col("__id")) & (_digest(rows["payload"]) == F.col("__digest"))
    rows = rows.join(again, same, "left").select("page_id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    path = C.scratch(pages.sparkSession, "warc")
    write(rows, path)
    return read(pages.sparkSession, path)


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; stops at a record that fails."""
    found = round_trip(pages)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("archive: "), F.col("error"))).cast("bigint")).otherwise(F.col("page_id"))
    return found.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
