"""WARC archives under Zstandard with a dictionary: one frame for each record, the dictionary in a leading skippable frame.

An archive is one row (name, content), a few megabytes long, whether it was written here or read with Spark's
binaryFile source. Spark has no sink for raw binary files; ``export`` puts them where executors can open a path.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

SKIPPABLE = 0x184D2A5D  # magic number of the frame that holds the dictionary
SKIPPABLES = range(0x184D2A50, 0x184D2A60)  # all that Zstandard lets a reader step over
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
CRLF = b"\r\n"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 8 << 20  # of payload; a longer record is an archive of its own
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
RECORD = "name string, offset bigint, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary, error string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """Header values are one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", "2024-01-01T00:00:00Z"), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in head).encode() + CRLF + block + CRLF + CRLF


def page_record(record_id: str, url: str, payload: bytes, digest: str, first: str | None) -> bytes:
    """A response; or, if ``first`` names the record with the same payload, a revisit of it, without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is None:
        return _record("response", record_id, fields, http + payload)
    return _record("revisit", record_id, [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", first)], http)


def pack(records: list[bytes], level: int = 3) -> bytes:
    """One archive. The dictionary is trained on the first records; too few or too alike: none."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r)
        size += len(r)
    lead, dictionary = b"", None
    if len(sample) >= 16:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=level)
            content = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
            lead = struct.pack("<II", SKIPPABLE, len(content)) + content
        except zstandard.ZstdError:
            dictionary = None
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return lead + b"".join(packer.compress(r) for r in records)


def _magic(data: memoryview, at: int) -> int | None:
    return struct.unpack_from("<I", data, at)[0] if len(data) >= at + 8 else None


def _skipped(data: memoryview, at: int) -> int:
    """Where the skippable frame that begins at ``at`` ends."""
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        raise ValueError("a skippable frame is cut off")
    return end


def _dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary, if the archive leads with one, and where its records begin. Other skippable frames may come before."""
    at = 0
    while (magic := _magic(data, at)) in SKIPPABLES and magic != SKIPPABLE:
        at = _skipped(data, at)
    if magic != SKIPPABLE:
        return None, at
    end = 8 + at + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        raise ValueError("the dictionary's frame is cut off")
    content = bytes(data[at + 8 : end])
    if content[:4] == FRAME:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if content[:4] != DICTIONARY:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content), end


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends: its header, its blocks by their sizes, its checksum."""
    head = bytes(data[at : at + 18])
    if head[:4] != FRAME:
        raise ValueError("no frame begins here")
    pos, last = at + zstandard.frame_header_size(head), False
    while not last:
        if pos + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[pos : pos + 3], "little")
        last = bool(block & 1)
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a repeated byte is stored once
    pos += 4 * zstandard.get_frame_parameters(head).has_checksum
    if pos > len(data):
        raise ValueError("a frame is cut off")
    return pos


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; ValueError if a header or a length is wrong."""
    head, blank, rest = record.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not blank or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        headers[name.strip().lower()] = value.strip()
    for name in NEEDED:
        if not headers.get(name.lower()):
            raise ValueError(f"no {name}")
    if not headers["content-length"].isdecimal() or len(rest) != int(headers["content-length"]) + 4:
        raise ValueError("the block is not as long as Content-Length says")
    if rest[-4:] != CRLF + CRLF:
        raise ValueError("the record does not end with two line breaks")
    return headers, rest[:-4]


def records(name: str, content: bytes) -> Iterator[tuple]:
    """Rows of RECORD. A faulty record has its ``error``; after a frame whose end is unknown the rest is one error."""
    data = memoryview(content)
    fault = lambda at, why: (name, at, None, None, None, None, None, None, None, str(why))
    try:
        dictionary, at = _dictionary(data)
    except (ValueError, zstandard.ZstdError) as e:
        yield fault(0, e)
        return
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            if _magic(data, at) in SKIPPABLES:
                at = _skipped(data, at)
                continue
            end = _frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield fault(at, e)
            return
        try:
            headers, block = parsed(reader.decompressobj().decompress(data[at:end]))
            kind, payload = headers["warc-type"], block
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
            size = None
            if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
                head, blank, payload = block.partition(CRLF + CRLF)
                if not blank:
                    raise ValueError("no HTTP header")
                said = [x.partition(b":")[2].strip() for x in head.split(CRLF) if x.lower().startswith(b"content-length:")]
                size = int(said[0]) if said and said[0].isdigit() else None
            if kind == "revisit":
                payload = None
            elif kind == "response":
                if size not in (None, len(payload)):
                    raise ValueError("the payload is not as long as its HTTP header says")
                if digest is not None and digest != base32_sha1(payload):
                    raise ValueError("the payload does not match its digest")
                size = len(payload)
            yield name, at, headers["warc-record-id"], kind, headers.get("warc-target-uri"), digest, size, headers.get("warc-refers-to"), payload, None
        except (ValueError, zstandard.ZstdError) as e:
            yield fault(at, e)
        at = end


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(name, content): archives with one record for each row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the least page_id is a response, the
    others revisit it; rows that repeat that page_id and payload are responses too. Null html is an empty payload, a null
    url an empty address, a null page_id an id without a number that comes after all others. Other columns are not
    looked at. The least ids are summed up by digest before the shuffle, so a payload that many pages share is one row there.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("_sha1", F.sha1(F.encode("html", "UTF-8")))
    firsts = keyed.where(F.octet_length("html") >= least_bytes).groupBy(F.col("_sha1").alias("_key")).agg(F.min("page_id").alias("_first"), F.lit(True).alias("_shared"))
    found = keyed.select("page_id", "url", "html", "_sha1").join(firsts, F.col("_sha1") == F.col("_key"), "left")
    other = F.coalesce("_shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    given = found.select("page_id", "url", "html", "_sha1", other.alias("_revisit"), "_first")
    given = given.sortWithinPartitions("page_id", "url", "_sha1")  # rows arrive in any order, archives are named by what they hold

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for page_id, url, html, sha1, revisit, first in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                record = page_record(_record_id(page_id), url or "", payload, digest, _record_id(first) if revisit else None)
                if held and size + len(record) > ARCHIVE_BYTES:
                    yield _archive(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield _archive(held)

    return given.mapInArrow(run, "name string, content binary")


def _archive(held: list[bytes]) -> pa.RecordBatch:
    name = hashlib.sha1(b"".join(held)).hexdigest()
    info = _record("warcinfo", f"<urn:archive:{name}>", [("Content-Type", "application/warc-fields")], b"software: steadyline\r\nformat: WARC File Format 1.1\r\n")
    return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.zst"]), pa.array([pack([info, *held])], pa.binary())], names=["name", "content"])


def open_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files as (name, content). A file is one value, so it has to be smaller than 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of archives (name, content) with RECORD's columns; null content: an empty archive, no rows.

    Each frame is decoded and checked by itself: version line, needed headers, block length, trailer, payload length
    and SHA-1. What fails is a row with ``error`` set, so that nothing is lost unseen. payload_bytes of a revisit
    is what its HTTP header says.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                held, size = [], 0
                for row in records(name, content.as_buffer() or b""):
                    held.append(row)
                    size += len(row[8] or b"")
                    if size > 4 << 20 or len(held) == 2_000:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    return archives.select("name", "content").mapInArrow(run, RECORD)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def export(archives: DataFrame, folder: str) -> None:
    """Put each archive into ``folder``, a URI that pyarrow opens on every executor. A repeated task writes the same file."""

    def put(rows):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{root}/{row.name}", compression=None) as out:  # it is already
                out.write(bytes(row.content))

    archives.select("name", "content").foreachPartition(put)
