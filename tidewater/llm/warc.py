"""Zstandard-compressed WARC archives: written from pages, read back record by record."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm.tables import table
from tidewater.spool import run_dir, spool

#: Payload bytes from which equal payloads are stored once.
LEAST_BYTES = 1000
#: Payload bytes of an archive, about; an archive is read back as one row.
ARCHIVE_BYTES = 32 << 20
#: Records, and bytes of them, from which an archive's dictionary is trained, and the dictionary's bytes at most.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 128, 1 << 20, 16 << 10
#: Fixed values of the formats: magic numbers of a frame, of the skippable frame that holds the dictionary, of any skippable frame.
FRAME, DICTIONARY, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
#: What the text writer puts after each row: an empty skippable frame, which decoders pass over.
BETWEEN = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_id string, record_type string, refers_to string, url string, payload binary, payload_digest string, problem string"


# --- writing ---------------------------------------------------------------------------------------------------------


def _url(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record_id(page_id, digest: str) -> str:
    return f"urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}"


def _record(page_id, url, payload: bytes, refers: int | None, revisit: bool, date: str) -> bytes:
    """One record: a response with its payload, or a revisit that names the response of the same payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_record_id(page_id, digest)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _url(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{_record_id(refers, digest)}>" if revisit else None),
        ("Page-Id", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on the first records of an archive; none where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _frames(records: Iterator[bytes], level: int) -> Iterator[bytes]:
    """The frames of one archive: the dictionary in a skippable frame, then one frame a record."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if len(first) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    words = _dictionary(first)
    if words:
        packed = zstandard.ZstdCompressor(level=19).compress(words)
        yield struct.pack("<II", DICTIONARY, len(packed)) + packed
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True, write_content_size=True)
    for some in (first, records):
        for r in some:
            yield press.compress(r)


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``page_id, url, html`` as archives below ``path``: one record a row.

    Rows with equal payloads (the html in UTF-8; null is empty) of at least ``least`` bytes are stored once: that with the
    largest ``page_id`` is the response, those with a smaller one or none revisit it, rows that repeat its id are responses
    as well. Shorter payloads are all responses. An archive is a task's file of about ``archive_bytes`` of payload, with a
    dictionary trained on its first records. Spark's text writer puts the frames down and commits them, so that any store
    works and a lost task leaves nothing behind; between frames it puts empty skippable ones. A url's white space and
    control characters are percent-encoded; a null url has no field. An empty table makes no archive. Extra columns are
    ignored. Each archive must be below 2 GB, so a single payload must.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = spool(rows.select("page_id", "digest", F.octet_length("payload").alias("size")))
    top = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("refers"), F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("low")).where("low < refers")
    again = narrow.where(F.col("size") >= least).join(top.select("digest", "refers"), "digest").where("page_id is null or page_id < refers")
    known = F.coalesce("page_id", F.lit(-(1 << 63)))
    again = again.select(known.alias("a_id"), F.col("digest").alias("a_digest"), "refers").distinct()
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not total[1]:
        return
    archives = 1 + (total[0] + 1000 * total[1]) // archive_bytes
    dealt = rows.repartition(int(archives), known, "digest")
    same = (known == F.col("a_id")) & (F.col("digest") == F.col("a_digest"))
    kept = dealt.join(again.hint("shuffle_hash"), same, "left").select("page_id", "url", "payload", "refers")

    def records(batches):
        for b in batches:
            for page_id, url, body, refers in zip(*(b.column(i) for i in range(4))):
                refers = refers.as_py()
                yield _record(page_id.as_py(), url.as_py(), body.as_py(), refers, refers is not None, date)

    def archive(batches):
        import pyarrow as pa

        for frame in _frames(records(batches), level):
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])

    frames = kept.mapInArrow(archive, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", BETWEEN.decode("ascii")).text(path)


# --- reading ---------------------------------------------------------------------------------------------------------


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, told by its header and the sizes of its blocks; ValueError where it is cut off."""
    try:
        info = zstandard.get_frame_parameters(data[at : at + 18])
        at += zstandard.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            head = int.from_bytes(data[at : at + 3].tobytes().ljust(3, b"\xff"), "little")
            last, kind = bool(head & 1), head >> 1 & 3
            at += 3 + (1 if kind == 1 else head >> 3)
            if at > len(data) or kind == 3:
                raise ValueError("a block of a frame is cut off")
    except zstandard.ZstdError as e:
        raise ValueError(f"no frame header: {e}") from None
    at += 4 * info.has_checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def frames(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The decoded frames of an archive, one after the other; with a frame that can't be decoded what is wrong, and nothing after a broken length."""
    view, at = memoryview(data), 0
    unpack = zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            yield None, "bytes after the last frame"
            return
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                yield None, "a skippable frame is cut off"
                return
            if magic == DICTIONARY and at == 0:
                words = view[8 : 8 + size].tobytes()
                if words[:4] == struct.pack("<I", FRAME):
                    words = unpack.decompressobj().decompress(words)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            at += 8 + size
            continue
        try:
            end = frame_end(view, at)
        except ValueError as e:
            yield None, str(e)
            return
        try:
            yield unpack.decompressobj().decompress(view[at:end]), None
        except zstandard.ZstdError as e:
            yield None, f"a frame can't be decoded: {e}"
        at = end


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by name in lower case; a line that begins with white space goes on with the one before."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse(record: bytes) -> dict:
    """One record's fields and payload; ``problem`` says what is wrong with its headers, lengths or digests."""
    out = dict.fromkeys(("page_id", "record_id", "record_type", "refers_to", "url", "payload", "payload_digest", "problem"))
    version, _, rest = record.partition(b"\r\n")
    head, found, rest = rest.partition(b"\r\n\r\n")
    if not version.startswith(b"WARC/1.") or not found:
        return out | {"problem": "no record header"}
    own = _fields(head)
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in own]:
        return out | {"problem": f"missing field: {missing[0]}"}
    page = own.get("page-id", "")
    strip = lambda v: v[1:-1] if v and v[0] == "<" and v[-1] == ">" else v
    out |= {"page_id": int(page) if page.lstrip("-").isdigit() else None, "record_id": strip(own["warc-record-id"]), "record_type": own["warc-type"].lower(), "refers_to": strip(own.get("warc-refers-to")), "url": own.get("warc-target-uri"), "payload_digest": own.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    length = own["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "length differs from Content-Length"}
    block = rest[:-4]
    if own.get("warc-block-digest", "").startswith("sha1:") and own["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        return out | {"problem": "block digest differs"}
    if out["record_type"] == "revisit":
        return out if out["refers_to"] else out | {"problem": "missing field: warc-refers-to"}
    http = own.get("content-type", "").startswith("application/http")
    if http and b"\r\n\r\n" not in block:
        return out | {"problem": "no end of the http header"}
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    if http and _fields(block.partition(b"\r\n\r\n")[0]).get("content-length", str(len(payload))) != str(len(payload)):
        return out | {"payload": payload, "problem": "payload length differs from the http header"}
    if out["payload_digest"] and out["payload_digest"] != hashlib.sha1(payload).hexdigest():
        return out | {"payload": payload, "problem": "payload digest differs"}
    return out | {"payload": payload}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: ``page_id, record_id, record_type, refers_to, url, payload, payload_digest, problem``.

    An archive is one row of Spark's own file reader (below 2 GB); its frames are decoded one at a time and go on in small
    batches. ``problem`` is null for a sound record; a record that breaks the format comes out with what could be read
    of it. Digests are those the header states, checked against the bytes. A folder without archives gives no rows.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    def unpacked(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for data, problem in frames(content.as_py()):
                    rows.append(dict.fromkeys(names) | {"problem": problem} if data is None else parse(data))
                    size += len(data or b"")
                    if size > 1 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpacked, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Sound records with ``payload_bytes``, ``refers_page`` and ``found``: a revisit gets them from the response it names.

    ``found`` is false for a revisit whose response is not among the records or has another digest. Payloads themselves are
    not shuffled.
    """
    own = spool(records.where("problem is null").select("page_id", "record_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("own_bytes")))
    there = own.where("record_type = 'response'").groupBy(F.col("record_id").alias("t_id")).agg(F.max("page_id").alias("t_page"), F.max("own_bytes").alias("t_bytes"), F.max("payload_digest").alias("t_digest"))
    revisits = own.where("record_type = 'revisit'").join(there, (F.col("refers_to") == F.col("t_id")) & (F.col("payload_digest") == F.col("t_digest")), "left")
    revisits = revisits.select("page_id", "record_type", F.col("t_bytes").alias("payload_bytes"), "payload_digest", F.col("t_page").alias("refers_page"), F.col("t_id").isNotNull().alias("found"))
    plain = own.where("record_type <> 'revisit'").select("page_id", "record_type", F.col("own_bytes").alias("payload_bytes"), "payload_digest", F.lit(None).cast("long").alias("refers_page"), F.lit(True).alias("found"))
    return plain.unionByName(revisits)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back from them."""
    path = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return resolved(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))


OP11_SQL = """
with rows as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
tops as (select *, max(page_id) over (partition by html) as top from rows)
select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest,
  case when n >= 1000 and top is not null and page_id is distinct from top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from top then top end as refers_to
from tops
"""
