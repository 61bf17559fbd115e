"""WARC archives in Zstandard, one frame a record, with the dictionary in a leading skippable frame.

Writing: Spark finds each payload's last page by its SHA-1 (a partial maximum, then an equi-join that
adaptive execution splits where one payload is very common); earlier pages become revisit records. Each
task packs its rows into archives of bounded size. Reading walks the frames by their block headers,
decodes each with the dictionary, and checks version line, header lines, Content-Length, the record's
end, the HTTP lengths and the payload digest. A record that fails raises ValueError with its place.
Foreign archives are read too: frames without content size, any record type and id, no digests.

Archives are rows (name, content) of a Parquet table in the shared folder, as Spark has no writer for
plain binary files; read_files() reads .warc.zst files from any store that Spark's binaryFile opens.

Defined results: null html is an empty payload; a null url is written as the record's id; rows with
one page_id count as that page each, so all copies of the largest are responses; a null page_id is
written as such, and revisits any page of the same payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import place, stored, table

#: Fixed values of the formats: frame magics, and those of the WARC revisit profile.
ZSTD_MAGIC = 0xFD2FB528
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Uncompressed bytes after which an archive is closed, records a dictionary learns from, and its size.
ARCHIVE_BYTES, SAMPLES, DICTIONARY_BYTES = 2 << 20, 120, 16 << 10
#: Only payloads of at least this many bytes are replaced by revisits.
REVISIT_FROM = 0
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

#: page_id and refers_to are those of our own ids; record_id and refers_to_id are what stands in the archive.
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = f"urn:page:{'none' if page_id is None else page_id}"
    uri = quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url else name
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("ascii") + block + b"\r\n\r\n"


def _headers() -> bytes:
    return record(0, "http://", b"", "", 0) + record(0, "https://www.", b"", "", None)


def pack(records: list[bytes]) -> bytes:
    """An archive. Where too little is there to learn a dictionary from, its dictionary is the common headers."""
    try:
        learnt = zstandard.train_dictionary(DICTIONARY_BYTES, records[:SAMPLES], level=LEVEL) if len(records) >= 8 else None
    except zstandard.ZstdError:
        learnt = None
    if learnt is None:
        learnt = zstandard.ZstdCompressionDict(_headers(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learnt, write_checksum=True, write_content_size=True)
    body = zstandard.ZstdCompressor(level=LEVEL).compress(learnt.as_bytes())
    head = struct.pack("<II", DICTIONARY_FRAME, len(body)) + body
    return head + b"".join(map(packer.compress, records))


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame, from the block headers alone."""
    at, n = 0, len(data)
    while at < n:
        if n - at < 8:
            raise ValueError(f"byte {at}: cut off in a frame's header")
        (magic,) = struct.unpack_from("<I", data, at)
        if magic in SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == ZSTD_MAGIC:
            head = data[at : at + 18]
            try:
                end = at + zstandard.frame_header_size(head)
                checksum = zstandard.get_frame_parameters(head).has_checksum
            except zstandard.ZstdError as e:
                raise ValueError(f"byte {at}: bad frame header: {e}") from e
            last = False
            while not last:
                if end + 3 > n:
                    raise ValueError(f"byte {at}: cut off in a block's header")
                bits = int.from_bytes(data[end : end + 3], "little")
                last, kind, size = bits & 1, bits >> 1 & 3, bits >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * checksum
        else:
            raise ValueError(f"byte {at}: no frame starts here")
        if end > n:
            raise ValueError(f"byte {at}: cut off in a frame")
        yield magic, at, end
        at = end


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(byte at which it starts, record) of an archive, or of several one after the other, each with its dictionary."""
    reader = zstandard.ZstdDecompressor()
    for magic, at, end in frames(data):
        if magic == DICTIONARY_FRAME:
            body = data[at + 8 : end]
            if body[:4] == struct.pack("<I", ZSTD_MAGIC):
                body = zstandard.ZstdDecompressor().decompress(body)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        elif magic == ZSTD_MAGIC:
            try:
                stream = reader.decompressobj()  # streaming writers leave the content size out
                raw = stream.decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise ValueError(f"byte {at}: frame can't be decoded: {e}") from e
            if not stream.eof:
                raise ValueError(f"byte {at}: frame has no end")
            yield at, raw


def _fields(lines: list[bytes], what: str) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"{what} has a bad header line: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _page(uri: str | None) -> int | None:
    """The page of one of our own ids, null for any other."""
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if uri == f"<urn:page:{number}>" and number.lstrip("-").isdigit() else None


def _check_digest(given: str, payload: bytes) -> str:
    """The digest without its label, after checking those of known kinds."""
    kind, colon, value = given.rpartition(":")
    if not colon or kind in ("sha1", "sha256", "md5"):
        own = hashlib.new(kind or "sha1", payload).digest()
        if value not in (base64.b32encode(own).decode(), own.hex()):
            raise ValueError("payload digest differs")
    return value


def _http(block: bytes, kind: str) -> tuple[dict[str, str], bytes]:
    """Header fields and body of an HTTP message. Servers' own header lines are taken as they are."""
    top, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = top.split(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError(f"no HTTP response in the {kind} record")
    pairs = (x.decode("latin-1").partition(":") for x in lines)
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}, payload


def parse(raw: bytes) -> tuple[tuple, bytes | None]:
    """A record's row in SCHEMA and its payload (None for a revisit), after checking version, header lines and
    lengths. Responses and revisits of HTTP have the message's body as payload, all other records their block.
    Ids may be any; a digest that isn't given is computed."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    f = _fields(lines, "record")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in f:
            raise ValueError(f"record lacks {name}")
    if not f["content-length"].isdigit():
        raise ValueError(f"bad Content-Length {f['content-length']!r}")
    n = int(f["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, but {len(rest) - 4} bytes are there")
    block, kind, given = rest[:n], f["warc-type"], f.get("warc-payload-digest")
    payload, size, coded = block, n, False
    if kind in ("response", "revisit") and f.get("content-type", "").startswith("application/http") and (block or kind == "response"):
        fields, payload = _http(block, kind)
        coded = "transfer-encoding" in fields  # lengths and digests may be those of either form
        length = fields.get("content-length", "")
        size = int(length) if length.isdigit() and not coded else len(payload)
        if kind == "response" and len(payload) != size:
            raise ValueError(f"HTTP Content-Length is {size}, but {len(payload)} bytes are there")
    if kind == "revisit":
        if payload and f.get("warc-profile") == REVISIT_PROFILE:
            raise ValueError("revisit with a payload")
        digest = given.rpartition(":")[2] if given else None
        return (_page(f["warc-record-id"]), f.get("warc-target-uri"), size, digest, kind, _page(f.get("warc-refers-to")), f["warc-record-id"], f.get("warc-refers-to")), None
    if given and not coded:
        digest = _check_digest(given, payload)
    else:
        digest = given.rpartition(":")[2] if given else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return (_page(f["warc-record-id"]), f.get("warc-target-uri"), size, digest, kind, None, f["warc-record-id"], f.get("warc-refers-to")), payload


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([pack(held)], pa.binary())], ["n_records", "content"])

    for b in batches:
        cols = {name: b.column(k) for k, name in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            payload = (cols["html"][i].as_py() or "").encode()
            digest = base64.b32encode(bytes.fromhex(cols["sha1"][i].as_py())).decode()
            held.append(record(cols["page_id"][i].as_py(), cols["url"][i].as_py(), payload, digest, cols["refers_to"][i].as_py()))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield closed()
                held, size = [], 0
    if held:
        yield closed()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
    for b in batches:
        for cell in b.column(b.schema.get_field_index("content")):
            rows = []
            for at, raw in records(cell.as_py()):
                try:
                    rows.append(parse(raw)[0])
                except ValueError as e:
                    raise ValueError(f"record at byte {at}: {e}") from e
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)


def planned(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, html, sha1, refers_to: what each page's record is to hold."""
    own = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    enough = F.octet_length(F.coalesce("html", F.lit(""))) >= revisit_from
    last = own.where(enough).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null")
    last = stored(last.select("sha1", "last"), "warc-last")
    both = own.join(last, "sha1", "left")
    return both.select("page_id", "url", "html", "sha1", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> None:
    """Archives of all pages, as rows (n_records, content) of a Parquet table at path."""
    planned(pages, revisit_from).mapInArrow(_write, "n_records long, content binary").write.option("compression", "none").parquet(path)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (column content), as SCHEMA."""
    return archives.select("content").mapInArrow(_read, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.zst files."""
    return read_archives(spark.read.format("binaryFile").load(path))


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark.read.schema("n_records long, content binary").parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
