"""WARC archives: writing them as one gzip stream a file, normalising those to one
member a record with a sidecar index, and reading records back by offset.

A monolithic file can only be read from its start.  The normaliser inflates such a
file once, as a stream, finds the records by their Content-Length, and writes each as a
gzip member of its own, so that any record can be read by itself later; the sidecar
(<file>.idx, one JSON line a record) has the offsets.

Files are named by partition and content and put in place by one rename, so a task that runs
again, after the loss of its executor or beside a copy of itself, leaves the same files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import materialise, new_file, new_folder, shared_dir

LEVEL = 3
#: Payload bytes in one archive, about.
FILE_BYTES = 16_000_000
REVISIT_BYTES = 1000
_CHUNK = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16


def _record(page_id, url, payload: bytes, digest: str, length: int, refers_to, revisit: bool) -> bytes:
    safe = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {safe or 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {length}",
        "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the payload of one record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("record cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


def _write_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, name = 0, hashlib.sha256()
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{name.hexdigest()[:32]}.warc.gz"
            with new_file(path) as f:
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                for r in held:
                    f.write(z.compress(r))
                f.write(z.flush())
            return pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([len(held)], pa.int64())})

        for b in batches:
            for r in b.to_pylist():
                payload = (r["payload"] or "").encode("utf-8")
                record = _record(r["page_id"], r["url"], payload, r["digest"], len(payload), r["refers_to"], r["revisit"])
                held.append(record)
                name.update(record)
                size += len(record)
                if size >= FILE_BYTES:
                    yield flush()
                    held, size, name = [], 0, hashlib.sha256()
        if held:
            yield flush()

    return run


def inflate(source) -> Iterator[bytes]:
    """Bytes of a gzip stream of one or more members, in chunks."""
    z = zlib.decompressobj(31)
    while chunk := source.read(_CHUNK):
        while chunk:
            if z.eof:
                z = zlib.decompressobj(31)
            yield z.decompress(chunk)
            chunk = z.unused_data
    if not z.eof:
        raise ValueError("gzip stream cut short")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed WARC stream; holds one record at a time."""
    buf = bytearray()
    need = -1
    for c in chunks:
        buf += c
        while True:
            if need < 0:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x.partition(b":")[2]) for x in bytes(buf[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = -1
    if buf:
        raise ValueError("archive cut short")


def normalise_file(path: str, to: str) -> list[tuple[int, int]]:
    """Rewrite one archive with a member for each record; the sidecar's (offset, length)."""
    fs, at = pafs.FileSystem.from_uri(path)
    index, offset = [], 0
    with fs.open_input_stream(at, compression=None) as src, new_file(to) as out:
        for record in split_records(inflate(src)):
            member = gzip.compress(record, LEVEL, mtime=0)
            out.write(member)
            index.append((offset, len(member)))
            offset += len(member)
    with new_file(f"{to}.idx") as f:
        f.write("".join(json.dumps({"offset": o, "length": n}) + "\n" for o, n in index).encode())
    return index


def _index_of(path: str) -> list[tuple[int, int]] | None:
    """The sidecar of a normalised archive; None if it isn't there (it is put in place last)."""
    fs, at = pafs.FileSystem.from_uri(f"{path}.idx")
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(at, compression=None) as f:
        return [(e["offset"], e["length"]) for e in map(json.loads, f.read().decode().splitlines())]


def _normalise(folder: str, remove: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                to = f"{folder}/{path.rpartition('/')[2]}"
                index = _index_of(to)  # there already if this task ran before
                if index is None:
                    index = normalise_file(path, to)
                if remove:
                    fs, at = pafs.FileSystem.from_uri(path)
                    if fs.get_file_info(at).type != pafs.FileType.NotFound:
                        fs.delete_file(at)
                yield pa.RecordBatch.from_pydict(
                    {"path": [to] * len(index), "offset": pa.array([o for o, _ in index], pa.int64()), "length": pa.array([n for _, n in index], pa.int64())}
                )

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            fs, at = pafs.FileSystem.from_uri(path)
            index = _index_of(path)
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
            held = 0
            with fs.open_input_file(at) as f:
                for offset, length in index:
                    f.seek(offset)
                    fields, payload = read_record(gzip.decompress(f.read(length)))
                    kind = fields["warc-type"]
                    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest differs in {path} at {offset}")
                    number = fields.get("x-page-id")
                    refers = fields.get("x-refers-to-page-id")
                    out["page_id"].append(None if number is None else int(number))
                    out["url"].append(fields["warc-target-uri"])
                    out["payload_bytes"].append(int(fields["x-payload-length"]))
                    out["payload_digest"].append(digest)
                    out["record_type"].append(kind)
                    out["refers_to"].append(None if refers is None else int(refers))
                    out["payload"].append(payload if kind == "response" else None)
                    held += len(payload)
                    if held > 4_000_000:
                        yield _records(out)
                        held, out = 0, {k: [] for k in out}
            yield _records(out)


_TYPES = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}


def _records(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, _TYPES.get(k, pa.string())) for k, v in out.items()})


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest (SHA-1), revisit, refers_to.

    Of equal payloads of at least ``least`` bytes, rows of the largest page_id stay
    responses (all of them, if that id repeats), others refer to it; null ids are least.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    many = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
        .where("n > 1 AND top IS NOT NULL")
        .select("digest", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(many, ["digest", "salt"], "left")
    revisit = F.coalesce(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_monolithic(records: DataFrame) -> DataFrame:
    """Archives of about FILE_BYTES, each one gzip stream; path and number of records."""
    folder = shared_dir(records.sparkSession, "warc-whole")
    new_folder(folder)
    return materialise(records.mapInArrow(_write_files(folder), "path string, n long"), "warc-files")


def normalise(files: DataFrame, remove: bool = False) -> DataFrame:
    """Rewrites the archives named in column path; path, offset, length of each record.

    remove: each archive goes once its rewritten form is in place.
    """
    folder = shared_dir(files.sparkSession, "warc-members")
    new_folder(folder)
    paths = files.select("path").distinct()
    return materialise(paths.mapInArrow(_normalise(folder, remove), "path string, offset long, length long"), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Records of normalised archives, each read by its offset in the sidecar."""
    paths = index.select("path").distinct()
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return paths.mapInArrow(_read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to archives, normalised, and read back: one row per page.

    Null payloads are empty; null urls become urn:none; rows may repeat.
    """
    return read_archives(normalise(write_monolithic(with_revisits(pages)), remove=True))
