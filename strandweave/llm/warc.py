"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader deals byte ranges of the archives to tasks: a task looks for
gzip magic from the start of its range, takes a place as a member only if its first bytes decode to
a WARC version line, and owns the records that start inside its range, reading past the end for the last one.
So archives of any size are read in parallel, without an index.

Archives are written to the shared folder through ``pyarrow.fs``, each under a name of the attempt and then moved, so
a task that runs again replaces its own file.

A null payload is an empty one. A null url is left out of the record. A null key is kept as null and
never becomes the record that others refer to; where all keys of a group are null, and for rows that repeat the smallest key, each is a response. An empty table writes no
records. A member that can't be decoded, or is no whole record, is left out, or told of with ``errors="keep"``, and the reader goes on at the next one; ``errors="fail"``
raises. Very long payloads are held one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.frames import lean, load
from strandweave.llm.textscan import slices, text_of
from strandweave.plans.staging import cut, scratch

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
SPLIT_BYTES = 4 << 20
WINDOW = 256 << 10
BROADCAST_FIRSTS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
READ = "record_id string, page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, position long, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("dbfs:/"):
        return pafs.LocalFileSystem(), "/dbfs/" + uri[6:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    for other in ("s3a://", "s3n://"):  # as Spark names them
        uri = "s3://" + uri.removeprefix(other) if uri.startswith(other) else uri
    return pafs.FileSystem.from_uri(uri)


def record_id(key: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{salt}')}>"


def record(key: int | None, uri: str | None, payload: bytes, sha: str, first: int | None, is_first: bool) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if is_first else "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", " ".join(uri.split()))] if uri else []
    head += [("WARC-Page-Key", str(key))] if key is not None else []
    head += [("WARC-Payload-Digest", f"sha1:{sha}")]
    if not is_first:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first))] + ([("WARC-Refers-To-Page-Key", str(first))] if first is not None else [])
    body = http + (payload if is_first else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    text = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def parse(text: bytes) -> dict:
    """A record as a row; raises ValueError for anything else."""
    head, gap, rest = text.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    row = {"record_id": fields.get("warc-record-id"), "page_id": _int(fields.get("warc-page-key")), "uri": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _int(fields.get("warc-refers-to-page-key"))}
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return row | {"payload_bytes": sizes[0] if sizes else None, "payload_digest": declared, "payload": None}
    sha = digest(payload)
    if declared and declared != sha:
        raise ValueError(f"payload digest of {row['record_id']} is {sha}, not {declared}")
    return row | {"payload_bytes": len(payload), "payload_digest": sha, "payload": payload}


def _int(x: str | None) -> int | None:
    return int(x) if x else None


def with_firsts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """url, html and the smallest key of its payload for each page. Equal payloads are counted before the shuffle.

    The payloads stay where they are while those that occur again are few (``BROADCAST_FIRSTS``, 100 bytes each); beyond that they are joined, and a
    partition that a frequent payload makes large is split at run time.
    """

    def run(batches):
        for batch in slices(batches, html):
            digests = pa.array([digest(x) for x in text_of(batch, html).cast(pa.binary()).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=kinds.names)

    def run_slim(batches):
        for batch in slices(batches, html):
            digests = pa.array([digest(x) for x in text_of(batch, html).cast(pa.binary()).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests], names=[key, "__sha"])

    kinds = pages.select("*").schema.add("__sha", "string")
    digested = pages.mapInArrow(lean(run), kinds)
    firsts = pages.select(key, html).mapInArrow(lean(run_slim), f"{key} long, __sha string").groupBy(F.col("__sha").alias("__of")).agg(F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    firsts = cut(firsts)
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_FIRSTS else firsts
    return digested.join(firsts, F.col("__sha") == F.col("__of"), "left").drop("__of")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> list[tuple[str, int]]:
    """Archives under ``folder``, one per task that has rows; their paths and sizes."""
    plain = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))

    def run(batches):
        from pyspark import TaskContext

        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = posixpath.join(base, f"part-{context.partitionId():06d}.warc.gz")
        draft = posixpath.join(base, f"_draft-{context.taskAttemptId()}")
        out, size = None, 0
        for batch in batches:
            for k, u, h, sha, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or fs.open_output_stream(draft)
                is_first = n is None or first is None or k == first
                member = record(k, u, (h or "").encode(), sha, first, is_first)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size])], names=["path", "bytes"])

    made = with_firsts(plain, "k", "h").select("k", "u", "h", "__sha", "__first", "__n").mapInArrow(lean(run), "path string, bytes long")
    return [(r["path"], r["bytes"]) for r in made.collect()]  # one row per archive


def splits(spark: SparkSession, archives: list[tuple[str, int]], step: int = SPLIT_BYTES) -> DataFrame:
    """(path, first, last): byte ranges of the archives, made by tasks from a row per archive."""
    rows = spark.createDataFrame(archives, "path string, bytes long").where("bytes > 0")
    at = rows.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("first"))
    ranges = sum(-(-size // step) for _, size in archives)
    return at.select("path", "first", F.least(F.col("first") + step, "bytes").alias("last")).repartition(max(1, min(ranges, 100_000)))


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """Position and text of each record that starts in [start, end); no text for a member that breaks off or is damaged."""
    size = file.size()

    def at(position: int, n: int) -> bytes:
        return file.read_at(min(n, size - position), position) if position < size else b""

    def whole(position: int) -> tuple[bytes, int]:
        """The member at ``position`` and where it ends."""
        unpack, parts, here = zlib.decompressobj(31), [], position
        while not unpack.eof:
            block = at(here, WINDOW)
            if not block:
                raise zlib.error("truncated member")
            parts.append(unpack.decompress(block))
            here += len(block)
        return b"".join(parts), here - len(unpack.unused_data)

    def is_member(position: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(at(position, 4096), 64).startswith(b"WARC/")
        except zlib.error:
            return False

    position, block_at, block = start, start, at(start, WINDOW + 2)
    while position < end:  # look for the first member; then each is followed by the next
        found = block.find(MAGIC, position - block_at)
        if found < 0:
            block_at += WINDOW
            position, block = block_at, at(block_at, WINDOW + 2)
            if not block:
                return
            continue
        position = block_at + found
        if position >= end:
            return
        if not is_member(position):
            position += 1
            continue
        while position < end and at(position, 3) == MAGIC:
            try:
                text, after = whole(position)
            except zlib.error:
                yield position, None
                position += 1  # the next member is looked for
                break
            if text.startswith(b"WARC/"):
                yield position, text
            position = after
        block_at, block = position, at(position, WINDOW + 2)


def read(spark: SparkSession, archives: list[tuple[str, int]], folder: str = "", payloads: bool = True, step: int = SPLIT_BYTES, errors: str = "skip") -> DataFrame:
    """A row per record of the archives (path and size), in ranges of ``step`` bytes; with ``errors="keep"`` also one per damaged member, with ``error`` set."""
    frame = splits(spark, archives, step)

    def run(batches):
        fs = filesystem(folder)[0]
        for batch in batches:
            for path, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for position, text in members(file, first, last):
                        try:
                            if text is None:
                                raise ValueError("damaged member")
                            row = parse(text) | {"archive": path, "position": position, "error": None}
                        except (ValueError, KeyError, IndexError) as e:
                            if errors == "fail":
                                raise
                            if errors == "skip":
                                continue
                            row = dict.fromkeys(kinds.names) | {"archive": path, "position": position, "error": f"{type(e).__name__}: {e}"}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    from strandweave.llm.frames import schema

    kinds = to_arrow_schema(schema(READ))
    return frame.mapInArrow(lean(run), READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = write(load(spark, sf_dir, "pages"), folder)
    back = read(spark, archives, folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
