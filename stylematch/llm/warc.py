"""WARC archives: whole-file gzip streams, rewritten with a member per record and an offset index."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.session import scratch_path, stage

GZIP = 31
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH = re.compile(rb"^Content-Length: *(\d+)\r?$", re.I | re.M)


def _page(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    number = uri.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record: a response with the payload, or a revisit of ``refers_to`` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_page(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_page(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record: page_id, record_type, refers_to, and size and digest of the full payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    own = {"page_id": _page_id(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "url": fields["WARC-Target-URI"]}
    if fields["WARC-Type"] == "revisit":
        stated = int(LENGTH.search(http)[1])
        return own | {"payload_bytes": stated, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": _page_id(fields["WARC-Refers-To"])}
    return own | {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "refers_to": None}


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def _own_name(folder: str, stem: str, suffix: str) -> str:
    """A file of this attempt of this task: what a lost attempt has left is never read."""
    task = TaskContext.get()
    return f"{folder}/{stem}-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


def _inflated(source) -> Iterator[bytes]:
    """The content of a gzip file with one or more members, in pieces."""
    unzip = zlib.decompressobj(GZIP)
    while piece := source.read(CHUNK):
        while True:
            got = unzip.decompress(piece, CHUNK)
            if got:
                yield got
            if unzip.eof:
                piece, unzip = unzip.unused_data, zlib.decompressobj(GZIP)
                if not piece:
                    break
            elif unzip.unconsumed_tail or len(got) == CHUNK:
                piece = unzip.unconsumed_tail
            else:
                break


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream: headers to the blank line, the stated length, and two line ends."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (head := held.find(b"\r\n\r\n")) >= 0:
            need = head + 4 + int(LENGTH.search(bytes(held[:head]) + b"\r\n")[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
    if held:
        raise ValueError(f"the archive ends inside a record: {len(held)} bytes are left")


def write_whole(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write each partition of (page_id, url, html, refers_to) as one gzip stream; (path, records) per file written."""

    def write(batches):
        path, packer, n, out = _own_name(folder, "whole", ".warc.gz"), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    system, at = _open(path)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(at, compression=None)
                out.write(packer.compress(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py())))
                n += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, records long")


def normalise(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each gzip archive of ``path`` with a member per record; (archive, index, records) per file.

    The input is inflated once, as a stream, whatever its members are; a record is held at a time. Beside the archive
    stands its index, a JSON line per record: offset and length of the member, page_id, record_type.
    """

    def rewrite(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _open(path)
                target = _own_name(folder, "members", f"-{hashlib.sha1(path.encode()).hexdigest()[:12]}.warc.gz")
                into, to = _open(target)
                into.create_dir(to.rpartition("/")[0], recursive=True)
                n = offset = 0
                with system.open_input_stream(at, compression=None) as source, into.open_output_stream(to, compression=None) as out, into.open_output_stream(f"{to}.idx", compression=None) as index:
                    for raw in split_records(_inflated(source)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = packer.compress(raw) + packer.flush()
                        head = raw[:raw.find(b"\r\n\r\n")].decode()
                        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
                        out.write(member)
                        index.write((json.dumps({"offset": offset, "length": len(member), "page_id": _page_id(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"]}) + "\n").encode())
                        offset += len(member)
                        n += 1
                yield pa.record_batch([pa.array([target]), pa.array([f"{target}.idx"]), pa.array([n], pa.int64())], ["archive", "index", "records"])

    return files.select("path").mapInArrow(rewrite, "archive string, index string, records long")


def read_index(archives: DataFrame, run: int = 200) -> DataFrame:
    """(archive, runs of offsets and lengths) from the sidecar indexes: up to ``run`` neighbouring members a row."""

    def read(batches):
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = _open(index)
                with system.open_input_stream(at) as source:
                    lines = [json.loads(line) for line in source.read().splitlines()]
                for i in range(0, len(lines), run):
                    part = lines[i:i + run]
                    yield pa.record_batch([pa.array([archive]), pa.array([[x["offset"] for x in part]]), pa.array([[x["length"] for x in part]])], ["archive", "offsets", "lengths"])

    return archives.select("archive", "index").mapInArrow(read, "archive string, offsets array<long>, lengths array<long>")


def read_records(runs: DataFrame) -> DataFrame:
    """The records at the indexed offsets, each inflated alone: (page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""
    names = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def read(batches):
        for batch in batches:
            for archive, offsets, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, at = _open(archive)
                with system.open_input_file(at) as source:
                    found = [parse(zlib.decompress(source.read_at(length, offset), GZIP)) for offset, length in zip(offsets, lengths)]
                yield pa.record_batch([pa.array([x[k] for x in found], kind) for k, kind in names.items()], list(names))

    return runs.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row of (page_id, url, html) to archives, normalise them, and read all records back.

    The payload is the html in UTF-8 (null: empty). Of rows whose payloads are equal and have at least ``least_bytes``
    bytes, those with the smallest page_id are responses and the others revisit it. Rows with a null page_id never lead
    a group that has other ids; a group of null ids alone, and rows that repeat the leading id, are responses. A null
    url is written empty. An empty table writes nothing and gives an empty result. Other columns are not read.

    Archives go to ``folder``, or a new one below ``spark.checkpoint.dir``, which all executors share. A partition of the
    input is one whole-file archive; a file is streamed through one task, its records are read back in parallel. File
    names carry the attempt, and later steps read only files that a finished task has reported, so lost executors leave
    no half-written archive in the result. The payload of a hot group is written once; the table of groups with
    copies is staged, so Spark broadcasts it only below its size threshold, and else splits hot keys of the join.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256))
    groups = rows.groupBy("sha").agg(F.min("page_id").alias("lead"), F.count("*").alias("n"), F.first(F.octet_length("html")).alias("bytes"))
    copies = stage(groups.filter(F.col("n") > 1).filter(F.col("bytes") >= least_bytes).select("sha", "lead"), "copies")
    marked = rows.join(copies, "sha", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead")))
    whole = stage(write_whole(marked, f"{folder}/whole"), "whole")
    members = stage(normalise(whole.repartition(max(1, whole.count()), "path"), f"{folder}/members"), "members")
    runs = stage(read_index(members), "runs")
    return read_records(runs.repartition(max(1, runs.count() // 4)))
