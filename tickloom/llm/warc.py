"""Operator 10: WARC archives through a chunked record table.

Payloads are rows (record, chunk number, bytes) of at most ``chunk_bytes``, each with the
SHA-1 of its record's bytes so far; the last one of a record is the payload's digest. The
writer streams the chunks of a record into one gzip member, checked chunk by chunk, and
the reader streams them out of it again, so that after the cut no step holds a whole
record. Writer tasks put
files into a folder all executors share, under a name of their own for each attempt;
only the files in the manifest that a finished task returns belong to the archive, so
lost or repeated tasks do no harm.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest
id is a response and the others are revisits that refer to it.

Nulls: a null payload is empty, a null url is left out, a row with a null id is written
(and revisits an equal payload that has an id; among null ids only, all are responses).
Rows that repeat an id and its payload are written alike.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import common

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of a record's bytes up to and with each chunk; the chunks of a record come one after another."""
    record, sha = None, None
    for batch in batches:
        out = []
        for row, chunk, data in zip(common.column(batch, "record").to_pylist(), common.column(batch, "chunk").to_pylist(), common.column(batch, "data"), strict=True):
            if chunk == 0:
                record, sha = row, hashlib.sha1()
            if row != record:
                raise ValueError("a chunk without its record's first one")
            sha.update(data.as_buffer())
            out.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "running"])


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = 1 << 20) -> DataFrame:
    """(record, page_id, url, digest, n_bytes, chunk, n_chunks, data, running): the payloads in UTF-8, cut into chunks.
    ``record`` tells rows apart that are equal in everything else; ``running`` is the digest of the bytes up to and with the
    chunk. A payload of one chunk is its own chunk; the chunks of longer ones are written with running digests, of which
    the last is the payload's."""
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    raw = raw.withColumns({"record": F.monotonically_increasing_id(), "n_bytes": F.octet_length("payload").cast("long")})
    named = ["record", "page_id", "url", "n_bytes"]
    short = raw.where(F.col("n_bytes") <= chunk_bytes).select(*named, F.lit(0).alias("chunk"), F.lit(1).alias("n_chunks"), F.col("payload").alias("data"))
    short = short.withColumn("running", F.sha1("data")).withColumn("digest", F.col("running"))
    many = F.ceil(F.col("n_bytes") / chunk_bytes).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring("payload", i * chunk_bytes + 1, F.lit(chunk_bytes)))
    long = raw.where(F.col("n_bytes") > chunk_bytes).select(*named, many.alias("n_chunks"), F.posexplode(pieces).alias("chunk", "data"))
    long = long.select(*named, "chunk", "n_chunks", "data")
    long = common.materialise(common.arrow_map(long, _running, f"{', '.join(f'{x.name} {x.dataType.simpleString()}' for x in long.schema)}, running string"), "warc-chunks")
    whole = long.where("chunk = n_chunks - 1").select("record", F.col("running").alias("digest"))
    return short.unionByName(long.join(whole, "record"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _header(row: dict, date: str) -> bytes:
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _name(row["page_id"]),
        "WARC-Date": date,
        "WARC-Target-URI": None if row["url"] is None else urllib.parse.quote(row["url"], safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode(),
        "WARC-Profile": _PROFILE if revisit else None,
        "WARC-Refers-To": _name(row["refers_to"]) if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(http) + (0 if revisit else row["n_bytes"])),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n").encode() + http


def write_archive(chunks: DataFrame, folder: str, min_bytes: int = 1000, file_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a chunk table as .warc.gz files into ``folder`` (a URI that all nodes reach); returns the manifest (file string, n_records long)."""
    first = chunks.where((F.col("chunk") == 0) & (F.col("n_bytes") >= min_bytes))
    owners = first.groupBy(F.col("digest").alias("o_digest"), F.col("n_bytes").alias("o_bytes")).agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1")
    told = chunks.join(owners, (chunks["digest"] == owners["o_digest"]) & (chunks["n_bytes"] == owners["o_bytes"]), "left")
    told = told.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")))
    told = told.where("refers_to is null or chunk = 0").select("record", "page_id", "url", "digest", "n_bytes", "chunk", "n_chunks", F.expr("if(refers_to is null, data, null)").alias("data"), "running", "refers_to")
    told = told.sortWithinPartitions("page_id", "record", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        stream, path, size, records, pack, sha = None, None, 0, 0, None, None
        done: list[tuple[str, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                if row["chunk"] == 0:
                    if stream is None or size >= file_bytes:
                        if stream is not None:
                            stream.close()
                            done.append((path, records))
                        path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                        stream, size, records = store.open_output_stream(path, compression=None), 0, 0
                    pack, sha = zlib.compressobj(4, zlib.DEFLATED, 31), hashlib.sha1()
                    out = pack.compress(_header(row, date))
                else:
                    out = b""
                data = row["data"] or b""
                sha.update(data)
                last = row["chunk"] == row["n_chunks"] - 1
                if row["refers_to"] is None and sha.hexdigest() != (row["digest"] if last else row["running"]):
                    raise ValueError(f"chunks of page {row['page_id']} don't make its payload")
                out += pack.compress(data)
                if row["refers_to"] is not None or last:
                    out += pack.compress(b"\r\n\r\n") + pack.flush()
                    records += 1
                stream.write(out)
                size += len(out)
        if stream is not None:
            stream.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "n_records"])

    return common.materialise(common.arrow_map(told, run, "file string, n_records long"), "warc-manifest")


class _Member:
    """Reads one file's gzip members as one stream, ``step`` compressed bytes at a time."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.pack, self.ready, self.raw = stream, step, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        if self.pack.eof:
            self.raw, self.pack = self.pack.unused_data, zlib.decompressobj(31)
        if not self.raw and not self.pack.unconsumed_tail:
            self.raw = self.stream.read(self.step)
            if not self.raw:
                return False
        self.ready += self.pack.decompress(self.pack.unconsumed_tail + self.raw, self.step)
        self.raw = b""
        return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.ready:
            if not self.more():
                return None
        line, self.ready = self.ready.split(b"\r\n", 1)
        return line

    def fields(self) -> dict[str, str] | None:
        """The named fields up to an empty line; None at the end."""
        out, first = {}, True
        while (line := self.line()) is not None:
            if not line and not first:
                return out
            if line:
                first = False
                k, _, v = line.decode().partition(": ")
                out[k] = v
        return None

    def block(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.ready and not self.more():
                raise EOFError("a record ends too soon")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            if piece:
                yield piece


def read_archive(spark: SparkSession, manifest: DataFrame, folder: str, step: int = 1 << 20) -> DataFrame:
    """Read the manifest's files back, one row a record: page_id, url (percent-encoded as stored), payload_bytes, payload_digest (hex), record_type, refers_to.

    For responses size and digest come from the payload as streamed; a digest that differs from the header's is an error.
    """
    number = lambda x: None if x is None or x.endswith(":none>") else int(x[len("<urn:page:") : -1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in common.column(batch, "file").to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    source = _Member(stream, step)
                    while (head := source.fields()) is not None:
                        left = int(head["Content-Length"])
                        http, gone = {}, 0
                        while line := source.line():
                            gone += len(line) + 2
                            k, _, v = line.decode().partition(": ")
                            http[k] = v
                        sha, size = hashlib.sha1(), 0
                        for piece in source.block(left - gone - 2):
                            sha.update(piece)
                            size += len(piece)
                        told = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if head["WARC-Type"] == "response" and (sha.hexdigest(), size) != (told, int(http["Content-Length"])):
                            raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} isn't the one its header names")
                        rows.append({"page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload_bytes": int(http["Content-Length"]), "payload_digest": told, "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To"))})
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select("file")
    return common.arrow_map(files.repartition(max(1, min(10_000, files.count())), "file"), run, _RESULT)
