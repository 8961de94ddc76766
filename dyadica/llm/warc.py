r"""WARC archives: a writer of one gzip member a record, and a splittable reader.

The reader's tasks take byte ranges of files. A task scans its range for gzip magic,
validates each candidate by inflating its start and parsing the record's header, and
then walks from member to member; it owns the records whose member starts inside its
range and reads the last of them beyond the range's end. So files are read in
parallel without an index, and a lost task is simply run again.

Of records with equal payloads of at least ``least_bytes``, the one with the largest
id is a response; the others are revisit records that name it and carry no payload.

The writer puts each task's records into a file of its own in the shared folder
under a temporary name, and renames it when complete; only files that successful
tasks report are read.

Defined cases: a null payload is empty; a null or odd URL is percent-encoded as far
as needed; rows with a null id are written without one and read back with null; rows
equal in id and payload are written each with the same type; a record whose payload's
largest id is null is a response; an empty table gives an empty result; other columns
are not read. A payload of one record is held in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadica.llm.common import join_hot, local_path, materialise, shared_path

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 16 << 20
LEVEL = 3
_READ = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member; a revisit if refers_to is given."""
    own = digest(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, own)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        body += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [f"WARC-Refers-To: {record_id(refers_to, own)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
        body += b"\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _store(uri: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri)


def open_read(uri: str):
    if path := local_path(uri):
        return open(path, "rb")
    store, path = _store(uri)
    return store.open_input_file(path)


class _Sink:
    """A file that gets its name when it is complete."""

    def __init__(self, uri: str):
        self.local, self.uri, self.size, self.records = local_path(uri), uri, 0, 0
        if self.local:
            os.makedirs(os.path.dirname(self.local), exist_ok=True)
            self.file = open(self.local + ".open", "wb")  # noqa: SIM115
        else:
            self.store, self.path = _store(uri)
            self.file = self.store.open_output_stream(self.path + ".open")

    def put(self, member: bytes) -> None:
        self.file.write(member)
        self.size += len(member)
        self.records += 1

    def done(self) -> None:
        self.file.close()
        if self.local:
            os.replace(self.local + ".open", self.local)
        else:
            self.store.move(self.path + ".open", self.path)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> list[tuple[str, int, int]]:
    """Write all rows as archives under folder; (file, bytes, records) of each."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8") if dict(pages.dtypes)[payload_col] == "string" else F.col(payload_col), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    lasts = materialise(own.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1"), "lasts")
    records = join_hot(own, lasts, ["digest"], "n", "left").select("id", "url", "payload", F.when(F.col("last") != F.coalesce("id", F.col("last") - 1), F.col("last")).alias("refers_to"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sink = None
        for batch in batches:
            for i in range(batch.num_rows):
                sink = sink or _Sink(f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz")
                page_id, url, payload, refers_to = (c[i].as_py() for c in batch.columns)
                sink.put(record(page_id, url, payload, refers_to))
        if sink:
            sink.done()
            yield pa.RecordBatch.from_pylist([{"file": sink.uri, "size": sink.size, "records": sink.records}])

    return [tuple(r) for r in records.mapInArrow(kernel, "file string, size long, records long").collect()]


def _header(raw: bytes) -> dict[str, str] | None:
    """Fields of a record header, None if it is none."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return fields if "warc-type" in fields and "content-length" in fields else None


class RangeReader:
    """Records whose members start in [begin, end) of a file."""

    def __init__(self, file, begin: int, end: int):
        self.file, self.end = file, end
        self.start, self.held, self.at = begin, bytearray(), 0  # held begins at start in the file; at is the place in it
        self.file.seek(begin)

    def _more(self) -> bool:
        new = self.file.read(_READ)
        self.held += new
        return bool(new)

    def _pass(self, to: int) -> None:
        """Go on to a place in what is held, and let go what lies far behind."""
        self.at = to
        if to >= _READ:
            del self.held[:to]
            self.start, self.at = self.start + to, 0

    def _candidate(self) -> bool:
        """Move to the next magic that starts before the range's end."""
        while True:
            i = self.held.find(MAGIC, self.at)
            if i >= 0:
                self._pass(i)
                return self.start + self.at < self.end
            self._pass(max(self.at, len(self.held) - len(MAGIC) + 1))
            if self.start + self.at >= self.end or not self._more():
                return False

    def _inflated(self) -> tuple[bytes, int] | None:
        """The member at the place and where it ends in what is held, None if it is no record."""
        unpacker = zlib.decompressobj(31)
        pieces, head, checked, given = [], bytearray(), False, self.at
        try:
            while not unpacker.eof:
                if given == len(self.held) and not self._more():
                    return None
                step = bytes(memoryview(self.held)[given : given + _READ])
                given += len(step)
                new = unpacker.decompress(step)
                pieces.append(new)
                if not checked:
                    seen = max(0, len(head) - 3)
                    head += new
                    if not head.startswith(b"WARC/1."[: len(head)]):
                        return None
                    if head.find(b"\r\n\r\n", seen) >= 0 or unpacker.eof:  # however long the header is
                        checked = True
                        if _header(bytes(head)) is None:
                            return None
                        head.clear()
        except zlib.error:
            return None
        return b"".join(pieces), given - len(unpacker.unused_data)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self._candidate():
            found = self._inflated()
            if found is None:
                self._pass(self.at + 1)
                continue
            raw, after = found
            fields = _header(raw)
            begin = raw.index(b"\r\n\r\n") + 4
            yield fields, raw[begin : begin + int(fields["content-length"])]
            self._pass(after)


_COLUMNS = (("file", "string"), ("record_type", "string"), ("page_id", "long"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "long"), ("payload", "binary"))


def read(spark: SparkSession, files: list[tuple[str, int, int]], split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """(file, record_type, page_id, url, payload_bytes, payload_digest, refers_to and, if payloads, payload) of every record. A response's size and digest are those of the payload read; a revisit, whose payload is null, has its response's, as declared."""
    ranges = [(f, a, min(size, a + split_bytes)) for f, size, _ in files for a in range(0, size, split_bytes)]
    tasks = spark.createDataFrame(ranges, "file string, begin long, end long").repartition(max(1, len(ranges)))
    columns = _COLUMNS if payloads else _COLUMNS[:-1]
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in columns])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind.type) for i, kind in enumerate(kinds)], schema=kinds)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                rows, held = [], 0
                with open_read(task["file"]) as f:
                    for fields, block in RangeReader(f, task["begin"], task["end"]):
                        kind, whose = fields["warc-type"], fields.get("x-page-id")
                        row = (task["file"], kind, int(whose) if whose else None, fields.get("warc-target-uri"))
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            row += (len(payload), digest(payload), None, payload)
                            held += len(payload)
                        else:
                            row += (int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-refers-to-page"]), None)
                        rows.append(row[: len(columns)])
                        if payloads and held > 4 << 20 or len(rows) >= 5000:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return tasks.mapInArrow(kernel, ", ".join(f"{n} {k}" for n, k in columns))


def op8(pages: DataFrame) -> DataFrame:
    """The digest of the contract: page_id, payload_bytes, payload_digest, record_type, refers_to, all read back; an error if not every record is."""
    spark = pages.sparkSession
    files = write(pages, shared_path(spark, "warc"))
    records = materialise(read(spark, files, payloads=False), "records")
    found, written = records.count(), sum(n for _, _, n in files)
    if found != written:
        raise RuntimeError(f"{found} records read of {written} written")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
