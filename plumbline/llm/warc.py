"""WARC archives from pages: a deterministic sharded writer, and a reader.

Records are range-sorted by page_id, between bounds that follow from a sample by hash of the
ids, so that runs over the same pages write the same files; a partition writes its records as gzip members and rolls
to a new file when the compressed size of the current one reaches `roll_bytes`.  Headers and
SHA-256 digests are made anew.  A file is written under a temporary name that names the attempt
and renamed when it is whole; the partitions' rows of file names, sizes and digests form the
manifest, written by Spark last; then temporary files that dead attempts left are deleted.  Readers open what
the manifest lists and nothing else, and hold a file against its size and digest there.

Equal payloads of at least `least_bytes` are stored once: the one with the smallest page_id is
a response, the others revisit it.  Digests are counted from (page_id, digest) rows; only
the revisits' narrow rows meet the pages, in the one shuffle that sorts them.

Defined results: a null html is empty; repeated rows with the smallest page_id of their
payload are responses all; a null page_id sorts first, is never referred to and refers to
the smallest id if there is one.  Other columns are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.text import shared_path, utf8

ROLL_BYTES, LEAST_BYTES, DATE = 64_000_000, 100, "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6f2cf5c2-6d0e-5b0c-9a55-0d6a4d3b1c11")


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of all pages that revisit another."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= least_bytes)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n", "last")
    return narrow.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: headers from the row, digest of the payload, and the payload unless it is a revisit."""
    digest = hashlib.sha256(payload).hexdigest()
    name = lambda i: f"<urn:uuid:{uuid.uuid5(SPACE, str(i))}>"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without a time, so that equal records give equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, compresslevel=level, mtime=0) as f:
        f.write(data)
    return out.getvalue()


class Roller:
    """Files of one partition: <stem>-00000.warc.gz and so on, each renamed when whole."""

    def __init__(self, folder: str, stem: str, attempt: str, roll_bytes: int):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.stem, self.attempt, self.roll_bytes = stem, attempt, roll_bytes
        self.n, self.out = 0, None
        self.done: list[tuple[str, int, int, str]] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.path}/.tmp-{self.stem}-{self.n:05d}-{self.attempt}"
            self.out, self.size, self.records, self.digest = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.size, self.records = self.size + len(data), self.records + 1
        self.digest.update(data)
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"{self.stem}-{self.n:05d}.warc.gz"
            self.fs.move(self.temporary, f"{self.path}/{name}")
            self.done.append((name, self.records, self.size, self.digest.hexdigest()))
            self.n, self.out = self.n + 1, None


def range_of(pages: DataFrame, parts: int, each: int = 100):
    """The number, from 0, of a page's range: as many of the bounds as are at most its page_id; nulls are in the first.

    Bounds are evenly spaced in about `each` ids a range, chosen by their hash: the same whenever the ids are the same.
    """
    ids = pages.where("page_id is not null").select("page_id")
    share = min(1.0, each * parts / max(1, ids.count()))
    sample = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("page_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().collect())
    bounds = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    if not bounds:
        return F.lit(0)
    known, steps = F.array(*map(F.lit, bounds)), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    fits = lambda low, s: (low + s <= len(bounds)) & (F.try_element_at(known, low + s) <= F.col("page_id"))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, s: F.when(fits(low, s), low + s).otherwise(low))


MANIFEST = "file string, records long, bytes long, sha256 string"


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to folder, which all executors share; returns the manifest."""
    spark = pages.sparkSession
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.lit(None).cast(kind).alias("refers_to"), F.lit(None).cast("string").alias("digest"))
    marks = revisits(pages, least_bytes).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to", "digest")
    # Marks sort before the page that they are about, and equal ids share a partition.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.unionByName(marks).repartitionById(n, range_of(pages, n)).sortWithinPartitions(F.col("page_id"), F.col("html").isNotNull(), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files = Roller(folder, f"part-{task.partitionId():05d}", f"{task.stageId()}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}", roll_bytes)
        page, marks = object(), {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "digest")]
            for i, url, to, digest, html in zip(*columns, utf8(batch.column("html")), strict=True):
                if i != page:
                    page, marks = i, {}
                if html is None:
                    marks[digest] = to
                else:
                    to = marks.get(hashlib.sha256(html).hexdigest()) if marks else None
                    files.add(member(record(i, url, html, to)))
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files.done, strict=True) if files.done else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "records", "bytes", "sha256"])

    manifest = f"{folder}/manifest"
    ordered.mapInArrow(run, MANIFEST).write.parquet(manifest)
    for left in fs.get_file_info(pafs.FileSelector(path)):
        if left.base_name.startswith(".tmp-"):
            fs.delete_file(left.path)
    return spark.read.parquet(manifest)


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at a place: headers, body, and the next place."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    begin, size = end + 4, int(head["Content-Length"])
    return head, data[begin : begin + size], begin + size + 4


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a .warc.gz stream, a gzip member each."""
    rest = b""
    while True:
        z, got = zlib.decompressobj(31), []
        while not z.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    return
            got.append(z.decompress(rest))
            rest = z.unused_data
        data = b"".join(got)
        at = 0
        while at < len(data):
            head, body, at = parse(data, at)
            yield head, body


class Checked:
    """A stream that counts and digests what is read from it."""

    def __init__(self, stream):
        self.stream, self.size, self.digest = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.digest.update(data)
        return data


READ = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}, html string"


def read(spark: SparkSession, folder: str, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """Records of the archives that the folder's manifest lists; sizes and digests of files and of stored payloads are checked."""
    files = spark.read.parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        number = lambda x: None if not x else int(x)
        for batch in batches:
            for name, size, whole in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "sha256")), strict=True):
                rows: list[tuple] = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    checked = Checked(f)
                    for head, body in records_of(checked):
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
                        if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(head["X-Payload-Length"])):
                            raise ValueError(f"{name}: payload of {head['WARC-Record-ID']} differs from its digest")
                        rows.append((number(head["X-Page-ID"]), head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, kind, number(head.get("X-Refers-To-Page-ID")), body.decode() if payloads and kind == "response" else None))
                        if len(rows) == 2000:
                            yield _rows(rows)
                            rows = []
                if (checked.size, checked.digest.hexdigest()) != (size, whole):
                    raise ValueError(f"{name} differs from its manifest")
                if rows:
                    yield _rows(rows)

    spread = files.select("file", "bytes", "sha256").repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 10_000)), "file")
    return spread.mapInArrow(run, READ.format(id=id_type))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = [x.split(" ")[0] for x in READ.format(id="x").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def round_trip(pages: DataFrame, **settings) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    pages = pages.withColumn("page_id", F.col("page_id").cast("long"))
    folder = shared_path(spark, "warc")
    write(pages, folder, **settings)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
