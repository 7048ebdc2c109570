"""Deterministic sharded WARC 1.1 archives: a writer that commits through temporary names and manifests, and a reader.

Records are range-sorted by id, and those of one id by a hash of their url, so a shard holds one interval. Tasks roll files by compressed size
and write them under names of their attempt; files.py commits them and lets a write go on after a dead driver. Headers and digests are
regenerated from the payload; the same rows in the same partitioning give the same bytes. The reader holds each file against its row of the
manifest: one that is missing, cut, swapped or short of a record raises.

Payloads that occur more than once are stored once, as the response with the largest id; the others are revisit records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import Scratch, look_up, need_whole_numbers, partitions, prepare

RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"


#: Rows of one id, or without one, are dealt to so many intervals of the range sort by their url.
SALTS = 64


def mark_of(url: str | None, sha: str) -> str:
    """Tells records of one id apart: by url and payload."""
    return hashlib.sha1(f"{url or ''}\0{sha}".encode()).hexdigest()[:16]


def record_id(page_id: int | None, mark: str, occurrence: int = 0) -> str:
    """Unique: rows equal in id, url and payload are numbered."""
    return f"<urn:warc-page:{'none' if page_id is None else page_id}:{mark}{f':{occurrence}' if occurrence else ''}>"


def page_of(value: str) -> int | None:
    number = value.strip("<>").split(":")[2]
    return None if number == "none" else int(number)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def uri(url: str | None) -> str:
    """A header value: line ends and other control characters, which would end the header, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str] | None, occurrence: int = 0) -> bytes:
    """A response, or a revisit of the record (page_id, mark) that ``refers_to`` names."""
    digest, is_revisit = base32_sha1(payload), refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, mark_of(url, hashlib.sha1(payload).hexdigest()), occurrence)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp, so equal records give equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def revisits(pages: DataFrame, page_id: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """(page_id, salt, digest, refers_to, target) of the rows that revisit another; ``target`` is the mark of the record with the largest
    id. Rows tied at that id are all responses; so are rows without an id whose payload no row with an id has."""
    digest = F.sha1(F.col(payload).cast("binary"))
    mark = F.substring(F.sha1(F.concat(F.coalesce(F.col(url), F.lit("")), F.lit("\0"), digest)), 1, 16)
    slim = pages.where(F.octet_length(payload) >= min_bytes).select(F.col(page_id).alias("_id"), _salt(F.col(url)).alias("_part"), digest.alias("_digest"), mark.alias("_mark"))
    most = F.max(F.when(F.col("_id").isNotNull(), F.struct("_id", "_mark")))
    many = slim.groupBy("_digest").agg(most.alias("_most"), F.count("*").alias("_n")).where("_n > 1 and _most is not null").select("_digest", "_n", F.col("_most._id").alias("refers_to"), F.col("_most._mark").alias("target"))
    total = pages.count()
    found = look_up(slim, many, ["_digest"], "_n", total, F.concat_ws(" ", "_id", "_mark"), "inner")
    return found.where(F.col("_id").isNull() | (F.col("_id") < F.col("refers_to"))).select("_id", "_part", "_digest", "refers_to", "target").distinct()


def _salt(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(SALTS)).cast("int")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per row to ``folder`` and return the manifest of its files.

    A null payload is empty; null and repeated ids are kept, each row as a record of its own; an empty table gives an empty manifest. Ids must be whole
    numbers, else TypeError. Other columns are ignored, whatever their names. A folder that is written already is refused; one whose driver died is gone on with,
    given the same rows.
    """
    spark = pages.sparkSession
    prepare(spark)
    need_whole_numbers(pages, page_id)
    scratch = Scratch(spark, "warc-marks")
    own = pages.select(F.col(page_id).cast("bigint").alias("_id"), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_payload"))
    marks = scratch.save(revisits(own, "_id", "_url", "_payload", min_revisit_bytes), "marks")
    none = lambda kind: F.lit(None).cast(kind)
    rows = own.select("_id", _salt(F.col("_url")).alias("_part"), F.lit(1).alias("_kind"), "_url", "_payload", F.sha1("_payload").alias("_digest"), none("bigint").alias("_refers"), none("string").alias("_target"))
    marked = marks.select("_id", "_part", F.lit(0).alias("_kind"), none("string").alias("_url"), none("binary").alias("_payload"), "_digest", F.col("refers_to").alias("_refers"), F.col("target").alias("_target"))
    # A mark is dealt to the shard of its rows and sorted before them: payloads are shuffled once, not once more for a join. Rows
    # without an id, and those of a repeated one, lie in SALTS intervals, so none of these ids is one task's.
    both = rows.unionByName(marked).withColumn("_sort", F.coalesce("_id", F.lit(-(2**63))))
    ordered = both.repartitionByRange(partitions(spark), "_sort", "_part").sortWithinPartitions("_sort", "_part", "_kind", "_digest", "_url").drop("_sort")
    temporary = files.temporary_of(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, part, done = None, 0, []
        here: tuple = ()
        targets: dict[str, tuple[int, str]] = {}
        last, again = None, 0

        for batch in batches:
            for key, salt, kind, link, body, sha, refers, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (key, salt):
                    here, targets = (key, salt), {}
                if not kind:
                    targets[sha] = (refers, target)
                    continue
                again = again + 1 if last == (key, link, sha) else 0
                last = (key, link, sha)
                data = member(record(key, link, body, targets.get(sha), again))
                if out is not None and out.size + len(data) > roll_bytes:
                    done.append(out.close())
                    out, part = None, part + 1
                if out is None:
                    out = files.Output(temporary, f"shard-{shard:06d}-{part:05d}.warc.gz", attempt, shard, part)
                out.write(data)
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], files.arrow_schema(files.MANIFEST).names).cast(files.arrow_schema(files.MANIFEST))

    listed = files.commit(spark, folder, lambda: ordered.mapInArrow(run, files.MANIFEST))
    scratch.drop(marks)
    return listed


def _inflated(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of many members, in pieces."""
    packed, z = b"", zlib.decompressobj(31)
    while True:
        if not packed and not (packed := stream.read(chunk)):
            return
        yield z.decompress(packed)
        packed = z.unused_data
        if z.eof:
            z = zlib.decompressobj(31)
        else:
            packed = b""


class _Reader:
    def __init__(self, stream):
        self.more, self.held = _inflated(stream), bytearray()

    def _fill(self) -> bool:
        for piece in self.more:
            if piece:
                self.held += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self._fill():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._fill():
                raise ValueError("the record is cut short")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(stream) -> Iterator[dict]:
    """Records of one file. Digests of blocks and payloads are computed anew and must agree with the headers."""
    r = _Reader(stream)
    while (head := r.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = r.take(int(fields["Content-Length"]))
        r.take(4)
        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(http.rpartition(b"Content-Length: ")[2])
        revisit, digest = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (digest != base32_sha1(payload) or n != len(payload)):
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
        yield {
            "page_id": page_of(fields["WARC-Record-ID"]),
            "url": fields["WARC-Target-URI"],
            "payload_bytes": n,
            "payload_digest": digest,
            "record_type": fields["WARC-Type"],
            "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
            "payload": None if revisit else payload,
        }


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all files in the manifest, one task per group of files; a revisit has a null payload. A folder without a committed manifest raises,
    and so does a file that is missing or differs in size, digest or number of records from its row, or holds a damaged record."""
    manifest = files.manifest(spark, folder).select("name", "n_bytes", "n_records", "sha1")
    schema = RECORDS if payloads else RECORDS.rpartition(", ")[0]
    arrow = files.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, at = files.opened(folder)
                with store.open_input_stream(f"{at}/{row['name']}", compression=None) as stream:
                    held: list[dict] = []
                    size = n = 0
                    checked = files.Checked(stream, row)
                    for found in parse(checked):
                        held.append(found)
                        n += 1
                        size += 200 + (found["payload_bytes"] if payloads else 0)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held, size = [], 0
                    checked.close(n)
                    if held:
                        yield pa.RecordBatch.from_pylist(held, arrow)

    return manifest.repartition(partitions(spark)).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to the shared folder and read the records back, without payloads."""
    spark = pages.sparkSession
    folder = f"{Scratch(spark, 'warc').root}/archive"
    write(pages, folder, min_revisit_bytes=min_revisit_bytes)
    return read(spark, folder, payloads=False)
