"""Deterministic sharded WARC writer and a reader that checks what was written.

Rows are dealt to shards by ranges of (page id, digest), cut where the running payload bytes
pass the shard size, so the shards follow from the data alone and not from the cluster. A shard is sorted by id and streamed into gzip members, one for each
record; a file rolls when its compressed size is reached. Headers, record ids and digests
are made anew from the row. Tasks write under temporary names and report them in a
manifest; only what the manifest lists is renamed, so retried and speculative attempts
leave nothing behind that a reader would see.

Payloads cross the network once: which records revisit another is settled on digests, and
those decisions join the sorted stream of the shard as rows of their own.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import NULL_ID, id_key, key_id, materialise, open_fs, partitions, running_totals, scratch_dir

#: Equal ranges of page ids in which the starts of shards are looked up.
CELLS = 1 << 16
#: Fixed value: the date of all records, as nothing in a row tells it.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard long, seq long, temporary string, file string, records long, bytes long, sha256 string"


def revisits(meta: DataFrame, min_bytes: int) -> DataFrame:
    """``page, digest, head``: records whose payload a record with a smaller id holds."""
    heads = meta.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page").alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
    return meta.join(materialise(heads, "heads"), "digest").where("page != head").select("page", "digest", "head").distinct()


def shard_ranges(meta: DataFrame, shard_bytes: int) -> tuple[DataFrame, Column, Column, int]:
    """How to find the shard of a record: a table ``cell, base, starts``, the cell of a
    ``page``, the shard of a row joined with the table, and the number of shards.

    Records in the order of (page, digest) are cut where their running bytes pass a multiple
    of ``shard_bytes``: no shard has more, but for its last record, whatever the ids are. The
    first record of each shard, a few dozen bytes, comes to the driver; ``CELLS`` equal
    ranges of ids tell which of these a row has to be compared with.
    """
    sized = meta.groupBy("page", "digest").agg(F.sum(F.col("n") + 400).alias("w"))
    placed = running_totals(sized, [F.col("page"), F.col("digest")], {"end": F.col("w")}, "placed")
    first = placed.groupBy(F.floor((F.col("end") - F.col("w")) / shard_bytes).alias("at")).agg(F.min(F.struct("page", "digest")).alias("s"))
    starts = sorted(tuple(r.s) for r in first.collect())
    low, high = meta.where(F.col("page") != NULL_ID).agg(F.min("page"), F.max("page")).first()
    low, high = (0, 0) if low is None else (low, high)
    width = (high - low) // CELLS + 1
    of = lambda page: CELLS if page == NULL_ID else (page - low) // width
    inside: dict[int, list] = {}
    for start in starts:
        inside.setdefault(of(start[0]), []).append(start)
    table, base = [], 0
    for k in range(CELLS + 1):
        table.append((k, base, inside.get(k, [])))
        base += len(inside.get(k, []))
    cells = meta.sparkSession.createDataFrame(table, "cell long, base int, starts array<struct<page:bigint,digest:string>>")
    cell = F.when(F.col("page") == NULL_ID, F.lit(CELLS)).otherwise(F.expr(f"(page - {low}L) div {width}L")).cast("long")
    passed = F.size(F.filter("starts", lambda s: s <= F.struct("page", "digest")))
    return cells, cell, (F.col("base") + passed - 1).cast("int"), len(starts)


def _headers(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [f"{k}: {''.join(c if ord(c) > 31 and ord(c) != 127 else f'%{ord(c):02X}' for c in v)}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode("utf-8", "surrogatepass")


def record(page: int, url: str | None, payload: bytes | None, digest: str, size: int, head: int | None, nth: int) -> bytes:
    """The bytes of one record. Without a ``payload`` it is a revisit of page ``head``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if head is None else http
    name = lambda p, k: f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{p}:{digest}:{k}'.encode()).hexdigest()[:32])}>"
    fields = [
        ("WARC-Type", "response" if head is None else "revisit"),
        ("WARC-Record-ID", name(page, nth)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", None if head is None else _PROFILE),
        ("WARC-Refers-To", None if head is None else name(head, 0)),
        ("WARC-Page", str(page)),
        ("WARC-Refers-To-Page", None if head is None else str(head)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _headers(fields) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with no time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Shard:
    """Rolling files of one shard under temporary names."""

    def __init__(self, fs, root: str, shard: int, roll_bytes: int):
        self.fs, self.root, self.shard, self.roll = fs, root, shard, roll_bytes
        self.attempt, self.done, self.out = uuid.uuid4().hex, [], None

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.seq = len(self.done)
            self.name = f"_temporary/{self.attempt}-{self.shard:06d}-{self.seq:05d}"
            self.out, self.size, self.records, self.hash = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.shard, self.seq, self.name, f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz", self.records, self.size, self.hash.hexdigest()))


def _writer(root: str, roll_bytes: int, min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(root)
        fs.create_dir(f"{path}/_temporary", recursive=True)
        shard, done, heads, last, nth = None, [], {}, None, 0
        for batch in batches:
            for s, page, url, payload, digest, size, head in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is None or shard.shard != s:
                    if shard is not None:
                        shard.close()
                        done += shard.done
                    shard = _Shard(fs, path, s, roll_bytes)
                if page != last:
                    heads, last, seen = {}, page, {}
                if payload is None:  # a decision, ahead of the records of its page
                    heads[digest] = head
                    continue
                nth = seen.get(digest, 0)
                seen[digest] = nth + 1
                of = heads.get(digest, page if nth and size >= min_bytes else None)
                shard.write(member(record(page, url, payload if of is None else None, digest, size, of, nth)))
        if shard is not None:
            shard.close()
            done += shard.done
        names = [f.split()[0] for f in _MANIFEST.split(", ")]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)

    return run


def _committer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(root)
        for batch in batches:
            for old, new in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist()):
                # A second attempt finds the file in place.
                if fs.get_file_info(f"{path}/{old}").type != pafs.FileType.NotFound:
                    fs.move(f"{path}/{old}", f"{path}/{new}")
            yield batch

    return run


def write_warc(pages: DataFrame, root: str, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20, min_bytes: int = 100) -> DataFrame:
    """Write ``page_id, url, html`` as WARC files under ``root``; return the manifest.

    Of records with equal payloads of ``min_bytes`` or more the one with the smallest
    page_id is a response, the others revisit it; smaller payloads are all responses. A
    null html is an empty payload and a null url leaves its header out; a null page_id
    sorts last; of rows that repeat a page_id and a payload the first is the response.
    Other columns are ignored. No rows give an empty manifest and no files.

    Shards hold ``shard_bytes`` of payload and headers, or one record where that alone has
    more; the files of a shard roll at ``roll_bytes``. Equal rows and parameters give equal
    files under equal names.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(id_key("page_id").alias("page"), "url", payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    meta = materialise(base.select("page", "digest", "n"), "digests")
    cells, cell, shard, n_shards = shard_ranges(meta, shard_bytes)
    none = F.lit(None)
    decided = revisits(meta, min_bytes).select("page", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "digest", none.cast("long").alias("n"), "head")
    rows = base.withColumn("head", none.cast("long")).unionByName(decided)
    dealt = rows.withColumn("cell", cell).join(F.broadcast(cells), "cell").select(shard.alias("shard"), "page", "url", "payload", "digest", "n", "head")
    order = ["shard", "page", F.col("payload").isNotNull(), "digest", "url"]
    # A task for each shard.
    dealt = dealt.repartitionById(max(1, n_shards), "shard").sortWithinPartitions(*order)
    written = materialise(dealt.mapInArrow(_writer(root, roll_bytes, min_bytes), _MANIFEST), "manifest")
    manifest = materialise(written.mapInArrow(_committer(root), _MANIFEST), "committed")
    fs, path = open_fs(root)
    fs.create_dir(path, recursive=True)
    manifest.drop("temporary").write.mode("overwrite").parquet(f"{root}/_manifest")
    total = manifest.agg(F.count("*"), F.sum("records"), F.sum("bytes")).first()
    with fs.open_output_stream(f"{path}/_SUCCESS") as out:
        out.write(json.dumps({"files": total[0], "records": total[1] or 0, "bytes": total[2] or 0}).encode())
    return manifest.drop("temporary")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            fields[k.lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        yield fields, block


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(root)
        names = ["page", "payload_bytes", "payload_digest", "record_type", "head"]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as stream:
                    for fields, block in read_records(io.BufferedReader(stream)):
                        header, _, payload = block.partition(b"\r\n\r\n")
                        size = int(header.rpartition(b"Content-Length: ")[2])
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        full = fields["warc-type"] == "response"
                        if fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or full and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"a digest or length in {file} is wrong")
                        head = fields.get("warc-refers-to-page")
                        rows.append((int(fields["warc-page"]), size, digest, fields["warc-type"], head and int(head)))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of all records of
    the manifest; lengths and digests are checked against the bytes."""
    files = spark.read.parquet(f"{root}/_manifest").select("file")
    rows = files.repartition(partitions(spark), "file").mapInArrow(_reader(root), "page long, payload_bytes long, payload_digest string, record_type string, head long")
    return rows.select(key_id("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key_id("head").alias("refers_to"))


def warc_digest(pages: DataFrame) -> DataFrame:
    root = scratch_dir(pages.sparkSession, "warc")
    write_warc(pages.select("page_id", "url", "html"), root)
    return read_warc(pages.sparkSession, root)


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, h, min(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> head THEN head END AS refers_to
FROM q
"""
