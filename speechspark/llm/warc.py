"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id into shards of about equal payload, cut from an exact histogram of id
ranges that is refined where it is crowded (so the cuts are the same in every run).  A shard is written in order, one gzip member
per record, and rolls to a new file by compressed size.  Headers, ids and digests are made anew from the
data; the date is a parameter.  Tasks write under temporary names that no other attempt has and return
manifest rows; only files in the manifest that Spark kept are renamed to their final names, a step that may
be repeated.  Lost executors and second attempts leave at most unused temporary files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from speechspark.llm.common import stored

CELLS = 16_384
#: How often a crowded range of ids is cut again.
LEVELS = 5
SHARD_MB = 16
FILE_MB = 8
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "shard int, file int, temporary string, name string, bytes long, sha256 string, records long"


def _base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes, revisit: bool, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers (with the payload's length) and no payload."""
    digest = _base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {safe}", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{_base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                 f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Files:
    """Writes the records of one shard after another, rolling by compressed size."""

    def __init__(self, folder: str, file_bytes: int, level: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.most, self.level, self.attempt = file_bytes, level, uuid.uuid4().hex
        self.shard = self.out = None
        self.done: list[dict] = []

    def _open(self, shard: int, number: int) -> None:
        temporary = f"_temporary/{self.attempt}-{shard:06d}-{number:05d}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.out, self.shard, self.number = self.fs.open_output_stream(f"{self.root}/{temporary}"), shard, number
        self.temporary, self.size, self.records, self.sha = temporary, 0, 0, hashlib.sha256()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append({
                "shard": self.shard, "file": self.number, "temporary": self.temporary,
                "name": f"part-{self.shard:06d}-{self.number:05d}.warc.gz",
                "bytes": self.size, "sha256": self.sha.hexdigest(), "records": self.records})

    def add(self, shard: int, data: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        if self.out is None or shard != self.shard:
            self.close()
            self._open(shard, 0)
        elif self.size + len(member) > self.most:
            self.close()
            self._open(shard, self.number + 1)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two longs, towards zero."""
    return F.call_function("div", a, b)


def _sharded(narrow: DataFrame, shard_bytes: int) -> tuple[int, Callable[[DataFrame], DataFrame]]:
    """The number of shards, and a step that adds ``shard`` to rows with ``i`` and ``d``.

    The cuts follow the order (i, d), nulls first.

    ``narrow`` (``i``, ``d``, ``n``) is summed over ``CELLS`` equal ranges of ids.  A range with more than a
    shard's bytes is cut again between its own least and greatest id, and a single id by the digest, so that
    far-off ids or an id of many rows don't put everything into one shard.  At most ``CELLS`` ranges are cut
    at a time, into six times as many at most; these small tables are all that is broadcast.
    """
    ends = narrow.agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.sum(F.col("n") + 512).alias("bytes")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    limit = max(shard_bytes, (ends["bytes"] or 0) // CELLS, 1)
    width = (hi - lo) // CELLS + 1
    # Quotients differ by CELLS at most, so extreme ids don't overflow; division towards zero keeps the order.
    start = F.coalesce(_div(F.col("i"), F.lit(width)) - _div(F.lit(lo), F.lit(width)), F.lit(-1).cast("long"))
    digest = F.conv(F.substring("d", 1, 8), 16, 10).cast("long")
    path, cuts = ["c0"], []

    def place(df: DataFrame) -> DataFrame:
        df = df.withColumn("c0", start)
        for k, cut in enumerate(cuts):
            df = df.join(F.broadcast(cut), path[:k + 1], "left")
            key = F.when(F.col("cut.one_id"), digest).otherwise(F.col("i"))
            sub = _div(key, F.col("cut.width")) - _div(F.col("cut.least"), F.col("cut.width"))
            df = df.withColumn(path[k + 1], F.coalesce(sub, F.lit(0).cast("long"))).drop("cut")
        return df

    while True:
        spans = lambda c: F.struct(F.min(c).alias("least"), F.max(c).alias("most"))
        cells = stored(place(narrow).groupBy(*path).agg(
            F.sum(F.col("n") + 512).alias("bytes"), spans(F.col("i")).alias("ids"), spans(digest).alias("digests")), "cells")
        one_id = F.coalesce(F.col("ids.least") == F.col("ids.most"), F.lit(True))
        heavy = (
            cells.filter(F.col("bytes") > limit)
            .select(*path, "bytes", one_id.alias("one_id"), F.when(one_id, F.col("digests")).otherwise(F.col("ids")).alias("x"))
            .filter("x.least < x.most")
        )
        parts = _div(F.col("bytes"), F.lit(limit)) * 4 + 2
        width = _div(F.col("x.most"), parts) - _div(F.col("x.least"), parts) + 1
        cut = F.struct("one_id", F.col("x.least").alias("least"), width.alias("width"))
        heavy = stored(heavy.select(*path, cut.alias("cut")), "heavy")
        if len(path) > LEVELS or heavy.first() is None:
            break
        cuts.append(heavy)
        path = [*path, f"c{len(path)}"]
    before = F.sum("bytes").over(Window.orderBy(*path)) - F.col("bytes")
    shards = stored(cells.select(*path, (before / shard_bytes).cast("int").alias("shard")), "shards")
    last = shards.agg(F.max("shard").alias("last")).first()["last"] or 0
    return last + 1, lambda df: place(df).join(F.broadcast(shards), path).drop(*path)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *,
    min_revisit_bytes: int = 0, shard_mb: float = SHARD_MB, file_mb: float = FILE_MB, level: int = LEVEL, date: str = DATE,
) -> DataFrame:
    """Write all rows to ``folder`` (any URI that pyarrow opens on the executors) and return the manifest.

    Payloads of at least ``min_revisit_bytes`` that occur again are written once: the smallest id is the
    response, others revisit it.  Rows that repeat an id and a payload are revisits of the first.  A null
    payload is empty, a null url too; null ids sort first, and are the response only if no equal payload
    has an id.  The id is a whole number; other columns are not read.  An empty table writes no file.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), payload.alias("p"))
    rows = rows.withColumns({"d": F.sha2("p", 256), "n": F.octet_length("p").cast("long")})
    narrow = stored(rows.select("i", "d", "n"), "narrow")
    first = narrow.groupBy("d").agg(F.min("i").alias("least"))
    revisits = (
        narrow.join(first, "d").filter(~F.col("i").eqNullSafe(F.col("least")) & (F.col("n") >= min_revisit_bytes))
        .select("i", "d", "least").distinct()
    )
    void = lambda name, kind: F.lit(None).cast(kind).alias(name)
    told = revisits.select("i", "d", F.lit(0).alias("o"), "least", void("u", "string"), void("p", "binary"))
    full = rows.select("i", "d", F.lit(1).alias("o"), void("least", "long"), "u", "p")
    n_shards, sharded = _sharded(narrow, int(shard_mb * 2**20))
    both = sharded(told.unionByName(full))
    # One task per shard: a partition by size or hash would give some tasks several.
    ordered = both.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", F.col("i").asc_nulls_first(), "d", "o", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, told, last = _Files(folder, int(file_mb * 2**20), level), None, None
        for b in batches:
            for row in range(b.num_rows):
                i, d, o, least, url, data, shard = (c[row].as_py() for c in b.columns)
                if o == 0:
                    told = (i, d, least)
                    continue
                if told is not None and told[:2] == (i, d):
                    revisit, of = True, told[2]
                else:  # the same id and payload again
                    revisit, of = last == (i, d) and len(data) >= min_revisit_bytes, i
                last = (i, d)
                files.add(shard, record(i, url, data, revisit, of if revisit else None, date))
        files.close()
        yield pa.RecordBatch.from_pylist(files.done, schema=_manifest_schema())

    written = stored(ordered.select("i", "d", "o", "least", "u", "p", "shard").mapInArrow(run, MANIFEST), "written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for x in b.to_pylist():
                source, target = f"{root}/{x['temporary']}", f"{root}/{x['name']}"
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.move(source, target)
                if system.get_file_info(target).size != x["bytes"]:
                    raise OSError(f"{target} was not committed whole")
            yield b

    # The manifest is written last: an archive set without one isn't committed.
    manifest = written.mapInArrow(commit, MANIFEST).drop("temporary")
    manifest.write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def _manifest_schema() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("temporary", pa.string()), ("name", pa.string()),
                      ("bytes", pa.int64()), ("sha256", pa.string()), ("records", pa.int64())])


def _fields(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream) -> Iterator[dict]:
    """Records of one decompressed archive; digests are checked against what is read."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _fields(stream)
        block = stream.read(int(head["content-length"]))
        stream.read(4)
        if f"sha1:{_base32_sha1(block)}" != head["warc-block-digest"]:
            raise ValueError("block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head["warc-type"] == "revisit"
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and (len(payload) != length or _base32_sha1(payload) != digest):
            raise ValueError("payload digest differs")
        number = lambda k: int(head[k]) if head.get(k) else None  # noqa: B023, E731
        yield {
            "page_id": number("x-page-id"), "url": head.get("warc-target-uri"), "payload_bytes": length,
            "payload_digest": digest, "record_type": head["warc-type"],
            "refers_to": number("x-refers-to-page-id") if revisit else None, "payload": None if revisit else payload}


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the archives in a manifest without their payloads; files are read as streams, about one a task."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[dict] = []
                with system.open_input_file(f"{root}/{name}") as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for x in read_records(stream):
                        rows.append({k: v for k, v in x.items() if k != "payload"})
                        if len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # Names are few bytes and would be packed into one task by size.
    return manifest.select("name").repartition(max(manifest.count(), 1)).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
