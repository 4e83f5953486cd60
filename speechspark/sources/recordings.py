"""Recordings of any length as PCM blocks: a Python data source whose partitions are byte ranges of files.

``read_recordings`` gives the blocks that ``pcm_blocks`` makes, context included, straight from the files, so
that no row, batch or task holds a whole recording: a long one is read by many tasks at once and short ones
share a task.  Conditions on ``clip_id`` and ``block_idx`` are pushed down; what they exclude is never opened.
``list_recordings`` gives one row per file and opens none.

The folder is any URI that pyarrow opens on the executors.  It is listed once, while planning, and the plan
holds a path and a length per file, as Spark's own file sources do.  Null, empty and odd files: a file of length zero, or of
a length that is no multiple of 4 (if ``strict``), is one row with ``error`` and block 0 without samples; a
folder without recordings gives no rows.  A file that has become shorter since it was listed fails the task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from speechspark.functions.numeric import SAMPLE_RATE
from speechspark.operators.pcm import BLOCK_SAMPLES, CONTEXT
from speechspark.session import ship_package
from speechspark.sources.pcm import CLIP_SUFFIX, MSG_ALIGN, MSG_EMPTY

FORMAT = "speech_recordings"
LISTED = "clip_id string, sample_rate int, n_bytes bigint, n_samples bigint, error string"
BLOCKS = (
    "clip_id string, sample_rate int, n_bytes bigint, block_idx bigint, n_samples bigint, samples array<float>, "
    "before array<float>, after array<float>, error string"
)
#: Bytes and files that one task reads at most, if a block is smaller; both change cost alone.
PARTITION_BYTES = 64 << 20
PARTITION_FILES = 1_024
#: Bytes of samples in one record batch, if a block is smaller.
BATCH_BYTES = 1 << 20
_BOUNDS = {EqualTo: (0, 0), GreaterThanOrEqual: (0, None), GreaterThan: (1, None), LessThanOrEqual: (None, 0), LessThan: (None, -1)}


@dataclass
class Piece:
    """Blocks ``first`` to ``end`` (exclusive) of one file."""

    path: str
    clip_id: str
    n_bytes: int
    error: str | None
    first: int
    end: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(None)
        self.pieces = pieces


class RecordingSource(DataSource):
    """Options: path, glob, recursive, strict, blocks (false: one row per file), block_samples, partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return BLOCKS if self.flag("blocks", True) else LISTED

    def flag(self, name: str, default: bool) -> bool:
        return str(self.options.get(name, default)).lower() == "true"

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader(self)


class RecordingReader(DataSourceReader):
    def __init__(self, source: RecordingSource):
        get = source.options.get
        self.path, self.glob = get("path"), get("glob", f"*{CLIP_SUFFIX}")
        self.recursive, self.strict, self.blocks = source.flag("recursive", False), source.flag("strict", True), source.flag("blocks", True)
        self.block_samples = int(get("block_samples", BLOCK_SAMPLES))
        self.partition_bytes = int(get("partition_bytes", PARTITION_BYTES))
        if not self.path or self.block_samples < 1 or self.partition_bytes < 1:
            raise ValueError("a path, and a positive block_samples and partition_bytes are needed")
        self.ids: set | None = None
        self.least, self.most = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on clip_id and on bounds of block_idx; gives the others back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("clip_id",) and isinstance(f, (EqualTo, In)):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = ids if self.ids is None else self.ids & ids
            elif column == ("block_idx",) and type(f) in _BOUNDS:
                low, high = _BOUNDS[type(f)]
                if low is not None:
                    self.least = max(self.least, f.value + low)
                if high is not None:
                    self.most = f.value + high if self.most is None else min(self.most, f.value + high)
            else:
                yield f

    def _files(self) -> Iterator[Piece]:
        """Every file that is asked for, with the range of its blocks that are."""
        from fnmatch import fnmatchcase

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        root = root.rstrip("/")
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=self.recursive)), key=lambda x: x.path):
            inner = info.path[len(root):].lstrip("/")
            hidden = any(part.startswith(("_", ".")) for part in inner.split("/"))
            if info.type != fs.FileType.File or hidden or not fnmatchcase(info.base_name, self.glob):
                continue
            clip = inner.removesuffix(CLIP_SUFFIX)
            if self.ids is not None and clip not in self.ids:
                continue
            size = info.size
            error = MSG_EMPTY if size == 0 else MSG_ALIGN % size if self.strict and size % 4 else None
            count = 1 if error else max(-(-(size // 4) // self.block_samples), 1)
            end = count if self.most is None else min(count, self.most + 1)
            if self.least < end or not self.blocks:
                yield Piece(info.path, clip, size, error, self.least, end)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        held: list[Piece] = []
        room = per = max(self.partition_bytes // (4 * self.block_samples), 1)
        for f in self._files():
            if not self.blocks:
                held.append(f)
            else:
                # A small file counts by its bytes, so that many of them share a task.
                at = f.first
                while at < f.end:
                    if room <= 0 or len(held) >= PARTITION_FILES:
                        out.append(Pieces(held))
                        held, room = [], per
                    take = min(f.end - at, max(int(room), 1))
                    held.append(Piece(f.path, f.clip_id, f.n_bytes, f.error, at, at + take))
                    room -= min(take, f.n_bytes / (4 * self.block_samples))
                    at += take
            if not self.blocks and len(held) >= 64 * PARTITION_FILES:
                out.append(Pieces(held))
                held = []
        return [*out, Pieces(held)] if held or not out else out

    def read(self, partition: Pieces) -> Iterator:
        return self._read_blocks(partition.pieces) if self.blocks else self._read_list(partition.pieces)

    def _read_list(self, pieces: list[Piece]) -> Iterator:
        import pyarrow as pa

        if pieces:
            n = len(pieces)
            yield pa.RecordBatch.from_arrays([
                pa.array([p.clip_id for p in pieces]), pa.array([SAMPLE_RATE] * n, pa.int32()), pa.array([p.n_bytes for p in pieces], pa.int64()),
                pa.array([p.n_bytes // 4 for p in pieces], pa.int64()), pa.array([p.error for p in pieces], pa.string()),
            ], names=["clip_id", "sample_rate", "n_bytes", "n_samples", "error"])

    def _read_blocks(self, pieces: list[Piece]) -> Iterator:
        import numpy as np
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        size, none = self.block_samples, np.zeros(0, "<f4")
        rows: list[tuple] = []
        held = 0
        for p in pieces:
            n = p.n_bytes // 4
            if p.error or n == 0:
                rows.append((p, 0, none, none, none))
                continue
            with system.open_input_file(p.path) as file:
                for block in range(p.first, p.end):
                    start = block * size
                    low, high = max(start - CONTEXT, 0), min(start + size + CONTEXT, n)
                    raw = file.read_at(4 * (high - low), 4 * low)
                    if len(raw) < 4 * (high - low):
                        raise OSError(f"{p.path} ends before byte {4 * high}")
                    x, lead = np.frombuffer(raw, "<f4"), start - low
                    rows.append((p, block, x[lead:lead + size], x[:lead], x[lead + size:]))
                    held += len(raw)
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]):
    import numpy as np
    import pyarrow as pa

    pieces = [r[0] for r in rows]

    def floats(parts):
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.float32, copy=False)))

    return pa.RecordBatch.from_arrays([
        pa.array([p.clip_id for p in pieces]), pa.array([SAMPLE_RATE] * len(rows), pa.int32()), pa.array([p.n_bytes for p in pieces], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()), pa.array([p.n_bytes // 4 for p in pieces], pa.int64()),
        *(floats([r[k] for r in rows]) for k in (2, 3, 4)), pa.array([p.error for p in pieces], pa.string()),
    ], names=["clip_id", "sample_rate", "n_bytes", "block_idx", "n_samples", "samples", "before", "after", "error"])


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(RecordingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(**options).load(path)


def read_recordings(
    spark: SparkSession, path: str, glob: str = f"*{CLIP_SUFFIX}", recursive: bool = False, strict: bool = True,
    block_samples: int = BLOCK_SAMPLES, partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """clip_id, sample_rate, n_bytes, block_idx, n_samples (of the clip), samples, before, after, error.

    ``split_failures`` parts the usable blocks from the rows of files that failed a check.
    """
    return _load(spark, path, glob=glob, recursive=recursive, strict=strict, block_samples=block_samples, partition_bytes=partition_bytes)


def list_recordings(spark: SparkSession, path: str, glob: str = f"*{CLIP_SUFFIX}", recursive: bool = False, strict: bool = True) -> DataFrame:
    """clip_id, sample_rate, n_bytes, n_samples, error: one row per recording, from its length alone."""
    return _load(spark, path, glob=glob, recursive=recursive, strict=strict, blocks=False)
