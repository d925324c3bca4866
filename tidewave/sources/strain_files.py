"""A Spark data source over folders of strain blocks: one file of samples for each block, read in fetch groups.

A block of detector D that begins at second G and lasts S seconds is the file `D-G-S.f8`: its samples as little-endian
64-bit numbers. The folder is a local path or any address that pyarrow's file systems know.

    spark.dataSource.register(StrainFiles)
    spark.read.format("strain_files").option("path", folder).load().where("detector = 'H1' and gps >= 100")

A partition is a fetch group: up to `group` blocks of a detector that follow one another. Limits on detector and gps
choose files by their names (with spark.sql.python.filterPushdown.enabled), and a schema without strain opens no file.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = re.compile(r"(?P<detector>[^-/]+)-(?P<gps>-?\d+)-(?P<seconds>\d+)\.f8")
SCHEMA = "detector string, gps bigint, seconds int, strain array<double>"
_KINDS = {"detector": pa.string(), "gps": pa.int64(), "seconds": pa.int32(), "strain": pa.list_(pa.float64())}
_LIMITS = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v,
}


def _located(path: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"(?:file:)?/+", path)
    return (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Block:
    detector: str
    gps: int
    seconds: int

    @property
    def name(self) -> str:
        return f"{self.detector}-{self.gps}-{self.seconds}.f8"


@dataclass
class FetchGroup(InputPartition):
    blocks: list[Block]


def fetch_groups(blocks: Iterable[Block], most: int) -> list[list[Block]]:
    """Blocks of a detector that follow one another, at most so many together."""
    out: list[list[Block]] = []
    for b in sorted(blocks, key=lambda b: (b.detector, b.gps)):
        last = out[-1][-1] if out else None
        if last and len(out[-1]) < most and (last.detector, last.gps + last.seconds) == (b.detector, b.gps):
            out[-1].append(b)
        else:
            out.append([b])
    return out


class StrainReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.fieldNames()
        self.path, self.group = options["path"], int(options.get("group", "4"))
        self.retries, self.wait = int(options.get("retries", "3")), float(options.get("wait", "0.5"))
        self.bad, self.missing, self.rate = options.get("bad", "error"), options.get("missing", "error"), int(options.get("rate", "0"))
        self.whole = options.get("whole", "false").lower() == "true"
        self.limits: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _LIMITS and f.attribute in (("detector",), ("gps",), ("seconds",)):
                self.limits.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[FetchGroup]:
        files, root = _located(self.path)
        names = (NAME.fullmatch(i.base_name) for i in files.get_file_info(fs.FileSelector(root)) if i.is_file)
        found = [Block(m["detector"], int(m["gps"]), int(m["seconds"])) for m in names if m]
        groups = fetch_groups((b for b in found if all(_LIMITS[kind](getattr(b, name), v) for name, kind, v in self.limits)), self.group)
        if self.whole:
            for a, b in zip(groups, groups[1:], strict=False):
                end = a[-1].gps + a[-1].seconds
                if a[-1].detector == b[0].detector and end != b[0].gps:
                    raise ValueError(f"no block of {b[0].detector} from {end} to {b[0].gps}")
        return [FetchGroup(g) for g in groups]

    def samples(self, files: fs.FileSystem, path: str, block: Block) -> np.ndarray | None:
        """A block's samples; a file that fails or is too short is tried again, after a wait that doubles."""
        for tried in range(self.retries + 1):
            try:
                with files.open_input_stream(path) as f:
                    data = f.read()
                if len(data) % 8 or (self.rate and len(data) != 8 * self.rate * block.seconds):
                    raise OSError(f"{block.name} has {len(data)} bytes")
                break
            except OSError as e:
                if tried == self.retries:
                    if self.missing == "skip" and isinstance(e, FileNotFoundError):
                        return None
                    raise OSError(f"no strain of {block.name} after {tried + 1} attempts: {e}") from e
                time.sleep(self.wait * 2**tried)
        x = np.frombuffer(data, "<f8")
        if not np.isfinite(x).all():
            if self.bad == "skip":
                return None
            raise ValueError(f"{block.name} holds samples that are not finite")
        return x

    def read(self, partition: FetchGroup) -> Iterator[pa.RecordBatch]:
        files, root = _located(self.path)
        for b in partition.blocks:  # one block a batch: no more is held at once
            row = {"detector": b.detector, "gps": b.gps, "seconds": b.seconds}
            if "strain" in self.columns:
                row["strain"] = self.samples(files, f"{root}/{b.name}", b)
                if row["strain"] is None:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], _KINDS[c]) for c in self.columns], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class StrainWriter(DataSourceArrowWriter):
    """Each attempt of a task writes to a folder of its own; files of those that succeed are moved into place at the end, whole."""

    def __init__(self, options: dict[str, str]):
        self.path, self.staging = options["path"], f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _located(self.path)
        folder, names = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        files.create_dir(folder)
        for batch in iterator:
            for row in range(batch.num_rows):
                block = Block(*(batch.column(c)[row].as_py() for c in ("detector", "gps", "seconds")))
                with files.open_output_stream(f"{folder}/{block.name}") as f:
                    f.write(batch.column("strain")[row].values.to_numpy(zero_copy_only=False).astype("<f8").tobytes())
                names.append(block.name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _located(self.path)
        for m in filter(None, messages):
            for name in m.names:
                files.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = _located(self.path)
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


class StrainFiles(DataSource):
    """Options: path; group (blocks in a partition, 4); retries (3) and wait (0.5 s before the first); rate (samples a second: a file of another length is not whole yet);

    bad: error or skip, for samples that are not finite; missing: error or skip, for a listed file that is gone; whole: an error for holes between the chosen blocks.
    """

    @classmethod
    def name(cls) -> str:
        return "strain_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> StrainReader:
        return StrainReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> StrainWriter:
        if overwrite:
            raise ValueError("blocks are added to a folder (mode append); one of the same name takes the place of the old one")
        return StrainWriter(self.options)
