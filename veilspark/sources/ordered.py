"""A sink for one file whose lines keep the order of the rows: a table with its header once, or plain lines.

Each task writes a part of its own; the commit puts the parts of the tasks that Spark counts together in the order of the partitions and
moves the whole to its place, so that readers see the old file or the new one. What failed or repeated tasks have left is deleted.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PIECE = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    place: str
    rows: int


class OrderedFile(DataSource):
    """Format `ordered_file`. Options: path; kind, `csv` (with a header, cells quoted where they must be) or `lines` (one text column);
    single, `true` for one file at path, or `false` for a folder of parts in order of which only the first has the header, for tables
    that are too large to be one file."""

    @classmethod
    def name(cls) -> str:
        return "ordered_file"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return _Writer(o["path"], o.get("kind", "csv"), o.get("single", "true") == "true", [f.name for f in schema.fields], overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, single: bool, names: list[str], overwrite: bool) -> None:
        if kind not in ("csv", "lines") or (kind == "lines" and len(names) != 1):
            raise ValueError("kind is csv, or lines with one column")
        self.path, self.kind, self.single, self.names, self.overwrite = path.rstrip("/"), kind, single, names, overwrite
        # Of this write alone: another one to the same place has its own.
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def _system(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)

    def _lines(self, rows: Iterator[tuple]) -> bytes:
        out = io.StringIO(newline="")
        if self.kind == "csv":
            csv.writer(out, lineterminator="\n").writerows(["" if v is None else v for v in r] for r in rows)
        else:
            out.writelines(f"{'' if r[0] is None else r[0]}\n" for r in rows)
        return out.getvalue().encode()

    def write(self, iterator) -> WriterCommitMessage:
        partition = TaskContext.get().partitionId()
        system, place = self._system(f"{self.staging}/{partition:06d}-{uuid.uuid4().hex}")
        system.create_dir(place.rpartition("/")[0], recursive=True)
        n = 0
        with system.open_output_stream(place, compression=None) as out:
            for batch in iterator:
                out.write(self._lines(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
                n += batch.num_rows
        return Part(partition, place, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        system, target = self._system(self.path)
        if system.get_file_info(target).type != fs.FileType.NotFound and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(target)
        staging = self._system(self.staging)[1]
        system.create_dir(staging, recursive=True)
        header = self._lines(iter([tuple(self.names)])) if self.kind == "csv" else b""
        whole = f"{staging}/whole"
        if self.single:
            with system.open_output_stream(whole, compression=None) as out:
                out.write(header)
                for m in parts:
                    self._copied(system, m.place, out)
        else:
            system.create_dir(whole)
            for i, m in enumerate(parts):
                if i or not header:
                    system.move(m.place, f"{whole}/{i:06d}")
            if header:
                with system.open_output_stream(f"{whole}/{0:06d}", compression=None) as out:
                    out.write(header)
                    if parts:
                        self._copied(system, parts[0].place, out)
        old = system.get_file_info(target).type
        if old == fs.FileType.Directory:
            system.delete_dir(target)
        elif old == fs.FileType.File and not self.single:
            system.delete_file(target)
        system.move(whole, target)
        system.delete_dir(staging)

    def _copied(self, system, place: str, out) -> None:
        with system.open_input_stream(place, compression=None) as source:
            while piece := source.read(PIECE):
                out.write(piece)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, staging = self._system(self.staging)
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)
