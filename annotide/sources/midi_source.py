"""Folders of MIDI files as a data source: spark.read.format("midi") and write.format("midi")."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from annotide.sources.midi import EVENTS, NAMES, STATUS, event_batches, file_events, head_bytes, message, meta, track_bytes

#: Bytes of files that a partition reads, at most, unless one file alone is larger.
PARTITION_BYTES = 1 << 20


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    moves: tuple[tuple[str, str], ...]


class MidiSource(DataSource):
    """Events of the files *.mid below a path, or files made of events.

    Options: path; mode, of reading: "permissive" (broken tracks give what stands before the break, and a row of kind
    "broken"), "dropmalformed" (without that row) or "failfast". Paths are those that pyarrow opens, local or not, so
    tasks need no folder but the store itself. Written rows are events as those read; path, relative to the folder,
    names the file, and a file's rows have to be in one partition, sorted by path, track, tick and seq (as after
    repartition("path").sortWithinPartitions(...)); files appear when the whole job has ended well.
    """

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MidiReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MidiWriter(self.options, schema.fieldNames(), overwrite)


class MidiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.mode = options["path"], options.get("mode", "permissive").lower()
        if self.mode not in ("permissive", "dropmalformed", "failfast"):
            raise ValueError(f"no such mode: {self.mode}")

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = sorted((i.path, i.size or 0) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(".mid"))
        out: list[InputPartition] = []
        part, size = [], 0
        for path, n in found:
            if part and size + n > PARTITION_BYTES:
                out.append(Files(tuple(part)))
                part, size = [], 0
            part.append(path)
            size += n
        return [*out, Files(tuple(part))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                data = f.read()
            name = posixpath.relpath(path, root)
            events = (e for e in file_events(name, data, self.mode == "failfast") if self.mode != "dropmalformed" or e[5] != "broken")
            yield from event_batches(events)


class MidiWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        missing = set(NAMES) - set(names)
        if missing:
            raise ValueError(f"events need {', '.join(sorted(missing))}")
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        moves: list[tuple[str, str]] = []
        tracks: list[list[tuple[int, bytes]]] = []
        path, ticks, done = None, 480, set()

        def close() -> None:
            if path is None:
                return
            target = posixpath.normpath(posixpath.join(root, path))
            if not target.startswith(root.rstrip("/") + "/") or path in done:
                raise ValueError(f"{path} is no file of its own below the folder, or its rows aren't together")
            done.add(path)
            store.create_dir(posixpath.dirname(target), recursive=True)
            temp = f"{target}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(temp) as out:
                out.write(head_bytes(1 if len(tracks) > 1 else 0, len(tracks), ticks) + b"".join(map(track_bytes, tracks)))
            moves.append((temp, target))

        for r in (r for b in batches for r in b.to_pylist()):
            if r["path"] != path:
                close()
                path, ticks, tracks = r["path"], r["ticks_per_beat"], []
            while len(tracks) <= r["track"]:
                tracks.append([])
            if r["kind"] == "tempo":
                tracks[-1].append((r["tick"], meta(0x51, int(r["a"]).to_bytes(3, "big"))))
            elif r["kind"] in STATUS:
                tracks[-1].append((r["tick"], message(r["kind"], r["channel"], r["a"], r["b"])))
        close()
        return Written(tuple(moves))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        moves = [m for w in messages if w for m in w.moves]
        if self.overwrite:
            kept = {temp for temp, _ in moves}
            for i in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if i.is_file and i.path.endswith(".mid") and i.path not in kept:
                    store.delete_file(i.path)
        for temp, target in moves:
            store.move(temp, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for temp, _ in (m for w in messages if w for m in w.moves):
            store.delete_file(temp)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MidiSource)
