"""Arrow IPC files and streams as a data source: planned from footers, a few record batches a task."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Fixed value: how files of Arrow's file format begin. Streams have no mark of their own.
MAGIC = b"ARROW1"
#: Partitions of one file at most; a file with more record batches gives several to each.
MOST_PARTITIONS = 1024


def uri_of(path: str) -> str:
    """A URI with two slashes before a local path's own, which Hadoop's form of it lacks."""
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def _input(uri: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _reader(source: pa.NativeFile, columns: list[str] | None = None):
    """A reader of a file (which knows its batches) or of a stream; only ``columns`` are decoded."""
    is_file = source.read(len(MAGIC)) == MAGIC
    source.seek(0)
    opened = pa.ipc.open_file if is_file else pa.ipc.open_stream
    if columns is None:
        return opened(source)
    names = opened(source).schema.names
    source.seek(0)
    return opened(source, options=pa.ipc.IpcReadOptions(included_fields=sorted(names.index(c) for c in columns)))


@dataclass
class Batches(InputPartition):
    """Record batches ``first`` to ``end`` of a file; ``end`` 0 means a stream, read to its end."""

    uri: str
    first: int = 0
    end: int = 0


class ArrowReader(DataSourceReader):
    def __init__(self, uris: list[str], columns: list[str] | None, schema: T.StructType):
        self.uris, self.columns, self.wanted = uris, columns, schema

    def partitions(self) -> list[Batches]:
        def planned(uri: str) -> list[Batches]:
            with _input(uri) as source:
                n = getattr(_reader(source), "num_record_batches", None)
            if n is None:
                return [Batches(uri)]
            step = -(-n // MOST_PARTITIONS) or 1
            return [Batches(uri, i, min(n, i + step)) for i in range(0, n, step)]

        with ThreadPoolExecutor(16) as pool:
            return [p for found in pool.map(planned, self.uris) for p in found] or [Batches("")]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        target = to_arrow_schema(self.wanted, prefers_large_types=False)
        with _input(partition.uri) as source:
            reader = _reader(source, self.columns)
            for batch in (reader.get_batch(i) for i in range(partition.first, partition.end)) if partition.end else reader:
                # dictionaries and large types become what Spark has; a file of another schema fails here, by name
                yield from pa.Table.from_batches([batch]).select(target.names).cast(target).to_batches()


@dataclass
class Written(WriterCommitMessage):
    """A task's file under its temporary name, and its name for good; none for a task without rows."""

    temporary: str | None
    name: str


class ArrowWriter(DataSourceArrowWriter):
    """A file a task, a record batch each that Spark hands over. Files get their names once all tasks have finished, so an attempt that failed leaves none."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = fs.FileSystem.from_uri(self.path)
        name = f"part-{task.partitionId():05}-{self.run}.arrow"
        temporary, out = f"{path}/.{name}-{task.taskAttemptId()}", None
        for batch in iterator:
            if out is None:
                system.create_dir(path)
                stream = system.open_output_stream(temporary)
                out = pa.ipc.new_file(stream, batch.schema)
            out.write_batch(batch)
        if out is None:
            return Written(None, name)
        out.close()
        stream.close()
        return Written(temporary, f"{path}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.temporary is not None:
                system.move(m.temporary, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.temporary is not None:
                system.delete_file(m.temporary)


class ArrowSource(DataSource):
    """``uris``: a JSON list of files; ``columns``: a JSON list of those to read, all if it isn't there. Written to ``path``, a folder's URI."""

    @classmethod
    def name(cls) -> str:
        return "tallyforge_arrow"

    def _listed(self, option: str) -> list[str] | None:
        return json.loads(self.options[option]) if option in self.options else None

    def schema(self) -> T.StructType:
        """That of the files' heads, which must agree; a head may be of any length."""

        def head(uri: str) -> pa.Schema:
            with _input(uri) as source:
                found = _reader(source).schema.remove_metadata()
            return pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in found])

        uris, columns = self._listed("uris"), self._listed("columns")
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(head, uris))
        for uri, other in zip(uris, heads, strict=True):
            if not other.equals(heads[0]):
                raise ValueError(f"{uri} has another schema than {uris[0]}: {other} / {heads[0]}")
        whole = from_arrow_schema(heads[0])
        return whole if columns is None else T.StructType([whole[c] for c in columns])

    def reader(self, schema: T.StructType) -> ArrowReader:
        return ArrowReader(self._listed("uris"), self._listed("columns"), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"])
