"""A data source for messages as bytes: ``rx_messages`` writes tables and streams in two phases, and reads its frames back.

Messages hold control characters and line breaks, so a text file would split them. Here each is a frame (the lengths of its
key and payload, then both), or a file of its own.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "key string, payload binary"
FRAME = struct.Struct(">iI")  # length of the key (-1: null), length of the payload
SUFFIX = ".frames"
#: A file is closed at the first message that reaches so many bytes, a partition to read takes files up to so many, and a batch
#: of messages is handed to Spark at so many.
FILE_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 128 << 20, 8 << 20
KEY_IN_NAME = 100
LAYOUTS = ("frames", "files")


@dataclass
class Staged(WriterCommitMessage):
    """What one task attempt has written: a folder below the staging folder, or none without rows."""

    folder: str | None


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Output:
    """One attempt's folder: frames in files of ``FILE_BYTES``, or a file for each message. It is made with the first message."""

    def __init__(self, files: store.FileSystem, folder: str, layout: str, suffix: str, parents: bool):
        self.files, self.folder, self.layout, self.suffix, self.parents = files, folder, layout, suffix, parents
        self.n, self.size, self.out = 0, 0, None

    def _open(self, name: str) -> None:
        if self.n == 0:
            self.files.create_dir(self.folder, recursive=self.parents)
        self.close()
        self.out, self.size = self.files.open_output_stream(f"{self.folder}/{name}"), 0
        self.n += 1

    def add(self, key: str | None, payload: bytes) -> None:
        if self.layout == "files":
            self._open(f"{self.n:08d}-{quote(key or '', safe='')[:KEY_IN_NAME]}{self.suffix}")
            self.out.write(payload)
            return
        if self.out is None or self.size >= FILE_BYTES:
            self._open(f"{self.n:08d}{SUFFIX}")
        name = (key or "").encode()
        self.out.write(FRAME.pack(-1 if key is None else len(name), len(payload)))
        self.out.write(name)
        self.out.write(payload)
        self.size += FRAME.size + len(name) + len(payload)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Writer:
    """Both phases. Attempts write into folders of their own below a staging folder, which readers don't see. The commit moves
    those that Spark reports (one move for each task) into ``_ready-<name>``, and then makes all visible by one move."""

    staging = "_staging"
    parents = True  # an attempt makes the staging folder where it isn't there

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.key, self.payload = options.get("key", "key"), options.get("payload", "payload")
        self.encoding, self.layout, self.suffix = options.get("encoding", "utf-8"), options.get("layout", LAYOUTS[0]), options.get("suffix", "")
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout is one of {', '.join(LAYOUTS)}, not {self.layout}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = store.FileSystem.from_uri(self.path)
        out = _Output(files, f"{root}/{self.staging}/{uuid.uuid4().hex}", self.layout, self.suffix, self.parents)
        try:
            for batch in iterator:
                keys = batch.column(self.key).cast(pa.string()).to_pylist() if self.key in batch.schema.names else [None] * batch.num_rows
                for key, payload in zip(keys, batch.column(self.payload).to_pylist(), strict=True):
                    if payload is None:
                        raise ValueError(f"a message without a payload can't be written (key {key})")
                    out.add(key, payload if isinstance(payload, bytes) else payload.encode(self.encoding))
            out.close()
        except BaseException:
            out.close()
            if out.n:
                self._drop(files, out.folder)
            raise
        return Staged(out.folder if out.n else None)

    def _drop(self, files: store.FileSystem, folder: str) -> None:
        """Take a folder away, first by its name, so that attempts that still run find it gone."""
        if files.get_file_info(folder).type == store.FileType.Directory:
            gone = f"{folder.rpartition('/')[0]}/_gone-{uuid.uuid4().hex}"
            files.move(folder, gone)
            files.delete_dir(gone)

    def _publish(self, messages: Sequence[Staged | None], name: str) -> str:
        files, root = store.FileSystem.from_uri(self.path)
        done, ready = f"{root}/{name}", f"{root}/_ready-{name}"
        if files.get_file_info(done).type == store.FileType.NotFound:  # else this batch was committed before a restart
            self._drop(files, ready)
            files.create_dir(ready, recursive=True)
            for n, message in enumerate(m for m in messages if m is not None and m.folder is not None):
                files.move(message.folder, f"{ready}/part-{n:06d}")
            files.move(ready, done)
        self._drop(files, f"{root}/{self.staging}")
        return done

    def _give_up(self) -> None:
        files, root = store.FileSystem.from_uri(self.path)
        self._drop(files, f"{root}/{self.staging}")


class TableWriter(_Writer, DataSourceArrowWriter):
    """A staging folder for each write, made on the driver; attempts of a write that was given up can't make it again."""

    parents = False

    def __init__(self, options: dict[str, str], overwrite: bool):
        super().__init__(options)
        self.overwrite = overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        files, root = store.FileSystem.from_uri(self.path)
        files.create_dir(f"{root}/{self.staging}", recursive=True)

    def commit(self, messages: list[Staged | None]) -> None:
        done = self._publish(messages, f"batch-{uuid.uuid4().hex}")
        if self.overwrite:
            files, root = store.FileSystem.from_uri(self.path)
            for info in files.get_file_info(store.FileSelector(root)):
                if info.base_name.startswith("batch-") and info.base_name != done.rpartition("/")[2]:
                    files.delete_dir(info.path)

    def abort(self, messages: list[Staged | None]) -> None:
        self._give_up()


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """One staging folder for the stream, since tasks and commits have a writer each; every commit takes it away."""

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self._publish(messages, f"batch-{batchId:020d}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self._give_up()


class FrameReader(DataSourceReader):
    """Frames of all committed batches. The driver lists names and sizes; a task reads whole files, a batch of messages at a time."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[Files]:
        files, root = store.FileSystem.from_uri(self.path)
        found: list[Files] = []
        size = READ_BYTES
        for folder in sorted(i.path for i in files.get_file_info(store.FileSelector(root)) if i.base_name.startswith("batch-")):
            listed = files.get_file_info(store.FileSelector(folder, recursive=True))
            for info in sorted((i for i in listed if i.path.endswith(SUFFIX)), key=lambda i: i.path):
                if size + info.size > READ_BYTES:
                    found.append(Files([]))
                    size = 0
                found[-1].paths.append(info.path)
                size += info.size
        return found or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = store.FileSystem.from_uri(self.path)
        keys: list[str | None] = []
        payloads: list[bytes] = []
        size = 0
        for path in partition.paths:
            with files.open_input_stream(path, buffer_size=1 << 20) as source:
                while head := source.read(FRAME.size):
                    n_key, n_payload = FRAME.unpack(head) if len(head) == FRAME.size else (0, 1)
                    key, payload = source.read(max(n_key, 0)), source.read(n_payload)
                    if len(head) < FRAME.size or len(key) != max(n_key, 0) or len(payload) != n_payload:
                        raise ValueError(f"{path} ends inside a frame")
                    keys.append(None if n_key < 0 else key.decode())
                    payloads.append(payload)
                    size += n_payload
                    if size >= BATCH_BYTES:
                        yield _batch(keys, payloads)
                        keys, payloads, size = [], [], 0
        if keys:
            yield _batch(keys, payloads)


def _batch(keys: list[str | None], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(payloads, pa.binary())], names=["key", "payload"])


class MessageFrames(DataSource):
    """``spark.read``, ``df.write`` and ``df.writeStream`` with ``.format("rx_messages")`` (see ``register``).

    Options: path (any file system that pyarrow knows and all executors share), key and payload (columns to write, ``key`` and
    ``payload`` by default; payload is binary, or a string in ``encoding``), layout (``frames``, or ``files`` for a file each, to
    be read by ``read_messages``; ``suffix`` ends their names). Reading gives key and payload of frames.

    A write shows nothing until all its tasks are done, and then everything at once: tasks write into hidden folders, lost and
    repeated attempts have folders of their own, and a failed write takes its folders away. A stream's batch that is
    committed again after a restart is left as it is, so a folder belongs to one stream. Overwriting puts the new batch in
    place before the older ones go. All this needs a store whose folders are moved at once (local, HDFS); an object store
    copies them.

    A null key is kept as null (``files``: a name without a key), a null payload fails the write, an empty payload is a frame of
    no bytes (``files``: a file without a byte, which Spark's reader leaves out), repeated keys are all kept, other columns are
    left out, and an empty table is a batch without files. A file is cut only between messages, so a message may be up to 2 GB.
    """

    @classmethod
    def name(cls) -> str:
        return "rx_messages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(dict(self.options), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageFrames)
