"""The grown parts of log files as a stream: a source whose offset is bytes per file."""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 32 << 20
_LOOK_BACK = 1 << 16
_BATCH_LINES = 10_000


@dataclass
class Grown:
    """Bytes of a file; the lines that begin between ``start`` and ``end`` belong to it."""

    name: str
    start: int
    end: int
    first: bool  # whether ``start`` is known to be the begin of a line


@dataclass
class Pieces(InputPartition):
    """What one task reads, one piece after the other."""

    pieces: list[Grown]


class TailReader(DataSourceStreamReader):
    """Offsets end behind the last complete line, so a line cut in the middle waits for its rest.

    A file that became shorter is a new one and read from its start.
    """

    def __init__(self, folder: str, existing: str, split_bytes: int, tasks: int = 1):
        self.folder, self.existing, self.split_bytes, self.tasks = folder, existing, split_bytes, tasks

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder)

    def _files(self) -> dict[str, int]:
        store, root = self._store()
        found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda path: any(part.startswith((".", "_")) for part in posixpath.relpath(path, root).split("/"))
        return {f.path: f.size for f in found if f.type == pafs.FileType.File and not hidden(f.path)}

    def _complete(self, store: pafs.FileSystem, name: str, size: int) -> int:
        """Bytes up to and including the last line end, looked for from behind."""
        with store.open_input_file(name) as f:
            end = size
            while end > 0:
                start = max(0, end - _LOOK_BACK)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def _ends(self) -> dict[str, int]:
        store = self._store()[0]
        return {name: self._complete(store, name, size) for name, size in self._files().items()}

    def initialOffset(self) -> dict:
        return {"files": self._ends() if self.existing == "skip" else {}}

    def latestOffset(self) -> dict:
        return {"files": self._ends()}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        """Pieces of files, dealt to tasks by bytes: many short files make one task."""
        grown = []
        for name, stop in sorted(end["files"].items()):
            begin = start["files"].get(name, 0)
            begin = begin if begin <= stop else 0
            for at in range(begin, stop, self.split_bytes):
                grown.append(Grown(name, at, min(stop, at + self.split_bytes), at == begin))
        share = min(self.split_bytes, -(-sum(g.end - g.start for g in grown) // self.tasks))
        out, size = [Pieces([])], 0
        for g in grown:
            if out[-1].pieces and size + g.end - g.start > share:
                out.append(Pieces([]))
                size = 0
            out[-1].pieces.append(g)
            size += g.end - g.start
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store = self._store()[0]
        for piece in partition.pieces:
            yield from self._read(store, piece)

    def _read(self, store: pafs.FileSystem, piece: Grown) -> Iterator[pa.RecordBatch]:
        with store.open_input_file(piece.name) as f:
            f.seek(piece.start - (not piece.first))
            lines = io.BufferedReader(f, _LOOK_BACK)
            # a line that began in the split before ends here, and is that split's
            at = piece.start if piece.first else piece.start - 1 + len(lines.readline())
            held = []
            while at < piece.end and (line := lines.readline()):
                at += len(line)
                held.append(line.rstrip(b"\n").decode(errors="replace"))
                if len(held) >= _BATCH_LINES:
                    yield self._batch(held, piece)
                    held = []
            if held:
                yield self._batch(held, piece)

    @staticmethod
    def _batch(lines: list[str], piece: Grown) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.array(lines, pa.string()), pa.array([piece.name] * n), pa.array([piece.start] * n, pa.int64())]
        return pa.record_batch(columns, names=["value", "source_file", "block_start"])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracehound_tail"

    def schema(self) -> str:
        return "value string, source_file string, block_start long"

    def streamReader(self, schema) -> TailReader:
        get = self.options.get
        return TailReader(self.options["path"], get("existing", "skip"), int(get("split_bytes", SPLIT_BYTES)), int(get("tasks", 1)))


def stream_tail(spark: SparkSession, folder: str, existing: str = "skip", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines appended to the files of a folder, and those of new files, as they come.

    What a file holds when the stream first starts is passed over, or read with
    ``existing="read"``. The folder is a local path or a store that pyarrow can open; it must
    be reachable by the executors. Offsets have one entry per file of the folder.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tracehound_tail").option("existing", existing).option("split_bytes", split_bytes)
    reader = reader.option("tasks", spark.sparkContext.defaultParallelism)
    return reader.load(folder).select(F.col("value").alias("text"), "source_file", F.col("block_start").alias("_block"))
