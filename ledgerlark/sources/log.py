"""A table's change log as a stream: its snapshot first, then the changes by their positions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    import pyarrow as pa


@dataclass
class Part(InputPartition):
    """A row group of a Parquet file, the positions wanted from it (all of a snapshot's), the snapshot's number and its position."""

    path: str
    group: int
    after: int | None
    to: int
    snapshot: int


class ChangeLog(DataSource):
    """Rows of `snapshot`, a folder of Parquet files, then those of `log`, another one whose files are added and dropped but never changed.

    A log has op, lsn and seq and the table's columns; rows of a snapshot are inserts (op 2) at
    the log's position when it was taken, so changes meanwhile come again, which applying them
    by key doesn't mind. Each row has the number of its snapshot: where positions have left the
    log before they were read, a new one is taken, and its rows replace what came before.

    Options: snapshot, log and positions (a folder of the stream's own, which all its runs
    see); maxOffsetsPerTrigger, the rows of the log that a batch takes, though never less than
    one position's, as a transaction is not split. Without it a batch takes all there are.
    The driver reads footers of files that it has not seen and, for the limit, positions of
    row groups until that many are found. Rows are read in tasks, one a row group.
    """

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        raise ValueError("a change log is read with a schema: snapshot, op, lsn, seq and the table's columns")

    def streamReader(self, schema: StructType) -> ChangeLogReader:
        return ChangeLogReader(schema, self.options)


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.shape, self.names = schema, schema.fieldNames()
        self.snapshots, self.log, self.folder = (options[c].rstrip("/") for c in ("snapshot", "log", "positions"))
        self.most = int(options.get("maxOffsetsPerTrigger", 0))
        self.at: dict | None = None
        self.groups: dict[str, list[tuple[int, int, int]]] = {}  # by file: group, first and last position

    # --- offsets: {"snapshot": snapshots taken, "lsn": last position handed out}

    def initialOffset(self) -> dict:
        self.at = {"snapshot": 0, "lsn": -1}
        return self.at

    def latestOffset(self) -> dict:
        at = self.at or self._remembered()
        found = self._index()
        first, last = min((low for _, _, low, _ in found), default=None), max((high for *_, high in found), default=-1)
        if at["snapshot"] == 0 or (first is not None and at["lsn"] < first - 1):
            return {"snapshot": at["snapshot"] + 1, "lsn": max(last, at["lsn"])}
        if last <= at["lsn"]:
            return at
        return {"snapshot": at["snapshot"], "lsn": self._admitted(found, at["lsn"], last)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._remember(end)
        n, to = end["snapshot"], end["lsn"]
        if n > start["snapshot"]:
            return [Part(p, g, None, to, n) for p in self._files(self.snapshots) for g in range(self._footer(p).num_row_groups)]
        parts = [Part(p, g, start["lsn"], to, n) for p, g, low, high in self._index(True) if high > start["lsn"] and low <= to]
        if to > start["lsn"] and min((low for _, _, low, _ in self._index(True)), default=to) > start["lsn"] + 1:
            raise LookupError(f"positions after {start['lsn']} left the log before a batch that wants them ran; begin with a new checkpoint and snapshot")
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        shape = to_arrow_schema(self.shape)
        fs, path = _place(partition.path)
        with fs.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            have = set(file.schema_arrow.names)
            for rows in file.iter_batches(row_groups=[partition.group], columns=[c for c in self.names if c in have]):
                if partition.after is None:
                    fixed = {"op": 2, "lsn": partition.to, "seq": 0}
                else:
                    rows, fixed = rows.filter(pc.and_(pc.greater(rows["lsn"], partition.after), pc.less_equal(rows["lsn"], partition.to))), {}
                fixed["snapshot"] = partition.snapshot
                cells = [pa.array(np.full(rows.num_rows, fixed[c.name], np.int64)) if c.name in fixed else rows[c.name] if c.name in have else pa.nulls(rows.num_rows) for c in shape]
                yield pa.RecordBatch.from_arrays([v.cast(c.type) for v, c in zip(cells, shape, strict=True)], schema=shape)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the log's owner drops its files."""

    # --- files

    def _files(self, folder: str) -> list[str]:
        import pyarrow.fs as pafs

        fs, path = _place(folder)
        before = folder.removesuffix(path)
        return sorted(before + i.path for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.path.endswith(".parquet"))

    def _footer(self, path: str) -> pa.parquet.FileMetaData:
        import pyarrow.parquet as pq

        fs, at = _place(path)
        return pq.read_metadata(at, filesystem=fs)

    def _index(self, cached: bool = False) -> list[tuple[str, int, int, int]]:
        """file, group, first and last position of the log's row groups; footers are read once."""
        files = list(self.groups) if cached and self.groups else self._files(self.log)
        self.groups = {p: self.groups[p] if p in self.groups else self._spans(p) for p in files}
        return [(p, *g) for p in files for g in self.groups[p]]

    def _spans(self, path: str) -> list[tuple[int, int, int]]:
        footer, out = self._footer(path), []
        lsn = footer.schema.names.index("lsn")
        for g in range(footer.num_row_groups):
            told = footer.row_group(g).column(lsn).statistics
            if told is not None and told.has_min_max:
                out.append((g, told.min, told.max))
            elif len(values := self._positions(path, g)):
                out.append((g, int(values.min()), int(values.max())))
        return out

    def _positions(self, path: str, group: int) -> np.ndarray:
        import pyarrow.parquet as pq

        fs, at = _place(path)
        with fs.open_input_file(at) as f:
            return pq.ParquetFile(f).read_row_group(group, columns=["lsn"])["lsn"].to_numpy()

    def _admitted(self, found: list[tuple[str, int, int, int]], after: int, last: int) -> int:
        """The last position whose rows and those before it, from `after` on, are at most the limit."""
        if not self.most:
            return last
        seen = np.empty(0, np.int64)
        for path, group, low, high in sorted(found, key=itemgetter(2)):
            if len(seen) > self.most and low > seen[-1]:
                break
            if high > after:
                more = self._positions(path, group)
                seen = np.sort(np.concatenate([seen, more[more > after]]))[: self.most + 1]
        if len(seen) <= self.most:
            return last
        whole = seen[seen < seen[-1]]
        return int(whole[-1] if len(whole) else seen[-1])

    # --- what a restarted stream has planned: Spark tells a source its start only when a batch is planned

    def _remember(self, end: dict) -> None:
        self.at = end
        fs, path = _place(self.folder)
        fs.create_dir(path)
        part = f"{path}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(json.dumps(end).encode())
        fs.move(part, f"{path}/last.json")

    def _remembered(self) -> dict:
        fs, path = _place(self.folder)
        try:
            with fs.open_input_stream(f"{path}/last.json") as f:
                self.at = json.loads(f.read())
        except FileNotFoundError:  # a stream's first batch: Spark asks for the latest offset before the first one
            self.at = self.initialOffset()
        return self.at


def _place(path: str):  # noqa: ANN202  a pyarrow file system and the path in it
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
