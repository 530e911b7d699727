"""Append-only tables without declared schemas, as segments of Parquet files.

A table's catalog is a small JSON file: the names and kinds of its columns, and its
segments, each a folder of Parquet files with the columns it was written with.  A
column may be missing in a segment, where it is NULL, and may have a narrower kind,
from which it is cast: int widens to float, and either to string.  Columns have made-up
names in the files, which allow any logical name.

A commit writes the next version of the catalog, under a name that only one writer can
create; one that comes second reads what the first has committed and adds its change to that.
So readers see a segment as a whole or not at all, segments are never changed, and no
writer's segments are lost.  Segments that were merged stay on disk for a while, as queries
planned before may read them; the catalog names them until ``vacuum`` deletes them.

Without a root folder tables live in the session: segments are DataFrames.
"""

from __future__ import annotations

import contextlib
import functools
import io
import json
import math
import re
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.typed import BOOL, FLOAT, INT, NULL, SPARK, STR, kind_of, stored
from ..plans.errors import FatalError

#: Rows of a file that merging makes, on average.
FILE_ROWS = 4_000_000
#: Bytes that are handed to the file system at a time.
PIECE = 1 << 20
#: Seconds for which merged segments stay, and older versions of a catalog that stay.
KEEP_SECONDS, KEEP_VERSIONS = 24 * 3600, 8
_RANK = {NULL: 0, BOOL: 1, INT: 1, FLOAT: 2, STR: 3}


def widest(a: str, b: str) -> str:
    """The kind that holds values of both."""
    if a == b:
        return a
    if BOOL in (a, b) and NULL not in (a, b):
        return STR
    return max(a, b, key=_RANK.__getitem__)


@dataclass(eq=False)
class Segment:
    columns: list[tuple[str, str]]  # name, kind
    path: str | None = None
    frame: DataFrame | None = None
    rows: int = 0


@dataclass
class Table:
    name: str
    created: int
    columns: dict[str, str] = field(default_factory=dict)
    segments: list[Segment] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each stream
    merged: list[tuple[str, float]] = field(default_factory=list)  # paths that were merged, and when
    version: int = -1

    def widen(self, columns: Sequence[tuple[str, str]]) -> None:
        for name, kind in columns:
            self.columns[name] = widest(self.columns.get(name, NULL), kind)

    def to_json(self) -> str:
        segments = [{"columns": s.columns, "path": s.path, "rows": s.rows} for s in self.segments]
        return json.dumps({"name": self.name, "created": self.created, "columns": self.columns, "segments": segments, "batches": self.batches, "merged": self.merged})

    @classmethod
    def from_json(cls, text: str, version: int) -> Table:
        x = json.loads(text)
        segments = [Segment([tuple(c) for c in s["columns"]], s["path"], rows=s["rows"]) for s in x["segments"]]
        return cls(x["name"], x["created"], x["columns"], segments, x["batches"], [tuple(m) for m in x["merged"]], version)


class Files:
    """The few file operations that a catalog needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.root = root.rstrip("/")
        hadoop = self.jvm.org.apache.hadoop.fs  # each name on the way to a class is asked of the JVM, so classes are kept
        self._new_path, self._renames, self._contexts = hadoop.Path, getattr(hadoop, "Options$Rename"), hadoop.FileContext
        self.fs = self._path("").getFileSystem(self.conf)
        self.uri, self.local = self.fs.getUri(), self.fs.getScheme() == "file"
        self._raw = self.fs.getRawFileSystem() if is_instance_of(self.gateway, self.fs, "org.apache.hadoop.fs.FilterFileSystem") else self.fs
        nio = self.jvm.java.nio.file
        self._nio, self._paths, self._none = nio.Files, nio.Paths, self.gateway.new_array(self.jvm.java.lang.String, 0)
        self._atomic = self.gateway.new_array(nio.CopyOption, 1)
        self._atomic[0] = nio.StandardCopyOption.ATOMIC_MOVE

    def _path(self, name: str):
        return self._new_path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _place(self, name: str):
        return self._paths.get(self._path(name).toUri().getPath(), self._none)

    def write(self, name: str, data: bytes, fs=None) -> None:
        stream = (fs or self.fs).create(self._path(name), True)
        try:
            for at in range(0, len(data), PIECE):
                stream.write(bytearray(data[at : at + PIECE]))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file under another name first, so a reader finds the old one or the new."""
        other = f"{name}.{uuid.uuid4().hex}"
        if self.local:  # Hadoop's renaming starts two processes here; without checksums there is one file to move
            self.write(other, text.encode(), self._raw)
            self._nio.deleteIfExists(self._place(re.sub("([^/]*)$", r".\1.crc", name, count=1)))
            self._nio.move(self._place(other), self._place(name), self._atomic)
        else:
            self.write(other, text.encode())
            self._rename(other, name, "OVERWRITE")

    def create(self, name: str, text: str) -> bool:
        """Write a file as a whole unless there is one of that name; whether it was written."""
        other = f"{name}.{uuid.uuid4().hex}"
        self.write(other, text.encode())
        try:
            if self.local:  # a link is made by one of several writers only, which renaming does not ensure here
                self._nio.createLink(self._place(name), self._place(other))
            else:
                self._rename(other, name, "NONE")
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            self.fs.delete(self._path(other), False)

    def _rename(self, old: str, new: str, how: str) -> None:
        qualify = lambda p: self._path(p).makeQualified(self.uri, self.fs.getWorkingDirectory())
        self._context.rename(qualify(old), qualify(new), self._how(how))

    @functools.cached_property
    def _context(self):
        return self._contexts.getFileContext(self.uri, self.conf)

    @functools.cache  # noqa: B019
    def _how(self, how: str):
        options = self.gateway.new_array(self._renames, 1)
        options[0] = getattr(self._renames, how)
        return options

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        """Bytes of a file or a folder."""
        return self.fs.getContentSummary(self._path(name)).getLength() if self.fs.exists(self._path(name)) else 0


class Store:
    """All tables of a database."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root.rstrip("/") if root else None
        self.files = Files(spark, self.root) if self.root else None
        self.tables: dict[str, Table] = {}
        self.views: dict[str, DataFrame] = {}
        self.lock = threading.RLock()
        for name in self.files.names("_catalog") if self.files else []:
            self.refresh(unquote(name))

    def _versions(self, name: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"_catalog/{quote(name, safe='')}") if re.fullmatch(r"\d+\.json", n))

    def refresh(self, name: str) -> None:
        """Take in what other writers have committed to a table."""
        while self.files and (versions := self._versions(name)):
            text = self.files.read(f"_catalog/{quote(name, safe='')}/{versions[-1]:012d}.json")
            if text is not None:  # else it was old already when it was to be read
                with self.lock:
                    self.tables[name] = Table.from_json(text, versions[-1])
                return

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame a table that can be queried, and not be appended to."""
        self.views[name] = df

    def names(self) -> list[str]:
        return sorted({*self.tables, *self.views})

    def columns(self, name: str) -> list[str]:
        if name in self.views:
            return self.views[name].columns
        return list(self.tables[name].columns) if name in self.tables else []

    def table(self, name: str) -> Table:
        if name not in self.tables:
            self.tables[name] = Table(name, int(time.time()))
        return self.tables[name]

    def append(self, name: str, df: DataFrame | pa.Table, *, columns: list[tuple[str, str]] | None = None, stream: str | None = None, batch: int = 0, rows: int | None = None, marks: Mapping[str, int] | None = None, expected: Mapping[str, int] | None = None, around: tuple | None = None) -> bool:
        """Add the rows of ``df`` as a segment; columns of types that the dialect lacks are
        kept as JSON text.  A stream's batch that was committed before adds nothing.
        ``marks`` are kept among the batches without that test; with ``expected`` nothing is
        added if one of these has another value meanwhile (-1: none).  ``around`` is a lock
        that is held for the commit, and what to call under it once it is done.  An Arrow table,
        of rows in the driver with ``columns`` c0, c1 and so on of these names and kinds, becomes one
        file without a Spark job."""
        table = self.table(name)
        if stream is not None and table.batches.get(stream, -1) >= batch:
            return False
        if isinstance(df, pa.Table):
            return self._add(name, self._file(name, df, columns), stream, batch, marks, expected, around)
        columns, chosen = [], []
        renamed = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        for i, f in enumerate(df.schema.fields):
            column = stored(F.col(f"c{i}"), f.dataType)
            kind = kind_of(f.dataType) if column is not None else STR
            column = F.to_json(f"c{i}") if column is None else column
            columns.append((f.name, kind))
            chosen.append(column.cast(SPARK[kind]).alias(f"c{i}"))
        frame = renamed.select(*chosen)
        if self.files:
            path = f"{quote(name, safe='')}/{len(table.segments):06d}-{uuid.uuid4().hex}"
            frame.write.parquet(f"{self.root}/{path}")
            count = self.spark.read.parquet(f"{self.root}/{path}").count() if rows is None else rows
            segment = Segment(columns, path, rows=count)
        else:
            frame = frame.cache()
            segment = Segment(columns, frame=frame, rows=frame.count())
        return self._add(name, segment, stream, batch, marks, expected, around)

    def _file(self, name: str, data: pa.Table, columns: list[tuple[str, str]]) -> Segment:
        path, out = f"{quote(name, safe='')}/{len(self.table(name).segments):06d}-{uuid.uuid4().hex}", io.BytesIO()
        pq.write_table(data, out)
        self.files.write(f"{path}/part-0.parquet", out.getvalue())
        return Segment(columns, path, rows=data.num_rows)

    def _add(self, name: str, segment: Segment, stream: str | None, batch: int, marks: Mapping[str, int] | None, expected: Mapping[str, int] | None, around: tuple | None) -> bool:
        def change(table: Table) -> bool:
            if stream is not None and table.batches.get(stream, -1) >= batch:
                return False
            if any(table.batches.get(k, -1) != v for k, v in (expected or {}).items()):
                return False
            table.segments.append(segment)
            table.widen(segment.columns)
            if stream is not None:
                table.batches[stream] = batch
            table.batches.update(marks or {})
            return True

        lock, after = around or (contextlib.nullcontext(), lambda: None)
        with lock:
            if done := self.commit(name, change):
                after()
        if not done:
            self.files.delete(segment.path) if segment.path else segment.frame.unpersist()
        return done

    def commit(self, name: str, change: Callable[[Table], bool]) -> bool:
        """Change a table's catalog, and what others have made of it meanwhile; whether
        ``change`` did.  It may be called again, with a newer catalog."""
        with self.lock:
            if not self.files:
                return change(self.table(name))
            folder = f"_catalog/{quote(name, safe='')}"
            while True:
                table = self.table(name)
                draft = Table.from_json(table.to_json(), table.version + 1)
                if not change(draft):
                    return False
                if self.files.create(f"{folder}/{draft.version:012d}.json", draft.to_json()):
                    self.tables[name] = draft
                    for old in self._versions(name)[:-KEEP_VERSIONS]:
                        self.files.delete(f"{folder}/{old:012d}.json")
                    return True
                self.refresh(name)

    def read(self, name: str, *extra: Segment) -> DataFrame:
        """All rows of a table.  Segments with the same columns are one scan, so there are
        as many as there are different schemas and not as there are segments."""
        if name in self.views:
            return self.views[name]
        if name not in self.tables and not extra:
            raise FatalError(f"there is no table {name}")
        table = self.table(name)
        columns = dict(table.columns)
        for s in extra:
            for c, kind in s.columns:
                columns[c] = widest(columns.get(c, NULL), kind)
        if not table.segments and not extra:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` {SPARK[k]}" for c, k in columns.items()) or "none string")
        return self._rows([*table.segments, *extra], columns)

    def _rows(self, segments: Sequence[Segment], columns: Mapping[str, str]) -> DataFrame:
        groups: dict[tuple, list[Segment]] = {}
        for s in segments:
            groups.setdefault((tuple(map(tuple, s.columns)), s.frame is None), []).append(s)
        parts = []
        for (had, on_disk), same in groups.items():
            if on_disk:
                schema = ", ".join(f"c{i} {SPARK[k]}" for i, (_, k) in enumerate(had))
                frames = [self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in same))]
            else:
                frames = [s.frame for s in same]
            place = {c: i for i, (c, _) in enumerate(had)}
            for frame in frames:
                chosen = [
                    (F.col(f"c{place[c]}").cast(SPARK[k]) if c in place else F.lit(None).cast(SPARK[k])).alias(f"x{i}") for i, (c, k) in enumerate(columns.items())
                ]
                parts.append(frame.select(*chosen))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.toDF(*columns)

    def compact(self, name: str, files: int | None = None, least: int = 2) -> int:
        """Merge all segments of a table into one, if there are ``least`` or more; returns
        how many were merged."""
        segments = self.table(name).segments
        return self._merge(name, list(segments), files) if len(segments) >= least else 0

    def compact_tiers(self, name: str, width: int) -> int:
        """Merge segments of about one size where there are ``width`` of them.  Merged
        segments are a tier higher, so a row is rewritten as often as there are tiers, which
        are as many as the logarithm of the table's rows, and not with each merge."""
        merged = 0
        while True:
            tiers: dict[int, list[Segment]] = {}
            for s in self.table(name).segments:
                tiers.setdefault(int(math.log(max(s.rows, 1), width)), []).append(s)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= width), None)
            if full is None:
                return merged
            merged += self._merge(name, full, None)

    def _merge(self, name: str, old: list[Segment], files: int | None) -> int:
        """Old files stay until ``vacuum``.  If another writer has merged one of them, its merge
        counts and not this one."""
        created, count = self.table(name).created, sum(s.rows for s in old)
        part = Table(name, created)
        for s in old:
            part.segments.append(s)
            part.widen(s.columns)
        columns = list(part.columns.items())
        frame = self._rows(part.segments, part.columns).toDF(*(f"c{i}" for i in range(len(columns))))
        frame = frame.coalesce(files or max(1, count // FILE_ROWS))
        if self.files:
            path = f"{quote(name, safe='')}/{len(self.table(name).segments):06d}-{uuid.uuid4().hex}"
            frame.write.parquet(f"{self.root}/{path}")
            made = Segment(columns, path, rows=count)
        else:
            frame = frame.cache()
            frame.count()
            made = Segment(columns, frame=frame, rows=count)
        gone = {s.path or id(s) for s in old}

        def change(table: Table) -> bool:
            at = [i for i, s in enumerate(table.segments) if (s.path or id(s)) in gone]
            if len(at) < len(old):
                return False
            kept = [s for s in table.segments if (s.path or id(s)) not in gone]
            table.segments = [*kept[: at[0]], made, *kept[at[0] :]]
            table.merged += [(s.path, time.time()) for s in old if s.path]
            return True

        if not self.commit(name, change):
            self.files.delete(made.path) if made.path else made.frame.unpersist()
            return 0
        for s in old:
            if s.frame is not None:
                s.frame.unpersist()
        return len(old)

    def vacuum(self, name: str, older_than: float = KEEP_SECONDS) -> int:
        """Delete segments that were merged so many seconds ago; queries planned before can't
        read them then.  Returns how many."""
        old = [p for p, t in self.table(name).merged if t <= time.time() - older_than]
        if not old:
            return 0

        def change(table: Table) -> bool:
            table.merged = [m for m in table.merged if m[0] not in old]
            return True

        for path in old:
            self.files.delete(path)
        self.commit(name, change)
        return len(old)

    def meta(self, name: str) -> DataFrame | None:
        """The meta tables: ``_meta_tables`` and ``_meta_columns_<table>``."""
        if name == "_meta_tables":
            rows = [(t.created, t.name) for t in self.tables.values()] + [(0, v) for v in self.views]
            rows += [(c, f"_meta_columns_{n}") for c, n in list(rows)]
            return self.spark.createDataFrame(rows, "timestamp long, name string")
        if (m := re.match("_meta_columns_(.*)", name, re.DOTALL)) and m[1] in self.names():
            return self.spark.createDataFrame([(c,) for c in self.columns(m[1])], "column_name string")
        return None

    def stats(self) -> list[Mapping]:
        """Rows, segments, columns and bytes of each table."""
        out = []
        for t in self.tables.values():
            parts = self.tree(t.name)
            out.append({"name": t.name, "rows": sum(p["rows"] for p in parts), "segments": len(parts), "columns": len(t.columns), "bytes": sum(p["bytes"] for p in parts)})
        return sorted(out, key=lambda x: x["name"])

    def tree(self, name: str) -> list[Mapping]:
        """Place, rows, columns and bytes of each segment of a table."""
        size = lambda s: self.files.size(s.path) if s.path else 0
        return [{"path": s.path, "rows": s.rows, "columns": dict(s.columns), "bytes": size(s)} for s in self.table(name).segments]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; below /tmp
    where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
