"""The engine: tables, ingestion and queries in one object."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass
from pprint import pformat

from pyspark.sql import DataFrame, SparkSession

from .functions.precision import truncated
from .plans.errors import QueryError, Unsupported, translated
from .plans.parser import parse
from .plans.planner import build
from .plans.session import SETTINGS
from .sources.csv import CsvOptions, read_csv
from .sources.generator import Generator, Markov, generate
from .sources.store import KEEP_SECONDS, Store
from .streaming.ingest import EventBuffer, Value, Waiting, stamped, stream_into, survey
from .streaming.wal import MARK, WriteAheadLog


@dataclass(frozen=True)
class EngineConfig:
    """``path``: folder of the database, None to keep tables in the session.  ``buffer_bytes``:
    events held back before they become a segment.  ``combine_segments``: segments of about
    one size that are merged when events are flushed.  ``write_ahead``: log what ``ingest`` and
    ``log`` get before they return, where there is a path; ``log_bytes``: what the log may take
    before events are flushed.  While they are, those who bring more wait.  ``flush_seconds`` and
    ``metrics_seconds``: how often events are flushed and counters recorded by themselves, 0
    for never.  ``keep_seconds``: how long merged segments stay readable.  ``threads``: requests
    that a server answers at a time.  ``compat``: "sql" or "store", see ``plans.planner.build``.
    ``extensions``: what the dialect adds to its core.  ``sorted_groups``: DataFrames have groups in
    the order of their keys also where the query has neither an order nor a limit, which takes one
    more shuffle; lists of rows always have them so."""

    path: str | None = None
    buffer_bytes: int = 64 << 20
    combine_segments: int = 16
    write_ahead: bool = True
    log_bytes: int = 256 << 20
    flush_seconds: float = 0
    metrics_seconds: float = 0
    keep_seconds: float = KEEP_SECONDS
    threads: int = 16
    compat: str = "sql"
    extensions: bool = True
    sorted_groups: bool = False
    metrics_table: str = "_metrics"

    def __post_init__(self) -> None:
        if self.compat not in ("sql", "store"):
            raise ValueError("compat is sql or store")
        if self.buffer_bytes < 0 or self.combine_segments < 2:
            raise ValueError("buffer_bytes can't be negative, and two segments are the fewest to combine")
        if min(self.log_bytes, self.flush_seconds, self.metrics_seconds, self.keep_seconds) < 0 or self.threads < 1:
            raise ValueError("sizes and times can't be negative, and one thread is the fewest")


class Engine:
    """A database on a Spark session.

    ``sql`` gives a DataFrame; ``query_rows`` and ``query_cols`` run the query.  Events given
    to ``ingest`` and ``log`` are seen by queries at once and become files with ``flush``.
    Threads may share an engine, and engines a folder.
    """

    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig()):
        for key in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone"):
            spark.conf.set(key, SETTINGS[key])
        self.spark, self.config = spark, config
        self.store = Store(spark, config.path)
        self.buffer = EventBuffer(config.buffer_bytes)
        self.counters = {"queries": 0, "rows_ingested": 0, "flushes": 0, "segments_combined": 0, "rows_scanned": 0, "files_opened": 0, "bytes_of_files": 0}
        self._before: dict[str, float] = {}
        self._events, self._flushing = threading.RLock(), threading.RLock()
        self._logged, self._closed = 0, threading.Event()
        self.log_file = WriteAheadLog(self.store) if config.path and config.write_ahead else None
        self.recover()
        for seconds, what in ((config.flush_seconds, self.flush), (config.metrics_seconds, self.record_metrics)):
            if seconds:
                threading.Thread(target=self._every, args=(seconds, what), daemon=True).start()

    def _every(self, seconds: float, what: Callable[[], None]) -> None:
        while not self._closed.wait(seconds):
            try:
                what()
            except Exception:  # tried again at the next turn; rows stay in the buffer and the log
                self.counters["failed_turns"] = self.counters.get("failed_turns", 0) + 1

    def close(self) -> None:
        """Flush, and end what runs by itself."""
        self._closed.set()
        self.flush()

    def recover(self) -> int:
        """Take in what others have committed, and the logged rows that no segment has and
        this engine does not hold; returns their number."""
        n = 0
        with self._events:
            for name in list(self.store.tables):
                self.store.refresh(name)
            for table, rows, batch in self.log_file.replay() if self.log_file else ():
                self.buffer.add_rows(table, rows, survey(rows), batch)
                n += len(rows)
        return n

    # tables

    def register(self, name: str, df: DataFrame) -> None:
        self.store.register(name, df)

    def tables(self) -> list[str]:
        return sorted({*self.store.names(), *self.buffer.rows})

    def dataframe(self, name: str) -> DataFrame:
        """All rows of a table, those not yet flushed too."""
        if (meta := self.store.meta(name)) is not None:
            return meta
        with self._events:
            waiting = self.buffer.segments(self.spark, name)
            if not waiting and name not in self.store.names():
                raise Unsupported(f"there is no table {name}")
            return self.store.read(name, *waiting)

    def load_csv(self, path: str | Sequence[str], table: str, options: CsvOptions = CsvOptions()) -> int:
        """Append CSV files to a table; returns its segments' number of rows now."""
        with translated():
            self.store.append(table, read_csv(self.spark, path, options))
        return sum(s.rows for s in self.store.tables[table].segments)

    def append(self, table: str, df: DataFrame) -> None:
        with translated():
            self.store.append(table, df)

    def gen_table(self, table: str, columns: Mapping[str, Generator | Markov], partitions: int, partition_size: int, seed: int = 0) -> None:
        self.append(table, generate(self.spark, columns, partitions, partition_size, seed))

    # events

    def ingest(self, table: str, columns: Mapping[str, Sequence[Value]]) -> None:
        """Columns of values; one that is shorter than others ends in NULL."""
        n = max(map(len, columns.values()), default=0)
        self.ingest_rows(table, [{c: v[i] if i < len(v) else None for c, v in columns.items()} for i in range(n)])

    def ingest_rows(self, table: str, rows: Sequence[Mapping[str, Value]]) -> None:
        """Rows, each with the columns that it has."""
        surveyed = survey(rows)
        with self._events:
            batch = None
            if self.log_file and rows:
                batch = self.log_file.write(table, rows)
                self._logged += self.log_file.latest
            self.buffer.add_rows(table, rows, surveyed, batch)
            self.counters["rows_ingested"] += len(rows)
            full = self.buffer.full or self._logged > self.config.log_bytes
        if full:
            self.flush()

    def log(self, table: str, event: Mapping[str, Value]) -> None:
        """One event, with the time in ``timestamp`` if it has none."""
        self.ingest_rows(table, [stamped(event)])

    def flush(self) -> None:
        """Make segments of all events, and merge those of tables that have too many.  Rows that
        another engine has flushed meanwhile, having found them in the log, are not added."""
        with self._flushing:
            retried = bool(self.buffer.frozen)  # the last flush failed: its rows come first
            for _ in range(1 + retried):
                with self._events:
                    if not self.buffer.frozen:
                        self.buffer.freeze()
                        self._logged = 0
                for table, waiting in list(self.buffer.frozen.items()):
                    self._write(table, waiting)
                    self.counters["segments_combined"] += self.store.compact_tiers(table, self.config.combine_segments)
                    self.store.vacuum(table, self.config.keep_seconds)
            if self.log_file:
                with self._events:
                    self.log_file.clear()
            self.counters["flushes"] += 1

    def _write(self, table: str, waiting: Waiting) -> None:
        while True:
            left = waiting.without(lambda batch: self.log_file is not None and self.log_file.done(table, batch))
            marks: dict[str, int] = {}
            for batch in set(left.batches):
                if batch is not None:
                    marks[f"{MARK}/{batch[1]}"] = max(batch[0], marks.get(f"{MARK}/{batch[1]}", -1))
            known = self.store.tables[table].batches if table in self.store.tables else {}
            expected = {m: known.get(m, -1) for m in marks}
            # queries must find the rows in the buffer or in the segment, and not in both
            def done() -> None:
                self.buffer.frozen.pop(table, None)

            if not left.rows:
                with self._events:
                    done()
                return
            direct = self.store.files and left.columns
            data = left.table() if direct else left.frame(self.spark)
            if self.store.append(table, data, columns=left.columns if direct else None, rows=len(left.rows), marks=marks, expected=expected, around=(self._events, done)):
                return

    def compact(self, table: str, files: int | None = None) -> int:
        """Merge all segments of a table."""
        merged = self.store.compact(table, files)
        self.counters["segments_combined"] += merged
        return merged

    def follow(self, table: str, folder: str, schema: str, checkpoint: str, **more):
        """Append files that appear in a folder; see ``streaming.ingest.stream_into``."""
        return stream_into(self.store, table, folder, schema, checkpoint, **more)

    # queries

    def sql(self, text: str, sorted_groups: bool | None = None) -> DataFrame:
        query = parse(text, self.config.extensions)
        self.counters["queries"] += 1
        with translated():
            return build(query, self.dataframe(query.table), self.config.compat, self.config.sorted_groups if sorted_groups is None else sorted_groups)

    def query_rows(self, text: str) -> dict:
        """{"colnames", "rows", "stats"}; rows are lists."""
        began = time.perf_counter_ns()
        df = self.sql(text, sorted_groups=True)
        with translated():
            rows = [list(r) for r in df.collect()]
        read = scanned(df)
        for counter, what in (("rows_scanned", "rows_scanned"), ("files_opened", "files"), ("bytes_of_files", "file_bytes")):
            self.counters[counter] += read[what]
        return {"colnames": df.columns, "rows": rows, "stats": {"runtime_ns": time.perf_counter_ns() - began, "rows": len(rows), **read}}

    def query_cols(self, text: str, mantissa: int | None = None, full_precision: Collection[str] = ()) -> dict:
        """{"colnames", "cols", "stats"}; cols has a list for each name (the last of equal
        ones).  With ``mantissa`` floats keep so many bits of theirs, but for the columns
        in ``full_precision``."""
        got = self.query_rows(text)
        lists = [list(c) for c in zip(*got["rows"])] or [[] for _ in got["colnames"]]
        cols = dict(zip(got["colnames"], lists))
        if mantissa is not None:
            for name, values in cols.items():
                if name not in full_precision and any(isinstance(v, float) for v in values):
                    cols[name] = truncated(values, mantissa)
        return {"colnames": got["colnames"], "cols": cols, "stats": got["stats"]}

    def multi_query_cols(self, texts: Sequence[str], mantissa: int | None = None, full_precision: Collection[str] = ()) -> list[dict]:
        return [self.query_cols(t, mantissa, full_precision) for t in texts]

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def ast(self, text: str) -> str:
        """The parsed query, or what is wrong with it."""
        try:
            return pformat(parse(text, self.config.extensions))
        except QueryError as e:
            return f"{type(e).__name__}: {e}"

    # about tables

    def columns(self, tables: str | Sequence[str], pattern: str = "", limit: int | None = None, offset: int = 0) -> dict:
        """A page of the sorted names of the tables' columns in which ``pattern`` is found."""
        names: set[str] = set()
        for table in [tables] if isinstance(tables, str) else tables:
            names |= set(self.search_columns(table, pattern))
        found, size = sorted(names), len(names)
        offset = min(offset, max(0, size - limit)) if limit is not None else 0  # the last page is full
        return {"columns": found[offset:][:limit], "offset": offset, "len": size}

    def search_columns(self, table: str, pattern: str) -> list[str]:
        known = {**dict.fromkeys(self.store.columns(table)), **dict.fromkeys(self.buffer.kinds.get(table, ()))}
        return [c for c in known if re.search(pattern, c)]

    def table_stats(self) -> list[Mapping]:
        waiting = {t: len(r) for t, r in self.buffer.rows.items()}
        out = [{**s, "buffered": waiting.pop(s["name"], 0)} for s in self.store.stats()]
        return out + [{"name": t, "rows": 0, "segments": 0, "columns": len(self.buffer.kinds[t]), "bytes": 0, "buffered": n} for t, n in waiting.items()]

    def mem_tree(self, table: str) -> list[Mapping]:
        """Place, rows, columns and bytes of each segment."""
        return self.store.tree(table)

    def perf_counters(self) -> dict[str, int]:
        return dict(self.counters)

    def record_metrics(self) -> None:
        """An event with the counters now, and their rates since the last one."""
        now = time.time()
        event: dict[str, Value] = {"timestamp": int(now)}
        for name, value in self.counters.items():
            event[name] = float(value)
            if self._before:
                event[f"{name}.rate"] = (value - self._before.get(name, 0)) / max(now - self._before["timestamp"], 1e-9)
        self._before = {"timestamp": now, **self.counters}
        with self._events:
            self.buffer.add_row(self.config.metrics_table, event)

    def evict_cache(self) -> None:
        """Take this database's own segments out of memory, and nobody else's tables; they
        are computed again when read."""
        for table in self.store.tables.values():
            for s in table.segments:
                if s.frame is not None:
                    s.frame.unpersist()


def scanned(df: DataFrame) -> dict[str, int]:
    """What a query that has run has read: rows that came out of its scans, files that these opened,
    and the bytes of those."""
    out = {"rows_scanned": 0, "files": 0, "file_bytes": 0}

    def walk(plan) -> None:
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if plan.children().isEmpty():
            metrics = plan.metrics()
            for key, metric in (("rows_scanned", "numOutputRows"), ("files", "numFiles"), ("file_bytes", "filesSize")):
                if metrics.contains(metric):
                    out[key] += metrics.apply(metric).value()
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))
        return None

    walk(df._jdf.queryExecution().executedPlan())
    return out


class Client:
    """Logging and queries under the names that client libraries use."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def log(self, table: str, metrics: Mapping[str, Value]) -> None:
        self.engine.log(table, metrics)

    def log_batch(self, table: str, metrics: Mapping[str, Sequence[Value]]) -> None:
        """Columns of one length, a row for each of their values."""
        if len({len(v) for v in metrics.values()}) > 1:
            raise ValueError("all columns must have one length")
        for values in zip(*metrics.values()):
            self.engine.log(table, dict(zip(metrics, values)))

    def query(self, text: str) -> dict[str, list]:
        return self.engine.query_cols(text)["cols"]

    def multi_query(self, texts: Sequence[str]) -> list[dict[str, list]]:
        return [self.query(t) for t in texts]

    def columns(self, table: str, pattern: str | None = None) -> list[str]:
        return self.engine.columns(table, pattern or "")["columns"]
