"""A client of a server (``tallywell.server``): events are gathered here and sent in batches.

A thread sends what has been gathered every ``flush_seconds``, and tries again, at growing
intervals, if the server does not answer.  Where events come faster than they can be sent, the
buffer fills: ``log`` then waits or drops the event, as ``when_full`` says.
"""

from __future__ import annotations

import base64
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Mapping, Sequence

from .functions.precision import unxored

Value = int | float | str | bool | None


class ServerError(RuntimeError):
    """What the server says about a request that it refuses."""

    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


class RemoteClient:
    """``buffer_bytes``: events held here at most.  ``when_full``: "block" or "drop".  ``retry_seconds``:
    the first and the longest wait after a failure."""

    def __init__(self, url: str, *, flush_seconds: float = 1.0, buffer_bytes: int = 16 << 20, when_full: str = "block", retry_seconds: tuple[float, float] = (0.1, 10.0), timeout: float = 60.0):
        if when_full not in ("block", "drop"):
            raise ValueError("when_full is block or drop")
        self.url, self.timeout, self.when_full, self.most = url.rstrip("/"), timeout, when_full, buffer_bytes
        self.flush_seconds, self.retry_seconds = flush_seconds, retry_seconds
        self.dropped = self.failures = self.sent = 0
        self._events: dict[str, list[Mapping[str, Value]]] = {}
        self._held = 0
        self._sending: list[tuple[str, int]] = []
        self._change = threading.Condition()
        self._closed = False
        self._opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    # events

    def log(self, table: str, event: Mapping[str, Value]) -> bool:
        """One event, with the time in ``timestamp`` if it has none; whether it was taken."""
        event = dict(event) if "timestamp" in event else {**event, "timestamp": time.time()}
        size = len(json.dumps(event))  # and an error here for values that can't be sent
        with self._change:
            while not self._closed and self._held and self._held + size > self.most:
                if self.when_full == "drop":
                    self.dropped += 1
                    return False
                self._change.notify_all()
                self._change.wait(0.5)
            if self._closed:
                raise RuntimeError("the client is closed")
            self._events.setdefault(table, []).append(event)
            self._held += size
            if self._held >= self.most // 2:
                self._change.notify_all()
        return True

    def log_batch(self, table: str, columns: Mapping[str, Sequence[Value]]) -> None:
        """Columns of one length, a row for each of their values."""
        if len({len(v) for v in columns.values()}) > 1:
            raise ValueError("all columns must have one length")
        for values in zip(*columns.values()):
            self.log(table, dict(zip(columns, values)))

    def flush(self, timeout: float | None = None) -> bool:
        """Wait until all events so far are sent; whether they are."""
        end = None if timeout is None else time.monotonic() + timeout
        with self._change:
            while self._events or self._sending:
                if end is not None and time.monotonic() >= end:
                    return False
                self._change.notify_all()
                self._change.wait(0.05)
        return True

    def close(self, timeout: float | None = 30.0) -> bool:
        """Send what is left, for so long at most; whether all was sent."""
        done = self.flush(timeout)
        with self._change:
            self._closed = True
            self._change.notify_all()
        self._thread.join(5)
        return done

    def _run(self) -> None:
        wait = self.retry_seconds[0]
        batch: dict[str, list[Mapping[str, Value]]] = {}
        while True:
            with self._change:
                if not batch:
                    self._change.wait(self.flush_seconds)
                    batch, self._events = self._events, {}
                    size = self._held
                    self._sending = [(t, len(r)) for t, r in batch.items()]
                if self._closed and not batch:
                    return
            if not batch:
                continue
            try:
                self._post("/insert_rows", batch)
                self.sent += sum(map(len, batch.values()))
            except ServerError as e:
                if e.status < 500:  # it will never be taken
                    self.dropped += sum(map(len, batch.values()))
                else:
                    wait = self._failed(wait)
                    continue
            except (OSError, urllib.error.URLError):
                wait = self._failed(wait)
                continue
            with self._change:
                batch, self._sending, wait = {}, [], self.retry_seconds[0]
                self._held -= size  # those that came meanwhile stay counted
                self._change.notify_all()

    def _failed(self, wait: float) -> float:
        self.failures += 1
        with self._change:
            self._change.wait(wait)
        return min(2 * wait, self.retry_seconds[1])

    # queries

    def _request(self, path: str, data: bytes | None) -> bytes:
        try:
            with self._opener.open(urllib.request.Request(self.url + path, data), timeout=self.timeout) as got:
                return got.read()
        except urllib.error.HTTPError as e:
            raise ServerError(e.code, e.read().decode(errors="replace")) from None

    def _post(self, path: str, value: object):
        return json.loads(self._request(path, json.dumps(value).encode()))

    def query(self, text: str, **more) -> dict[str, list]:
        """Columns by name.  ``mantissa`` and ``full_precision`` as on the server; floats come as
        they are, or XOR-coded with ``encoding="xor"``."""
        return _plain(self._post("/query_cols", {"query": text, **more})["cols"])

    def multi_query(self, texts: Sequence[str], **more) -> list[dict[str, list]]:
        return [_plain(x["cols"]) for x in self._post("/multi_query_cols", {"queries": list(texts), **more})]

    def query_table(self, text: str):
        """A query's result as an Arrow table."""
        import pyarrow as pa

        return pa.ipc.open_stream(self._request("/query_data", json.dumps({"query": text}).encode())).read_all()

    def insert_table(self, table: str, data) -> None:
        """Append an Arrow table, at once and not through the buffer."""
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, data.schema) as writer:
            writer.write_table(data)
        self._request(f"/insert_bin?table={urllib.parse.quote(table)}", sink.getvalue().to_pybytes())

    def columns(self, table: str, pattern: str | None = None) -> list[str]:
        return self._post("/columns", {"tables": [table], "pattern": pattern or ""})["columns"]

    def tables(self) -> list[str]:
        return json.loads(self._request("/tables", None))


def _plain(cols: Mapping[str, object]) -> dict[str, list]:
    return {c: unxored(base64.b64decode(v["xor"]), v["nulls"]) if isinstance(v, dict) else v for c, v in cols.items()}
