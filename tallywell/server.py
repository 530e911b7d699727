"""The engine over HTTP, with JSON bodies unless said otherwise.

GET  /tables, /table/<name>, /metrics, /hey, /, /plot?query=<text> (a page with a chart of a
     query's first column against the others)
POST /query {"query"}, /query_cols {"query"}, /multi_query_cols {"queries"} (the latter two
     with "mantissa" and "full_precision" if floats are to be cut short, and with "encoding":
     "xor" if columns of floats are to come XOR-coded), /query_data {"query"} (an Arrow stream),
     /columns {"tables", "pattern", "limit", "offset"}, /insert {table: {column: [values]}},
     /insert_rows {table: [{column: value}]}, /insert_bin?table=<name> (an Arrow stream), /echo

Requests are answered by threads, as many at a time as the engine's ``threads``; others wait.
"""

from __future__ import annotations

import base64
import json
import threading
from html import escape
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

import pyarrow as pa

from .engine import Engine
from .functions.precision import xored
from .plans.errors import QueryError

#: Rows that a chart shows at most; more are left out, which the page says.
PLOT_ROWS = 5000


def _coded(result: dict, encoding: str | None) -> dict:
    if encoding == "xor":
        for name, values in result["cols"].items():
            if any(isinstance(v, float) for v in values) and all(v is None or isinstance(v, float) for v in values):
                data, nulls = xored(values)
                result["cols"][name] = {"xor": base64.b64encode(data).decode(), "nulls": nulls}
    elif encoding:
        raise ValueError("encoding is xor or nothing")
    return result


def _arrow(engine: Engine, text: str) -> bytes:
    table = engine.sql(text, sorted_groups=True).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def plot(engine: Engine, text: str) -> str:
    """A page with a chart of a query, whose first column is the x axis."""
    got = engine.query_rows(text)
    rows = [r for r in got["rows"] if all(isinstance(v, (int, float)) for v in r[:1])][:PLOT_ROWS]
    lines, names = [], got["colnames"]
    xs = [r[0] for r in rows] or [0]
    ys = [v for r in rows for v in r[1:] if isinstance(v, (int, float))] or [0]
    scale = lambda v, values, size: (v - min(values)) / ((max(values) - min(values)) or 1) * size
    for k in range(1, len(names)):
        points = " ".join(f"{scale(r[0], xs, 800):.1f},{400 - scale(r[k], ys, 400):.1f}" for r in rows if isinstance(r[k], (int, float)))
        hue = 137 * k % 360
        lines.append(f'<polyline fill="none" stroke="hsl({hue} 60% 40%)" points="{points}"/><text x="810" y="{20 * k}" fill="hsl({hue} 60% 40%)">{escape(names[k])}</text>')
    note = f"{len(got['rows'])} rows" + (f", of which {len(rows)} are shown" if len(rows) < len(got["rows"]) else "")
    return f'<!doctype html><meta charset="utf-8"><title>{escape(text)}</title><pre>{escape(text)}</pre><svg width="1000" height="420" viewBox="-10 -10 1000 420">{"".join(lines)}</svg><p>x: {escape(names[0])}, {min(xs)} to {max(xs)}; y: {min(ys)} to {max(ys)}; {note}</p>'


def answer(engine: Engine, method: str, path: str, body: bytes) -> tuple[int, object]:
    """Status and value for a request: bytes are an Arrow stream, a page begins with a doctype, and
    all else is JSON."""
    path, _, rest = path.partition("?")
    given = {k: v[-1] for k, v in parse_qs(rest).items()}
    try:
        if method == "GET":
            if path == "/tables":
                return 200, engine.tables()
            if path.startswith("/table/"):
                return 200, engine.columns(unquote(path[7:]))
            if path == "/metrics":
                return 200, engine.perf_counters()
            if path == "/plot":
                return 200, plot(engine, given["query"])
            if path in ("/", "/hey"):
                return 200, "hey"
            return 404, "no such page"
        if path == "/echo":
            return 200, body.decode(errors="replace")
        if path == "/insert_bin":
            table = pa.ipc.open_stream(body).read_all()
            engine.ingest(given["table"], table.to_pydict())
            return 200, "ok"
        data = json.loads(body or b"{}")
        cut = (data.get("mantissa"), data.get("full_precision") or ()) if isinstance(data, dict) else ()
        if path == "/query":
            return 200, engine.query_rows(data["query"])
        if path == "/query_data":
            return 200, _arrow(engine, data["query"])
        if path == "/query_cols":
            return 200, _coded(engine.query_cols(data["query"], *cut), data.get("encoding"))
        if path == "/multi_query_cols":
            return 200, [_coded(x, data.get("encoding")) for x in engine.multi_query_cols(data["queries"], *cut)]
        if path == "/columns":
            return 200, engine.columns(data["tables"], data.get("pattern") or "", data.get("limit"), data.get("offset") or 0)
        if path == "/insert":
            for table, columns in data.items():
                engine.ingest(table, columns)
            return 200, "ok"
        if path == "/insert_rows":
            for table, rows in data.items():
                engine.ingest_rows(table, rows)
            return 200, "ok"
        return 404, "no such page"
    except QueryError as e:
        return e.status, f"{type(e).__name__}: {e}"
    except (KeyError, ValueError, TypeError, AttributeError, pa.ArrowInvalid) as e:
        return 400, f"{type(e).__name__}: {e}"


def serve(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> HTTPServer:
    """A server that ``serve_forever`` or ``handle_request`` starts."""
    free = threading.Semaphore(engine.config.threads)

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            with free:
                try:
                    status, value = answer(engine, self.command, self.path, body)
                except Exception as e:  # of Spark, say: the server goes on
                    status, value = 500, f"{type(e).__name__}: {e}"
            page = isinstance(value, str) and urlsplit(self.path).path == "/plot" and status == 200
            kind = "application/vnd.apache.arrow.stream" if isinstance(value, bytes) else "text/html" if page else "application/json"
            data = value if isinstance(value, bytes) else value.encode() if page else json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply  # noqa: N815  (names of the base class)

        def log_message(self, *args) -> None:
            pass

    class Server(ThreadingHTTPServer):
        daemon_threads = True
        request_queue_size = 128

    return Server((host, port), Handler)
