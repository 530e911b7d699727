"""A prompt for queries: ``python -m tallywell [--path FOLDER] [--load FILE.csv TABLE]``.

:load FILE TABLE   :explain QUERY   :show QUERY (with what it read)   :ast QUERY
:table_stats   :memtree TABLE   :recover   :flush   :compact TABLE   :help   exit
"""

from __future__ import annotations

import argparse

from .engine import Engine, EngineConfig
from .plans.errors import QueryError
from .plans.session import local_session


def command(engine: Engine, line: str) -> str | None:
    """What a line gives; None ends the session."""
    line = line.strip().rstrip(";")
    word, _, rest = line.partition(" ")
    try:
        match word:
            case "":
                return ""
            case "exit" | ":exit":
                return None
            case "help" | ":help":
                return __doc__.strip()
            case ":load":
                path, _, table = rest.partition(" ")
                return f"{engine.load_csv(path, table or 'default')} rows"
            case ":explain":
                return engine.explain(rest)
            case ":show":
                return f"{engine.explain(rest)}\n{engine.query_rows(rest)['stats']}"
            case ":ast":
                return engine.ast(rest)
            case ":table_stats":
                return "\n".join(map(str, engine.table_stats()))
            case ":memtree":
                return "\n".join(map(str, engine.mem_tree(rest))) if rest else "\n".join(map(str, engine.table_stats()))
            case ":recover":
                return f"{engine.recover()} rows"
            case ":flush":
                engine.flush()
                return "done"
            case ":compact":
                return f"{engine.compact(rest)} segments merged"
        got = engine.query_rows(line)
        rows = [["NULL" if v is None else str(v) for v in r] for r in got["rows"]]
        widths = [max(map(len, c)) for c in zip(got["colnames"], *rows)]
        out = [" | ".join(v.ljust(w) for v, w in zip(r, widths)) for r in [got["colnames"], *rows]]
        return "\n".join([out[0], "-+-".join("-" * w for w in widths), *out[1:], f"{len(rows)} rows in {got['stats']['runtime_ns'] / 1e6:.0f} ms"])
    except QueryError as e:
        return f"{type(e).__name__}: {e}"


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--path")
    args.add_argument("--load", nargs=2, action="append", default=[], metavar=("FILE", "TABLE"))
    given = args.parse_args()
    engine = Engine(local_session(), EngineConfig(path=given.path))
    for path, table in given.load:
        engine.load_csv(path, table)
    while True:
        try:
            out = command(engine, input("tallywell> "))
        except EOFError:
            break
        if out is None:
            break
        print(out)


if __name__ == "__main__":
    main()
