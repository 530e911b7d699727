from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywell.__main__ import command
from tallywell.engine import Client, Engine, EngineConfig
from tallywell.functions.precision import truncated
from tallywell.plans import errors
from tallywell.plans.ast import Binary, Call, Item, Literal, Name, Order, Query, Unary
from tallywell.plans.parser import parse, tokens
from tallywell.server import answer, serve
from tallywell.sources import generator as gen
from tallywell.sources.csv import CsvOptions, read_csv
from tallywell.sources.schema import ColumnSchema, CsvSchema
from tallywell.sources.store import widest


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "db")


def rows(db, text):
    return db.query_rows(text)["rows"]


# parser


def test_ast():
    got = parse("select a, COUNT(1) as c from t where a + 2 * 3 > -1 order by c desc limit 5 offset 2 rows")
    two_three = Binary("*", Literal(2, "2"), Literal(3, "3"))
    assert got == Query(
        (Item(Name("a"), None), Item(Call("count", (Literal(1, "1"),), "COUNT"), "c")), "t",
        where=Binary(">", Binary("+", Name("a"), two_three), Unary("-", Literal(1, "1"))), order_by=(Order(Name("c"), True),), limit=5, offset=2,
    )


@pytest.mark.parametrize("text,shape", [("1 - 2 - 3", "((1-2)-3)"), ("1 + 2 * 3 % 4", "(1+((2*3)%4))"), ("a or b and not c = d", "(aOR(bANDNOT(c=d)))"), ("(a or b) and c", "((aORb)ANDc)"), ("-a * b", "(-a*b)"), ("a < b + 1", "(a<(b+1))")])
def test_precedence(text, shape):
    def show(e):
        match e:
            case Binary(op, a, b):
                return f"({show(a)}{op}{show(b)})"
            case Unary(op, a):
                return f"{op}{show(a)}"
        return show(e.inner) if hasattr(e, "inner") else str(e)

    assert show(parse(f"SELECT {text} FROM t").select[0].expr) == shape


def test_numbers():
    value = lambda t: parse(f"SELECT {t} FROM t").select[0].expr.value
    assert [value(t) for t in ("7", "1e3", ".5", "2.", "99999999999999999999")] == [7, 1000.0, 0.5, 2.0, 1e20]


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_parses_or_is_refused(text):
    for t in (text, f"SELECT {text} FROM t"):
        try:
            parse(t)
        except errors.QueryError:
            pass
        except RecursionError:
            pass


@given(st.lists(st.sampled_from(["a", "1", "'x'", "+", "(", ")", ",", "and", "not", "count", "is", "null", "like", "*", "."]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_names_parse_again(parts):
    text = "SELECT " + " ".join(parts) + " FROM t"
    try:
        query = parse(text)
    except errors.QueryError:
        return
    for item in query.select:
        if item.alias is None and str(item.expr) != "*":
            assert str(parse(f"SELECT {item.expr} FROM t").select[0].expr) == str(item.expr)


def test_tokens_cover_the_text():
    assert [t.text for t in tokens("a>=1 -- c\n<>'it''s'\"x\"\"y\"")][:-1] == ["a", ">=", "1", "<>", "'it''s'", '"x""y"']


# sources


def test_schema_strings():
    assert CsvSchema.parse("i,ns,string,nint") == CsvSchema((ColumnSchema("int"), ColumnSchema("str", True), ColumnSchema("str"), ColumnSchema("int", True)))
    named = CsvSchema.parse("name:s,x:i.100,when:ni.date,gone:")
    assert named.names == ("name", "x", "when", "gone") and named.columns[1].transform == "100" and named.columns[3].kind == "drop"
    for bad in ("a:s,i", "x", "a:b:i", "i.1.2"):
        with pytest.raises(errors.ParseError):
            CsvSchema.parse(bad)


def test_csv_kinds_and_empty_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i,f,s,e,q\n1,1,x,,"a,""b"""\n,2.5,,,\n-3,1e2,007,,z\n')
    plain = read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in plain.collect()] == [(1, 1.0, "x", "", 'a,"b"'), (0, 2.5, "", "", ""), (-3, 100.0, "007", "", "z")]
    nullable = read_csv(spark, str(tmp_path / "a.csv"), CsvOptions(all_nullable=True))
    assert [tuple(r) for r in nullable.collect()] == [(1, 1.0, "x", None, 'a,"b"'), (None, 2.5, None, None, None), (-3, 100.0, "007", None, "z")]
    some = read_csv(spark, str(tmp_path / "a.csv"), CsvOptions(nullable={0}, always_string={1}, ignore={3, 4}))
    assert [tuple(r) for r in some.collect()] == [(1, "1", "x"), (None, "2.5", ""), (-3, "1e2", "007")]


def test_csv_schema_and_gzip(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("1.999,2013-08-02 00:00:01,9\n,,\n-0.555,1969-12-31 23:59:59,x\n")
    options = CsvOptions.with_schema("a:i.100,d:ni.date,n:ni", header=False)
    got = read_csv(spark, str(tmp_path / "b.csv.gz"), options)
    assert [tuple(r) for r in got.collect()] == [(199, 1375401601, 9), (0, None, None), (-55, -1, None)]


def test_generators(spark):
    db = Engine(spark)
    db.gen_table("t", {"a": gen.incrementing_int(), "b": gen.int_uniform(0, 10), "c": gen.string_markov_chain(["x", "y"], [[0, 1], [1, 0]]), "d": gen.partition_sparse(0.5, gen.incrementing_int())}, 8, 100)
    got = rows(db, "SELECT a, b, c, d FROM t ORDER BY a")
    assert [r[0] for r in got] == list(range(800)) and {r[1] for r in got} == set(range(10))
    for p in range(8):
        part = got[100 * p : 100 * p + 100]
        assert all(x[2] != y[2] for x, y in zip(part, part[1:]))
        assert len({r[3] is None for r in part}) == 1
    again = Engine(spark)
    again.gen_table("t", {"a": gen.incrementing_int(), "b": gen.int_uniform(0, 10), "c": gen.string_markov_chain(["x", "y"], [[0, 1], [1, 0]]), "d": gen.partition_sparse(0.5, gen.incrementing_int())}, 8, 100)
    assert rows(again, "SELECT a, b, c, d FROM t ORDER BY a") == got


def test_widest():
    assert [widest(a, b) for a, b in (("null", "int"), ("int", "float"), ("float", "str"), ("bool", "int"), ("bool", "null"))] == ["int", "float", "str", "str", "bool"]


# events and storage


def test_events_are_seen_before_and_after_flush(spark, path):
    db = Engine(spark, EngineConfig(path=path))
    db.log("m", {"x": 1, "timestamp": 5})
    db.log("m", {"x": 2.5, "new": "a"})
    before = rows(db, "SELECT x, new FROM m ORDER BY x")
    assert before == [[1.0, None], [2.5, "a"]]
    db.flush()
    db.log("m", {"x": "text", "odd.name [k]": 7})
    want = [["1.0", None, None], ["2.5", "a", None], ["text", None, 7]]
    assert rows(db, 'SELECT x, new, "odd.name [k]" FROM m ORDER BY x') == want
    db.flush()
    again = Engine(spark, EngineConfig(path=path))
    assert rows(again, 'SELECT x, new, "odd.name [k]" FROM m ORDER BY x') == want
    assert rows(again, "SELECT COUNT(timestamp) FROM m") == [[3]]


def test_sparse_columns_and_compaction(spark, path):
    db = Engine(spark, EngineConfig(path=path))
    for start in range(0, 60, 20):
        db.ingest_rows("s", [{"row": i, **({"f": i / 2} if i % 7 == 0 else {})} for i in range(start, start + 20)])
        db.flush()
    query = "SELECT SUM(row), COUNT(f), SUM(f) FROM s"
    want = [[sum(range(60)), 9, sum(i / 2 for i in range(0, 60, 7))]]
    assert rows(db, query) == want and db.table_stats()[0]["segments"] == 3
    assert db.compact("s") == 3 and db.compact("s") == 0
    assert rows(db, query) == want and db.table_stats()[0]["segments"] == 1
    assert rows(Engine(spark, EngineConfig(path=path)), query) == want


def test_automatic_flush_and_compaction(spark, path):
    db = Engine(spark, EngineConfig(path=path, buffer_bytes=200, combine_segments=3))
    for i in range(40):
        db.log("t", {"v": i})
    db.flush()
    assert rows(db, "SELECT COUNT(1), SUM(v) FROM t") == [[40, 780]]
    assert db.counters["segments_combined"] >= 3 and db.table_stats()[0]["segments"] < 4


def test_size_tiers(spark, path):
    db = Engine(spark, EngineConfig(path=path, combine_segments=3))
    for i in range(9):
        db.ingest("t", {"v": [i], f"only{i}": [1]})
        db.flush()
    sizes = sorted(s["rows"] for s in db.mem_tree("t"))
    assert sizes == [9] and db.counters["segments_combined"] == 12  # each row was rewritten twice
    assert rows(db, "SELECT COUNT(1), SUM(v), COUNT(only3) FROM t") == [[9, 36, 1]]


def test_log_survives_the_driver(spark, path):
    db = Engine(spark, EngineConfig(path=path))
    db.ingest("a", {"v": [1, 2]})
    db.ingest_rows("b", [{"w": "x"}, {"w": None, "z": 1.5}])
    again = Engine(spark, EngineConfig(path=path))  # without a flush
    assert rows(again, "SELECT SUM(v) FROM a") == [[3]] and rows(again, "SELECT COUNT(1), COUNT(w), SUM(z) FROM b") == [[2, 1, 1.5]]
    # as if the driver had gone between the two tables' commits
    again.store.append("a", again.buffer.frame(spark, "a"), marks={"_log": again.log_file.last})
    third = Engine(spark, EngineConfig(path=path))
    assert rows(third, "SELECT SUM(v) FROM a") == [[3]] and rows(third, "SELECT COUNT(1) FROM b") == [[2]]
    third.flush()
    assert third.store.files.names("_log") == []
    assert rows(Engine(spark, EngineConfig(path=path)), "SELECT COUNT(1) FROM b") == [[2]]
    third.ingest("a", {"v": [10]})
    assert rows(Engine(spark, EngineConfig(path=path)), "SELECT SUM(v) FROM a") == [[13]]
    with pytest.raises(errors.QueryTypeError):
        third.ingest("a", {"v": [1, [2]]})
    assert rows(third, "SELECT SUM(v) FROM a") == [[13]]


def test_restart_loop(spark, path):
    for n in range(1, 4):
        db = Engine(spark, EngineConfig(path=path))
        db.ingest("t", {"v": [float(n)] * 5})
        db.flush()
        assert rows(Engine(spark, EngineConfig(path=path)), "SELECT SUM(v) FROM t") == [[5.0 * sum(range(1, n + 1))]]


def test_meta_tables(spark, path):
    db = Engine(spark, EngineConfig(path=path))
    db.ingest("one", {"a": [1]})
    db.ingest("two", {"b": [1], "a": [2]})
    db.flush()
    names = [r[0] for r in rows(db, "SELECT name FROM _meta_tables ORDER BY name")]
    assert names == ["_meta_columns_one", "_meta_columns_two", "one", "two"]
    assert rows(db, "SELECT column_name FROM _meta_columns_two ORDER BY column_name") == [["a"], ["b"]]
    assert db.tables() == ["one", "two"]
    assert db.columns(["one", "two"]) == {"columns": ["a", "b"], "offset": 0, "len": 2}
    assert db.columns("two", "", limit=1, offset=9) == {"columns": ["b"], "offset": 1, "len": 2}
    assert db.columns("two", "^a") == {"columns": ["a"], "offset": 0, "len": 1}


def test_stream(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "db")
    db = Engine(spark, EngineConfig(path=path))
    follow = lambda: db.follow("e", folder, "id long, v string", str(tmp_path / "at"), once=True, most_files=1).awaitTermination()
    spark.range(0, 10).selectExpr("id", "'a' AS v").coalesce(1).write.json(folder)
    follow()
    spark.range(10, 15).selectExpr("id", "'b' AS v").coalesce(1).write.mode("append").json(folder)
    follow()
    follow()
    assert rows(db, "SELECT v, COUNT(1), SUM(id) FROM e") == [["a", 10, 45], ["b", 5, 60]]
    stream, last = next(iter(db.store.tables["e"].batches.items()))
    assert not db.store.append("e", spark.range(3), stream=stream, batch=last)  # tried again after a failure
    assert rows(db, "SELECT COUNT(1) FROM e") == [[15]]


def test_names_by_case_and_twice(spark):
    db = Engine(spark)
    db.register("t", spark.createDataFrame([(1, 2)], "a long, b long"))
    assert rows(db, "SELECT a, A, a, b FROM t") == [[1, None, 1, 2]]
    assert db.query_cols("SELECT a, b AS `x.y` FROM t")["cols"] == {"a": [1], "x.y": [2]}


def test_unreadable_types(spark):
    db = Engine(spark)
    db.register("t", spark.sql("SELECT 1 AS a, array(1) AS b, TIMESTAMP '1970-01-02 00:00:00' AS c, 1.5BD AS d"))
    assert rows(db, "SELECT a, c, d FROM t") == [[1, 86400, 1.5]]
    with pytest.raises(errors.QueryTypeError):
        db.sql("SELECT b FROM t")


# facades


def test_client(spark):
    client = Client(Engine(spark))
    client.log("t", {"x": 1})
    client.log_batch("t", {"x": [2, 3], "y": ["a", None]})
    assert client.query("SELECT x, y FROM t ORDER BY x") == {"x": [1, 2, 3], "y": [None, "a", None]}
    assert client.multi_query(["SELECT SUM(x) AS s FROM t", "SELECT COUNT(y) AS c FROM t"]) == [{"s": [6]}, {"c": [1]}]
    assert client.columns("t") == ["timestamp", "x", "y"] and client.columns("t", "x|y") == ["x", "y"]
    with pytest.raises(ValueError):
        client.log_batch("t", {"x": [1], "y": []})
    with pytest.raises(errors.QueryTypeError):
        client.log("t", {"x": [1]})


def test_mantissa(spark):
    db = Engine(spark)
    db.register("t", spark.sql("SELECT 1.0D / 3 AS a, 1.0D / 3 AS b, 3 AS c UNION ALL SELECT NULL, double('nan'), 4"))
    got = db.query_cols("SELECT a, b, c FROM t ORDER BY c", mantissa=2, full_precision=["b"])["cols"]
    assert got["a"] == [0.3125, None] and got["b"][0] == 1 / 3 and got["c"] == [3, 4]
    assert truncated([1.75, -1.75, float("inf")], 1) == [1.5, -1.5, float("inf")] and truncated([0.1], 52) == [0.1]
    with pytest.raises(ValueError):
        truncated([1.0], 53)


def test_metrics(spark):
    db = Engine(spark)
    db.ingest("t", {"x": [1]})
    db.record_metrics()
    rows(db, "SELECT x FROM t")
    db.record_metrics()
    got = rows(db, 'SELECT queries, rows_ingested, "queries.rate" FROM _metrics ORDER BY queries')
    assert [r[:2] for r in got] == [[0.0, 1.0], [1.0, 1.0]] and got[0][2] is None and got[1][2] > 0


def test_http(spark):
    db = Engine(spark)
    post = lambda path, data: answer(db, "POST", path, json.dumps(data).encode())
    assert post("/insert", {"t": {"x": [1, 2]}}) == (200, "ok")
    assert post("/query", {"query": "SELECT x FROM t ORDER BY x"})[1]["rows"] == [[1], [2]]
    assert post("/query_cols", {"query": "SELECT x FROM t ORDER BY x"})[1]["cols"] == {"x": [1, 2]}
    assert [r["cols"] for r in post("/multi_query_cols", {"queries": ["SELECT COUNT(1) AS c FROM t"]})[1]] == [{"c": [2]}]
    assert post("/columns", {"tables": ["t"]}) == (200, {"columns": ["x"], "offset": 0, "len": 1})
    assert [post("/query", {"query": q})[0] for q in ("SELECT", "SELECT a FROM t JOIN u", "SELECT x + 'a' FROM t")] == [400, 501, 400]
    assert post("/query", {})[0] == 400 and answer(db, "GET", "/nothing", b"")[0] == 404
    server = serve(db, 0)
    thread = threading.Thread(target=lambda: [server.handle_request() for _ in range(2)], daemon=True)
    thread.start()
    base = f"http://127.0.0.1:{server.server_port}"
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
    assert json.load(opener.open(f"{base}/tables")) == ["t"]
    with pytest.raises(urllib.error.HTTPError):
        opener.open(f"{base}/query", b'{"query": "SELECT x FROM nowhere"}')
    server.server_close()


def test_prompt(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,\n")
    db = Engine(spark)
    assert command(db, f":load {tmp_path}/a.csv t") == "2 rows"
    assert command(db, "SELECT x, y FROM t ORDER BY x;").splitlines()[:3] == ["x | y", "--+--", "1 | a"]
    assert "Scan" in command(db, ":explain SELECT x FROM t") and "Query(" in command(db, ":ast SELECT x FROM t")
    assert command(db, "SELECT FROM").startswith("ParseError") and command(db, "exit") is None
    assert "'rows': 2" in command(db, ":table_stats")


def test_plans(spark, path):
    """One scan of the columns used, filters pushed to it, partial aggregation, and a top-k."""
    db = Engine(spark, EngineConfig(path=path))
    db.append("t", spark.range(100).selectExpr("id", "id % 3 AS k", "'x' AS s", "id * 2.0D AS v"))
    plan = db.explain("SELECT k, SUM(v) AS s FROM t WHERE id < 50 ORDER BY SUM(v) DESC LIMIT 2")
    assert plan.count("Scan parquet") >= 1 and "partial_sum" in plan and "TakeOrderedAndProject" in plan
    assert "PushedFilters: [IsNotNull(c0), LessThan(c0,50)]" in plan and "ReadSchema: struct<c0:bigint,c1:bigint,c3:double>" in plan


def test_config():
    for bad in ({"compat": "x"}, {"buffer_bytes": -1}, {"combine_segments": 1}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


@pytest.mark.parametrize("parts,shuffles", [(1, 1), (7, 3)])
def test_partitioning_does_not_show(spark, parts, shuffles):
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        db = Engine(spark)
        db.register("t", spark.range(1000).selectExpr("id", "id % 10 AS k").repartition(parts))
        assert rows(db, "SELECT k, SUM(id), COUNT(1) FROM t LIMIT 2") == [[0, 49500, 100], [1, 49600, 100]]
        assert rows(db, "SELECT id FROM t ORDER BY k, id DESC LIMIT 2 OFFSET 1") == [[980], [970]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
