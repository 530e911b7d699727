from __future__ import annotations

import pytest

from tallywell.engine import Engine, EngineConfig
from tallywell.plans import errors
from tallywell.sources.csv import CsvOptions

from .edge_cases import CSV, GOLDENS, OVERFLOWS, STORE_GOLDENS


@pytest.fixture(scope="module", params=["memory", "disk"])
def engines(spark, request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edge")
    (folder / "edge.csv").write_text(CSV)
    out = {}
    for compat in ("sql", "store"):
        path = None if request.param == "memory" else str(folder / f"db_{compat}")
        out[compat] = Engine(spark, EngineConfig(path=path, compat=compat))
        out[compat].load_csv(str(folder / "edge.csv"), "default", CsvOptions(all_nullable=True))
        if path:
            out[compat] = Engine(spark, EngineConfig(path=path, compat=compat))  # from the files alone
    return out


def same(got, want):
    return len(got) == len(want) and all(g == (pytest.approx(w, rel=1e-12, abs=1e-300) if isinstance(w, float) else w) for a, b in zip(got, want) for g, w in zip(a, b))


@pytest.mark.parametrize("query,want", GOLDENS)
def test_golden(engines, query, want):
    got = engines["sql"].query_rows(query)["rows"]
    assert same(got, want), got


@pytest.mark.parametrize("query,want", STORE_GOLDENS)
def test_store_compat(engines, query, want):
    assert engines["store"].query_rows(query)["rows"] == want


def test_sql_compat(engines):
    run = lambda q: engines["sql"].query_rows(q)["rows"]
    assert run("SELECT MIN(_step), COUNT(_step) FROM default WHERE _step IS NOT NULL") == [[None, 0]]
    assert run("SELECT id/5, COUNT(nope) FROM default") == [[0, 0], [1, 0]]


@pytest.mark.parametrize("query", OVERFLOWS)
def test_overflow(engines, query):
    with pytest.raises(errors.Overflow):
        engines["sql"].query_rows(query)


@pytest.mark.parametrize(
    "query,names",
    [
        ("SELECT non_dense_ints + negative - 2 FROM default", ["non_dense_ints + negative - 2"]),
        ("SELECT SUM(u8_offset_encoded) FROM default;", ["SUM(u8_offset_encoded)"]),
        ("SELECT COUNT(1) as cnt FROM default", ["cnt"]),
        ('SELECT "u8_offset_encoded" FROM "default" WHERE "u8_offset_encoded" = 256;', ["u8_offset_encoded"]),
        ("SELECT name, COUNT(1) AS c, timestamp FROM _meta_tables;", ["name", "c", "timestamp"]),
        ("select  ( id+1 )*2,NOT id IS NULL, name LIKE 'a%' from default", ["(id + 1) * 2", "NOT id IS NULL", "name LIKE 'a%'"]),
    ],
)
def test_names(engines, query, names):
    assert engines["sql"].sql(query).columns == names


def test_star_is_sorted(engines):
    columns = engines["sql"].sql("SELECT * FROM default").columns
    assert columns == sorted(CSV.splitlines()[0].split(","))


ERRORS = [
    ("SELECT", errors.ParseError), ("SELECT a b c FROM t", errors.ParseError), ("SELECT a FROM (SELECT 1)", errors.ParseError), ("SELECT a FROM default LIMIT x", errors.ParseError),
    ("SELECT a FROM default; SELECT 1", errors.ParseError), ("SELECT 'a FROM default", errors.ParseError), ("", errors.ParseError), ("SELECT id FROM default ORDER id", errors.ParseError),
    ("SELECT a FROM t, u", errors.Unsupported), ("SELECT a FROM t JOIN u", errors.Unsupported), ("SELECT a FROM t UNION SELECT b FROM u", errors.Unsupported), ("INSERT INTO t VALUES (1)", errors.Unsupported),
    ("SELECT nothing(id) FROM default", errors.Unsupported), ("SELECT sum(id) OVER () FROM default", errors.Unsupported), ("SELECT id FROM nowhere", errors.Unsupported),
    ("SELECT id FROM default ORDER BY id NULLS FIRST", errors.Unsupported), ("SELECT t.id FROM default", errors.Unsupported), ("WITH x AS (SELECT 1) SELECT 1 FROM x", errors.Unsupported),
    ("SELECT sum(sum(id)) FROM default", errors.QueryTypeError), ("SELECT enum + 1 FROM default", errors.QueryTypeError), ("SELECT id FROM default WHERE enum = 1", errors.QueryTypeError),
    ("SELECT id FROM default WHERE id", errors.QueryTypeError), ("SELECT id FROM default WHERE id AND id > 1", errors.QueryTypeError), ("SELECT id + sum(id) FROM default", errors.QueryTypeError),
    ("SELECT id FROM default WHERE sum(id) > 1", errors.QueryTypeError), ("SELECT regex(enum, '(') FROM default", errors.QueryTypeError), ("SELECT length(id) FROM default", errors.QueryTypeError),
    ("SELECT regex(enum, country) FROM default", errors.QueryTypeError), ("SELECT to_year(enum) FROM default", errors.QueryTypeError), ("SELECT floor(id, 1) FROM default", errors.QueryTypeError),
]


@pytest.mark.parametrize("query,error", ERRORS)
def test_errors(engines, query, error):
    with pytest.raises(errors.QueryError) as e:
        engines["sql"].query_rows(query)
    assert type(e.value) is error


@pytest.mark.parametrize("query", ["SELECT id, count(1) FROM default GROUP BY id", "SELECT DISTINCT id FROM default", "SELECT COUNT(*) FROM default", "SELECT id FROM default WHERE id IN (1)", "SELECT id FROM default WHERE id BETWEEN 1 AND 2", "SELECT TRUE FROM default", "SELECT CASE WHEN id = 1 THEN 2 END FROM default"])
def test_core_dialect(spark, query):
    core = Engine(spark, EngineConfig(extensions=False))
    core.register("default", spark.range(3))
    with pytest.raises(errors.Unsupported):
        core.sql(query)


EXTENSIONS = [
    ("SELECT enum, COUNT(*) FROM default GROUP BY enum HAVING COUNT(*) > 2 ORDER BY enum", [["aa", 5], ["bb", 3]]),
    ("SELECT COUNT(1) FROM default GROUP BY enum", [[5], [3], [2]]),
    ("SELECT DISTINCT enum FROM default ORDER BY enum DESC", [["cc"], ["bb"], ["aa"]]),
    ("SELECT id FROM default WHERE id IN (1, 3, 99) OR id BETWEEN 8 AND 9 ORDER BY id", [[1], [3], [8], [9]]),
    ("SELECT id FROM default WHERE id NOT IN (0, 1, 2, 3) AND id NOT BETWEEN 5 AND 9", [[4]]),
    ("SELECT CASE WHEN id < 2 THEN 'low' WHEN id < 4 THEN 'mid' ELSE 'high' END AS c, COUNT(1) FROM default ORDER BY c", [["high", 6], ["low", 2], ["mid", 2]]),
    ("SELECT CASE enum WHEN 'aa' THEN 1 END FROM default ORDER BY id LIMIT 4", [[1], [1], [1], [None]]),
    ("SELECT float01 + 1, float01 / 2, avg(float01) > 0 FROM default WHERE id = 8", [[1.742, 0.371, True]]),
    ("SELECT AVG(float01), MIN(enum), MAX(string_packed) FROM default WHERE id < 2", [[-0.05, "aa", "xyz"]]),
    ("SELECT CAST(id AS STRING), CAST(float AS BIGINT) FROM default WHERE id = 3", [["3", 3]]),
    ("SELECT id AS n FROM default ORDER BY n DESC LIMIT 1", [[9]]),
    ("SELECT COUNT(DISTINCT enum) FROM default", [[3]]),
    ("SELECT length(string_packed), to_year(id * 40000000), floor(float01), -id FROM default WHERE id = 9", [[4, 1981, -1, -9]]),
    ("SELECT id FROM default WHERE string_packed LIKE 'a__' AND NOT regex(string_packed, 'y$') ORDER BY id", [[1], [2], [6]]),
    ("SELECT id FROM default WHERE string_packed NOT LIKE '%x%' AND regex(string_packed, '^[a-z]+$') ORDER BY id", [[1], [4], [6], [8]]),
    ("SELECT enum FROM default ORDER BY SUM(id) DESC", [["bb"], ["aa"], ["cc"]]),
    ("SELECT SUM(id) FROM default ORDER BY enum", [[15], [16], [14]]),
    ("SELECT id FROM default ORDER BY id LIMIT 5 OFFSET 50", []),
    ("SELECT id FROM default WHERE nope = 1 OR id = 2", [[2]]),
    ("SELECT id FROM default WHERE 3 > 2 AND id = 2 ORDER BY 'x'", [[2]]),
    ("SELECT -9223372036854775808 + 0, 9223372036854775808 > 1 FROM default LIMIT 1", [[-9223372036854775808, True]]),
]


@pytest.mark.parametrize("query,want", EXTENSIONS)
def test_extensions(engines, query, want):
    got = engines["sql"].query_rows(query)["rows"]
    assert same(got, want), got
