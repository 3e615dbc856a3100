"""Cases of batch queries over files and SQLite tables, as inputs and expected rows."""

import io
import json
import sqlite3

import pytest
from fixtures import jsonl, write_all
from pyspark.sql import functions as F

from tidewell.cli import main
from tidewell.engine import ATTACHED, FULL_SCAN, INDEXED, Engine, stream
from tidewell.plans.dialect import QueryError, parse_one
from tidewell.sources.csvfile import left_out
from tidewell.sources.textfiles import by_lines
from tidewell.sources.uri import SourceSpec, parse_binding, parse_uri


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    uris = write_all(tmp_path_factory.mktemp("files"))
    engine = Engine(spark)
    for name, uri in uris.items():
        engine.add_source(name, uri)
    return engine


def rows(engine, query):
    out = io.StringIO()
    engine.print(query, out)
    return [json.loads(line) for line in out.getvalue().splitlines()]


def titles(*names):
    return [{"title": n} for n in names]


GOLDEN = [
    ("SELECT title, crew FROM boats WHERE crew >= 6 ORDER BY crew", [{"title": "Dorado", "crew": 6}, {"title": "Corvo", "crew": 9}, {"title": "Falke", "crew": 12}]),
    ("SELECT COUNT(*) AS n, MIN(crew) AS lo, MAX(crew) AS hi, SUM(crew) AS hands FROM boats", [{"n": 7, "lo": 2, "hi": 12, "hands": 41}]),
    ("SELECT AVG(crew) AS mean FROM boats WHERE harbour = 'Porto'", [{"mean": 20 / 3}]),
    ("SELECT kind, COUNT(*) AS n FROM signals GROUP BY kind ORDER BY n DESC LIMIT 2", [{"kind": "depart", "n": 4}, {"kind": "radio", "n": 3}]),
    ("SELECT goods, tonnes / 2 AS half FROM cargo WHERE tonnes < 32 ORDER BY half DESC", [{"goods": "Wine", "half": 15.5}, {"goods": "Glass", "half": 6.375}, {"goods": "Fish", "half": 3.25}]),
    ("SELECT title FROM boats WHERE crew BETWEEN 3 AND 5 ORDER BY title", titles("Albatros", "Elster", "Gaivota")),
    ("SELECT title FROM boats WHERE crew NOT IN (2, 4, 12) ORDER BY title", titles("Corvo", "Dorado", "Elster", "Gaivota")),
    ("SELECT title FROM boats WHERE title LIKE '%LST%'", titles("Elster")),
    ("SELECT title FROM boats WHERE title NOT LIKE '%r%' ORDER BY title", titles("Falke", "Gaivota")),
    ("SELECT title FROM boats ORDER BY crew DESC LIMIT 2", titles("Falke", "Corvo")),
    ("SELECT n, ok FROM gaps WHERE ok IS NOT NULL", [{"n": 30, "ok": 1}]),
    ("SELECT * FROM gaps WHERE mark = 'r'", [{"n": None, "mark": "r", "level": None, "ok": None}]),
    ("SELECT DISTINCT kind FROM cargo ORDER BY kind", [{"kind": k} for k in ("boxes", "bulk", "cold")]),
    ("SELECT crew / 8 AS a, COUNT(*) / 4 AS c FROM boats WHERE boat = 20", [{"a": 1.5, "c": 0}]),
    ("SELECT b.title FROM boats b LEFT JOIN trips t ON b.boat = t.boat WHERE t.trip IS NULL ORDER BY b.title", titles("Elster", "Gaivota")),
    ("SELECT title FROM boats WHERE crew > 1000", []),
    ("SELECT crew * 3, LOWER(title) FROM boats WHERE boat = 12", [{'("crew" * 3)': 6, 'LOWER("title")': "brise"}]),
]


@pytest.mark.parametrize("query,expected", GOLDEN)
def test_golden(files, query, expected):
    assert rows(files, query) == expected


@pytest.mark.parametrize(
    "query,n",
    [
        ("SELECT * FROM boats", 7),
        ("SELECT s.kind, b.title FROM signals s JOIN boats b ON s.boat = b.boat", 8),
        ("SELECT t.trip, b.title, c.goods FROM trips t JOIN boats b ON t.boat = b.boat JOIN cargo c ON t.code = c.code ORDER BY t.trip", 8),
        ("SELECT b.title, t.trip FROM boats b LEFT JOIN trips t ON b.boat = t.boat", 10),
        ("SELECT b.title, t.trip FROM trips t RIGHT JOIN boats b ON b.boat = t.boat", 10),
        ("SELECT title FROM boats WHERE (crew IN (2, 9) OR title LIKE 'e%') AND crew BETWEEN 1 AND 8", 2),
        ("SELECT kind FROM signals s JOIN boats b ON s.boat = b.boat WHERE b.crew > 3", 6),
    ],
)
def test_counts(files, query, n):
    assert len(rows(files, query)) == n


def test_keys_are_sorted_and_the_last_name_wins(files):
    out = io.StringIO()
    files.print("SELECT * FROM trips t JOIN boats b ON t.boat = b.boat ORDER BY trip LIMIT 1", out)
    assert list(json.loads(out.getvalue())) == ["boat", "code", "crew", "days", "harbour", "title", "trip"]
    assert rows(files, "SELECT 1 AS k, 2 AS k") == [{"k": 2}]


@pytest.mark.parametrize("query", ["SELECT x FROM boats", "SELECT b.x FROM boats b", "SELECT SUM(*) FROM boats", "SELECT boat FROM boats a JOIN boats b ON a.boat = b.boat", "SELECT NOSUCH(1) FROM boats", "SELECT title FROM boats WHERE COUNT(*) > 1", "SELECT title FROM boats ORDER BY 5"])
def test_errors(files, query):
    with pytest.raises(QueryError):
        files.sql(query)


# --- SQLite


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "port.db")
    db = sqlite3.connect(path)
    db.executescript(
        """CREATE TABLE piers (pier INTEGER, side TEXT, depth REAL); INSERT INTO piers VALUES (11, 'North', 7.5), (14, 'South', NULL), (15, 'East', 4), (31, 'West', 9);
        CREATE TABLE mixed (whole_no INTEGER, share REAL, label TEXT, raw BLOB); INSERT INTO mixed VALUES (-17, 0.625, 'quay', x'beef');
        CREATE TABLE unused (a INTEGER, b TEXT); CREATE TABLE flags (sign TEXT, meaning TEXT); INSERT INTO flags VALUES ('radio', 'calls'), ('alarm', 'help'), ('depart', 'off'), ('none', '-');
        CREATE TABLE far (id INTEGER PRIMARY KEY, x TEXT); INSERT INTO far VALUES (-5, 'a'), (1000000000000, 'b');"""
    )
    db.execute("CREATE TABLE soundings (id INTEGER, fathoms REAL)")
    db.executemany("INSERT INTO soundings VALUES (?, ?)", [(k, k * 0.7) for k in range(1500)])
    db.commit()
    return path


def with_table(files, database, name, table=None):
    engine = Engine(files.spark)
    engine.specs, engine.frames = dict(files.specs), dict(files.frames)
    return engine.add_source(name, f"sqlite://{database}" + (f"?table={table}" if table else ""))


def test_sqlite_types_and_filters(files, database):
    engine = with_table(files, database, "mixed")
    frame = engine.frame("mixed")
    assert [t for _, t in frame.dtypes] == ["bigint", "double", "string", "binary"]
    assert rows(engine, "SELECT * FROM mixed") == [{"raw": "vu8=", "whole_no": -17, "share": 0.625, "label": "quay"}]
    assert rows(engine, "SELECT whole_no / 5 AS q FROM mixed WHERE whole_no = -17 AND label IN ('quay', 'x')") == [{"q": -3}]


def test_sqlite_override_join_and_nulls(files, database):
    engine = with_table(files, database, "p", "piers")
    assert rows(engine, "SELECT b.title, p.side FROM boats b LEFT JOIN p ON b.boat = p.pier WHERE b.boat < 16 ORDER BY b.boat") == [
        {"title": "Albatros", "side": "North"}, {"title": "Brise", "side": None}, {"title": "Corvo", "side": "South"}, {"title": "Dorado", "side": "East"}]
    assert rows(engine, "SELECT side FROM p WHERE depth IS NULL") == [{"side": "South"}]


def test_sqlite_large_empty_and_wide_ids(files, database):
    total = round(sum(k * 0.7 for k in range(1500)), 4)
    assert rows(with_table(files, database, "soundings"), "SELECT COUNT(*) AS n, ROUND(SUM(fathoms), 4) AS s FROM soundings") == [{"n": 1500, "s": total}]
    engine = with_table(files, database, "unused")
    assert rows(engine, "SELECT * FROM unused") == [] and rows(engine, "SELECT COUNT(*) AS n FROM unused") == [{"n": 0}]
    engine = with_table(files, database, "far")
    assert rows(engine, "SELECT id, x FROM far ORDER BY id") == [{"id": -5, "x": "a"}, {"id": 10**12, "x": "b"}]
    assert engine.frame("far").rdd.getNumPartitions() <= 2
    with pytest.raises(Exception, match="no such table"):
        with_table(files, database, "nothing").sql("SELECT * FROM nothing").collect()


def test_sqlite_reads_only_the_columns_that_are_used(files, database):
    engine = with_table(files, database, "piers")
    for query, columns in (("SELECT SIDE FROM piers p WHERE p.depth > 5", ["side", "depth"]), ("SELECT COUNT(*) AS n FROM piers", ["pier"]), ("SELECT * FROM piers", ["pier", "side", "depth"])):
        assert engine._used("piers", parse_one(query)).columns == columns
    assert rows(engine, "SELECT SIDE FROM piers p WHERE p.depth > 5 ORDER BY side") == [{"SIDE": "North"}, {"SIDE": "West"}]
    assert rows(engine, "SELECT COUNT(*) AS n FROM piers") == [{"n": 4}]
    with pytest.raises(QueryError, match="no such column"):
        engine.sql("SELECT nope FROM piers")


def test_access_paths(files, database):
    engine = with_table(files, database, "flags").add_source("s", "stdin")
    assert engine.explain_access("SELECT * FROM s JOIN flags ON s.a = flags.sign OVER 1m") == {"flags": ATTACHED}
    assert engine.explain_access("SELECT * FROM s JOIN boats b ON s.boat_no = b.boat OVER 1m") == {"boats": INDEXED}
    assert engine.explain_access("SELECT * FROM s JOIN boats b ON b.boat = boat_no OVER 1m") == {"boats": INDEXED}
    for on in ("s.boat_no = b.boat AND b.crew > 1", "s.boat_no < b.boat", "boat_no = boat", "b.boat = b.crew"):
        assert engine.explain_access(f"SELECT * FROM s JOIN boats b ON {on} OVER 1m") == {"boats": FULL_SCAN}
    assert engine.explain_access("SELECT * FROM boats b JOIN s ON s.boat_no = b.boat OVER 1m") == {"boats": FULL_SCAN}


# --- file shapes


def load(engine, folder, name, text, query="SELECT * FROM t"):
    (folder / name).write_text(text)
    return rows(Engine(engine.spark).add_source("t", f"file://{folder}/{name}"), query)


def test_csv_inference(files, tmp_path):
    text = 'a,b,c,d,e,f\n007,T,,1e5,"x, ""y""",inf\n-2.5,F,z,,"two\nlines",3\n'
    got = Engine(files.spark).add_source("t", str(tmp_path / "t.csv"))
    (tmp_path / "t.csv").write_text(text)
    frame = got.frame("t")
    assert dict(frame.dtypes) == {"a": "double", "b": "bigint", "c": "string", "d": "double", "e": "string", "f": "double"}
    assert [tuple(r) for r in frame.collect()] == [(7.0, 1, "", 100000.0, 'x, "y"', float("inf")), (-2.5, 0, "z", None, "two\nlines", 3.0)]


def test_csv_ragged_header_only_and_empty(files, tmp_path):
    assert load(files, tmp_path, "ragged.csv", "a,b\n1,2\n3\n4,5,6\n7,8\n", "SELECT a FROM t ORDER BY a") == [{"a": 1}, {"a": 7}]
    assert load(files, tmp_path, "head.csv", "a,b\n", "SELECT COUNT(*) AS n FROM t") == []
    assert load(files, tmp_path, "none.csv", "", "SELECT COUNT(*) AS n FROM t") == []


def test_one_odd_file_leaves_the_others_to_lines(files, tmp_path, capsys):
    spark = files.spark
    (tmp_path / "some.csv").mkdir()
    (tmp_path / "some.csv" / "a b.csv").write_text('k,v\n1,"two\nlines"\n2\n3,"x"\n')
    (tmp_path / "some.csv" / "c.csv").write_text("k,v\n4,y\n5,z,9\n6,\n")
    plain, whole = by_lines(spark, str(tmp_path / "some.csv"), F.col("value").contains("two"))
    assert [p.rsplit("/", 1)[1] for p in plain] == ["c.csv"] and [p.rsplit("/", 1)[1] for p in whole] == ["a b.csv"]
    engine = Engine(spark).add_source("t", str(tmp_path / "some.csv"))
    assert rows(engine, "SELECT k, v FROM t ORDER BY k") == [{"k": 1, "v": "two\nlines"}, {"k": 3, "v": "x"}, {"k": 4, "v": "y"}, {"k": 6, "v": ""}]
    assert "2 rows" in capsys.readouterr().err
    assert sorted(r[0] for r in left_out(spark, str(tmp_path / "some.csv")).collect()) == ["2", "5,z,9"]
    assert rows(engine, "SELECT COUNT(*) AS n FROM t") == [{"n": 4}]
    (tmp_path / "some.jsonl").mkdir()
    (tmp_path / "some.jsonl" / "a.jsonl").write_text('{"k": 1}\n{"k":\n2} x {"k": 3}\n')
    (tmp_path / "some.jsonl" / "b.jsonl").write_text('{"k": 4, "w": true}\n\n{"k": 5}\n')
    assert [r["k"] for r in rows(Engine(spark).add_source("t", str(tmp_path / "some.jsonl")), "SELECT k, w FROM t ORDER BY k")] == [1, 2, 4, 5]


def test_json_shapes(files, tmp_path):
    one = '{"pier":"east","depth":{"low":2,"open":false,"b":"<&>"}}\n'
    assert load(files, tmp_path, "nested.jsonl", one) == [{"pier": "east", "depth": '{"b":"\\u003c\\u0026\\u003e","low":2,"open":false}'}]
    assert load(files, tmp_path, "array.json", '{"no": 5,\n "crew": ["ann", "bo"]} {"no": 6}\n[3]{"no": 7}', "SELECT * FROM t ORDER BY no") == [{"no": 5, "crew": '["ann","bo"]'}, {"no": 6, "crew": None}]
    assert load(files, tmp_path, "bool.jsonl", '{"lamp":"red","lit":false}\n{"lamp":"green","lit":true}\n', "SELECT lamp FROM t WHERE lit = TRUE") == [{"lamp": "green"}]
    assert load(files, tmp_path, "cut.jsonl", '{"a":1}\n{"a":2}\n{"a":\n{"a":4}\n', "SELECT a FROM t ORDER BY a") == [{"a": 1}, {"a": 2}]
    assert load(files, tmp_path, "signs.jsonl", jsonl([{"x": v} for v in (8, -6, 0, 2)]), "SELECT x FROM t WHERE x > -4 ORDER BY x") == [{"x": 0}, {"x": 2}, {"x": 8}]
    assert load(files, tmp_path, "empty.jsonl", "", "SELECT COUNT(*) AS n FROM t") == []
    assert load(files, tmp_path, "null.jsonl", '{"a":null,"b":1}\n{"a":"x","b":2}\n', "SELECT a FROM t WHERE a IS NULL") == [{"a": None}]


def test_empty_source_switch(files, tmp_path):
    (tmp_path / "e.csv").write_text("boat,x\n")
    for absent, n in ((True, 0), (False, 7)):
        engine = Engine(files.spark, empty_source_is_absent=absent)
        engine.add_source("boats", files.specs["boats"].path).add_source("e", str(tmp_path / "e.csv"))
        assert len(rows(engine, "SELECT b.title FROM boats b LEFT JOIN e ON b.boat = e.boat")) == n


def test_uris():
    assert parse_uri("u", "file://a/b.CSV") == SourceSpec("u", "csv", "a/b.CSV") and parse_uri("u", "b.jsonl").format == "json"
    assert parse_uri("u", "sqlite:///abs.db?table=t&x=1") == SourceSpec("u", "sqlite", "/abs.db", "t") and parse_uri("u", "sqlite://rel.db") == SourceSpec("u", "sqlite", "rel.db", "u")
    assert parse_binding("e=stdin").streaming and parse_binding("e=").streaming
    for bad in ("x.txt", "x.db", "mysql://h/d", "postgres://h/d"):
        with pytest.raises(QueryError):
            parse_uri("u", bad)
    with pytest.raises(QueryError):
        parse_binding("nothing")


# --- standard input and the command line


def test_stdin_is_an_unbound_table(files):
    engine = Engine(files.spark, stdin=io.StringIO('{"boat":15,"kind":"arrive"}\n{"boat":12,"kind":"depart"}\n\nnot json\n{"boat":20}\n'))
    engine.add_source("boats", files.specs["boats"].path)
    assert rows(engine, "SELECT b.title, s.kind FROM seen s JOIN boats b ON s.boat = b.boat ORDER BY b.boat") == [{"title": "Brise", "kind": "depart"}, {"title": "Dorado", "kind": "arrive"}]
    with pytest.raises(QueryError, match="only one"):
        Engine(files.spark).sql("SELECT 1 FROM a JOIN b ON a.x = b.x")


def test_command_line(files, spark, monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", io.StringIO('{"boat":17,"ok":true}\n'))
    boats = files.specs["boats"].path
    assert main(["--source", f"b={boats}", "SELECT b.title, s.ok FROM s JOIN b ON s.boat = b.boat; SELECT 2"], spark) == 0
    assert capsys.readouterr().out == '{"ok":1,"title":"Elster"}\n'
    assert main(["-s", f"b={boats}", "SELECT nope FROM b"], spark) == 1
    assert "no such column" in capsys.readouterr().err


def test_rebinding_replaces_a_source(files):
    engine = Engine(files.spark).add_source("t", files.specs["boats"].path).add_source("t", files.specs["cargo"].path)
    assert len(rows(engine, "SELECT kind FROM t")) == 6


def test_batch_over_in_memory_records(files):
    out = io.StringIO()
    stream(Engine(files.spark), "SELECT a, COUNT(*) AS n FROM m GROUP BY a ORDER BY a EVERY 5s", {"m": [{"a": 1}, {"a": 2}, {"a": 1}]}, out)
    assert out.getvalue() == '{"a":1,"n":2}\n{"a":2,"n":1}\n'
