"""Sources, formats and sinks."""

import math

import pytest
from golden import engine, expected, lines

from tidewater.errors import EngineError, InvalidConfig
from tidewater.session import Engine
from tidewater.sources import checksum
from tidewater.sources.generator import sinus_rate


def read(e, path, fields, options="", kind="CSV"):
    return e.query(f"""SELECT * FROM File('{path}' AS "SOURCE".FILE_PATH, '{kind}' AS INPUT_FORMATTER."TYPE"{options}, SCHEMA({fields}) AS "SOURCE"."SCHEMA")""")


def test_csv_of_every_type(spark, tmp_path):
    (tmp_path / "in.csv").write_text("-128,255,18446744073709551615,true,é x,-1.5\n127,0,0,false,,\n")
    rel = read(Engine(spark), tmp_path / "in.csv", "a INT8 NOT NULL, b UINT8 NOT NULL, c UINT64 NOT NULL, d BOOLEAN NOT NULL, e VARSIZED, f FLOAT64")
    from tidewater.sources import csv_lines

    assert sorted(r["value"] for r in csv_lines(rel).collect()) == expected("-128,255,18446744073709551615,true,é x,-1.5\n127,0,0,false,NULL,NULL")


def test_csv_delimiters_and_quotes(spark, tmp_path):
    (tmp_path / "in.csv").write_text('1|"a|b"|2;3|c|4')
    rel = read(Engine(spark), tmp_path / "in.csv", "a INT32 NOT NULL, b VARSIZED NOT NULL, c INT32 NOT NULL", ", '|' AS INPUT_FORMATTER.FIELD_DELIMITER, ';' AS INPUT_FORMATTER.TUPLE_DELIMITER, 'true' AS INPUT_FORMATTER.ALLOW_COMMAS_IN_STRINGS")
    assert sorted(map(tuple, rel.df.collect())) == [(1, "a|b", 2), (3, "c", 4)]


@pytest.mark.parametrize("text", ["one,2", ",2", "1,x"])
def test_csv_that_does_not_fit_fails(spark, tmp_path, text):
    (tmp_path / "in.csv").write_text(text)
    with pytest.raises(Exception):
        read(Engine(spark), tmp_path / "in.csv", "a INT32 NOT NULL, b INT32").df.collect()


def test_json_goes_by_key(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"b": "x", "A": 1, "more": [1]}\n{"a": 18446744073709551615}\n')
    rel = read(Engine(spark), tmp_path / "in.json", "a UINT64 NOT NULL, b VARSIZED", kind="JSON")
    assert sorted(map(tuple, rel.df.collect())) == [(-1, None), (1, "x")]
    (tmp_path / "in.json").write_text('{"b": "x"}\n')
    with pytest.raises(Exception, match="4003"):
        read(Engine(spark), tmp_path / "in.json", "a UINT64 NOT NULL, b VARSIZED", kind="JSON").df.collect()


def test_options_that_no_connector_has(spark, tmp_path):
    with pytest.raises(InvalidConfig):
        read(Engine(spark), tmp_path, "a INT32", ", '5' AS \"SOURCE\".SPEED")
    e = engine(spark, s=("a INT32 NOT NULL", "1"))
    with pytest.raises(InvalidConfig):
        e.sql(f"SELECT * FROM s INTO File('{tmp_path}/out' AS SINK.FILE_PATH, '5' AS SINK.SPEED)")
    for text in ("SELECT * FROM s INTO Nowhere()", "SELECT * FROM Nothing(SCHEMA(a INT32) AS \"SOURCE\".\"SCHEMA\")"):
        with pytest.raises(EngineError):
            e.sql(text)


def test_several_physical_sources_are_one(spark):
    e = engine(spark, s=("a INT32 NOT NULL", "1"))
    e.sql("""CREATE PHYSICAL SOURCE FOR s TYPE Inline SET('{"A": 7}' AS "SOURCE".ROWS, 'JSON' AS INPUT_FORMATTER."TYPE")""")
    assert lines(e, "SELECT * FROM s") == ["1", "7"]


def generated(spark, fields, schema, more):
    e = Engine(spark)
    e.sql(f"""CREATE LOGICAL SOURCE g({fields}); CREATE PHYSICAL SOURCE FOR g TYPE Generator SET(7 AS "SOURCE".SEED, '{schema}' AS "SOURCE".GENERATOR_SCHEMA, {more})""")
    return e.query("SELECT * FROM g")


def test_sequences_stop_and_hold(spark):
    schema = "SEQUENCE UINT64 2 12 2, SEQUENCE INT32 0 -3 -1"
    got = lambda rule: sorted(map(tuple, generated(spark, "a UINT64 NOT NULL, b INT32 NOT NULL", schema, f"""'{rule}' AS "SOURCE".STOP_GENERATOR_WHEN_SEQUENCE_FINISHES""").df.collect()))
    assert got("ALL") == [(2 + 2 * k, max(-k, -3)) for k in range(5)]
    assert got("ONE") == [(2 + 2 * k, -k) for k in range(3)]


def test_random_fields(spark, tmp_path):
    (tmp_path / "words").write_text("ebb\nflow\n")
    fields = "n FLOAT64 NOT NULL, t VARSIZED NOT NULL, w VARSIZED NOT NULL"
    rows = generated(spark, fields, f"NORMAL_DISTRIBUTION FLOAT64 10 2, RANDOMSTR 3 70, WORDLIST {tmp_path}/words", """4000 AS "SOURCE".MAX_RUNTIME_MS""").df.collect()
    assert len(rows) == 4000
    mean = sum(r["N"] for r in rows) / len(rows)
    assert abs(mean - 10) < 0.2 and abs(math.sqrt(sum((r["N"] - mean) ** 2 for r in rows) / len(rows)) - 2) < 0.2
    assert {len(r["T"]) for r in rows} == set(range(3, 71)) and len({r["T"] for r in rows}) > 3900
    assert {r["W"] for r in rows} == {"ebb", "flow"}


def test_rates(spark):
    count = lambda more: generated(spark, "a UINT64 NOT NULL", "SEQUENCE UINT64 0 1000000 1", more).df.count()
    assert count("""2500 AS "SOURCE".MAX_RUNTIME_MS, 'emit_rate 8' AS "SOURCE".GENERATOR_RATE_CONFIG""") == 20
    want = sum(sinus_rate(100, 0.05, s) for s in range(10))
    assert count("""10000 AS "SOURCE".MAX_RUNTIME_MS, 'SINUS' AS "SOURCE".GENERATOR_RATE_TYPE, 'amplitude 100, frequency 0.05' AS "SOURCE".GENERATOR_RATE_CONFIG""") == want != 10_000
    with pytest.raises(InvalidConfig):
        generated(spark, "a UINT64 NOT NULL", "SEQUENCE UINT64 0 9 1", """'NONE' AS "SOURCE".STOP_GENERATOR_WHEN_SEQUENCE_FINISHES""")


def test_files_and_checksum(spark, tmp_path):
    e = engine(spark, s=("a INT32 NOT NULL, f FLOAT64, t VARSIZED", "1,2.5,x\n2,,é"))
    text = "1,2.5,x\n2,NULL,é\n".encode()
    assert tuple(checksum(e.query("SELECT * FROM s")).first()) == (2, sum(b - 256 if b > 127 else b for b in text))
    for kind in ("CSV", "JSON", "PARQUET"):
        e.sql(f"""SELECT * FROM s INTO File('{tmp_path}/{kind}' AS SINK.FILE_PATH, '{kind}' AS SINK.OUTPUT_FORMAT)""")
    for kind in ("JSON", "PARQUET"):
        back = read(e, tmp_path / kind, "a INT32 NOT NULL, f FLOAT64, t VARSIZED", kind=kind)
        assert sorted(map(tuple, back.df.collect())) == [(1, 2.5, "x"), (2, None, "é")]


def test_print_and_checksum_sinks(spark, capsys):
    e = engine(spark, s=("a INT32 NOT NULL", "1\n2"))
    e.sql("SELECT * FROM s INTO Print(); SELECT * FROM s INTO Checksum()")
    out = capsys.readouterr().out.split("\n")
    assert sorted(out[:2]) == ["1", "2"] and out[2] == f"2 {sum(b'1\n2\n')}"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from tidewater.__main__ import main

    (tmp_path / "a.sql").write_text("""CREATE LOGICAL SOURCE s(a INT32, b VARSIZED); CREATE PHYSICAL SOURCE FOR s TYPE Inline SET('1,x\n,y' AS "SOURCE".ROWS); SHOW LOGICAL SOURCES;""")
    assert main([str(tmp_path / "a.sql"), "-e", "SHOW SINKS"], spark) == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["NAME,SCHEMA,TYPE,CONFIG", "NAME,SCHEMA", "S,A INT32, B VARSIZED"]
    monkeypatch.setattr("sys.stdin", io.StringIO((tmp_path / "a.sql").read_text() + "\nSELECT b, a\nFROM s;\n"))
    assert main([], spark) == 0
    assert sorted(capsys.readouterr().out.split("\n")[-4:]) == ["", "B,A", "x,1", "y,NULL"]
    assert main(["-e", "SELECT a FROM nowhere"], spark) == 1 and "2030" in capsys.readouterr().err
