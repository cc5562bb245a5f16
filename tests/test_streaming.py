"""Queries on streams against the same queries on the same rows at rest."""

import random

import pytest

from tidewater.errors import LateRow
from tidewater.plans import Relation
from tidewater.session import Engine
from tidewater.sources import csv_lines

FIELDS = {"l": "k INT32, v INT64 NOT NULL, t UINT64 NOT NULL", "r": "j INT32, w INT64 NOT NULL, u UINT64 NOT NULL"}


def engines(spark, folder, **options):
    """The same two sources as files, read at rest and as streams."""
    rng = random.Random(5)
    out = [Engine(spark), Engine(spark, streaming=True, to_end=True, **options)]
    for name, fields in FIELDS.items():
        path = folder / name
        path.mkdir()
        for part in range(2):
            (path / f"{part}.csv").write_text("".join(f"{rng.choice(['', 1, 2])},{rng.randrange(100)},{rng.randrange(3000)}\n" for _ in range(25)))
        for e in out:
            e.sql(f"""CREATE LOGICAL SOURCE {name}({fields}); CREATE PHYSICAL SOURCE FOR {name} TYPE File SET('{path}' AS "SOURCE".FILE_PATH)""")
    return out


QUERIES = [
    "SELECT v + INT64(1) AS x FROM l WHERE v > INT64(50)",
    "SELECT v, t FROM l UNION SELECT v, t FROM l",
    "SELECT start, end, COUNT(*) AS n, SUM(v) AS s, MIN(v) AS a, MAX(v) AS b, AVG(v) AS m, COUNT(k) AS c FROM l WINDOW TUMBLING(t, SIZE 1 SEC)",
    "SELECT start, k, MEDIAN(v) AS m FROM l GROUP BY k WINDOW TUMBLING(t, SIZE 1 SEC)",
    "SELECT start, k, SUM(v) AS s FROM l WHERE v < INT64(60) GROUP BY k WINDOW SLIDING(t, SIZE 1 SEC, ADVANCE BY 300 MS)",
    "SELECT start, SUM(v * INT64(3)) + INT64(1) AS s FROM l WINDOW SLIDING(t, SIZE 200 MS, ADVANCE BY 700 MS) HAVING s > INT64(10)",
    "SELECT start, end FROM l WINDOW TUMBLING(t, SIZE 500 MS)",
    "SELECT later, n FROM (SELECT start + UINT64(5) AS later, COUNT(*) AS n FROM l WINDOW TUMBLING(t, SIZE 1 SEC))",
    "SELECT start, k, COUNT(*) AS n FROM l GROUP BY k WINDOW TUMBLING(t, SIZE 1 SEC) HAVING k > INT32(1)",
    "SELECT start, v, w FROM l RIGHT JOIN r ON k = j AND v < INT64(50) AND w < INT64(40) WINDOW TUMBLING(t, u, SIZE 1 SEC)",
    "SELECT start, v, w FROM l JOIN r ON v < w WINDOW TUMBLING(t, u, SIZE 1 SEC)",
    *(f"SELECT start, k, v, j, w FROM l {kind} JOIN r ON k = j WINDOW {window}" for kind in ("INNER", "LEFT", "RIGHT", "FULL") for window in ("TUMBLING(t, u, SIZE 1 SEC)", "SLIDING(t, u, SIZE 1 SEC, ADVANCE BY 500 MS)")),
]


@pytest.mark.parametrize("query", QUERIES)
def test_a_stream_gives_what_the_table_gives(spark, tmp_path, query):
    rest, stream = engines(spark, tmp_path)
    stream.sql(f"{query} INTO File('{tmp_path}/out' AS SINK.FILE_PATH) SET('q' AS QUERY.ID)")
    assert [tuple(r) for r in stream.sql("SHOW QUERIES").collect()] == [("q", "STOPPED")]
    got = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect())
    want = sorted(r["value"] for r in csv_lines(rest.query(query)).collect())
    assert got == want and want


def test_other_sinks(spark, tmp_path, capfd):
    rest, stream = engines(spark, tmp_path)
    stream.sql("SELECT start, COUNT(*) AS n FROM l WINDOW TUMBLING(t, SIZE 1 SEC) INTO Print(); SELECT v FROM l INTO Void(); SELECT v FROM l INTO Checksum()")
    said = capfd.readouterr().out.split("\n")
    from tidewater.sources import checksum

    for line in (r["value"] for r in csv_lines(rest.query("SELECT start, COUNT(*) AS n FROM l WINDOW TUMBLING(t, SIZE 1 SEC)")).collect()):
        assert line in said
    count, total = checksum(rest.query("SELECT v FROM l")).first()
    assert f"{count} {total}" in said


def late(spark, folder, delay):
    (folder / "in").mkdir()
    import os

    for k, times in enumerate(([100, 5000], [9000], [200])):  # the last is of a window that has fired
        path = folder / "in" / f"{k}.csv"
        path.write_text("".join(f"{t}\n" for t in times))
        os.utime(path, (1000 + k, 1000 + k))
    e = Engine(spark, streaming=True, to_end=True, delay_ms=delay)
    e.sql(f"""CREATE LOGICAL SOURCE s(t UINT64 NOT NULL); CREATE PHYSICAL SOURCE FOR s TYPE File SET('{folder}/in' AS "SOURCE".FILE_PATH, 1 AS "SOURCE".FILES_PER_TRIGGER)""")
    e.sql(f"SELECT start, COUNT(*) AS n FROM s WINDOW TUMBLING(t, SIZE 1 SEC) INTO File('{folder}/out' AS SINK.FILE_PATH)")
    return sorted(r["value"] for r in spark.read.text(f"{folder}/out").collect())


def test_late_rows_are_an_error(spark, tmp_path):
    with pytest.raises(LateRow) as e:
        late(spark, tmp_path, 0)
    assert e.value.code == 3014


def test_a_watermark_that_waits_long_enough(spark, tmp_path):
    assert late(spark, tmp_path, 60_000) == ["0,2", "5000,1", "9000,1"]


def test_queries_run_until_they_are_dropped(spark, tmp_path):
    e = Engine(spark, streaming=True)
    e.sql("""CREATE LOGICAL SOURCE g(a UINT64 NOT NULL); CREATE PHYSICAL SOURCE FOR g TYPE Generator SET('SEQUENCE UINT64 0 10 1' AS "SOURCE".GENERATOR_SCHEMA)""")
    e.sql("SELECT a FROM g INTO Void() SET('q' AS QUERY.ID)")
    stream = e.queries["q"].stream
    assert stream.isActive and [tuple(r) for r in e.sql("SHOW QUERIES").collect()] == [("q", "RUNNING")]
    e.sql("DROP QUERY WHERE ID = 'q'")
    assert not stream.isActive


def test_ingestion_time(spark):
    rel = Relation.of(spark.readStream.format("rate").load().select("value"))
    from tidewater.operators import Aggregate, Window, window_aggregate

    out = window_aggregate(rel, Window((), 1000, 1000), [], [Aggregate("COUNT", None, "N")])
    assert out.df.isStreaming and out.schema.names == ["START", "END", "N"]
