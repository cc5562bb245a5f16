"""The dialect on small tables of a harbour: berths, tides and ferries.  Results are worked out by hand from the rules."""

import math

import pytest
from golden import engine, expected, lines

from tidewater.errors import EngineError

GAUGES = ("a INT8 NOT NULL, b UINT8 NOT NULL, c INT16 NOT NULL, d UINT16 NOT NULL, e INT32 NOT NULL, f UINT32 NOT NULL, g INT64 NOT NULL, h UINT64 NOT NULL, x FLOAT32 NOT NULL, y FLOAT64 NOT NULL", "-3,200,-500,60000,70000,4000000000,-9000000000,18000000000000000000,0.5,-2.75")
U32, U64 = 1 << 32, 1 << 64


@pytest.mark.parametrize(
    ("expr", "value"),
    [
        ("a + b", "197"),  # both narrow: INT32
        ("b - d", "-59800"),
        ("a - f", str((-3 - 4000000000) % U32)),  # UINT32 wins over narrower signed ones
        ("e * e", str((70000 * 70000 + (1 << 31)) % U32 - (1 << 31))),
        ("a + h", str((18 * 10**18 - 3) % U64)),
        ("g * h", str(-9 * 10**9 * 18 * 10**18 % U64)),
        ("c / a", "166"),  # towards zero
        ("c % a", "-2"),
        ("h / b", str(18 * 10**18 // 200)),
        ("h % UINT64(7)", str(18 * 10**18 % 7)),
        ("-h", str(-18 * 10**18 % U64)),
        ("x + a", "-2.5"),
        ("y / x", "-5.5"),
        ("y * y", "7.5625"),
        ("a < b", "true"),
        ("a < f", "false"),  # -3 is 4294967293 there
        ("g < h", "false"),
        ("c = INT16(-500)", "true"),
        ("d != d OR b >= UINT8(200)", "true"),
        ("NOT (a > c) AND x < y", "false"),
        ("ABS(c)", "500"),
        ("ABS(y)", "2.75"),
        ("CEIL(y)", "-2.0"),
        ("FLOOR(y)", "-3.0"),
        ("ROUND(y)", "-3.0"),
        ("ROUND(x)", "1.0"),
        ("CEIL(c)", "-500"),
        ("SQRT(FLOAT64(6.25))", "2.5"),
        ("POW(a, INT32(3))", "-27.0"),
        ("EXP(FLOAT64(0))", "1.0"),
        ("CASTTOTYPE(c AS UINT8)", str(-500 % 256)),
        ("CASTTOTYPE(f AS INT32)", str(4000000000 - U32)),
        ("CASTTOTYPE(y AS INT16)", "-2"),
        ("CASTTOTYPE(h AS FLOAT64)", "18000000000000000000.0"),
        ("ISNULL(a)", "false"),
    ],
)
def test_one_row_of_every_number(spark, expr, value):
    assert lines(engine(spark, gauge=GAUGES), f"SELECT {expr} AS v FROM gauge") == [value]


def test_rounding_of_odd_floats(spark):
    from tidewater.functions import Call, field
    from tidewater.operators import project
    from tidewater.plans import Relation

    values = [1e300, -1e300, math.inf, -math.inf, math.nan, 0.49999999999999994, 0.5, -0.5, 2.5, -2.5, 4503599627370497.0, -0.2, 0.0, None]
    rel = Relation.of(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "n long, v double"))
    got = {r[0]: r[1:] for r in project(rel, [(field("n"), "N"), *((Call(f, (field("v"),)), f) for f in ("CEIL", "FLOOR", "ROUND"))]).df.collect()}
    for k, v in enumerate(values):
        if v is None or not math.isfinite(v):
            want = [v] * 3
        else:
            away = math.copysign(math.floor(abs(v)) + (abs(v) - math.floor(abs(v)) >= 0.5), v)
            want = [float(math.ceil(v)), float(math.floor(v)), away]
        assert repr(list(got[k])).replace("-0.0", "0.0") == repr(want).replace("-0.0", "0.0"), v


def test_dividing_by_zero(spark):
    tides = ("up INT32 NOT NULL, zero INT32 NOT NULL, low FLOAT64 NOT NULL, none FLOAT64 NOT NULL", "8,0,-1.5,0")
    assert lines(engine(spark, tide=tides), "SELECT low / none AS v FROM tide") == ["-inf"]
    for op in "/%":
        with pytest.raises(Exception, match="3013"):
            lines(engine(spark, tide=tides), f"SELECT up {op} zero AS v FROM tide")


TIMES = {
    "1999-12-31T23:59:59Z": 946684799000,
    "1999-12-31T23:59:59.25Z": 946684799250,
    "1999-12-31T23:59:59": 946684799000,
    "1999-12-31 23:59:59": 946684799000,
    "2000-01-01T01:29:59+01:30": 946684799000,
    "1999-12-31T18:59:59-0500": 946684799000,
    "1970-01-01T00:00:00Z": 0,
    "2016-02-29T12:00:00.123456789Z": 1456747200123,
    "Fri, 31 Dec 1999 23:59:59 GMT": 946684799000,
}


def test_times_in_text(spark):
    rel = engine(spark).register("log", spark.createDataFrame([(t,) for t in TIMES], "t string"))
    assert rel.schema.names == ["T"]
    e = engine(spark)
    e.register("log", spark.createDataFrame([(t,) for t in TIMES], "t string"))
    got = {r[0]: r[1] for r in e.query("SELECT t, CASTTOUNIXTS(t) AS ms FROM log").df.collect()}
    assert got == TIMES


@pytest.mark.parametrize("bad", ["", "tomorrow", "1999-12-31", "23:59:59", "1999-13-01T00:00:00Z", "1999-12-31T25:00:00Z", "1960-01-01T00:00:00Z", "31 Dec 1999"])
def test_text_that_is_no_time(spark, bad):
    e = engine(spark)
    e.register("log", spark.createDataFrame([(bad,)], "t string"))
    with pytest.raises(Exception, match="4003"):
        e.query("SELECT CASTTOUNIXTS(t) AS ms FROM log").df.collect()


def test_parts_of_a_time(spark):
    e = engine(spark, log=("t UINT64 NOT NULL", "1456747200123"))
    assert lines(e, "SELECT YEAR_OF(t) AS y, MONTH_OF(t) AS m, DAY_OF(t) AS d, CASTFROMUNIXTS(t) AS s FROM log") == ["2016,2,29,2016-02-29T12:00:00.123Z"]


def test_text(spark):
    e = engine(spark, ferry=("name VARSIZED NOT NULL, fare VARSIZED NOT NULL", "Øresund,kr. -12 per km\nÅland,7"))
    assert lines(e, "SELECT CHAR_LENGTH(name) AS c, OCTET_LENGTH(name) AS o, CONCAT(name, VARSIZED('?')) AS q, FROM_BASE64(TO_BASE64(name)) AS n FROM ferry") == expected("7,8,Øresund?,Øresund\n5,6,Åland?,Åland")
    assert lines(e, "SELECT CASTTOTYPE(fare AS INT16) AS v FROM ferry WHERE name = VARSIZED('Åland')") == ["7"]
    with pytest.raises(Exception, match="4003"):  # the point of "kr." stays
        lines(e, "SELECT CASTTOTYPE(fare AS INT16) AS v FROM ferry")


BERTH = ("pier INT32 NOT NULL, tons UINT64 NOT NULL, at UINT64 NOT NULL", "1,40,5\n1,10,990\n2,70,1000\n1,20,1500\n2,30,1999\n2,50,3001")


def test_tumbling_windows_and_names(spark):
    e = engine(spark, berth=BERTH)
    q = "SELECT start, end, COUNT(tons), MIN(tons), MAX(tons), SUM(tons), AVG(tons), MEDIAN(tons) FROM berth WINDOW TUMBLING(at, SIZE 1 SEC)"
    assert e.query(q).schema.names == ["START", "END", *(f"TONS_{f}" for f in ("COUNT", "MIN", "MAX", "SUM", "AVG", "MEDIAN"))]
    assert lines(e, q) == expected("0,1000,2,10,40,50,25.0,25.0\n1000,2000,3,20,70,120,40.0,30.0\n3000,4000,1,50,50,50,50.0,50.0")


def test_keys_having_and_expressions_about_aggregates(spark):
    e = engine(spark, berth=BERTH)
    assert lines(e, "SELECT pier, SUM(tons * UINT64(2)) - MAX(tons) AS v FROM berth GROUP BY pier WINDOW TUMBLING(at, SIZE 2 SEC)") == expected("1,100\n2,130\n2,50")
    assert lines(e, "SELECT pier, COUNT(*) AS n FROM berth GROUP BY pier WINDOW TUMBLING(at, SIZE 1 MINUTE) HAVING n > UINT64(3)") == []
    assert lines(e, "SELECT start FROM berth WINDOW TUMBLING(at, SIZE 1 SEC)") == expected("0\n1000\n3000")


def test_sliding_windows_begin_at_zero_and_may_leave_gaps(spark):
    e = engine(spark, berth=BERTH)
    assert lines(e, "SELECT start, COUNT(*) AS n FROM berth WINDOW SLIDING(at, SIZE 2 SEC, ADVANCE BY 1 SEC)") == expected("0,5\n1000,3\n2000,1\n3000,1")
    assert lines(e, "SELECT start, end, SUM(tons) AS s FROM berth WINDOW SLIDING(at, SIZE 500 MS, ADVANCE BY 1500 MS)") == expected("0,500,40\n1500,2000,50\n3000,3500,50")


def brute_windows(rows, size, slide):
    out = {}
    for key, at, value in rows:
        start = 0
        while start <= at:
            if at < start + size:
                out.setdefault((start, key), []).append(value)
            start += slide
    return out


@pytest.mark.parametrize(("size", "slide"), [(300, 100), (250, 100), (100, 30), (7, 5), (400, 20), (390, 30), (101, 7), (1000, 1)])
def test_windows_by_panes_and_blocks_equal_brute_force(spark, size, slide):
    import random

    from tidewater.functions import field
    from tidewater.operators import Aggregate, sliding, window_aggregate
    from tidewater.plans import Relation

    rng = random.Random(size)
    rows = [(rng.choice([None, 1, 2]), rng.randrange(1500), rng.choice([None, rng.randrange(-50, 50)])) for _ in range(120)]
    rel = Relation.of(spark.createDataFrame(rows, "k int, t long, v long"))
    aggs = [Aggregate(f, field("v"), f) for f in ("SUM", "MIN", "MAX", "AVG", "COUNT")] + [Aggregate("COUNT", None, "N")]
    got = {(r["START"], r["K"]): (r["END"], r["SUM"], r["MIN"], r["MAX"], r["AVG"], r["COUNT"], r["N"]) for r in window_aggregate(rel, sliding(size, slide, "t"), ["K"], aggs).df.collect()}
    want = {}
    for (start, key), values in brute_windows(rows, size, slide).items():
        v = [x for x in values if x is not None]
        want[start, key] = (start + size, sum(v) if v else None, min(v, default=None), max(v, default=None), sum(v) / len(v) if v else None, len(v), len(values))
    assert got == want


def test_nulls_in_aggregates_and_keys(spark):
    e = engine(spark, berth=("pier INT32, tons INT32, at UINT64 NOT NULL", "4,,10\n4,6,20\n,8,30\n,,40\n4,,1010"))
    got = lines(e, "SELECT start, pier, COUNT(*) AS n, COUNT(tons) AS c, SUM(tons) AS s, AVG(tons) AS a, MEDIAN(tons) AS m FROM berth GROUP BY pier WINDOW TUMBLING(at, SIZE 1 SEC)")
    assert got == expected("0,4,2,1,6,6.0,6.0\n0,NULL,2,1,8,8.0,8.0\n1000,4,1,0,NULL,NULL,NULL")


SHIPS = ("ship INT32 NOT NULL, came UINT64 NOT NULL", "7,100\n8,2100\n9,4100")
PILOTS = ("pilot INT32 NOT NULL, took UINT64 NOT NULL", "8,1900\n7,3900\n5,100")


def test_joins_once_for_each_shared_window(spark):
    e = engine(spark, ships=SHIPS, pilots=PILOTS)
    window = "WINDOW SLIDING(came, took, SIZE 4 SEC, ADVANCE BY 2 SEC)"
    inner = "0,4000,7,100,7,3900\n0,4000,8,2100,8,1900\n"
    left = "2000,6000,8,2100,NULL,NULL\n2000,6000,9,4100,NULL,NULL\n4000,8000,9,4100,NULL,NULL\n"
    right = "0,4000,NULL,NULL,5,100\n2000,6000,NULL,NULL,7,3900\n"
    for kind, want in (("INNER", inner), ("LEFT", inner + left), ("RIGHT", inner + right), ("FULL", inner + left + right)):
        assert lines(e, f"SELECT * FROM ships {kind} JOIN pilots ON ship = pilot {window}") == expected(want), kind


@pytest.mark.parametrize("kind", ["INNER", "LEFT", "RIGHT", "FULL"])
@pytest.mark.parametrize(("on", "rule"), [("a < b", lambda a, b: a < b), ("a = b OR m = n", None), ("a = b OR a < n", None), ("NOT (a = b) AND m != n", None), ("a = b", lambda a, b: a == b)])
def test_joins_equal_brute_force(spark, kind, on, rule):
    import random

    from tidewater.session import Engine

    rng = random.Random(3)
    mine = [(rng.choice([None, 1, 2, 3]), rng.randrange(4), rng.randrange(60)) for _ in range(14)]
    theirs = [(rng.choice([None, 1, 2, 3]), rng.randrange(4), rng.randrange(60)) for _ in range(12)]
    e = Engine(spark)
    e.register("l", spark.createDataFrame(mine, "a int, m int, t long"))
    e.register("r", spark.createDataFrame(theirs, "b int, n int, u long"))
    got = sorted(map(repr, map(tuple, e.query(f"SELECT start, a, m, b, n FROM l {kind} JOIN r ON {on} WINDOW SLIDING(t, u, SIZE 20 MS, ADVANCE BY 10 MS)").df.collect())))

    def holds(a, m, b, n):
        def either(x, y):  # of three values
            return True if x or y else None if None in (x, y) else False

        equal, less, third, fourth = (None if None in p else f(*p) for f, p in ((lambda x, y: x == y, (a, b)), (lambda x, y: x < y, (a, b)), (lambda x, y: x == y, (m, n)), (lambda x, y: x < y, (a, n))))
        return {"a < b": less, "a = b OR m = n": either(equal, third), "a = b OR a < n": either(equal, fourth), "NOT (a = b) AND m != n": False if third else None if equal is None else not equal, "a = b": equal}[on]

    want = []
    for start in range(0, 60, 10):
        l, r = ([x for x in side if start <= x[2] < start + 20] for side in (mine, theirs))
        pairs = [(i, j) for i, x in enumerate(l) for j, y in enumerate(r) if holds(x[0], x[1], y[0], y[1])]
        want += [(start, *l[i][:2], *r[j][:2]) for i, j in pairs]
        if kind in ("LEFT", "FULL"):
            want += [(start, *x[:2], None, None) for i, x in enumerate(l) if i not in {p[0] for p in pairs}]
        if kind in ("RIGHT", "FULL"):
            want += [(start, None, None, *y[:2]) for j, y in enumerate(r) if j not in {p[1] for p in pairs}]
    assert got == sorted(map(repr, want))


def test_a_theta_join_of_one_window_is_dealt_to_parts(spark):
    from tidewater.session import Engine

    e = Engine(spark)
    e.register("l", spark.createDataFrame([(k, 0) for k in range(200)], "a long, t long"))
    e.register("r", spark.createDataFrame([(k, 0) for k in range(200)], "b long, u long"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = e.query("SELECT a, b FROM l JOIN r ON a < b WINDOW TUMBLING(t, u, SIZE 1 SEC)").df
        assert df.count() == 199 * 200 // 2
        assert "__lp" in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pairs_of_a_theta_join_take_a_fraction_of_a_byte_in_a_file(spark, tmp_path):
    from tidewater.session import Engine

    e = Engine(spark)
    for name, fields in (("l", "a long, i long, t long"), ("r", "b long, j long, u long")):  # four windows; values in no order
        e.register(name, spark.createDataFrame([(k * 7919 % 4801, (name == "r") * 5000 + k * 31 % 4801, k % 4 * 1000) for k in range(4800)], fields))
    df = e.query("SELECT start, a, i, b, j FROM l JOIN r ON a < b AND i != j WINDOW TUMBLING(t, u, SIZE 1 SEC)").df
    df.write.parquet(str(tmp_path / "pairs"))
    sides = [sorted(k * 7919 % 4801 for k in range(w, 4800, 4)) for w in range(4)]
    want = sum(len(side) * (len(side) - 1) // 2 for side in sides)
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == want
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < want


@pytest.mark.parametrize(("cell", "tile", "size"), [(5, 128, 1 << 22), (5, 2, 4), (1, 1, 1)])
@pytest.mark.parametrize("on", ["a < b", "a < b AND m != n", "a < b AND m < INT32(3) AND n > INT32(0)", "CHAR_LENGTH(x) < CHAR_LENGTH(y)", "a < b OR x = y", "INT32(1) = INT32(1)", "NOT ISNULL(a)"])
def test_theta_joins_by_cells_and_tiles_equal_brute_force(spark, monkeypatch, on, cell, tile, size):
    import random

    from tidewater.operators import join
    from tidewater.session import Engine

    for name, value in (("CELL", cell), ("TILE", tile), ("TILE_BYTES", size)):
        monkeypatch.setattr(join, name, value)
    rng = random.Random(cell + tile)
    side = lambda n: [(rng.choice([None, *range(9)]), rng.randrange(4), rng.choice([None, "", "kelp", "eel"]), rng.choice([3, 3, 3, 14, 25])) for _ in range(n)]
    mine, theirs = side(33), side(27)
    mine += mine[:3]  # rows may be equal
    e = Engine(spark)
    e.register("l", spark.createDataFrame(mine, "a int, m int, x string, t long"))
    e.register("r", spark.createDataFrame(theirs, "b int, n int, y string, u long"))
    got = e.query(f"SELECT start, a, m, x, b, n, y FROM l JOIN r ON {on} WINDOW SLIDING(t, u, SIZE 20 MS, ADVANCE BY 10 MS)").df.collect()
    less = lambda a, b: None not in (a, b) and a < b
    holds = {
        "a < b": lambda a, m, x, b, n, y: less(a, b),
        "a < b AND m != n": lambda a, m, x, b, n, y: less(a, b) and m != n,
        "a < b AND m < INT32(3) AND n > INT32(0)": lambda a, m, x, b, n, y: less(a, b) and m < 3 and n > 0,
        "CHAR_LENGTH(x) < CHAR_LENGTH(y)": lambda a, m, x, b, n, y: None not in (x, y) and len(x) < len(y),
        "a < b OR x = y": lambda a, m, x, b, n, y: less(a, b) or (x is not None and x == y),
        "INT32(1) = INT32(1)": lambda *_: True,
        "NOT ISNULL(a)": lambda a, *_: a is not None,
    }[on]
    want = [(s, *p[:3], *q[:3]) for s in range(0, 30, 10) for p in mine for q in theirs if s <= p[3] < s + 20 and s <= q[3] < s + 20 and holds(*p[:3], *q[:3])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_window_of_many_rows_is_cut_into_cells_and_others_are_not(spark, monkeypatch):
    from tidewater.operators import join

    monkeypatch.setattr(join, "CELL", 100)
    l, r = (spark.createDataFrame([(k, 0) for k in range(many)] + [(k, 1000) for k in range(50)], f"{c} long, __{c}s long") for c, many in (("l", 1000), ("r", 250)))  # noqa: E741
    l, r = join._grid(l, r, 4)  # noqa: E741
    cells = [{(x[f"__{c}s"], x[f"__{c}p"], x[f"__{c}q"]) for x in df.collect()} for c, df in (("l", l), ("r", r))]
    assert cells[0] == cells[1] == {(0, i, j) for i in range(4) for j in range(3)} | {(1000, 0, 0)}
    assert (l.count(), r.count()) == (1000 * 3 + 50, 250 * 4 + 50)


def test_unions_keep_all_and_go_by_name(spark):
    e = engine(spark, north=("buoy INT64 NOT NULL, lit BOOLEAN NOT NULL", "3,true\n4,false"), south=("lit BOOLEAN NOT NULL, buoy INT64 NOT NULL", "true,3"))
    assert lines(e, "SELECT * FROM north UNION SELECT * FROM south") == expected("3,true\n3,true\n4,false")


def test_a_projection_reads_its_input_only(spark):
    e = engine(spark, tide=("hi INT32 NOT NULL, lo INT32 NOT NULL", "9,2"))
    assert lines(e, "SELECT hi - lo AS hi, hi + lo AS lo FROM tide") == ["7,11"]


TIDE = ("hi UINT64 NOT NULL, moon VARSIZED NOT NULL, at UINT64 NOT NULL", "5,new,10")


@pytest.mark.parametrize(
    ("query", "code"),
    [
        ("SELECT hi FROM tide LIMIT 3", 2000),
        ("SELECT hi + 2 AS v FROM tide", 2000),  # a constant has no type
        ("SELECT MAX(hi) AS v FROM tide", 2000),  # no window
        ("SELECT moon FROM tide GROUP BY moon", 2000),
        ("SELECT * FROM tide JOIN (SELECT hi AS a, at AS b FROM tide) ON hi = a", 2000),
        ("SELECT hi FROM tide SET('x' AS tide.speed)", 2000),
        ("SELECT hi AS v, at AS v FROM tide", 2003),
        ("SELECT hi FROM tide WHERE hi", 2003),
        ("SELECT hi FROM tide UNION SELECT moon FROM tide", 2003),
        ("SELECT low FROM tide", 2004),
        ("SELECT hi < moon AS v FROM tide", 2007),
        ("SELECT * FROM tide LEFT JOIN (SELECT hi AS a, at AS b FROM tide) ON INT32(1) = INT32(1) WINDOW TUMBLING(at, b, SIZE 1 SEC)", 2008),
        ("SELECT hi FROM ebb", 2030),
        ("SELECT * FROM MODEL_INFERENCE(waves, tide)", 2040),
    ],
)
def test_errors(spark, query, code):
    with pytest.raises(EngineError) as e:
        engine(spark, tide=TIDE).query(query)
    assert e.value.code == code


def test_catalog(spark):
    e = engine(spark, tide=TIDE)
    assert [r["NAME"] for r in e.sql("SHOW LOGICAL SOURCES").collect()] == ["TIDE"]
    assert e.sql("SHOW PHYSICAL SOURCES FOR tide").count() == 1
    e.sql("CREATE SINK gone(hi UINT64 NOT NULL) TYPE Void; SELECT hi FROM tide INTO gone SET('flood' AS QUERY.ID)")
    assert [tuple(r) for r in e.sql("SHOW QUERIES WHERE ID = 'flood'").collect()] == [("flood", "STOPPED")]
    assert "Scan" in e.sql("EXPLAIN SELECT hi FROM tide") or "Project" in e.sql("EXPLAIN SELECT hi FROM tide")
    e.sql("DROP SINK WHERE NAME = 'GONE'; DROP QUERY WHERE ID = 'flood'; CREATE WORKER 'quay:9'")
    assert e.sql("SHOW SINKS FORMAT JSON").first()[0] == "[]"
    with pytest.raises(EngineError):
        e.sql("DROP WORKER WHERE ID = 'quay:9'")


def test_inference(spark):
    from golden import schema

    e = engine(spark, wave=("u FLOAT32 NOT NULL, v FLOAT32 NOT NULL", "3.0,4.0\n1.0,1.0"))
    e.model("height", lambda x: (x**2).sum(axis=1, keepdims=True), schema("u FLOAT32, v FLOAT32"), schema("h FLOAT32"))
    assert lines(e, "SELECT * FROM MODEL_INFERENCE(height, wave) WHERE h > FLOAT32(4)") == ["3.0,4.0,25.0"]
