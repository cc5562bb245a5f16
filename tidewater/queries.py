"""Queries over the test tables, one or more for each operator, with DuckDB SQL for the same rows.

The dialect has integers for times, so ``events``, ``orders`` and ``lineitem`` come in
as relations with milliseconds since 1970.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import field
from .operators import Aggregate, sliding, window_aggregate
from .session import Engine
from .types import Field, Schema, c_semantics, declared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_TABLES = {
    "events": ("EVENT_ID INT64 NOT NULL, TS UINT64 NOT NULL, USER_ID INT64 NOT NULL, EVENT_TYPE VARSIZED NOT NULL, VALUE FLOAT64, PROPS VARSIZED", {"ts": "ts"}),
    "orders": ("O_ORDERKEY INT64 NOT NULL, O_CUSTKEY INT64 NOT NULL, O_ORDERSTATUS VARSIZED, O_TOTALPRICE FLOAT64, O_ORDERDATE UINT64 NOT NULL, O_ORDERPRIORITY VARSIZED", {"o_orderdate": "o_orderdate"}),
    "lineitem": ("L_ORDERKEY INT64 NOT NULL, L_PARTKEY INT64 NOT NULL, L_SUPPKEY INT64 NOT NULL, L_LINENUMBER INT32 NOT NULL, L_QUANTITY FLOAT64, L_EXTENDEDPRICE FLOAT64, L_DISCOUNT FLOAT64, L_TAX FLOAT64, L_RETURNFLAG VARSIZED, L_LINESTATUS VARSIZED, L_SHIPDATE UINT64 NOT NULL", {"l_shipdate": "l_shipdate"}),
    "customer": ("C_CUSTKEY INT64 NOT NULL, C_NAME VARSIZED, C_NATIONKEY INT32, C_ACCTBAL FLOAT64, C_MKTSEGMENT VARSIZED", {}),
    "part": ("P_PARTKEY INT64 NOT NULL, P_NAME VARSIZED, P_BRAND VARSIZED, P_TYPE VARSIZED, P_SIZE INT32, P_RETAILPRICE FLOAT64", {}),
    "supplier": ("S_SUPPKEY INT64 NOT NULL, S_NAME VARSIZED, S_NATIONKEY INT32, S_ACCTBAL FLOAT64", {}),
    "nation": ("N_NATIONKEY INT32 NOT NULL, N_NAME VARSIZED, N_REGIONKEY INT32", {}),
    "region": ("R_REGIONKEY INT32 NOT NULL, R_NAME VARSIZED", {}),
    "documents": ("DOC_ID INT64 NOT NULL, TEXT VARSIZED, LANG VARSIZED, SOURCE VARSIZED, N_CHARS INT64", {}),
}
#: Milliseconds in DuckDB.
_EV = "(SELECT event_id, epoch_us(ts) // 1000 AS ts, user_id, event_type, value FROM events)"
_OR = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) // 1000 AS ts FROM orders)"
#: Orders, shifted by 29 years into the time of the events.
_SHIFT = 915_148_800_000
_LATER = f"(SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000 + {_SHIFT} AS ts FROM orders)"
_LI = "(SELECT *, epoch_us(l_shipdate) // 1000 AS ts FROM lineitem)"
DAY, HOUR = 86_400_000, 3_600_000


def schema(text: str) -> Schema:
    return Schema(tuple(Field(p.split()[0], declared(" ".join(p.split()[1:]))) for p in text.split(",")))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """An engine that knows the given tables of a folder."""
    engine = Engine(spark)
    for name in names:
        text, times = _TABLES[name]
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        with c_semantics(spark):
            df = df.withColumns({c: F.unix_millis(F.col(c).cast("timestamp")) for c in times})
        engine.register(name, df, schema(text))
    return engine


def _sql(name: str, uses: str, text: str, oracle: str | None = None) -> None:
    """Registers a query in the dialect."""
    QUERIES[name] = lambda spark, sf_dir: tables(spark, sf_dir, *uses.split()).query(text).lower()
    if oracle:
        ORACLE_SQL[name] = oracle


def _windows(size: int, slide: int, table: str) -> str:
    """DuckDB: rows of a table expression, once for each window, as ws."""
    return f"(SELECT *, unnest(generate_series(CASE WHEN ts < {size} THEN 0 ELSE ((ts - {size}) // {slide} + 1) * {slide} END, ts - ts % {slide}, {slide})) AS ws FROM {table} AS w)"


# -- projection, selection, union --------------------------------------------------------------

_sql("projection_rename", "events", "SELECT ts AS t, event_id AS id, user_id FROM events", "SELECT epoch_us(ts) // 1000 AS t, event_id AS id, user_id FROM events")
_sql("projection_star_expr", "supplier", "SELECT *, s_acctbal * FLOAT64(2) AS twice FROM supplier", "SELECT *, s_acctbal * 2 AS twice FROM supplier")
_sql("projection_reuses_name", "supplier", "SELECT s_suppkey + INT64(1) AS s_suppkey, s_suppkey + s_nationkey AS s_nationkey FROM supplier", "SELECT s_suppkey + 1 AS s_suppkey, s_suppkey + s_nationkey AS s_nationkey FROM supplier")
_sql("selection_and", "events", "SELECT event_id, value FROM events WHERE event_type = VARSIZED('purchase') AND value > FLOAT64(50)", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
_sql("selection_or_not", "events", "SELECT event_id FROM events WHERE NOT (event_type == VARSIZED('view')) OR user_id < INT64(5)", "SELECT event_id FROM events WHERE NOT (event_type = 'view') OR user_id < 5")
_sql("selection_stacked", "orders", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = VARSIZED('F')) WHERE o_totalprice >= FLOAT64(100000)", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
_sql("union_all", "nation region", "SELECT n_nationkey AS k, n_name AS n FROM nation UNION SELECT r_name AS n, r_regionkey AS k FROM region UNION SELECT r_regionkey AS k, r_name AS n FROM region",
     "SELECT n_nationkey AS k, n_name AS n FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
_sql("union_tagged", "customer supplier", "SELECT INT32(1) AS tag, c_custkey AS k, c_acctbal AS b FROM customer UNION SELECT INT32(2) AS tag, s_suppkey AS k, s_acctbal AS b FROM supplier",
     "SELECT 1 AS tag, c_custkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT 2, s_suppkey, s_acctbal FROM supplier")

# -- scalar functions ------------------------------------------------------------------------------

_sql("fn_arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS a, l_orderkey - l_partkey AS s, l_linenumber * INT32(3) AS m, l_orderkey / INT64(7) AS d, l_orderkey % INT64(7) AS r, l_extendedprice / FLOAT64(8) AS f FROM lineitem",
     "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS a, l_orderkey - l_partkey AS s, l_linenumber * 3 AS m, l_orderkey // 7 AS d, l_orderkey % 7 AS r, l_extendedprice / 8 AS f FROM lineitem")
_sql("fn_wraparound", "part", "SELECT p_partkey, CASTTOTYPE(p_partkey AS INT32) * INT32(2000000) AS w FROM part",
     "SELECT p_partkey, (((p_partkey::HUGEINT * 2000000 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::INTEGER AS w FROM part")
_sql("fn_unsigned", "supplier", "SELECT s_suppkey, CASTTOTYPE(s_nationkey AS INT8) - UINT32(100) AS u, CASTTOTYPE(s_nationkey AS UINT8) - UINT8(100) AS i FROM supplier",
     "SELECT s_suppkey, (s_nationkey::BIGINT - 100 + 4294967296) % 4294967296 AS u, (s_nationkey - 100)::INTEGER AS i FROM supplier")
_sql("fn_rounding", "supplier", "SELECT s_suppkey, ABS(s_acctbal) AS a, CEIL(s_acctbal) AS c, FLOOR(s_acctbal) AS f, ROUND(s_acctbal) AS r, -s_acctbal AS n FROM supplier",
     "SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(s_acctbal) AS r, -s_acctbal AS n FROM supplier")
_sql("fn_powers", "part", "SELECT p_partkey, SQRT(p_retailprice) AS s, POW(p_size, INT32(2)) AS p FROM part WHERE EXP(CASTTOTYPE(p_size AS FLOAT64)) > FLOAT64(100)",
     "SELECT p_partkey, sqrt(p_retailprice) AS s, pow(p_size, 2)::DOUBLE AS p FROM part WHERE exp(p_size) > 100")
_sql("fn_comparisons", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity < FLOAT64(10) AS lt, l_quantity <= FLOAT64(10) AS le, l_quantity > FLOAT64(10) AS gt, l_quantity >= FLOAT64(10) AS ge, l_linenumber == INT64(1) AS eq, l_linenumber != INT64(1) AS ne FROM lineitem",
     "SELECT l_orderkey, l_linenumber, l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_quantity > 10 AS gt, l_quantity >= 10 AS ge, l_linenumber = 1 AS eq, l_linenumber != 1 AS ne FROM lineitem")
_sql("fn_isnull", "events", "SELECT event_id, ISNULL(value) AS missing FROM events", "SELECT event_id, value IS NULL AS missing FROM events")
_sql("fn_text", "documents", "SELECT doc_id, CHAR_LENGTH(text) AS c, OCTET_LENGTH(text) AS o, CONCAT(lang, source) AS ls FROM documents",
     "SELECT doc_id, length(text) AS c, strlen(text) AS o, lang || source AS ls FROM documents")
_sql("fn_base64", "customer", "SELECT c_custkey, TO_BASE64(c_name) AS e, FROM_BASE64(TO_BASE64(c_name)) AS d, FROM_BASE64(VARSIZED('***')) AS x FROM customer",
     "SELECT c_custkey, base64(c_name::BLOB) AS e, c_name AS d, '' AS x FROM customer")
_sql("fn_casts", "lineitem", "SELECT l_orderkey, l_linenumber, CASTTOTYPE(l_quantity AS INT32) AS q, CASTTOTYPE(l_orderkey AS UINT8) AS b, CASTTOTYPE(l_linenumber AS FLOAT64) AS f FROM lineitem",
     "SELECT l_orderkey, l_linenumber, trunc(l_quantity)::INTEGER AS q, l_orderkey % 256 AS b, l_linenumber::DOUBLE AS f FROM lineitem")
_sql("fn_text_to_number", "part", "SELECT p_partkey, CASTTOTYPE(p_brand AS INT64) AS n FROM part", "SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g')::BIGINT AS n FROM part")
_sql("fn_times", "events", "SELECT event_id, CASTFROMUNIXTS(ts) AS iso, CASTTOUNIXTS(CASTFROMUNIXTS(ts)) AS back, YEAR_OF(ts) AS y, MONTH_OF(ts) AS m, DAY_OF(ts) AS d FROM events",
     "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, epoch_us(ts) // 1000 AS back, year(ts) AS y, month(ts) AS m, day(ts) AS d FROM events")

# -- windowed aggregation ---------------------------------------------------------------------------

_AGGS = "COUNT(*) AS n, COUNT(value) AS c, MIN(value) AS lo, MAX(value) AS hi"
_sql("agg_tumbling_keyed", "events", f"SELECT start, end, user_id, {_AGGS} FROM events GROUP BY user_id WINDOW TUMBLING(ts, SIZE 1 DAY)",
     f"SELECT ts - ts % {DAY} AS start, ts - ts % {DAY} + {DAY} AS \"end\", user_id, count(*) AS n, count(value) AS c, min(value) AS lo, max(value) AS hi FROM {_EV} GROUP BY ALL")
_sql("agg_tumbling_global", "events", "SELECT start, end, COUNT(*) AS n, SUM(user_id) AS s, AVG(user_id) AS a FROM events WINDOW TUMBLING(ts, SIZE 1 HOUR)",
     f"SELECT ts - ts % {HOUR} AS start, ts - ts % {HOUR} + {HOUR} AS \"end\", count(*) AS n, sum(user_id)::BIGINT AS s, avg(user_id) AS a FROM {_EV} GROUP BY ALL")
_sql("agg_sliding_keyed", "events", "SELECT start, end, event_type, COUNT(*) AS n, SUM(user_id) AS s, AVG(user_id) AS a, MAX(user_id) AS m FROM events GROUP BY event_type WINDOW SLIDING(ts, SIZE 1 DAY, ADVANCE BY 6 HOUR)",
     f"SELECT ws AS start, ws + {DAY} AS \"end\", event_type, count(*) AS n, sum(user_id)::BIGINT AS s, avg(user_id) AS a, max(user_id) AS m FROM {_windows(DAY, 6 * HOUR, _EV)} GROUP BY ALL")
_sql("agg_sliding_uneven", "events", "SELECT start, end, COUNT(*) AS n, MIN(user_id) AS m FROM events WINDOW SLIDING(ts, SIZE 7 HOUR, ADVANCE BY 3 HOUR)",
     f"SELECT ws AS start, ws + {7 * HOUR} AS \"end\", count(*) AS n, min(user_id) AS m FROM {_windows(7 * HOUR, 3 * HOUR, _EV)} GROUP BY ALL")
_sql("agg_sliding_gap", "events", "SELECT start, end, COUNT(*) AS n FROM events WINDOW SLIDING(ts, SIZE 1 HOUR, ADVANCE BY 5 HOUR)",
     f"SELECT ts - ts % {5 * HOUR} AS start, ts - ts % {5 * HOUR} + {HOUR} AS \"end\", count(*) AS n FROM {_EV} WHERE ts % {5 * HOUR} < {HOUR} GROUP BY ALL")
_sql("agg_median", "events", "SELECT start, event_type, MEDIAN(user_id) AS m FROM events GROUP BY event_type WINDOW SLIDING(ts, SIZE 1 DAY, ADVANCE BY 12 HOUR)",
     f"SELECT ws AS start, event_type, median(user_id) AS m FROM {_windows(DAY, 12 * HOUR, _EV)} GROUP BY ALL")
_sql("agg_expression", "lineitem", "SELECT start, l_returnflag, SUM(l_linenumber * INT32(2)) + INT32(1) AS s, MAX(l_quantity) - MIN(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag WINDOW TUMBLING(l_shipdate, SIZE 30 DAY)",
     f"SELECT ts - ts % {30 * DAY} AS start, l_returnflag, (sum(l_linenumber * 2) + 1)::INTEGER AS s, max(l_quantity) - min(l_quantity) AS spread FROM {_LI} GROUP BY ALL")
_sql("agg_having", "events", "SELECT start, user_id, COUNT(*) AS n FROM events GROUP BY user_id WINDOW TUMBLING(ts, SIZE 1 DAY) HAVING n >= UINT64(2)",
     f"SELECT ts - ts % {DAY} AS start, user_id, count(*) AS n FROM {_EV} GROUP BY ALL HAVING count(*) >= 2")
_sql("agg_stacked", "events", "SELECT start, end, MAX(n) AS top FROM (SELECT start AS s, user_id, COUNT(*) AS n FROM events GROUP BY user_id WINDOW TUMBLING(ts, SIZE 1 HOUR)) WINDOW TUMBLING(s, SIZE 1 DAY)",
     f"SELECT s - s % {DAY} AS start, s - s % {DAY} + {DAY} AS \"end\", max(n) AS top FROM (SELECT ts - ts % {HOUR} AS s, user_id, count(*) AS n FROM {_EV} GROUP BY ALL) GROUP BY ALL")
_sql("agg_windows_only", "events", "SELECT start, end FROM events WINDOW TUMBLING(ts, SIZE 1 HOUR)", f"SELECT DISTINCT ts - ts % {HOUR} AS start, ts - ts % {HOUR} + {HOUR} AS \"end\" FROM {_EV}")
_sql("agg_sum_wraps", "lineitem", "SELECT start, SUM(CASTTOTYPE(l_linenumber AS INT8)) AS s FROM lineitem WINDOW TUMBLING(l_shipdate, SIZE 30 DAY)",
     f"SELECT ts - ts % {30 * DAY} AS start, ((sum(l_linenumber) + 128) % 256 - 128)::TINYINT AS s FROM {_LI} GROUP BY ALL")

# -- windowed joins -------------------------------------------------------------------------------------

_L = "(SELECT user_id AS u, event_id AS a, ts AS ta FROM events WHERE event_type = VARSIZED('purchase'))"
_R = "(SELECT user_id AS v, event_id AS b, ts AS tb FROM events WHERE event_type = VARSIZED('error'))"


def _join(name: str, kind: str, on: str, on_sql: str, window: str, size: int, slide: int) -> None:
    text = f"SELECT start, end, u, a, v, b FROM {_L} {kind} JOIN {_R} ON {on} WINDOW {window}"
    side = lambda t, u, i: _windows(size, slide, f"(SELECT user_id AS {u}, event_id AS {i}, ts FROM {_EV} WHERE event_type = '{t}')")
    oracle = f"SELECT coalesce(l.ws, r.ws) AS start, coalesce(l.ws, r.ws) + {size} AS \"end\", u, a, v, b FROM {side('purchase', 'u', 'a')} l {kind} JOIN {side('error', 'v', 'b')} r ON l.ws = r.ws AND {on_sql}"
    _sql(name, "events", text, oracle)


_join("join_inner_tumbling", "INNER", "u = v", "u = v", "TUMBLING(ta, tb, SIZE 1 DAY)", DAY, DAY)
_join("join_inner_sliding", "INNER", "u = v", "u = v", "SLIDING(ta, tb, SIZE 1 DAY, ADVANCE BY 8 HOUR)", DAY, 8 * HOUR)
_join("join_left", "LEFT", "u = v", "u = v", "TUMBLING(ta, tb, SIZE 1 DAY)", DAY, DAY)
_join("join_right", "RIGHT", "u = v", "u = v", "TUMBLING(ta, tb, SIZE 1 DAY)", DAY, DAY)
_join("join_full_sliding", "FULL", "u = v", "u = v", "SLIDING(ta, tb, SIZE 12 HOUR, ADVANCE BY 4 HOUR)", 12 * HOUR, 4 * HOUR)
_join("join_theta", "INNER", "u < v AND a != b", "u < v AND a != b", "TUMBLING(ta, tb, SIZE 2 HOUR)", 2 * HOUR, 2 * HOUR)
_join("join_or", "INNER", "u = v OR a = b", "(u = v OR a = b)", "TUMBLING(ta, tb, SIZE 6 HOUR)", 6 * HOUR, 6 * HOUR)
_sql("join_mixed_types", "orders customer", "SELECT k, c FROM (SELECT CASTTOTYPE(o_custkey AS INT32) AS k, o_orderkey, UINT64(0) AS t1 FROM orders) JOIN (SELECT c_custkey AS c, UINT64(0) AS t2 FROM customer) ON k = c WINDOW TUMBLING(t1, t2, SIZE 1 SEC)",
     "SELECT o_custkey::INTEGER AS k, c_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey")
_sql("join_multiway", "events orders", f"SELECT start, end, n, m, w FROM (SELECT start AS s1, n, m FROM (SELECT start AS sa, COUNT(*) AS n FROM events WINDOW TUMBLING(ts, SIZE 1 DAY)) JOIN (SELECT start AS sb, COUNT(value) AS m FROM events WINDOW TUMBLING(ts, SIZE 1 DAY)) ON n >= m WINDOW TUMBLING(sa, sb, SIZE 1 DAY)) LEFT JOIN (SELECT start AS sc, COUNT(*) AS w FROM (SELECT o_orderdate + UINT64({_SHIFT}) AS later FROM orders) WINDOW TUMBLING(later, SIZE 1 DAY)) ON n != w WINDOW TUMBLING(s1, sc, SIZE 1 DAY)",
     f"""WITH a AS (SELECT ts - ts % {DAY} AS s, count(*) AS n, count(value) AS m FROM {_EV} GROUP BY 1), c AS (SELECT ts - ts % {DAY} AS s, count(*) AS w FROM {_LATER} GROUP BY 1)
     SELECT a.s AS start, a.s + {DAY} AS "end", n, m, w FROM a LEFT JOIN c ON a.s = c.s AND n != w WHERE n >= m""")  # fmt: skip

# NULLs: no table has any, so an outer join makes them.
_HALF = f"(SELECT start AS s, a, v, b FROM {_L} LEFT JOIN {_R} ON u = v AND b > a WINDOW TUMBLING(ta, tb, SIZE 1 DAY))"
_HALF_SQL = f"(SELECT l.ts - l.ts % {DAY} AS s, l.event_id AS a, r.user_id AS v, r.event_id AS b FROM (SELECT * FROM {_EV} WHERE event_type = 'purchase') l LEFT JOIN (SELECT * FROM {_EV} WHERE event_type = 'error') r ON l.user_id = r.user_id AND l.ts // {DAY} = r.ts // {DAY} AND r.event_id > l.event_id)"
_sql("null_predicates", "events", f"SELECT s, a, ISNULL(b) AS missing, b + a AS x, b > a AS y, NOT (b > a) AS z FROM {_HALF}", f"SELECT s, a, b IS NULL AS missing, b + a AS x, b > a AS y, NOT (b > a) AS z FROM {_HALF_SQL}")
_sql("null_selection", "events", f"SELECT a, b FROM {_HALF} WHERE b > INT64(100) OR ISNULL(v)", f"SELECT a, b FROM {_HALF_SQL} WHERE b > 100 OR v IS NULL")
_sql("null_group_keys", "events", f"SELECT start, v, COUNT(*) AS n, COUNT(b) AS c, SUM(b) AS t, MIN(b) AS lo, MAX(b) AS hi, AVG(b) AS m, MEDIAN(b) AS d FROM {_HALF} GROUP BY v WINDOW TUMBLING(s, SIZE 3 DAY)",
     f"SELECT s - s % {3 * DAY} AS start, v, count(*) AS n, count(b) AS c, sum(b)::BIGINT AS t, min(b) AS lo, max(b) AS hi, avg(b) AS m, median(b) AS d FROM {_HALF_SQL} GROUP BY ALL")
for _kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    _sql(f"null_join_keys_{_kind.lower()}", "events", f"SELECT start, a, v, b, w, e FROM {_HALF} {_kind} JOIN (SELECT user_id AS w, event_id AS e, ts AS t FROM events WHERE event_type = VARSIZED('signup')) ON v = w WINDOW TUMBLING(s, t, SIZE 12 HOUR)",
         f"SELECT coalesce(l.s, r.ts) - coalesce(l.s, r.ts) % {DAY // 2} AS start, a, v, b, user_id AS w, event_id AS e FROM {_HALF_SQL} l {_kind} JOIN (SELECT * FROM {_EV} WHERE event_type = 'signup') r ON v = user_id AND l.s // {DAY // 2} = r.ts // {DAY // 2}")
_sql("join_self", "nation", "SELECT x, y FROM (SELECT n_nationkey AS x, n_regionkey AS rx, UINT64(5) AS t1 FROM nation) JOIN (SELECT n_nationkey AS y, n_regionkey AS ry, UINT64(7) AS t2 FROM nation) ON rx = ry AND NOT (x = y) WINDOW TUMBLING(t1, t2, SIZE 1 SEC)",
     "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")

# -- benchmark shapes -----------------------------------------------------------------------------------------

_sql("nexmark_q0", "events", "SELECT * FROM (SELECT ts, event_id, user_id, value FROM events)", "SELECT epoch_us(ts) // 1000 AS ts, event_id, user_id, value FROM events")
_sql("nexmark_q1", "events", "SELECT event_id, value * FLOAT64(89) / FLOAT64(100) AS price FROM events", "SELECT event_id, value * 89 / 100 AS price FROM events")
_sql("nexmark_q2", "events", "SELECT ts, event_id, value FROM events WHERE event_id % INT64(123) = INT64(0)", "SELECT epoch_us(ts) // 1000 AS ts, event_id, value FROM events WHERE event_id % 123 = 0")
_COUNTS = "SELECT user_id, COUNT(user_id) AS {n}, start AS {s} FROM events GROUP BY user_id WINDOW SLIDING(ts, SIZE 10 HOUR, ADVANCE BY 2 HOUR)"
_sql("nexmark_q5", "events", f"SELECT start, end, user_id, num, top FROM ({_COUNTS.format(n='num', s='s1')}) INNER JOIN (SELECT MAX(num2) AS top, start AS s3 FROM ({_COUNTS.format(n='num2', s='s2')}) WINDOW TUMBLING(s2, SIZE 2 HOUR)) ON num == top WINDOW TUMBLING(s1, s3, SIZE 2 HOUR)",
     f"""WITH c AS (SELECT ws, user_id, count(*) AS num FROM {_windows(10 * HOUR, 2 * HOUR, _EV)} GROUP BY ALL)
     SELECT ws AS start, ws + {2 * HOUR} AS "end", user_id, num, num AS top FROM c QUALIFY num = max(num) OVER (PARTITION BY ws)""")  # fmt: skip
_sql("nexmark_q8", "events orders", f"SELECT start, end, user_id, event_id, o_orderkey FROM (SELECT ts AS t1, user_id, event_id FROM events) INNER JOIN (SELECT o_orderdate + UINT64({_SHIFT}) AS t2, o_orderkey, o_custkey FROM orders) ON user_id = o_custkey WINDOW TUMBLING(t1, t2, SIZE 10 DAY)",
     f"SELECT e.ts - e.ts % {10 * DAY} AS start, e.ts - e.ts % {10 * DAY} + {10 * DAY} AS \"end\", user_id, event_id, o_orderkey FROM {_EV} e JOIN {_LATER} o ON user_id = o_custkey AND e.ts // {10 * DAY} = o.ts // {10 * DAY}")
_sql("ysb", "events", "SELECT start, end, user_id, COUNT(*) AS n, SUM(user_id) AS s FROM events WHERE event_type = VARSIZED('purchase') GROUP BY user_id WINDOW TUMBLING(ts, SIZE 30 SEC)",
     f"SELECT ts - ts % 30000 AS start, ts - ts % 30000 + 30000 AS \"end\", user_id, count(*) AS n, sum(user_id)::BIGINT AS s FROM {_EV} WHERE event_type = 'purchase' GROUP BY ALL")
_sql("linear_road_q1", "events", "SELECT start, event_type, AVG(user_id) AS speed FROM events GROUP BY event_type WINDOW SLIDING(ts, SIZE 5 HOUR, ADVANCE BY 1 MINUTE) HAVING speed < FLOAT64(400)",
     f"SELECT ws AS start, event_type, avg(user_id) AS speed FROM {_windows(5 * HOUR, 60_000, _EV)} GROUP BY ALL HAVING avg(user_id) < 400")
_sql("linear_road_q2", "events", "SELECT start, end, event_type, user_id, COUNT(*) AS n FROM events GROUP BY event_type, user_id WINDOW SLIDING(ts, SIZE 30 MINUTE, ADVANCE BY 1 MINUTE)",
     f"SELECT ws AS start, ws + {30 * 60_000} AS \"end\", event_type, user_id, count(*) AS n FROM {_windows(30 * 60_000, 60_000, _EV)} GROUP BY ALL")
_sql("debs_range", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= FLOAT64(10) AND l_quantity < FLOAT64(20)", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
_sql("debs_q7", "lineitem", "SELECT start, l_suppkey, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_suppkey WINDOW TUMBLING(l_shipdate, SIZE 30 DAY)",
     f"SELECT ts - ts % {30 * DAY} AS start, l_suppkey, sum(l_linenumber)::INTEGER AS s FROM {_LI} GROUP BY ALL")
_sql("debs_q8", "lineitem", "SELECT start, l_suppkey, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_suppkey WINDOW SLIDING(l_shipdate, SIZE 60 DAY, ADVANCE BY 10 DAY)",
     f"SELECT ws AS start, l_suppkey, sum(l_linenumber)::INTEGER AS s FROM {_windows(60 * DAY, 10 * DAY, _LI)} GROUP BY ALL")
_sql("cluster_monitoring_q2", "events", "SELECT start, user_id, SUM(event_id) AS s FROM events WHERE event_type = VARSIZED('click') GROUP BY user_id WINDOW SLIDING(ts, SIZE 60 SEC, ADVANCE BY 1 SEC)",
     f"SELECT ws AS start, user_id, sum(event_id)::BIGINT AS s FROM {_windows(60_000, 1000, f'''(SELECT * FROM {_EV} WHERE event_type = 'click')''')} GROUP BY ALL")
_sql("manufacturing_q1", "lineitem", "SELECT start, end, AVG(l_linenumber) AS a, MIN(l_quantity) AS b, MAX(l_quantity) AS c, COUNT(l_tax) AS d, SUM(l_partkey) AS e FROM lineitem WINDOW SLIDING(l_shipdate, SIZE 60 DAY, ADVANCE BY 1 DAY)",
     f"SELECT ws AS start, ws + {60 * DAY} AS \"end\", avg(l_linenumber) AS a, min(l_quantity) AS b, max(l_quantity) AS c, count(l_tax) AS d, sum(l_partkey)::BIGINT AS e FROM {_windows(60 * DAY, DAY, _LI)} GROUP BY ALL")


# -- what is not one statement of the dialect --------------------------------------------------------------


def _checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import checksum

    return checksum(tables(spark, sf_dir, "nation").query("SELECT n_nationkey, n_name FROM nation"))


def _csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import csv_lines

    return csv_lines(tables(spark, sf_dir, "supplier").query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")).withColumnRenamed("value", "line")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.sql(
        """CREATE LOGICAL SOURCE g(a UINT64 NOT NULL, b INT32 NOT NULL, c FLOAT64 NOT NULL);
        CREATE PHYSICAL SOURCE FOR g TYPE Generator SET('ALL' AS "SOURCE".STOP_GENERATOR_WHEN_SEQUENCE_FINISHES, 1 AS "SOURCE".SEED,
        'SEQUENCE UINT64 0 1000 1, SEQUENCE INT32 5 100 5, SEQUENCE FLOAT64 0 10 0.5' AS "SOURCE".GENERATOR_SCHEMA)"""
    )
    return engine.query("SELECT * FROM g").lower()


def _inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = tables(spark, sf_dir, "supplier")
    one = Schema((Field("A", declared("FLOAT32")), Field("B", declared("FLOAT32"))))
    engine.model("line", lambda x: x[:, :1] * 2 + x[:, 1:] + 1, one, Schema((Field("Y", declared("FLOAT32")),)))
    engine.register("s", engine.query("SELECT s_suppkey, CASTTOTYPE(s_suppkey AS FLOAT32) AS a, CASTTOTYPE(s_suppkey AS FLOAT32) AS b FROM supplier").df, schema("S_SUPPKEY INT64 NOT NULL, A FLOAT32 NOT NULL, B FLOAT32 NOT NULL"))
    return engine.query("SELECT s_suppkey, CASTTOTYPE(y AS FLOAT64) AS y FROM MODEL_INFERENCE(line, s) WHERE y > FLOAT32(10)").lower()


def _panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = tables(spark, sf_dir, "events").query("SELECT * FROM events")
    aggs = [Aggregate("COUNT", None, "N"), Aggregate("MAX", field("user_id"), "M")]
    return window_aggregate(rel, sliding(60 * HOUR, HOUR, "ts"), ["EVENT_TYPE"], aggs).lower()


QUERIES |= {"sink_checksum": _checksum, "format_csv": _csv_text, "source_generator": _generated, "model_inference": _inference, "agg_panes_60": _panes}
ORACLE_SQL |= {
    "sink_checksum": "SELECT count(*) AS count, sum(list_sum(list_transform(string_split(n_nationkey || ',' || n_name || chr(10), ''), lambda c: ascii(c))))::BIGINT AS checksum FROM nation",
    "format_csv": r"SELECT s_suppkey || ',' || s_name || ',' || regexp_replace(regexp_replace(printf('%.6f', s_acctbal), '0+$', ''), '\.$', '.0') AS line FROM supplier",
    "source_generator": "SELECT i AS a, least(5 + i * 5, 100)::INTEGER AS b, least(i * 0.5, 10)::DOUBLE AS c FROM range(1000) t(i)",
    "model_inference": "SELECT s_suppkey, (s_suppkey * 3 + 1)::DOUBLE AS y FROM supplier WHERE s_suppkey * 3 + 1 > 10",
    "agg_panes_60": f"SELECT ws AS start, ws + {60 * HOUR} AS \"end\", event_type, count(*) AS n, max(user_id) AS m FROM {_windows(60 * HOUR, HOUR, _EV)} GROUP BY ALL",
}

from .queries_by_type import register as _register  # noqa: E402

_register(_sql, QUERIES, ORACLE_SQL)
