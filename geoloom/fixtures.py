"""Geometry views over the given tables.

Each view is kept once as text with ``{rows}`` places; constant row lists render as
``LATERAL VIEW inline`` for Spark, so no cross join is planned, and as ``CROSS JOIN VALUES``
for the SQL the results are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.plans.scan import ordered_scan
from geoloom.plans.scratch import materialize

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def _literal(value) -> str:
    return str(value) if isinstance(value, int) else f"'{value}'"


def _rows(alias: str, columns: list[str], values: list[tuple], ansi: bool) -> str:
    tuples = ["(" + ", ".join(_literal(v) for v in t) + ")" for t in values]
    if ansi:
        return f"CROSS JOIN (VALUES {', '.join(tuples)}) AS {alias}({', '.join(columns)})"
    structs = ", ".join(f"struct{t}" for t in tuples)
    return f"LATERAL VIEW inline(array({structs})) {alias} AS {', '.join(columns)}"


def _ints(alias: str, column: str, values, ansi: bool) -> str:
    return _rows(alias, [column], [(v,) for v in values], ansi)


# Corners of the twelve triangles of a unit box: two caps, then four walls (fixed values).
_BOX_FACETS = [
    (0, 0, 0, 0, 1, 1, 0, 1, 0, 0), (1, 0, 0, 0, 0, 1, 0, 1, 1, 0),
    (2, 0, 0, 1, 1, 0, 1, 1, 1, 1), (3, 0, 0, 1, 1, 1, 1, 0, 1, 1),
    (4, 0, 0, 0, 1, 0, 0, 1, 0, 1), (5, 0, 0, 0, 1, 0, 1, 0, 0, 1),
    (6, 1, 0, 0, 1, 1, 0, 1, 1, 1), (7, 1, 0, 0, 1, 1, 1, 1, 0, 1),
    (8, 1, 1, 0, 0, 1, 0, 0, 1, 1), (9, 1, 1, 0, 0, 1, 1, 1, 1, 1),
    (10, 0, 1, 0, 0, 0, 0, 0, 0, 1), (11, 0, 1, 0, 0, 0, 1, 0, 1, 1),
]

# Customers, orders and parts of one hundredth of the unit scale share a square of 10,007 units; the next
# keys lie in the next square along x. Customers, parts and orders number 1,500, 2,000 and 15,000 there.
SQUARE = 10100


def _square(key: str, keys: int) -> str:
    return f"CAST(floor({key} / {keys}.0) AS BIGINT) * {SQUARE}"


_HEADER = ["M48", "METRIC,LZ", "VER,1", "FMAT,2", "T1C0.4", "T2C0.8", "T3C1.2", "T4C3.0", "M95"]
_DXF_CODES = ["0", "100", "8", "100", "10", "20", "11", "21", "31"]


def view_sql(name: str, ansi: bool) -> str:
    """The SELECT of one view, for Spark (``ansi=False``) or for the checking engine."""

    def vert(n: int) -> str:
        return " || ' ' || ".join(f"CAST(CAST({c}{n} AS BIGINT) AS STRING) || '.0'" for c in "xyz")

    texts = {
        "point": """
            SELECT c_custkey AS id, c_mktsegment AS layer,
                   CAST((c_custkey * 7919) % 10007 + {square} AS DOUBLE) AS x,
                   CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y,
                   CAST(c_custkey % 50 AS DOUBLE) AS z
            FROM customer""".format(square=_square("c_custkey", 1500)),
        "segment": """
            SELECT o_orderkey AS id, o_orderpriority AS layer, o_custkey AS path_id,
                   CAST((o_orderkey * 7919) % 10007 + {square} AS DOUBLE) AS x1,
                   CAST((o_orderkey * 104729) % 10009 AS DOUBLE) AS y1,
                   CAST((o_orderkey * 7919) % 10007 + (o_orderkey * 31) % 401 - 200 + {square} AS DOUBLE) AS x2,
                   CAST((o_orderkey * 104729) % 10009 + (o_orderkey * 17) % 399 - 199 AS DOUBLE) AS y2
            FROM orders""".format(square=_square("o_orderkey", 15000)),
        "vertex": """
            SELECT user_id AS path_id, seq,
                   CAST(user_id * 1000 + (event_id * 37) % 500 AS DOUBLE) AS x,
                   CAST(seq * 10 AS DOUBLE) AS y
            FROM (SELECT user_id, event_id,
                         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq
                  FROM events) e""",
        "chain": """
            SELECT id, layer, path_id,
                   CASE WHEN id % 2 = 1 THEN bx ELSE ax END AS x1, CASE WHEN id % 2 = 1 THEN by_ ELSE ay END AS y1,
                   CASE WHEN id % 2 = 1 THEN ax ELSE bx END AS x2, CASE WHEN id % 2 = 1 THEN ay ELSE by_ END AS y2
            FROM (SELECT event_id AS id, event_type AS layer, user_id AS path_id,
                         CAST(user_id * 1000 + (event_id * 37) % 500 AS DOUBLE) AS ax,
                         CAST(seq * 10 AS DOUBLE) AS ay,
                         CAST(user_id * 1000 + (lead(event_id) OVER w * 37) % 500 AS DOUBLE) AS bx,
                         CAST(seq * 10 + 10 AS DOUBLE) AS by_
                  FROM (SELECT user_id, event_id, event_type, ts,
                               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq
                        FROM events) e
                  WINDOW w AS (PARTITION BY user_id ORDER BY seq)) t
            WHERE bx IS NOT NULL""",
        "box": """
            SELECT p_partkey AS id,
                   CAST((p_partkey * 7919) % 10007 - p_size * 8 + {square} AS DOUBLE) AS min_x,
                   CAST((p_partkey * 104729) % 10009 - p_size * 6 AS DOUBLE) AS min_y,
                   CAST((p_partkey * 7919) % 10007 + p_size * 8 + {square} AS DOUBLE) AS max_x,
                   CAST((p_partkey * 104729) % 10009 + p_size * 6 AS DOUBLE) AS max_y
            FROM part""".format(square=_square("p_partkey", 2000)),
        "curve": """
            SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'circle' ELSE 'arc' END AS kind,
                   CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS cx, CAST((s_suppkey * 104729) % 10009 AS DOUBLE) AS cy,
                   CAST(s_suppkey % 40 + 1 AS DOUBLE) AS r,
                   CAST(s_suppkey % 6 AS DOUBLE) AS a0, CAST((s_suppkey * 5) % 7 AS DOUBLE) AS a1
            FROM supplier""",
        "facet": f"""
            SELECT p_partkey AS mesh_id, p_partkey * 12 + f AS facet_id,
                   CAST(ax * w AS DOUBLE) AS x0, CAST(ay * h AS DOUBLE) AS y0, CAST(az * d AS DOUBLE) AS z0,
                   CAST(bx * w AS DOUBLE) AS x1, CAST(by_ * h AS DOUBLE) AS y1, CAST(bz * d AS DOUBLE) AS z1,
                   CAST(cx * w AS DOUBLE) AS x2, CAST(cy * h AS DOUBLE) AS y2, CAST(cz * d AS DOUBLE) AS z2
            FROM (SELECT p_partkey, p_size + 1 AS w, p_partkey % 13 + 2 AS h, p_partkey % 17 + 3 AS d FROM part) b
            {_rows("t", "f ax ay az bx by_ bz cx cy cz".split(), _BOX_FACETS, ansi)}""",
        "drill_line": f"""
            SELECT 'job' || CAST(o_custkey % 20 AS STRING) AS file, o_orderkey * 2 + k AS line_no,
                   CASE WHEN k = 0 THEN 'T' || CAST(o_custkey % 4 + 1 AS STRING)
                        WHEN o_orderkey % 3 = 0 THEN 'X' || CAST((o_orderkey * 7919) % 10007 AS STRING)
                        ELSE 'X' || CAST((o_orderkey * 7919) % 10007 AS STRING) ||
                             'Y' || CAST((o_orderkey * 104729) % 10009 AS STRING) END AS text
            FROM orders {_ints("t", "k", range(2), ansi)}
            WHERE k = 1 OR o_orderkey % 5 = 0""",
        "dxf_line": f"""
            SELECT 'dwg' || CAST(o_orderkey % 20 AS STRING) AS file, o_orderkey * 18 + p * 2 + half AS line_no,
                   CASE WHEN half = 0 THEN code
                        WHEN p = 0 THEN 'LINE' WHEN p = 1 THEN 'AcDbEntity' WHEN p = 2 THEN o_orderpriority
                        WHEN p = 3 THEN 'AcDbLine'
                        WHEN p = 4 THEN CAST((o_orderkey * 7919) % 10007 AS STRING)
                        WHEN p = 5 THEN CAST((o_orderkey * 104729) % 10009 AS STRING)
                        WHEN p = 6 THEN CAST((o_orderkey * 31) % 401 AS STRING)
                        WHEN p = 7 THEN CAST((o_orderkey * 17) % 399 AS STRING)
                        ELSE '0' END AS text
            FROM orders
            {_rows("t", ["p", "code"], list(enumerate(_DXF_CODES)), ansi)}
            {_ints("u", "half", range(2), ansi)}""",
        "drill_program": f"""
            SELECT DISTINCT 'prog' || CAST(o_orderkey % 50 AS STRING) AS file, CAST(k - 100 AS BIGINT) AS line_no, txt AS text
            FROM orders {_rows("h", ["k", "txt"], list(enumerate(_HEADER)), ansi)}
            UNION ALL
            SELECT 'prog' || CAST(o_orderkey % 50 AS STRING), o_orderkey * 11 + k,
                   CASE k WHEN 0 THEN 'M25' WHEN 1 THEN 'T' || CAST(o_custkey % 4 + 1 AS STRING)
                          WHEN 2 THEN 'X' || CAST(10000 + (o_orderkey * 7919) % 10007 AS STRING) ||
                                      'Y' || CAST(10000 + (o_orderkey * 104729) % 10009 AS STRING)
                          WHEN 3 THEN 'X' || CAST(20000 + (o_orderkey * 31) % 401 AS STRING)
                          WHEN 4 THEN 'M01' WHEN 5 THEN 'M02X50000Y0' WHEN 6 THEN 'M02X0Y70000' WHEN 7 THEN 'M08'
                          WHEN 8 THEN 'G00X10000Y10000' WHEN 9 THEN 'X15000Y15000' ELSE 'G05' END
            FROM orders {_ints("t", "k", range(11), ansi)}""",
        "dxf_header": f"""
            SELECT DISTINCT 'dwg' || CAST(o_orderkey % 20 AS STRING) AS file, CAST(k AS BIGINT) AS line_no,
                   CASE k WHEN -4 THEN '9' WHEN -3 THEN '$ACADVER' WHEN -2 THEN '1'
                          ELSE CASE o_orderkey % 5 WHEN 0 THEN 'AC1015' WHEN 1 THEN 'AC1018' WHEN 2 THEN 'AC1021'
                                                   WHEN 3 THEN 'AC1024' ELSE 'AC1009' END END AS text
            FROM orders {_ints("t", "k", range(-4, 0), ansi)}""",
        "stl_line": f"""
            SELECT 'mesh' || CAST(mesh_id AS STRING) AS file, facet_id * 7 + k AS line_no,
                   CASE k WHEN 0 THEN 'facet normal 0.0 0.0 0.0' WHEN 1 THEN 'outer loop'
                          WHEN 2 THEN 'vertex ' || {vert(0)} WHEN 3 THEN 'vertex ' || {vert(1)}
                          WHEN 4 THEN 'vertex ' || {vert(2)} WHEN 5 THEN 'endloop' ELSE 'endfacet' END AS text
            FROM fx_facet {_ints("t", "k", range(7), ansi)}""",
        "node": """
            SELECT CAST(r_regionkey AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 'plate' AS level,
                   CAST(r_regionkey * 1000 AS DOUBLE) AS off_x, CAST(0 AS DOUBLE) AS off_y,
                   CAST(90 * (r_regionkey % 4) AS DOUBLE) AS rot_deg, CAST(1 AS DOUBLE) AS scale,
                   CAST(2 AS BIGINT) AS num_x, CAST(3 AS BIGINT) AS num_y,
                   CAST(5000 AS DOUBLE) AS pitch_x, CAST(4000 AS DOUBLE) AS pitch_y FROM region
            UNION ALL
            SELECT 100 + n_nationkey, CAST(n_regionkey AS BIGINT), 'device', CAST(n_nationkey * 10 AS DOUBLE), CAST(5 AS DOUBLE),
                   CAST(90 * (n_nationkey % 4) AS DOUBLE), CAST(2 AS DOUBLE), CAST(1 + n_nationkey % 3 AS BIGINT),
                   CAST(1 + n_nationkey % 2 AS BIGINT), CAST(50 AS DOUBLE), CAST(40 AS DOUBLE) FROM nation
            UNION ALL
            SELECT 1000 + s_suppkey, CAST(100 + s_nationkey AS BIGINT), 'layer', CAST(s_suppkey % 7 AS DOUBLE),
                   CAST(s_suppkey % 5 AS DOUBLE), CAST(90 * (s_suppkey % 4) AS DOUBLE), CAST(1 AS DOUBLE),
                   CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM supplier""",
        "pair": """
            SELECT CAST(c_nationkey AS BIGINT) AS grp,
                   CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 89 AS DOUBLE) AS y,
                   CAST(2 * (c_custkey % 97) - c_custkey % 89 + c_nationkey AS DOUBLE) AS mx,
                   CAST(c_custkey % 97 + 3 * (c_custkey % 89) - 5 AS DOUBLE) AS my
            FROM customer""",
        "pixel": """
            SELECT event_id % 100 AS row, CAST(floor(event_id / 100.0) AS BIGINT) AS col, user_id % 16 AS val FROM events""",
        "progress": """
            SELECT user_id AS entity_id, ts,
                   CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'PAUSED' WHEN 'purchase' THEN 'COMPLETED'
                                   WHEN 'signup' THEN 'WAITING' ELSE 'ERROR' END AS state,
                   CASE WHEN value > 100 THEN 100.0 ELSE value END AS progress
            FROM events""",
    }
    return texts[name]


def oracle(query: str, *views: str) -> str:
    """``query`` with the named views in front as common table expressions."""
    need = list(views)
    if "stl_line" in need and "facet" not in need:
        need.insert(0, "facet")
    parts = ",\n".join(f"fx_{v} AS ({view_sql(v, ansi=True)})" for v in need)
    query = query.strip()
    if query.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts},\n{query[len('WITH RECURSIVE'):]}"
    if query.startswith(","):
        return f"WITH {parts}\n{query}"
    if query.upper().startswith("WITH"):
        return f"WITH {parts},\n{query[4:]}"
    return f"WITH {parts}\n{query}"


class Fixtures:
    """The views as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._events = None

    def table(self, name: str) -> DataFrame:
        """One table. A file too small to give every core a task is spread over the cores, since
        the views multiply its rows; a table of many files is read as it is."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if name not in ("region", "nation") and df.rdd.getNumPartitions() * 4 <= cores else df

    def _sql(self, name: str, *tables: str) -> DataFrame:
        for t in tables:
            self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(view_sql(name, ansi=False))

    def _sequenced_events(self) -> DataFrame:
        """Events numbered per user in time order, without a whole user in one task."""
        hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
        if self._events is None:
            events = self.table("events").select("user_id", "event_id", "event_type", "ts")
            numbered = ordered_scan(
                events, ["user_id"], ["ts", "event_id"], hour, index="seq", lead={"next_event": F.col("event_id")}
            )
            self._events = materialize(numbered.drop("ts"), "events")
        return self._events

    def __getattr__(self, name: str) -> DataFrame:
        source = {
            "point": "customer", "segment": "orders", "box": "part", "curve": "supplier", "facet": "part",
            "drill_line": "orders", "dxf_line": "orders", "drill_program": "orders", "dxf_header": "orders",
            "pair": "customer", "pixel": "events", "progress": "events",
        }
        if name in source:
            return self._sql(name, source[name])
        if name == "node":
            return self._sql(name, "region", "nation", "supplier")
        if name == "stl_line":
            self.facet.createOrReplaceTempView("fx_facet")
            return self._sql(name)
        if name == "vertex":
            e = self._sequenced_events()
            return e.select(
                F.col("user_id").alias("path_id"),
                "seq",
                (F.col("user_id") * 1000 + (F.col("event_id") * 37) % 500).cast("double").alias("x"),
                (F.col("seq") * 10).cast("double").alias("y"),
            )
        if name == "chain":
            e = self._sequenced_events().filter("next_event IS NOT NULL")
            a = (F.col("user_id") * 1000 + (F.col("event_id") * 37) % 500).cast("double")
            b = (F.col("user_id") * 1000 + (F.col("next_event") * 37) % 500).cast("double")
            ay, by = (F.col("seq") * 10).cast("double"), (F.col("seq") * 10 + 10).cast("double")
            odd = F.col("event_id") % 2 == 1
            return e.select(
                F.col("event_id").alias("id"),
                F.col("event_type").alias("layer"),
                F.col("user_id").alias("path_id"),
                F.when(odd, b).otherwise(a).alias("x1"),
                F.when(odd, by).otherwise(ay).alias("y1"),
                F.when(odd, a).otherwise(b).alias("x2"),
                F.when(odd, ay).otherwise(by).alias("y2"),
            )
        raise AttributeError(name)
