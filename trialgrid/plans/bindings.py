"""Views that bind the operators to tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # one row per run
    "v_rec": """
SELECT o_orderkey AS run_key,
       concat('m', cast(c_nationkey % 17 AS varchar(9))) AS model,
       CASE c_custkey % 3 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'static' ELSE 'vehicle' END AS category,
       o_orderpriority AS scenario, cast(o_custkey % 5 AS varchar(9)) AS route_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'visual_shift' ELSE 'geometric_shift' END AS level,
       concat('p', cast(cast(floor(o_orderkey / 3.0) AS bigint) % 3 AS varchar(9))) AS variant,
       42 + cast(floor(o_orderkey / 9.0) AS bigint) % 3 AS seed,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice / cast(5000 AS double) END AS driving_score,
       CASE WHEN o_orderstatus = 'P' THEN 'Perfect' WHEN o_orderstatus = 'F' THEN 'Completed'
            WHEN o_orderkey % 5 = 0 THEN 'Failed' WHEN o_orderkey % 5 = 1 THEN 'Failed - TickRuntime'
            WHEN o_orderkey % 5 = 2 THEN 'Failed - Agent got blocked' WHEN o_orderkey % 5 = 3 THEN 'Failed - Agent crashed'
            ELSE 'Failed - Simulation crashed' END AS status,
       cast(100 + o_custkey % 900 AS double) AS route_length,
       cast(o_orderkey % 300 AS double) AS duration_game
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # one row per logged message of a run
    "v_inf": """
SELECT l_orderkey AS run_key, l_linenumber AS line, l_extendedprice AS price,
       CASE WHEN l_quantity < 25 THEN 'min_speed_infractions' WHEN l_returnflag = 'A' THEN 'collisions_vehicle'
            WHEN l_returnflag = 'N' THEN 'collisions_pedestrian' ELSE 'red_light' END AS kind,
       concat('hit type=vehicle.b', cast(l_partkey % 5 AS varchar(9)), ' and id=', cast(l_linenumber AS varchar(9))) AS message
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "v_type": """
SELECT r.*, CASE WHEN run_key % 4 = 0 THEN NULL WHEN run_key % 101 = 0 THEN 'unknown'
                 WHEN category = 'static' AND variant = 'p1' AND run_key % 7 = 0 THEN 'vehicle.b4'
                 ELSE concat('vehicle.b', substr(variant, 2, 1)) END AS agent_type
FROM {v_rec} r""",
    # one row per tick of a run, 20 Hz
    "v_tel": """
SELECT l_suppkey AS run_id, frame,
       CASE WHEN frame % 120 < 60 THEN cast(12 AS double) - cast(0.1 AS double) * (frame % 60) ELSE cast(6 AS double) + cast(0.1 AS double) * (frame % 60) END AS ego_velocity,
       cast(60 AS double) - cast(0.5 AS double) * (frame % 110) AS distance, l_discount * 20 AS lateral_offset,
       cast(floor(frame / 75.0) AS bigint) % 2 AS lane_id,
       CASE WHEN l_suppkey % 5 = 0 THEN 400 ELSE NULL END AS collision_frame
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame FROM {lineitem}) t""",
    # one row per attempt at a route
    "v_att": """
SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt_no, event_id % 4 AS worker,
       CASE event_type WHEN 'signup' THEN 'NEVER_STARTED' WHEN 'error' THEN 'ABNORMAL_END' WHEN 'purchase' THEN 'TORN_DOWN' ELSE 'CLEAN_EXIT' END AS outcome_class,
       CASE event_id % 6 WHEN 0 THEN 'NO_FINAL_RECORD' WHEN 1 THEN 'ACCEPT' WHEN 2 THEN 'RETRY_RECORD' WHEN 3 THEN 'RETRY_TICKRUNTIME' WHEN 4 THEN 'FATAL' ELSE 'UNKNOWN' END AS on_disk_case
FROM {events}""",
    # one row per item with sizes in metres
    "v_dim": """
SELECT p_partkey AS item, p_brand AS brand, cast(3 AS double) + p_size * cast(0.08 AS double) AS l,
       cast(1.5 AS double) + (p_partkey % 17) * cast(0.06 AS double) AS w, cast(1.2 AS double) + (p_partkey % 11) * cast(0.12 AS double) AS h,
       CASE WHEN p_size % 3 = 0 THEN 'visual_shift' ELSE 'geometric_shift' END AS declared
FROM {part}""",
    # one row per planned route
    "v_man": """
SELECT category, scenario, route_id, level, variant, concat(category, '/', scenario, '/', level, '/route_', route_id, '_', variant, '.xml') AS path,
       concat('vehicle.b', substr(variant, 2, 1)) AS blueprint
FROM (SELECT DISTINCT category, scenario, route_id, level, variant FROM {v_rec}) d
WHERE (ascii(scenario) + cast(route_id AS int) * 7 + cast(substr(variant, 2, 1) AS int) * 3) % 11 <> 0
UNION ALL SELECT 'static', 'extra', '9', 'base', 'p0', 'static/extra/base/route_9_p0.xml', 'vehicle.b0'""",
    "v_ledger": """
SELECT task, cast(count(*) FILTER (WHERE on_disk_case = 'RETRY_RECORD') AS bigint) AS attempts_record,
       cast(count(*) FILTER (WHERE on_disk_case = 'RETRY_TICKRUNTIME') % 2 AS bigint) AS attempts_tickruntime,
       cast(count(*) FILTER (WHERE outcome_class = 'NEVER_STARTED') % 4 AS bigint) AS attempts_infra,
       cast(count(*) FILTER (WHERE outcome_class = 'ABNORMAL_END') % 3 AS bigint) AS attempts_killed,
       task % 3 = 0 AS finished
FROM {v_att} GROUP BY task""",
}

#: Views whose windows run within a key of a table: the table and the key. Its rows are dealt by the key, so that later windows, joins and counts by it need no other shuffle.
DEALT = {"v_tel": ("lineitem", "l_suppkey"), "v_att": ("events", "user_id")}
#: Rows of a partition that is sorted, at most, where keys are small: what one task holds doesn't grow with the table.
PART_ROWS = 500_000

_name = re.compile(r"\{(\w+)\}")


def duckdb_with(*names: str) -> str:
    """A WITH clause that defines the views and those they need, over tables of their own names."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for other in _name.findall(VIEWS[name]):
                need(other)
            order.append(name)

    for name in names:
        need(name)
    body = ",\n".join(f"{n} AS ({_name.sub(lambda m: m[1], VIEWS[n])})" for n in order)
    return f"WITH RECURSIVE {body}\n" if body else ""


class Bound:
    """Tables and views of a data folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._known[name] = self.spark.sql(VIEWS[name], **{n: self._dealt(name, n) for n in set(_name.findall(VIEWS[name]))})
        return self._known[name]

    def _dealt(self, view: str, table: str) -> DataFrame:
        if DEALT.get(view, ("", ""))[0] != table:
            return getattr(self, table)
        return getattr(self, table).repartition(self.parts(table), DEALT[view][1])

    def parts(self, table: str) -> int:
        """How many partitions a table's rows fill; those of spark.sql.shuffle.partitions at least."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-getattr(self, table).count() // PART_ROWS))

    def state_parts(self, table: str) -> int:
        """How many parts of a stream's state a table's rows fill, one a core at least: a part is a task in each batch, however few its rows."""
        return max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, table).count() // PART_ROWS))

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """SQL over named frames."""
        return self.spark.sql(text, **frames)


class Catalog:
    """Queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, Callable[[], str]] = {}

    def query(self, name: str, sql: str | None = None, views: str = ""):
        def put(f: Callable[[Bound], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
            if sql is not None:
                self.sql[name] = lambda: joined(duckdb_with(*views.split()), sql)
            return f

        return put


def joined(with_clause: str, sql: str) -> str:
    """The query behind a WITH clause; its own leading WITH is merged."""
    text = sql.strip()
    if with_clause and text.upper().startswith("WITH "):
        return with_clause.rstrip() + ",\n" + re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", text, flags=re.I)
    return with_clause + text
