"""Views that derive the inputs of the counting operators from the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    # objects in zones of 20, cameras in front of them, and what each camera sees of each object
    "bars": """SELECT CAST(s_suppkey AS BIGINT) AS bar_id, CAST(FLOOR(s_suppkey / 20) AS BIGINT) AS zone_id,
        (s_suppkey * 7 % 41) * 0.06e0 + FLOOR(s_suppkey / 20) * 4.0e0 AS x, (s_suppkey * 11 % 43) * 0.06e0 AS y, 0.0e0 AS z FROM {supplier}""",
    "cams": """SELECT CAST(n_nationkey AS BIGINT) AS frame_id, CAST(n_nationkey AS BIGINT) AS seq, ((n_nationkey % 5) - 2) * 0.5e0 AS tx, (FLOOR(n_nationkey / 5) - 2) * 0.4e0 AS ty, 3.0e0 AS tz,
        0.0e0 AS fx, 0.0e0 AS fy, -1.0e0 AS fz FROM {nation}""",
    "obs": """SELECT b.zone_id, c.frame_id, b.bar_id AS det_id, 0.6e0 + ((b.bar_id * 3 + c.frame_id * 7) % 40) / 100.0e0 AS conf,
        4.0e0 * b.zone_id + 1.2e0 + c.tx AS ox, 1.3e0 + c.ty AS oy, c.tz AS oz,
        CAST(FLOOR(800.0e0 * ((b.x - (4.0e0 * b.zone_id + 1.2e0 + c.tx)) / (-3.0e0)) + 320.0e0) AS INT) AS px,
        CAST(FLOOR(800.0e0 * ((b.y - (1.3e0 + c.ty)) / (-3.0e0)) + 240.0e0) AS INT) AS py
        FROM {bars} b CROSS JOIN {cams} c WHERE (b.bar_id + c.frame_id) % 4 <> 0""",
    "zones": """SELECT zone_id, 4.0e0 * zone_id + 1.2e0 AS cx, 1.3e0 AS cy, 0.0e0 AS cz, MIN(x) - 0.3e0 AS minx, MAX(x) + 0.3e0 AS maxx, MIN(y) - 0.3e0 AS miny, MAX(y) + 0.3e0 AS maxy,
        MIN(z) - 0.3e0 AS minz, MAX(z) + 0.3e0 AS maxz FROM {bars} GROUP BY zone_id""",
    # frames of sessions, with the measurements that the quality gate reads
    "frames": """SELECT CAST(user_id AS BIGINT) AS session_id, CAST(event_id AS BIGINT) AS frame_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value AS luma_std, (event_id * 37 % 100) / 100.0e0 AS dark,
        (event_id * 53 % 100) / 100.0e0 AS bright, value * 4.0e0 AS lap, (event_id % 7) * 0.01e0 AS tx, (event_id % 5) * 0.01e0 AS ty, 0.0e0 AS tz,
        0.0e0 AS qx, SIN(RADIANS((event_id % 12) / 2.0e0)) AS qy, 0.0e0 AS qz, COS(RADIANS((event_id % 12) / 2.0e0)) AS qw FROM {events}""",
    "requests": """SELECT CAST(user_id AS BIGINT) AS session_id, CAST(event_id AS BIGINT) AS request_id, CAST(event_id % 7 AS BIGINT) AS zone_id, CAST(ts AS TIMESTAMP) AS ts,
        CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'DELETE' END AS state FROM {events}""",
    # detections of images, and the true boxes
    "numbered": """SELECT *, CAST(FLOOR(l_orderkey / 32) AS BIGINT) AS image_id,
        CAST(ROW_NUMBER() OVER (PARTITION BY FLOOR(l_orderkey / 32) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS det FROM {lineitem}""",
    "boxes": """SELECT image_id, det, CAST(l_partkey % 640 AS DOUBLE) AS "left", CAST(l_suppkey * 37 % 480 AS DOUBLE) AS top,
        CAST(l_partkey % 640 + 8 + l_quantity AS DOUBLE) AS "right", CAST(l_suppkey * 37 % 480 + 8 + 7 * l_linenumber AS DOUBLE) AS bottom, CAST(l_discount * 10 AS DOUBLE) AS score FROM {numbered}""",
    "truth": """SELECT image_id, det, CAST(l_partkey % 640 + l_linenumber % 3 AS DOUBLE) AS "left", CAST(l_suppkey * 37 % 480 + l_linenumber % 3 AS DOUBLE) AS top,
        CAST(l_partkey % 640 + 8 + l_quantity + l_linenumber % 3 AS DOUBLE) AS "right", CAST(l_suppkey * 37 % 480 + 8 + 7 * l_linenumber + l_linenumber % 3 AS DOUBLE) AS bottom FROM {numbered} WHERE l_returnflag <> 'R'""",
    "images": """SELECT CAST(o_orderkey AS BIGINT) AS id, 640 AS width, 480 AS height, 'img_' || CAST(o_orderkey AS VARCHAR(20)) || '.png' AS file_name FROM {orders}""",
    "annotations": """SELECT CAST(l_orderkey AS BIGINT) AS image_id, CAST(det AS BIGINT) AS ann, l_returnflag AS category, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS iscrowd,
        CAST(l_partkey % 640 AS DOUBLE) AS x, CAST(l_suppkey * 37 % 480 AS DOUBLE) AS y, CAST(8 + l_quantity AS DOUBLE) AS w, CAST(8 + 7 * l_linenumber AS DOUBLE) AS h, l_linenumber FROM {numbered}""",
    # points in space with their labels, and the zones that the labels' means make
    "points": """SELECT CAST(vec_id AS BIGINT) AS point_id, CAST(label AS BIGINT) AS label, {e1} + (label % 5) * 0.5e0 AS x, {e2} + FLOOR(label / 5) * 0.5e0 AS y, CAST({e3} AS DOUBLE) AS z,
        LEAST(1.0e0, 0.5e0 + ABS({e7})) AS conf FROM {embeddings} WHERE label IS NOT NULL""",
    "point_zones": """SELECT label AS zone_id, ROUND(AVG(x), 6) AS cx, ROUND(AVG(y), 6) AS cy, ROUND(AVG(z), 6) AS cz FROM {points} GROUP BY label""",
    # grey images of 16 x 16
    "pixels": """SELECT CAST(p_partkey AS BIGINT) AS image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST((p_size * 7 + x * 13 + y * 29 + x * y) % 256 AS INT) AS luma
        FROM {part} CROSS JOIN (SELECT CAST(n_nationkey AS INT) AS x FROM {nation} WHERE n_nationkey < 16) a CROSS JOIN (SELECT CAST(n_nationkey AS INT) AS y FROM {nation} WHERE n_nationkey < 16) b""",
}


def _needs(name: str) -> list[str]:
    return [x for x in dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])) if x in VIEWS or x in TABLES]


def view(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, str] = {}) -> DataFrame:
    """A table or derived view as a DataFrame. Tables of which a view makes many rows of each may be dealt to tasks by a key first, however few files and row groups they come in."""
    if name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return table.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt[name]) if name in dealt else table
    elements = {f"e{i}": f"CAST(element_at(embedding, {i}) AS DOUBLE)" for i in (1, 2, 3, 7)}
    text = VIEWS[name].replace('"', "`").replace("VARCHAR(20)", "STRING")
    for k, e in elements.items():
        text = text.replace("{" + k + "}", e)
    return spark.sql(text, **{x: view(spark, sf_dir, x, dealt) for x in _needs(name)})


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: body with the named views, and those they need, before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for x in _needs(name):
                visit(x)
            order.append(name)

    for name in names.split():
        visit(name)
    elements = {f"e{i}": f"CAST(embedding[{i}] AS DOUBLE)" for i in (1, 2, 3, 7)}
    parts = []
    for name in order:
        text = VIEWS[name]
        for k, e in elements.items():
            text = text.replace("{" + k + "}", e)
        parts.append(f"{name} AS (" + re.sub(r"\{(\w+)\}", r"\1", text) + ")")
    return "WITH " + ",\n".join(parts) + ("," if body.lstrip().startswith(",") is False and re.match(r"\s*\w+ AS \(", body) else "") + "\n" + body
