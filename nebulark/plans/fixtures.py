"""Catalogues derived from the relational tables by integer hashing, one text for every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

D = "CAST({} AS DOUBLE)".format


def _unit(number: str, mod: int) -> str:
    return f"CAST(({number}) % {mod} AS DOUBLE)/CAST({mod} AS DOUBLE)"


VIEWS = {
    "halos": (
        "orders",
        {
            "id": "o_orderkey",
            "x": _unit("o_orderkey*48271 + 11", 65537),
            "y": _unit("o_orderkey*69621 + o_custkey*7919 + 5", 65521),
            "z": _unit("o_orderkey*16807 + o_custkey*104729 + 3", 65519),
            "vx": "CAST((o_orderkey*31 + 7) % 2001 - 1000 AS DOUBLE)",
            "vy": "CAST((o_orderkey*37 + 11) % 2001 - 1000 AS DOUBLE)",
            "vz": "CAST((o_orderkey*41 + 13) % 2001 - 1000 AS DOUBLE)",
            "pot": "-CAST((o_orderkey*53 + 29) % 1000 AS DOUBLE)/CAST(100000000 AS DOUBLE)",
            "mvir": "o_totalprice",
            "child_level": "CAST(substr(o_orderpriority,1,1) AS INT) - 1",
        },
    ),
    "tracers": (
        "events",
        {
            "id": "event_id",
            "x": _unit("event_id*40014 + user_id*613 + 17", 65521),
            "y": _unit("event_id*40692 + user_id*2741 + 19", 65537),
            "z": _unit("event_id*53668 + user_id*9973 + 23", 65519),
            "mass": "value",
            "species": "event_type",
        },
    ),
    "particles": (
        "lineitem",
        {
            "x": _unit("l_orderkey*7919 + l_partkey*104729 + 31", 65537),
            "y": _unit("l_orderkey*6841 + l_partkey*10007 + l_suppkey*613 + 37", 65521),
            "z": _unit("l_orderkey*4561 + l_partkey*30011 + l_linenumber*8191 + 41", 65519),
            "vx": "(l_discount - CAST(0.05 AS DOUBLE))",
            "vy": "(l_tax - CAST(0.04 AS DOUBLE))",
            "vz": "CAST(l_linenumber - 4 AS DOUBLE)",
            "mass": "l_quantity",
            "pot": "l_extendedprice",
        },
    ),
    "random_catalog": (
        "orders",
        {
            "id": "o_orderkey",
            "x": _unit("o_orderkey*45991 + 101", 64997),
            "y": _unit("o_orderkey*12347 + o_custkey*51407 + 103", 65003),
            "z": _unit("o_orderkey*33391 + o_custkey*27103 + 107", 65011),
        },
    ),
    "vectors": ("embeddings", {"id": "vec_id", "embedding": "embedding", "label": "label"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def view_sql(*names: str) -> str:
    """Common table expressions of the views, for an oracle query."""
    return ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in VIEWS[n][1].items())} FROM {VIEWS[n][0]})" for n in names)
