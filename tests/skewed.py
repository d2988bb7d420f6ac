"""A copy of the tables in which a third of the rows share one key."""

import os
import shutil

import duckdb

from twins import TABLES


def skewed_copy(sf_dir: str, target: str) -> str:
    """One order, part and customer take a third of the lines; one user, type and minute a third of the events."""
    os.makedirs(target, exist_ok=True)
    changes = {
        "lineitem": "SELECT * REPLACE (CASE WHEN hot THEN 1 ELSE l_orderkey END AS l_orderkey, "
        "CASE WHEN hot THEN 1 ELSE l_partkey END AS l_partkey) FROM "
        "(SELECT *, (l_orderkey * 7 + l_linenumber) % 3 = 0 AS hot FROM src)",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey) FROM src",
        "events": "SELECT * REPLACE (CASE WHEN hot THEN 7 ELSE user_id END AS user_id, "
        "CASE WHEN hot THEN 'view' ELSE event_type END AS event_type, "
        "CASE WHEN hot THEN TIMESTAMP '2024-01-05 12:00:30' ELSE ts END AS ts) FROM "
        "(SELECT *, event_id % 3 = 0 AS hot FROM src)",
    }
    con = duckdb.connect()
    for name in TABLES:
        source, out = f"{sf_dir}/{name}.parquet", f"{target}/{name}.parquet"
        if name not in changes:
            shutil.copyfile(source, out)
            continue
        sql = changes[name].replace("src", f"read_parquet('{source}')")
        drop = "EXCLUDE (hot)" if "hot" in sql else ""
        con.execute(f"COPY (SELECT * {drop} FROM ({sql})) TO '{out}' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    return target
