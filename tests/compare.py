"""Run a registered query and its SQL check and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb

KINDS = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double",
    "VARCHAR": "string", "BOOLEAN": "boolean",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty if names, types and rows agree."""
    found = []
    result = con.execute(sql)
    expected_types = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    types = dict(spark_df.dtypes)
    if types != expected_types:
        found.append(f"types {types} != {expected_types}")
        if set(types) != set(expected_types):
            return found
    names = sorted(types)
    at = [[d[0] for d in result.description].index(n) for n in names]
    expected = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    actual = sorted((tuple(r) for r in spark_df.select(*names).collect()), key=repr)
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows, expected {len(expected)}")
    missing = set(expected) - set(actual)
    extra = set(actual) - set(expected)
    if missing or extra:
        found.append(f"{len(missing)} missing {sorted(missing, key=repr)[:3]}, {len(extra)} extra {sorted(extra, key=repr)[:3]} ({names})")
    elif actual != expected:
        found.append("row multiplicities differ")
    return found
