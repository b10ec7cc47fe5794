"""Run registered queries next to their SQL oracles and report differences.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from catalog import registry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
_FAMILY = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=0, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def difference(df, connection, sql: str) -> str | None:
    """None when rows and schema agree, else a short description."""
    names = sorted(df.columns)
    cursor = connection.execute(sql)
    described = {c[0]: str(c[1]) for c in cursor.description}
    if sorted(described) != names:
        return f"columns {names} vs {sorted(described)}"
    types = dict(df.dtypes)
    for name in names:
        if _FAMILY.get(types[name], types[name]) != described[name]:
            return f"type of {name}: {types[name]} vs {described[name]}"
    at = [list(described).index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=_key)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    if len(want) != len(got):
        return f"rows {len(got)} vs {len(want)}"
    for g, w in zip(got, want, strict=True):
        if not all(_same(x, y) for x, y in zip(g, w, strict=True)):
            return f"first difference {g!r:.300} vs {w!r:.300}"
    return None if got else "EMPTY"


def main() -> None:
    from casequeue.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("compare", 8)
    connection = connect(sf_dir)
    oracles = registry.oracles()
    bad = 0
    for name, build in registry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            if name in oracles:
                note = difference(build(spark, sf_dir), connection, oracles[name])
            else:
                note = f"no oracle, rows {build(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            note = f"ERROR {str(error)[:600]}"
        bad += note is not None
        print(f"{name:36s} {time.time() - started:6.2f}s {note or 'ok'}", flush=True)
    print("not ok:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
