"""Round every DOUBLE column of the DuckDB oracles to 6 places.

The Spark queries report doubles rounded to 6 places (``registry.finalize``);
the oracle must do the same on its side.  Output types are found with
DuckDB ``DESCRIBE`` against empty tables that have the driver-table
schemas, so no data is read.
"""

from __future__ import annotations

# schemas of the driver tables the oracles read
_SCHEMAS = {
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INTEGER",
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, "
                 "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                 "l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP"),
}
_CACHE: dict[str, str] = {}


def rounded(raw: dict[str, str], digits: int = 6) -> dict[str, str]:
    try:
        import duckdb
    except ImportError:  # pragma: no cover - oracle tooling absent
        return dict(raw)
    con = duckdb.connect()
    for t, cols in _SCHEMAS.items():
        con.execute(f"CREATE TABLE {t} ({cols})")
    out = {}
    for name, sql in raw.items():
        key = f"{digits}\0{sql}"
        if key not in _CACHE:
            try:
                desc = con.execute(f"DESCRIBE {sql}").fetchall()
                dbl = [row[0] for row in desc if row[1] in ("DOUBLE", "FLOAT")]
            except Exception:  # noqa: BLE001 - leave the query as written
                dbl = []
            if dbl:
                rep = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in dbl)
                _CACHE[key] = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS oracle_q"
            else:
                _CACHE[key] = sql
        out[name] = _CACHE[key]
    con.close()
    return out
