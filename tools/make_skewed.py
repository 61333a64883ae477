"""Write a skewed copy of a test-table folder for correctness checks under skew.

Usage: python tools/make_skewed.py <src sf dir> <dst dir>

One customer receives a third of all orders (every order whose key is a
multiple of 3) and one product a third of all lines; all other tables are
copied unchanged.  The registered queries and their oracles then run on the
copy (tools/check_oracle.py <dst dir>).
"""

from __future__ import annotations

import os
import shutil
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def main(src: str, dst: str) -> None:
    os.makedirs(dst, exist_ok=True)
    con = duckdb.connect()
    for t in TABLES:
        if t == "orders":
            con.execute(f"""COPY (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey,
                                         o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
                                  FROM read_parquet('{src}/orders.parquet'))
                            TO '{dst}/orders.parquet' (FORMAT PARQUET)""")
        elif t == "lineitem":
            con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS l_partkey)
                                  FROM read_parquet('{src}/lineitem.parquet'))
                            TO '{dst}/lineitem.parquet' (FORMAT PARQUET)""")
        else:
            shutil.copy(f"{src}/{t}.parquet", f"{dst}/{t}.parquet")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
