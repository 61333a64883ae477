"""Skew: one customer holds a third of all orders and one product a third of all lines.
The skew-sensitive operators must still equal their SQL oracles."""

import tempfile

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of
from tools.make_skewed import main as make_skewed

NAMES = ["R2_rfm_scores", "R3_rfv_test_scores", "W1_purchase_gaps", "R9b_value_box", "B3_ticket_box_by_segment",
         "H4_generate_shares", "L1_order_numbers", "L8_duplicate_candidates", "PR3_margin_ranking", "N1_item_keys"]


@pytest.fixture(scope="module")
def skewed():
    d = tempfile.mkdtemp(prefix="skew-", dir="/tmp")
    make_skewed("/root/testdata/sf0.001", d)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return d, con


@pytest.mark.parametrize("name", NAMES)
def test_skewed_matches_oracle(spark, skewed, name):
    d, con = skewed
    sdf = E.queries()[name](spark, d)
    res = con.sql(E.oracle_sql()[name])
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(res.columns, res.fetchall())
