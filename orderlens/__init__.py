"""orderlens: order analytics as Spark DataFrame operators.

Every operator is a pure function from DataFrames to a DataFrame built from
Spark's own expressions.  Relative dates take an explicit ``ref_date``; when it
is omitted the data anchor (latest non-cancelled order date) is used, computed
inside the plan as a scalar subquery.
"""

from orderlens.session import get_spark, checkpoint_dir  # noqa: F401
from orderlens.sources.adapter import Tables, load_test_tables  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "Tables", "load_test_tables"]
