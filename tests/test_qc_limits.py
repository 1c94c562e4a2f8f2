"""Values that sit exactly on a robust limit are judged as the SQL judges them, to the last bit."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tandem.plans.queries import ORACLES, QUERIES

#: Taxes (hundredths) of the items of a part.  Of the first and second the greatest lies on the limit, above and below by rounding.
PARTS = ([0, 1, 1, 3, 3, 3, 3, 4, 4, 6, 6, 6], [0, 0, 0, 2, 3, 3, 3, 3, 3, 5, 5, 6], [0, 0, 0, 2, 2, 3, 3, 3, 3, 5, 5, 6], [2] * 12, [1, 2, 3])


@pytest.mark.parametrize("name", ["qc_outliers", "qc_split_counts"])
def test_values_on_a_limit(spark, tmp_path, name):
    rows = [(i, p, t / 100) for p, taxes in enumerate(PARTS) for i, t in enumerate(taxes)]
    n = len(rows)
    table = {
        "l_orderkey": [r[0] for r in rows], "l_partkey": [r[1] for r in rows], "l_suppkey": [0] * n, "l_linenumber": pa.array([1] * n, pa.int32()), "l_quantity": [5.0] * n,
        "l_discount": [0.04] * n, "l_tax": [r[2] for r in rows], "l_returnflag": ["N"] * n,
    }
    pq.write_table(pa.table(table), tmp_path / "lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = c.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect())) == sorted(want.fetchall())
