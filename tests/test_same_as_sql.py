"""Values at which a query once differed from its SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarn.plans import catalog

ODD = [-1e-9, 1e-9, -0.0, 0.0, 0.18, 0.29, -0.29, -2.91, 2.9099998, -3e-8, 3e-8, -6e-8, 0.49999997, 1.0, -1.0, 0.5]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Vectors of elements that are tiny, negative or just below a hundredth; balances without a whole unit and with many."""
    d = tmp_path_factory.mktemp("odd")
    rng = np.random.default_rng(1)
    rows = [ODD, ODD[::-1]] + [(rng.integers(-300, 300, 16) / 100).tolist() for _ in range(200)]
    pq.write_table(pa.table({"vec_id": range(len(rows)), "label": [i % 3 for i in range(len(rows))], "embedding": pa.array(rows, pa.list_(pa.float32()))}), d / "embeddings.parquet")
    money = [0.29, -0.79, 0.0, -0.004, 9.5, -999.99, 1000.0, -123456.78, 1234567.89, -12345678.9, None]
    pq.write_table(pa.table({"c_custkey": range(len(money)), "c_acctbal": money}), d / "customer.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["format_to_char_number", "json_elements", "vec_half_values", "vec_normalize", "vec_slice", "vec_avg_by_label"])
def test_odd_values(spark, odd, name):
    df = catalog.QUERIES[name](spark, odd)
    con = duckdb.connect()
    for t in ("embeddings", "customer"):
        con.execute(f"create view {t} as select * from '{odd}/{t}.parquet'")
    told = con.sql(catalog.ORACLES[name]).project(", ".join(f'"{c}"' for c in df.columns)).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, told))
