"""Queries against their SQL on tables with values that the given ones lack."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from arrayloom.operators import views
from arrayloom.plans import catalog


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query and of its SQL over ``tables`` (name -> (rows, schema)), both as text in order."""

    def run(name: str, **tables):
        duck = duckdb.connect()
        for t, (rows, schema) in tables.items():
            at = str(tmp_path / f"{t}.parquet")
            spark.createDataFrame(rows, schema).write.parquet(at)
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/*.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        return sorted(map(str, got)), sorted(map(str, want))

    return run


def events_of(values):
    return [(k, v) for k, v in enumerate(values)], "event_id bigint, value double"


def test_classes_of_missing_values(against_sql):
    got, want = against_sql("fp_classify", events=events_of([None] * 5 + [0.0] * 5 + [2.5] * 5 + [5e-324] * 5))
    assert got == want


def test_powers_beyond_four_decimals_and_missing_values(against_sql):
    """2 ** 40.6 and 2 ** 47.6 have fewer than four decimals as doubles; the SQL rounds their product with 10000."""
    got, want = against_sql("logarithms_and_powers", events=events_of([None, None, 406.6, 0.0, 0.0, 476.4, 0.5, 5e-324]))
    assert got == want


def test_printed_lines_stay_where_their_values_are(against_sql, monkeypatch):
    """No collecting of the vector while the query is built; missing values and places are left out."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows, schema = events_of([0.004, None, 12.34, 9999.99, -5.0] * 5 + [None] * 10 + [1.0] * 3)
    tables = {"events": ([(*r, "a", 0) for r in rows if r[0] != 7], schema + ", event_type string, user_id bigint")}
    plan = catalog.queries()["vector_printed"]

    def planned(*args):
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "collect", lambda self: pytest.fail("rows were collected"))
            return plan(*args)

    monkeypatch.setitem(catalog.queries(), "vector_printed", planned)
    got, want = against_sql("vector_printed", **tables)
    assert got == want


def test_parts_of_a_product_grow_in_number_not_in_size(spark, monkeypatch):
    from arrayloom.operators import sparse
    from arrayloom.plans import q_linalg

    monkeypatch.setattr(sparse, "PART", 100, raising=False)
    at = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{at}/lineitem.parquet").count()
    sizes = q_linalg.matrix(spark, at).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == -(-n // 100) and max(sizes) < 1000


@pytest.mark.parametrize("a_source, b_source", [([1, 0], [1, 2]), ([0], [2, 0]), ([2], [0]), ([0, 1, 2], [1])])
def test_shapes_meet_as_if_replicated(spark, a_source, b_source):
    dims = [2, 3, 4]
    a, b = (spark.range(math.prod(dims[k] for k in s)).select(F.col("id").alias("idx"), (F.col("id") * 7 % 5).alias(c)) for s, c in ((a_source, "x"), (b_source, "y")))
    want = views.reshaped(a, dims, a_source).join(views.reshaped(b, dims, b_source), "idx").collect()
    got = views.met(a, a_source, b, b_source, dims)
    assert sorted(got.collect()) == sorted(want) and len(want) == 24


def test_product_by_three_axes_makes_no_replicas_before_the_join(spark):
    plan = catalog.queries()["matmul_reshape"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and plan.count("Join") == 1  # the embeddings' own elements, once a factor
