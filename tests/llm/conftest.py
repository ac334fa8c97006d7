import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """Build a DataFrame from rows and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def oracle():
    """Rows of a DuckDB query over the small tables, or over given frames."""
    import duckdb

    def run(sql, **tables):
        con = duckdb.connect()
        for name in os.listdir(SF):
            if name.removesuffix(".parquet") not in tables:
                con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
        for name, df in tables.items():
            con.register(name, df.toArrow())
        result = con.execute(sql)
        return [d[0] for d in result.description], result.fetchall()

    return run


def ordered(rows):
    return sorted(rows, key=repr)
