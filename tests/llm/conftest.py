import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def make(rows, extra=()):
        full = [(r[0], r[1], *(r[2:] or ("en", f"src{(r[0] or 0) % 3}")), len(r[1] or "")) for r in rows]
        out = spark.createDataFrame(full, SCHEMA)
        for name in extra:
            from pyspark.sql import functions as F
            out = out.withColumn(name, F.lit("mine"))
        return out

    return make


@pytest.fixture(scope="session")
def sql_rows():
    """Result of a DuckDB query over named tables given as Spark DataFrames, as sorted tuples by column name."""
    def run(sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        order = [names.index(c) for c in sorted(names)]
        return sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)

    return run


@pytest.fixture(scope="session")
def rows_of():
    def run(df):
        return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)

    return run
