"""Comparison of a Spark result and a DuckDB result as bags of rows."""


def rows(frame):
    clean = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(map(str, r)) for r in clean[sorted(frame.columns)].itertuples(index=False))


def same(spark_frame, duck_frame):
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    a, b = rows(spark_frame), rows(duck_frame)
    assert len(a) == len(b)
    assert a == b
