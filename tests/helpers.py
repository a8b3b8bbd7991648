"""What several test modules share."""

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    """Rows of a Spark or DuckDB result, columns by name, in a comparable order."""
    if hasattr(df, "collect"):
        names, data = df.columns, [tuple(r) for r in df.collect()]
    else:
        names, data = df.columns, df.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: v if v is None or isinstance(v, (bool, str)) else (float(v) if isinstance(v, float) or "Decimal" in type(v).__name__ else v)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)
