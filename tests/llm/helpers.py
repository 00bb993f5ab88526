"""Rows of frames in an order that holds with nulls."""


def rows_of(df, *columns):
    """All rows as tuples, sorted with nulls first."""
    return ordered(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
