"""What several test files read from a result."""


def column(df, name, symbol="A", order="date"):
    return [r[name] for r in df.where(df.symbol == symbol).orderBy(order).collect()]
