"""Comparing tables."""


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple(str(x) for x in r))


def same(got, expected):
    assert got == sorted(expected, key=lambda r: tuple(str(x) for x in r))
