"""Rows of any engine in one form."""


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    return repr(int(v)) if hasattr(v, "__index__") else str(v)


def rows_of(columns, rows):
    o = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in o) for r in rows)
