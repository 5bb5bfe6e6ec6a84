"""What tests share."""

def rows(df, *columns):
    """Sorted rows, doubles rounded, for order-free comparison."""
    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v
    picked = df.select(*columns) if columns else df
    return sorted((tuple(norm(v) for v in r) for r in picked.collect()), key=repr)
