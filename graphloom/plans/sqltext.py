"""Pieces of DuckDB SQL that several queries share."""

QUERIES: dict = {}

N = "n AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hlc DESC, site_id DESC) rn FROM nodes) WHERE rn = 1 AND deleted_at IS NULL)"
NALL = "nall AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hlc DESC, site_id DESC) rn FROM nodes) WHERE rn = 1)"
E = "e AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY src, type, dst ORDER BY hlc DESC, site_id DESC) rn FROM edges) WHERE rn = 1 AND deleted_at IS NULL)"
CLOSED = "('closed', 'cancelled', 'superseded', 'retracted')"
HIDDEN = "('superseded', 'retracted', 'cancelled')"


def attr(key: str, of: str = "attrs") -> str:
    return f"json_extract_string({of}, '$.{key}')"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
