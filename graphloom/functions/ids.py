"""Record ids: ``slug-`` and 12 Crockford base32 characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base32 alphabet of ids and the characters read as another.
ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"
LOOKALIKES = {"i": "1", "l": "1", "o": "0"}
BODY_LENGTH = 12

_WELL_FORMED = "^[a-z][a-z0-9]{1,7}-[0-9a-tv-z]{12}$"
_EDGE_BLANKS = r"(?U)^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


def trimmed(c: Column) -> Column:
    """Without any Unicode blanks around it."""
    return F.regexp_replace(c, _EDGE_BLANKS, "")


def canonical_id(c: Column) -> Column:
    """The spelling under which an id is compared.

    Letter case, surrounding blanks and look-alike characters in the body are
    levelled.  A text that isn't an id stays as it is but for case and blanks,
    so that it never equals a well-formed id.  Null gives null.
    """
    low = F.lower(trimmed(c))
    body = F.translate(F.substring(low, -BODY_LENGTH, BODY_LENGTH), "".join(LOOKALIKES), "".join(LOOKALIKES.values()))
    return F.when(low.rlike(_WELL_FORMED), F.concat(F.substring_index(low, "-", 1), F.lit("-"), body)).otherwise(low)


def prefix_range(prefix: str) -> tuple[str, str]:
    """Bounds [low, high) of the ids that begin with ``prefix``."""
    low = prefix.lower()
    kept = low.rstrip(ALPHABET[-1])
    if kept and kept[-1] in ALPHABET:
        return low, kept[:-1] + ALPHABET[ALPHABET.index(kept[-1]) + 1]
    return low, low + "{"


def utc_month(ms: Column) -> Column:
    """``yyyy-MM`` of epoch milliseconds in UTC, whatever the session's zone."""
    day = F.floor(ms / F.lit(86_400_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM")
