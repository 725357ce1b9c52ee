"""Normal forms of keys, statuses and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space: controls, blank, no-break, typographic and ideographic spaces.
SPACES = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(_col(x), F.lit(SPACES))


def folded(x: Column | str) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(trimmed(x))


def terms(*arrays: Column | str) -> Column:
    """Distinct terms of the arrays pooled: folded, blank and null ones dropped; a null array counts as empty."""
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(_col(a), empty) for a in arrays]
    pooled = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.array_distinct(F.filter(F.transform(pooled, folded), lambda t: F.length(t) > 0))
