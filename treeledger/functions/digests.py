"""Digest columns. Arguments are column names or SQL expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeledger.schema import ABBREVIATED_LENGTH, LINK, ZERO_DIGEST


def text_digest(text: str) -> Column:
    return F.expr(f"sha1(cast({text} AS binary))")


def link_identity(kind: str = "kind", link_target: str = "link_target", digest: str = "digest") -> Column:
    """A link is identified by the text of its target, everything else by its content."""
    return F.expr(f"CASE WHEN {kind} = '{LINK}' THEN sha1(cast({link_target} AS binary)) ELSE {digest} END")


def unreadable(digest: str = "digest") -> Column:
    return F.expr(f"{digest} = '{ZERO_DIGEST}'")


def abbreviated(digest: str = "digest") -> Column:
    return F.expr(f"substring({digest}, 1, {ABBREVIATED_LENGTH})")


def lane(digest: str, number: int) -> str:
    """Sixty bits of a hex digest as an exact number that sums without overflow."""
    return f"cast(conv(substring({digest}, {1 + 15 * number}, 15), 16, 10) AS decimal(38, 0))"
