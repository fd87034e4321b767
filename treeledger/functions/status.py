"""Columns about the status of a change. Arguments are column names or SQL expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter and name of every status.
STATUS_NAMES = {
    "-": "unmodified",
    "A": "added",
    "D": "deleted",
    "M": "modified",
    "R": "renamed",
    "C": "copied",
    "T": "type-changed",
}
# Statuses that share one letter.
OTHER_STATUS_NAMES = ("ignored", "untracked", "unreadable", "conflicted")
OTHER_STATUS_LETTER = "X"


def _lookup(pairs: dict[str, str], key: str) -> Column:
    entries = ", ".join(f"'{name}', '{value}'" for name, value in pairs.items())
    return F.expr(f"try_element_at(map({entries}), {key})")


def status_name(letter: str = "status") -> Column:
    return _lookup(STATUS_NAMES, letter)


def status_code(name: str = "status_name") -> Column:
    letters = {long: letter for letter, long in STATUS_NAMES.items()}
    letters |= dict.fromkeys(OTHER_STATUS_NAMES, OTHER_STATUS_LETTER)
    return _lookup(letters, name)


def adds_new_content(status: str = "status", similarity: str = "similarity") -> Column:
    """Moves and exact copies bring no new content; additions and edits do."""
    return F.expr(f"{status} IN ('A', 'M') OR ({status} IN ('R', 'C') AND {similarity} <> 100)")


def shown_old_digest(
    status: str = "status", similarity: str = "similarity", old_digest: str = "old_digest"
) -> Column:
    """The digest that is about to be lost, ``-`` where nothing is."""
    return F.expr(f"CASE WHEN {status} = 'A' OR {similarity} = 100 THEN '-' ELSE {old_digest} END")
