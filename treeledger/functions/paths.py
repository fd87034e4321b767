"""Columns about slash-separated relative paths. The root directory is the empty string.

Arguments are column names or SQL expressions; results are SQL expressions, to be used in
``selectExpr`` and ``expr``.
"""

import re


def quoted(text: str) -> str:
    """A string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def parent_dir(path: str = "path") -> str:
    name = f"substring_index({path}, '/', -1)"
    return f"substring({path}, 1, length({path}) - length({name}) - 1)"


def proper_ancestors(path: str = "path") -> str:
    """All directories above a path, the root first."""
    # A sequence from 1 down to 0 has two elements, so a path without a slash needs its own case.
    return f"""
        CASE WHEN {path} = '' THEN cast(array() AS array<string>)
             WHEN instr({path}, '/') = 0 THEN array('')
             ELSE concat(array(''), transform(
                 sequence(1, size(split({path}, '/')) - 1),
                 n -> substring_index({path}, '/', n))) END"""


def ancestors_and_self(path: str = "path") -> str:
    return f"concat({proper_ancestors(path)}, array({path}))"


def normalised(path: str) -> str:
    """A path as users type it; ``.`` and the empty string mean the whole tree."""
    parts = [part for part in path.split("/") if part not in ("", ".")]
    if ".." in parts or path.startswith("/"):
        raise ValueError(f"not a path below the root: {path}")
    return "/".join(parts)


def at_or_below(path: str, directories: list[str]) -> str:
    """Is the path one of the directories or inside one; reaches the parquet scan as a filter."""
    tests = ["false"]
    for directory in directories:
        if directory == "":
            return "true"
        tests.append(f"{path} = {quoted(directory)}")
        tests.append(f"startswith({path}, {quoted(directory + '/')})")
    return "(" + " OR ".join(tests) + ")"


def glob_regex(pattern: str) -> str:
    """A file name pattern as a regular expression; a backslash takes away the special meaning.

    ``*`` and ``?`` match slashes too, and a matched directory stands for everything below it.
    """
    out = []
    rest = list(pattern)
    while rest:
        char = rest.pop(0)
        if char == "\\" and rest:
            out.append(re.escape(rest.pop(0)))
        elif char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and "]" in rest[1:]:
            end = rest.index("]", 1)
            body = "".join(rest[:end])
            del rest[: end + 1]
            negated = body[0] in "!^"
            body = re.sub(r"([\\\[&^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{body}]")
        else:
            out.append(re.escape(char))
    return "(?s)^" + "".join(out) + r"(/.*)?\z"


def path_change(old_path: str = "old_path", new_path: str = "new_path") -> str:
    """Two paths in short form, the part they share written once: ``a/{b -> c}/d``."""

    def first_difference(left: str, right: str) -> str:
        same = f"zip_with({left}, {right}, (x, y) -> coalesce(x = y, false))"
        return f"cast(array_position({same}, false) AS int)"

    def tail(parts: str) -> str:
        return f"reverse(slice({parts}, p.front + 1, size({parts})))"

    def middle(parts: str) -> str:
        return f"array_join(slice({parts}, p.front + 1, size({parts}) - p.front - p.back), '/')"

    split = f"array(struct(split({old_path}, '/') AS a, split({new_path}, '/') AS b))"
    # Each step is bound by a lambda over a one-element array, so it is evaluated once per row.
    counted_front = f"p -> struct(p.a AS a, p.b AS b, {first_difference('p.a', 'p.b')} - 1 AS front)"
    counted_back = f"""p -> struct(p.a AS a, p.b AS b, p.front AS front,
        {first_difference(tail('p.a'), tail('p.b'))} - 1 AS back)"""
    # Neither side of the arrow may be empty: if one is, it takes one shared part back.
    one_is_empty = "least(size(p.a), size(p.b)) = p.front + p.back"
    balanced = f"""p -> struct(p.a AS a, p.b AS b,
        p.front - if({one_is_empty} AND p.front > 0, 1, 0) AS front,
        p.back - if({one_is_empty} AND p.front = 0, 1, 0) AS back)"""
    arrow = f"concat({middle('p.a')}, ' -> ', {middle('p.b')})"
    written = f"""p -> if(p.front + p.back = 0, {arrow}, array_join(concat(
        slice(p.a, 1, p.front),
        array(concat('{{', {arrow}, '}}')),
        slice(p.a, size(p.a) - p.back + 1, p.back)), '/'))"""
    steps = split
    for step in (counted_front, counted_back, balanced, written):
        steps = f"transform({steps}, {step})"
    return f"CASE WHEN {old_path} = {new_path} THEN {old_path} ELSE get({steps}, 0) END"
