"""Secret scans: fixed patterns, and a battery of randomness tests on strings that look encoded.

Fixed patterns give the base spans, which always stay. Further candidates are strings of at least
MIN_LENGTH letters of an encoding, after an equals sign too. The encoding is inferred from the letters: decimal,
hexadecimal, base 32 or base 64. Under the hypothesis that a candidate is random in its encoding
three tests are made: chi-squared for equal shares of the alphabet's letters, the number of runs
above and below the middle of the alphabet, and the serial correlation of neighbours. Their squared
normal scores add up to one p-value.

A candidate is rejected as ordinary text by the Benjamini-Hochberg procedure, per band of lengths, as
the tests tell more of long strings than of short ones: among those rejected at most ALPHA are
expected to be random. The thresholds come from counts of p-values in fine logarithmic steps, so
that no p-values are gathered. What is not rejected is added as a span of kind "random".

Everything that touches rows is SQL. The driver sees the counts per band and step, whose number is
fixed. Nulls: a missing text is empty. Repeated rows, and rows without doc_id, are searched each by
itself. Other columns are ignored. An empty table gives an empty result.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.shared import stored
from treeledger.llm.sql_text import apart, clean, let, masked, matches

# The base patterns, with group 2 of an assignment as the tail of the match.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
_ASSIGN_HEAD = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"
# Equals signs are padding only where nothing of the encoding follows; before a string they assign it.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
MIN_LENGTH = 20
ALPHA = 0.05
# P-values are counted in steps of this factor.
STEP = 1.05
_STEPS = 1000

KINDS = ("assign", "access", "hex", "random")
_ALPHABETS = {
    10: "0123456789",
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def base_spans(text: str) -> str:
    """SQL for the base spans of a cleaned text."""
    quoted = _ASSIGN_HEAD.replace("\\", "\\\\").replace("'", "\\'")
    parts = [
        f"filter({matches(text, ASSIGN, 'assign', f'''({text} RLIKE '[:=]')''')}, x -> length(regexp_replace(x.m, '{quoted}', '')) >= 6)",
        f"filter({matches(text, ACCESS, 'access', f'''contains({text}, 'AKIA')''')}, x -> length(x.m) >= 20)",
        matches(text, HEX, "hex", f"{text} RLIKE '[0-9a-f]{{24}}'"),
    ]
    return f"concat({', '.join(parts)})"


def _survival(x: str) -> str:
    """Chance that the sum of three squared normal scores exceeds x: erfc(sqrt(x / 2)) and a term of exp(-x / 2)."""
    root = f"sqrt({x} / 2)"
    t = f"(1 / (1 + 0.3275911D * {root}))"
    # The polynomial approximation of erfc, with an error below 1.5e-7.
    erfc = f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))) * exp(-({x}) / 2))"
    return f"({erfc} + sqrt(2 * ({x}) / pi()) * exp(-({x}) / 2))"


def p_random(value: str) -> str:
    """SQL for the p-value of a string under the hypothesis that it is random in its encoding."""
    base = "CASE WHEN v RLIKE '^[0-9]+$' THEN 10 WHEN v RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 16 WHEN v RLIKE '^[A-Z2-7]+$' THEN 32 ELSE 64 END"
    alphabet = "CASE k " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in _ALPHABETS.items()) + " END"
    read = "if(k = 16, lower(v), if(k = 64, translate(v, '-_', '+/'), v))"
    uniform = "(k * aggregate(array_distinct(letters), 0D, (a, c) -> a + power(size(filter(letters, d -> d = c)), 2)) / n - n)"
    z_uniform = f"greatest(0D, (power(greatest({uniform}, 0D) / (k - 1), 1 / 3D) - (1 - 2 / (9D * (k - 1)))) / sqrt(2 / (9D * (k - 1))))"
    high = "aggregate(codes, 0, (a, c) -> a + if(2 * c >= k, 1, 0))"
    runs = "aggregate(sequence(1, n - 1), 1, (a, i) -> a + if((2 * codes[i] >= k) <> (2 * codes[i - 1] >= k), 1, 0))"
    wanted = "(2D * h * (n - h) / n + 1)"
    z_runs = f"if(h = 0 OR h = n, sqrt(CAST(n AS DOUBLE)), ({runs} - {wanted}) / sqrt(greatest(({wanted} - 1) * ({wanted} - 2) / (n - 1), 1e-9D)))"
    mean = "(aggregate(codes, 0D, (a, c) -> a + c) / n)"
    spread = "aggregate(codes, 0D, (a, c) -> a + (c - mu) * (c - mu))"
    serial = "aggregate(sequence(1, n - 1), 0D, (a, i) -> a + (codes[i] - mu) * (codes[i - 1] - mu))"
    z_serial = f"sqrt(CAST(n AS DOUBLE)) * {serial} / greatest({spread}, 1e-9D)"
    total = f"least(power({z_uniform}, 2) + power({z_runs}, 2) + power({z_serial}, 2), 1200D)"
    body = let("x2", total, _survival("x2"))
    body = let("mu", mean, let("h", high, body))
    body = let("codes", f"transform(letters, c -> greatest(instr({alphabet}, c) - 1, 0))", body)
    body = let("n", "size(letters)", body)
    body = let("letters", f"split({read}, '')", body)
    return let("v", f"rtrim('=', {value})", let("k", base, body))


def _band(span: str) -> str:
    return f"least(CAST(log2({span}.e - {span}.s) AS INT), 12)"


def _step(p: str) -> str:
    return f"CAST(least(-ln(greatest({p}, 1e-300D)) / {math.log(STEP)}D, {_STEPS}) AS INT)"


def _scanned(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base spans and tested candidates of each document, and the columns to keep."""
    rows = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", f"{clean('text')} AS t", *keep)
    kept = [name.rpartition(" AS ")[2] for name in keep]
    plain = "x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e)"
    long_runs = matches("t", CANDIDATE, "random", "t RLIKE '[A-Za-z0-9+/_-]{20}'")
    tested = f"transform(free, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'p', {p_random('x.m')}))"
    based = rows.selectExpr("doc_id", f"{base_spans('t')} AS base", f"{long_runs} AS long_runs", *kept)
    based = based.selectExpr("doc_id", "base", f"{apart('long_runs', 'base')} AS free", *kept)
    return based.selectExpr("doc_id", f"transform(base, {plain}) AS base", f"{tested} AS tested", *kept)


def rejected_from(found: DataFrame) -> dict[int, int]:
    """For each band of lengths the step of p-values from which on candidates are rejected as ordinary."""
    counts = (
        found.selectExpr("explode(tested) AS x")
        .groupBy(F.expr(f"{_band('x')} AS band"), F.expr(f"{_step('x.p')} AS step"))
        .agg(F.expr("count(1) AS n"))
        .collect()
    )
    limits = {}
    for band in {row.band for row in counts}:
        steps = sorted((row.step, row.n) for row in counts if row.band == band)
        total = sum(n for _, n in steps)
        smaller = total
        for step, n in steps:
            # All with a p-value of this step or a smaller one; the largest p-value of the step counts.
            if STEP**-step <= ALPHA * smaller / total:
                limits[band] = step
                break
            smaller -= n
    return limits


def all_spans(limits: dict[int, int]) -> str:
    """SQL for the spans of a row of base spans and tested candidates."""
    table = "map(" + ", ".join(f"{band}, {step}" for band, step in sorted(limits.items())) + ")" if limits else "map(-1, 0)"
    kept = f"filter(tested, x -> coalesce({_step('x.p')} < {table}[{_band('x')}], true))"
    return f"concat(base, transform({kept}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e)))"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of each document."""
    found = stored(_scanned(docs), "secrets")
    return found.selectExpr("doc_id", f"{all_spans(rejected_from(found))} AS spans")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All documents with all columns, and the mark in the text in place of each span; a null text stays null."""
    limits = rejected_from(_scanned(docs))
    whole = "struct(" + ", ".join(f"`{name}`" for name in docs.columns) + ") AS whole"
    found = _scanned(docs, (whole,)).selectExpr("whole", f"{all_spans(limits)} AS spans")
    text = f"if(size(spans) = 0, whole.text, {masked('whole.text', 'spans', mark)})"
    return found.selectExpr(*[f"{text} AS `{c}`" if c == "text" else f"whole.`{c}` AS `{c}`" for c in docs.columns])
