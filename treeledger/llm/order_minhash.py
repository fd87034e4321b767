"""Document fingerprints: Order MinHash.

Symbols of a text are its runs of at most 16 characters without white space. A longer run (of a
script without blanks, or encoded) gives its WIDE characters from each place on, so that a character
put in changes the symbols around it only. K symbols in a row form a k-mer; equal k-mers of a text
are numbered in their order, so a repeated one counts as often as it occurs. The hashes of the
numbered k-mers are dealt over BUCKETS buckets by their lowest bits, which take the place of as many
permutations. In each bucket the two least are selected, put back into the order in which they stand
in the text, and hashed as a tuple. Moving a passage keeps the k-mers and changes tuples, so the
likeness follows edits and not only shared content. The likeness of two fingerprints is the share of
equal tuples among the buckets that either of them fills. Everything is SQL. A text's work grows
with its length times its logarithm.

Nulls and empty texts, and texts of white space, have the empty fingerprint; two empty ones are
alike (1), an empty and a filled one are not (0). Rows without doc_id come first in the order of
doc_id, rows that share one are ordered by text. A single document is its own next. Other columns
are ignored. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.ranges import LEAST, range_number, range_starts
from treeledger.llm.sql_text import let

K = 2
BUCKETS = 64
# Documents in a range of ids that is sorted at once, about.
RANGE_ROWS = 1024

# Runs up to SHORT characters are symbols; a longer one has one of WIDE characters at each place.
SHORT, WIDE = 16, 8
# Bits that tell the bucket.
_LOW = BUCKETS - 1


def _first_place(hashes: str, value: str) -> str:
    """Where a value begins in a sorted array, by halving steps."""
    steps = ", ".join(str(1 << n) for n in reversed(range(31)))
    return f"""aggregate(array({steps}), 0L,
        (at, step) -> if(get({hashes}, CAST(least(at + step - 1, 2147483646) AS INT)) < {value}, at + step, at))"""


def symbols(text: str) -> str:
    """SQL for the symbols of a text, in their order."""
    runs = rf"regexp_extract_all({text}, '\\S+', 0)"
    wide = rf"regexp_extract_all(r, '(?=(\\S{{{WIDE}}}))\\S', 1)"
    # Most texts have no long run.
    return rf"if({text} RLIKE '\\S{{{SHORT + 1}}}', flatten(transform({runs}, r -> if(length(r) <= {SHORT}, array(r), {wide}))), {runs})"


def signature(text: str) -> str:
    """SQL for the tuples' hashes, an array with one number for each bucket that has any."""
    kmers = f"transform(slice(words, 1, greatest(size(words) - {K - 1}, 1)), (w, i) -> xxhash64(w, " + ", ".join(
        f"get(words, i + {j})" for j in range(1, K)
    ) + "))"
    plain = "transform(kmers, (h, i) -> named_struct('h', xxhash64(h, 0L), 'i', i))"
    # Equal ones lie together when sorted; how far one is from the first of them is its number.
    numbered = let(
        "ordered",
        "sort_array(transform(kmers, (h, i) -> named_struct('h', h, 'i', i)))",
        let(
            "hashes",
            "transform(ordered, x -> x.h)",
            f"""transform(ordered, (x, t) -> named_struct('h', xxhash64(x.h,
                if(t > 0 AND get(hashes, t - 1) = x.h, t - {_first_place('hashes', 'x.h')}, 0L)), 'i', x.i))""",
        ),
    )
    every = f"if(size(array_distinct(kmers)) = size(kmers), {plain}, {numbered})"
    dealt = f"sort_array(transform({every}, x -> named_struct('b', x.h & {_LOW}L, 'h', x.h, 'i', x.i)))"
    two_least = "filter(dealt, (x, t) -> t < 2 OR get(dealt, t - 2).b <> x.b)"
    tuples = f"""filter(transform(least2, (x, t) -> CASE
        WHEN t > 0 AND get(least2, t - 1).b = x.b THEN NULL
        WHEN coalesce(get(least2, t + 1).b <> x.b, true) THEN (xxhash64(x.h) & {~_LOW}L) | x.b
        WHEN x.i < get(least2, t + 1).i THEN (xxhash64(x.h, get(least2, t + 1).h) & {~_LOW}L) | x.b
        ELSE (xxhash64(get(least2, t + 1).h, x.h) & {~_LOW}L) | x.b END), x -> x IS NOT NULL)"""
    return let(
        "words",
        symbols(text),
        let("kmers", kmers, let("dealt", dealt, let("least2", two_least, tuples))),
    )


def fingerprint(signature_: str) -> str:
    """SQL for a signature as text."""
    return f"array_join(transform({signature_}, x -> lower(hex(x))), ',')"


def likeness(one: str, other: str) -> str:
    """SQL for the likeness of two signatures, from 0 to 1."""
    filled = f"size(array_union(transform({one}, x -> x & {_LOW}L), transform({other}, x -> x & {_LOW}L)))"
    return let("filled", filled, f"if(filled = 0, 1D, size(array_intersect({one}, {other})) / filled)")


def with_next(docs: DataFrame, size: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, sig and those of the next document by doc_id; after the last comes the first.

    Ranges of ids are sorted side by side. Each also gets the first documents of the following range
    as guests, the last one those of the first, so no row looks beyond its range.
    """
    rows = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "coalesce(text, '') AS text")
    starts = range_starts(rows, "doc_id", size)
    least = rows.agg(F.expr(f"min(coalesce(doc_id, {LEAST + 1}L - 1L)) AS id")).first().id
    own = "coalesce(doc_id, {0}L - 1L)".format(LEAST + 1)
    begins = f"{own} IN ({', '.join(f'{s}L' for s in starts)})" if starts else "false"
    first = "false" if least is None else f"{own} = {least}L" if least > LEAST else "doc_id IS NULL"
    places = f"""concat(array(named_struct('part', part, 'guest', false, 'turn', 0)),
        if({begins}, array(named_struct('part', part - 1, 'guest', true, 'turn', 0)), array()),
        if({first}, array(named_struct('part', {len(starts)}, 'guest', true, 'turn', 1)), array()))"""
    placed = (
        rows.selectExpr("*", f"{signature('text')} AS sig", f"{range_number('doc_id', starts)} AS part")
        .selectExpr("doc_id", "text", "sig", f"explode({places}) AS place")
        .selectExpr("doc_id", "text", "sig", "place.part", "place.guest", "place.turn")
    )
    over = "OVER (PARTITION BY part ORDER BY turn, doc_id, text)"
    return placed.selectExpr(
        "doc_id", "text", "sig", "guest", f"lead(text) {over} AS next_text", f"lead(sig) {over} AS next_sig"
    ).where("NOT guest")


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit: the last half replaced by the next text's beginning."""
    half = "CAST(length(text) DIV 2 AS INT)"
    edited = f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))"
    found = with_next(docs).selectExpr("doc_id", "text", "sig", "next_sig", f"{edited} AS edited")
    found = found.selectExpr("*", f"{signature('edited')} AS edited_sig")
    return found.selectExpr(
        "doc_id",
        "CAST(length(text) AS LONG) AS n_chars",
        "sha2(edited, 256) AS edited_sha256",
        f"{fingerprint('sig')} AS fingerprint",
        f"{fingerprint('edited_sig')} AS edited_fingerprint",
        f"{likeness('sig', 'edited_sig')} AS near_edited",
        f"{likeness('sig', 'next_sig')} AS near_next",
    )
