"""SQL expressions on texts: names for parts of an expression, and where a pattern matches."""

# Marks matches within a text; where a text has it, another character that no pattern knows stands in.
_MARK, _STAND_IN = "\x01", "\x02"


def let(name: str, value: str, body: str) -> str:
    """The body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def literal(pattern: str) -> str:
    """A string as SQL has it."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def clean(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_MARK}', '{_STAND_IN}')"


def running(values: str, joined: str = "x + y") -> str:
    """SQL for the running sums of an array (or another fold of ``x`` and ``y``), in n log n steps.

    Each step adds what lies 1, 2, 4, ... places before, so no list is copied once per element.
    """
    steps = f"sequence(0, CAST(ceil(log2(greatest(size({values}), 2))) AS INT) - 1)"
    step = f"transform(sums, (y, i) -> if(i < shiftleft(1, k), y, {let('x', 'get(sums, i - shiftleft(1, k))', joined)}))"
    return f"aggregate({steps}, {values}, (sums, k) -> {step})"


def below(ordered: str, value: str, or_equal: bool = False) -> str:
    """SQL for how many elements of an ascending array lie below a value, by halving steps."""
    steps = f"transform(sequence(CAST(log2(greatest(size({ordered}), 1)) AS INT), 0, -1), k -> shiftleft(1, k))"
    test = "<=" if or_equal else "<"
    return f"aggregate({steps}, 0, (at, step) -> if(get({ordered}, at + step - 1) {test} {value}, at + step, at))"


def matches(text: str, pattern: str, kind: str, only_if: str = "true") -> str:
    """All matches in a cleaned text: an array of structs of kind, s, e (code points) and m (the match).

    ``only_if`` is a cheap condition that every text with a match meets.
    """
    empty = "CAST(array() AS ARRAY<STRUCT<kind: STRING, s: BIGINT, e: BIGINT, m: STRING>>)"
    marked = f"regexp_replace({text}, {literal(pattern)}, '{_MARK}$0{_MARK}')"
    # Every second part is a match.
    found = f"""transform(sequence(1, size(parts) - 2, 2), i -> named_struct('kind', '{kind}',
        's', get(ends, i - 1), 'e', get(ends, i), 'm', get(parts, i)))"""
    places = let("ends", running("transform(parts, p -> CAST(length(p) AS BIGINT))"), found)
    split = f"split({marked}, '{_MARK}', -1)"
    return f"if({only_if}, {let('parts', split, f'if(size(parts) < 3, {empty}, {places})')}, {empty})"


def apart(spans: str, others: str) -> str:
    """SQL for those of the spans that share no place with any of the others; both structs with s and e."""
    ordered = f"array_sort(transform({others}, b -> named_struct('s', b.s, 'e', b.e)))"
    hit = f"coalesce(get(furthest, {below('begins', 'x.e')} - 1) > x.s, false)"
    kept = f"filter({spans}, x -> NOT {hit})"
    kept = let("furthest", running("transform(ordered, b -> b.e)", "greatest(x, y)"), kept)
    kept = let("begins", "transform(ordered, b -> b.s)", kept)
    return f"if(size({spans}) = 0 OR size({others}) = 0, {spans}, {let('ordered', ordered, kept)})"


# Characters of a block of a text, within which a place is found without passing over the whole text.
BLOCK = 2048


def blocks(text: str) -> str:
    """SQL for a text in blocks of BLOCK code points, for ``part``."""
    return f"if(length({text}) <= {BLOCK}, array({text}), regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0))"


def part(blocks_: str, start: str, count: str) -> str:
    """SQL for at most BLOCK code points of a text that is given in blocks."""
    at = f"CAST({start} DIV {BLOCK} AS INT)"
    return f"""substring(if({start} % {BLOCK} + {count} <= {BLOCK}, get({blocks_}, {at}),
        concat(get({blocks_}, {at}), coalesce(get({blocks_}, {at} + 1), ''))), CAST({start} % {BLOCK} AS INT) + 1, CAST({count} AS INT))"""


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(value: str) -> str:
    """Whether the digits of a value pass the Luhn check."""
    total = f"""aggregate(transform(split(reverse({digits(value)}), ''), (c, i) -> if(i % 2 = 0, CAST(c AS INT),
        CAST(c AS INT) * 2 - if(CAST(c AS INT) > 4, 9, 0))), 0, (x, y) -> x + coalesce(y, 0))"""
    return f"{total} % 10 = 0"


def masked(text: str, spans: str, mark: str) -> str:
    """A text with ``mark`` in place of each span (structs with s and e). Spans that touch share one mark."""
    ordered = f"array_sort(transform({spans}, x -> named_struct('s', x.s, 'e', x.e)))"
    before = "if(i = 0, 0L, get(furthest, i - 1))"
    between = f"if(x.s - a > {BLOCK}, substring({text}, CAST(a AS INT) + 1, CAST(x.s - a AS INT)), {part('cut', 'a', '(x.s - a)')})"
    kept = let("a", before, f"if(i > 0 AND x.s <= a, '', concat({between}, '{mark}'))")
    end = f"substring({text}, CAST(get(furthest, size(ordered) - 1) AS INT) + 1)"
    whole = f"concat(array_join(transform(ordered, (x, i) -> {kept}), ''), {end})"
    whole = let("cut", blocks(text), whole)
    whole = let("furthest", running("transform(ordered, x -> x.e)", "greatest(x, y)"), whole)
    return f"if(size({spans}) = 0, {text}, {let('ordered', ordered, whole)})"
