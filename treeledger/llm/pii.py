"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Exact patterns give the base spans, which always stay. Looser patterns give candidates: addresses
that are written out, telephone numbers without a country, card numbers that fail their check digits,
names after a title. On every span, base or candidate, labelers vote for or against it or abstain:
the exact pattern, check digits and lengths, gazetteers (domains, titles, area codes), words of
context before it, and the shape of what stands around it. Expectation-maximisation over the counts of
each vote pattern, per kind, estimates how reliable each labeler is and how likely a span with these
votes is real. A span classifier (naive Bayes on form, length, context and surroundings) is trained
on these soft labels; a candidate that it and the votes find real is added, unless as many labelers vote
against it as for it: whichever way few counts turn the estimate, a card number that fails its check is not added.

Everything that touches rows is SQL. The driver sees the counts of vote patterns and of features,
whose numbers are fixed by the labelers and features, not by the data.

Nulls: a missing text is empty. Repeated rows, and rows without doc_id, are searched each by itself.
Other columns are ignored. An empty table gives an empty result.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.shared import stored
from treeledger.llm.sql_text import apart, blocks, clean, digits, literal, luhn, matches, part

# The base patterns. A possessive quantifier matches the same and never goes back; what
# stands before them keeps a search from starting within a run that it has already failed on.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Shorter runs of digits fail the count anyway.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates.
WRITTEN_EMAIL = (
    r"(?i)\b[a-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[a-z0-9-]{2,63}){1,4}"
)
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
NAME = r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Señora?)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?"

# Words of context, and domains that the gazetteer knows.
CONTEXT = r"(?i)\b(?:e-?mail|mail|contact|write|reach|tel|phone|call|mobile|fax|card|visa|credit|account|ip|host|server|telefon|téléphone|teléfono|karte|carte|tarjeta|adresse)\b[^\p{L}]{0,12}(?:\p{L}{1,8}[^\p{L}]{1,3}){0,2}$"
DOMAINS = r"(?i)(?:example|gmail|yahoo|hotmail|outlook|gmx|web|orange|mail)\.(?:com|org|net|de|fr|es)$"
AREA = r"^\(?[2-9][0-9]{2}"

KINDS = ("email", "ip", "card", "phone", "name")
LABELERS = ("pattern", "check", "gazetteer", "context", "shape")
ROUNDS = 50
# How sure the votes and the classifier must be for a candidate to be added.
SURE = 0.9

_SPAN = "STRUCT<kind: STRING, s: BIGINT, e: BIGINT, m: STRING>"


def base_spans(text: str) -> str:
    """SQL for the base spans of a cleaned text, by kind and start."""
    digit = f"{text} RLIKE '[0-9]'"
    ip = "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND CAST(concat('0', ltrim('0', p)) AS BIGINT) <= 255)"
    card = f"length({digits('x.m')}) BETWEEN 13 AND 19 AND {luhn('x.m')}"
    phone = f"length({digits('x.m')}) BETWEEN 9 AND 15"
    parts = [
        matches(text, EMAIL, "email", f"contains({text}, '@')"),
        f"filter({matches(text, IP, 'ip', digit)}, x -> {ip})",
        f"filter({matches(text, CARD, 'card', digit)}, x -> {card})",
        f"filter({matches(text, PHONE, 'phone', f'''contains({text}, '+')''')}, x -> {phone})",
    ]
    return f"concat({', '.join(parts)})"


def loose_spans(text: str) -> str:
    digit = f"{text} RLIKE '[0-9]'"
    card = f"length({digits('x.m')}) BETWEEN 13 AND 19 AND NOT ({luhn('x.m')})"
    parts = [
        matches(text, WRITTEN_EMAIL, "email", f"{text} RLIKE '(?i)[(\\\\[{{]at[)\\\\]}}]'"),
        f"filter({matches(text, CARD, 'card', digit)}, x -> {card})",
        matches(text, LOCAL_PHONE, "phone", digit),
        matches(text, NAME, "name", f"{text} RLIKE '\\\\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Señora?)\\\\b'"),
    ]
    return f"concat({', '.join(parts)})"


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, and every base span and candidate of each document with what the labelers look at."""
    rows = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", f"{clean('text')} AS t")
    both = rows.selectExpr("doc_id", "t", f"{base_spans('t')} AS base", f"{loose_spans('t')} AS loose")
    # A candidate that touches a base span is none.
    both = both.selectExpr("doc_id", "base", f"{apart('loose', 'base')} AS free", f"{blocks('t')} AS cut")
    described = lambda spans, base: f"""transform({spans}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'm', x.m,
        'base', {base}, 'before', {part('cut', 'greatest(x.s - 40, 0L)', 'least(x.s, 40L)')},
        'after', coalesce({part('cut', 'x.e', '1')}, '')))"""  # noqa: E731
    return stored(both.selectExpr("doc_id", f"concat({described('base', 'true')}, {described('free', 'false')}) AS spans"), "pii")


# Each labeler's vote on a span x: 1 for it, -1 against it, 0 abstains.
_VOTES = {
    "pattern": "if(x.base, 1, if(x.kind = 'name', 0, -1))",
    "check": f"""CASE x.kind WHEN 'card' THEN if({luhn('x.m')}, 1, -1)
        WHEN 'phone' THEN if(length({digits('x.m')}) BETWEEN 9 AND 15, 1, -1)
        WHEN 'ip' THEN if(x.m RLIKE '^(?:0|127|255)[.]', -1, 1) ELSE 0 END""",
    "gazetteer": f"""CASE x.kind WHEN 'email' THEN if(x.m RLIKE {{domains}}, 1, 0)
        WHEN 'phone' THEN if(regexp_replace(x.m, '^[+][0-9]+[^0-9]+', '') RLIKE '{AREA.replace(chr(92), chr(92) * 2)}', 1, 0)
        WHEN 'name' THEN 1 ELSE 0 END""",
    "context": "if(x.before RLIKE {context}, 1, 0)",
    "shape": "if(x.before RLIKE '[A-Za-z0-9_]$' OR x.after RLIKE '[A-Za-z0-9_]', -1, 1)",
}


def _votes_sql() -> str:
    filled = {k: v.replace("{domains}", literal(DOMAINS)).replace("{context}", literal(CONTEXT)) for k, v in _VOTES.items()}
    return "concat(" + ", ".join(f"CAST(({filled[name]}) + 1 AS STRING)" for name in LABELERS) + ")"


# What the span classifier sees.
_FEATURES = {
    "form": "concat(x.kind, if(x.base, '!', '?'))",
    "length": "concat(x.kind, least(length(x.m) DIV 6, 8))",
    "context": "concat(x.kind, votes[3])",
    "around": "concat(x.kind, regexp_replace(right(x.before, 1), '[^ ]', 'x'), regexp_replace(x.after, '[^ ]', 'x'))",
}


def estimate(counts: list[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
    """How likely a span of a kind with these votes is real, by expectation-maximisation.

    ``counts``: kind, votes (a digit per labeler: 0 against, 1 abstains, 2 for), spans. A labeler has,
    per class, a chance for each vote; priors keep it better than chance and away from certainty.
    """
    found: dict[tuple[str, str], float] = {}
    for kind in sorted({c[0] for c in counts}):
        rows = [(votes, n) for k, votes, n in counts if k == kind]
        # Before anything is learned: the share of votes for it.
        real = {v: (v.count("2") + 0.5) / (v.count("2") + v.count("0") + 1) for v, _ in rows}
        for _ in range(ROUNDS):
            total = sum(n for _, n in rows)
            share = (sum(n * real[v] for v, n in rows) + 1) / (total + 2)
            odds = dict.fromkeys(real, math.log(share / (1 - share)))
            for i in range(len(LABELERS)):
                chance = {}
                for cls in (0, 1):
                    prior = {"0": (6, 2)[cls], "1": 4, "2": (2, 6)[cls]}
                    weight = {c: prior[c] + sum(n * (real[v] if cls else 1 - real[v]) for v, n in rows if v[i] == c) for c in "012"}
                    chance[cls] = {c: w / sum(weight.values()) for c, w in weight.items()}
                for v in odds:
                    odds[v] += math.log(chance[1][v[i]] / chance[0][v[i]])
            real = {v: 1 / (1 + math.exp(-max(-30, min(30, o)))) for v, o in odds.items()}
        found |= {(kind, v): p for v, p in real.items()}
    return found


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans: structs of kind, s, e (code points, end exclusive), base (by an exact pattern) and real (a chance)."""
    found = find_candidates(docs)
    voted = found.selectExpr("doc_id", f"transform(spans, x -> named_struct('x', x, 'votes', {_votes_sql()})) AS spans")
    each = voted.selectExpr("explode(spans) AS y").selectExpr("y.x AS x", "y.votes AS votes")
    # At most 3^5 vote patterns and a few dozen features per kind come to the driver.
    counts = [(r.kind, r.votes, r.n) for r in each.groupBy("x.kind", "votes").agg(F.expr("count(1) AS n")).collect()]
    real = estimate(counts)
    chances = _table({f"{k}{v}": p for (k, v), p in real.items()})
    by_letter = {name: sql.replace("votes[3]", "substring(votes, 4, 1)") for name, sql in _FEATURES.items()}
    listed = "array(" + ", ".join(f"concat('{name}:', {sql})" for name, sql in by_letter.items()) + ")"
    soft = each.selectExpr(f"explode({listed}) AS feature", f"{chances}[concat(x.kind, votes)] AS p", "x.kind AS kind")
    sums = soft.groupBy("kind", "feature").agg(F.expr("sum(p) AS good"), F.expr("sum(1 - p) AS bad")).collect()
    totals = {k: [sum(n * (p if c else 1 - p) for (kk, v), p in real.items() if kk == k for k2, v2, n in counts if (k2, v2) == (k, v)) for c in (0, 1)] for k in KINDS}
    weights = {r.feature: math.log((r.good + 1) / (totals[r.kind][1] + 2)) - math.log((r.bad + 1) / (totals[r.kind][0] + 2)) for r in sums}
    prior = {k: math.log((good + 1) / (bad + 1)) for k, (bad, good) in totals.items()}
    odds = f"aggregate({listed.replace('x.', 'y.x.').replace('votes', 'y.votes')}, {_table(prior)}[y.x.kind], (a, f) -> a + coalesce({_table(weights)}[f], 0D))"
    # The classifier's chance, and that of the votes; a candidate needs both, and more votes for it than against.
    carried = "length(translate(y.votes, '01', '')) > length(translate(y.votes, '12', ''))"
    scored = f"""transform(spans, y -> named_struct('kind', y.x.kind, 's', y.x.s, 'e', y.x.e, 'base', y.x.base,
        'carried', {carried}, 'real', least(1 / (1 + exp(-({odds}))), {chances}[concat(y.x.kind, y.votes)])))"""
    return voted.selectExpr("doc_id", f"{scored} AS spans").selectExpr(
        "doc_id", f"transform(filter(spans, x -> x.base OR (x.carried AND x.real >= {SURE})), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'base', x.base, 'real', x.real)) AS spans"
    )


def _table(values: dict[str, float]) -> str:
    if not values:
        return "map('', 0D)"
    return "map(" + ", ".join(f"{literal(k)}, {v!r}D" for k, v in sorted(values.items())) + ")"


def listed(spans: str, kinds: tuple[str, ...], by_start: bool = False) -> str:
    """SQL for spans as kind:start:end, joined by commas: by kind and start, or by start and kind."""
    place = "array_position(array(" + ", ".join(f"'{k}'" for k in kinds) + "), x.kind)"
    order = ("x.s", place) if by_start else (place, "x.s")
    keyed = f"array_sort(transform({spans}, x -> named_struct('a', {order[0]}, 'b', {order[1]}, 'e', x.e, 't', concat(x.kind, ':', x.s, ':', x.e))))"
    return f"array_join(transform({keyed}, x -> x.t), ',')"
