"""Spelling variants: words one edit apart, joined by pivotal grams, and the form each belongs to.

A word's bigrams are ordered by how many words have them, rare ones first. Its prefix is the first
three in that order (with all that equal the third); among any three at least two share no letter. Its pivots are two such bigrams of
the prefix with the smallest sum of frequencies, chosen by dynamic programming. One edit touches one
of two disjoint pivots at most, so of two words one edit apart, the one whose prefix ends earlier in the
order has a pivot that stands in the other's prefix; where it may stand there follows from the
lengths and from the side of it on which the edit lies, and what stands on its other side is equal. So pivots
meet prefixes by (bigram, place, length, text on one side), equal keys only, and the pairs that meet are
verified by their distance. Keys with many prefixes are cut into pieces, each of which the pivots are sent to.

A word's form is its near word with the largest count, ties by code points, if that count is at least
twice its own; the root follows forms to the end by doubling steps, and counts at least double each time.

Nulls and empty texts have no words; a missing doc_id counts as an empty one. Repeated rows count
each time. Long texts are read in slices cut between words. A table without words gives an empty result. Other columns are ignored.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.shared import keyed_join, prepare, stored

_RUN = re.compile("[a-zÀ-ÿ]{5,}")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
# Characters of a text read at once, about; distinct words a task holds before it passes their counts on.
_SLICE, _HELD = 1 << 20, 1 << 19
LEAST_LETTERS, LEAST_COUNT = 5, 3
# One of so many words of documents is misspelt on purpose.
MISSPELT = 97
# Prefix entries with one key that stay together.
PIECE = 2048


def lowered(text: str) -> str:
    """The text with A-Z as small letters, all others as they are."""
    return text.encode().lower().decode()


def slices(text: str) -> Iterator[str]:
    """The text in pieces of about _SLICE characters, none of which ends within a run of letters."""
    at = 0
    while len(text) - at > _SLICE:
        gap = _BREAK.search(text, at + _SLICE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def misspelt(run: str, start: int) -> str:
    """The run, or without one letter if the checksum of document and run says so; ``start`` is that of the document."""
    h = zlib.crc32(run.encode(), start)
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            start = zlib.crc32(f"{'' if not doc_id.is_valid else doc_id.as_py()}:".encode())
            for part in slices(text.as_py() or ""):
                # A letter may go, but none comes.
                for run, n in Counter(_RUN.findall(lowered(part))).items():
                    word = misspelt(run, start)
                    if len(word) >= LEAST_LETTERS:
                        held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield batch_of()
                    held.clear()
    yield batch_of()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n, for the words that are long and frequent enough."""
    prepare(docs.sparkSession)
    counted = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(_count, "word string, n long")
    return stored(counted.groupBy("word").agg(F.expr("sum(n) AS n")).where(f"n >= {LEAST_COUNT}"), "words")


def prefix_and_pivots(word: str, ranks: dict[str, int], costs: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """The rank at which the prefix ends, the places of its bigrams, and those of the two pivots."""
    ordered = sorted((ranks[word[p : p + 2]], p) for p in range(len(word) - 1))
    last = ordered[2][0]
    places = sorted(p for rank, p in ordered if rank <= last)
    # best[k]: least cost of k disjoint bigrams among the places seen; the step before leaves out neighbours.
    history: list[tuple[int, list[tuple[int, list[int]] | None]]] = [(-2, [(0, []), None, None])]
    for place in places:
        best = list(history[-1][1])
        free = next(found for at, found in reversed(history) if at <= place - 2)
        for k in (1, 2):
            if free[k - 1] is not None:
                cost = free[k - 1][0] + costs[word[place : place + 2]]
                if best[k] is None or cost < best[k][0]:
                    best[k] = (cost, [*free[k - 1][1], place])
        history.append((place, best))
    return last, places, history[-1][1][2][1]


def _grams(words: DataFrame) -> DataFrame:
    """word, n, letters, last, prefix and pivots (gram and place each) of every word."""
    found = words.selectExpr("explode(array_distinct(transform(sequence(1, length(word) - 1), i -> substring(word, i, 2)))) AS g")
    # Words have 90 different letters at most, so there are 8,100 bigrams at most.
    costs = {row.g: row.n for row in found.groupBy("g").agg(F.expr("count(1) AS n")).collect()}
    ranks = {g: i for i, g in enumerate(sorted(costs, key=lambda g: (costs[g], g)))}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lasts, prefixes, pivots = [], [], []
            for word in batch.column(0).to_pylist():
                last, places, chosen = prefix_and_pivots(word, ranks, costs)
                lasts.append(last)
                prefixes.append([{"g": word[p : p + 2], "p": p} for p in places])
                pivots.append([{"g": word[p : p + 2], "p": p} for p in chosen])
            kind = pa.list_(pa.struct([("g", pa.string()), ("p", pa.int32())]))
            columns = [*batch.columns, pa.array(lasts, pa.int32()), pa.array(prefixes, kind), pa.array(pivots, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "letters", "last", "prefix", "pivots"])

    kind = "array<struct<g: string, p: int>>"
    return stored(
        words.selectExpr("word", "n", "CAST(length(word) AS INT) AS letters").mapInArrow(
            choose, f"word string, n long, letters int, last int, prefix {kind}, pivots {kind}"
        ),
        "grams",
    )


def near_pairs(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """word, n, other, other_n: all pairs of words one edit apart, in both directions."""
    grams = _grams(words)
    # The edit lies on one side of a pivot that survives, so what stands on the other side is equal too.
    left, right = "struct(0 AS side, substring({w}, 1, at.p) AS text)", "struct(1 AS side, substring({w}, at.p + 3) AS text)"
    key = "xxhash64(at.g, {p}, {letters}, kept.side, kept.text) AS key"
    entries = (
        grams.selectExpr("word", "n", "letters", "last", "explode(prefix) AS at")
        .selectExpr("word", "n", "letters", "last", "at", f"explode(array({left.format(w='word')}, {right.format(w='word')})) AS kept")
        .selectExpr("word", "n", "last", key.format(p="at.p", letters="letters"))
    )
    # By how much the other word is longer, and so how far on the pivot stands there if the edit is before it.
    probes = (
        grams.selectExpr("word AS w", "n AS wn", "letters", "last AS wlast", "explode(pivots) AS at")
        .selectExpr("w", "wn", "letters", "wlast", "at", f"explode(array({left.format(w='w')}, {right.format(w='w')})) AS kept")
        .selectExpr("w", "wn", "letters", "wlast", "at", "kept", "explode(array(0, 1, -1)) AS longer")
        .selectExpr("w", "wn", "wlast", key.format(p="at.p + kept.side * longer", letters="letters + longer"))
    )
    # Keys with many entries; each takes a piece of them, so there are few.
    crowded = stored(
        entries.groupBy("key").agg(F.expr("count(1) AS _n")).where(f"_n > {piece}").selectExpr("key", f"CAST(ceil(_n / {piece}) AS INT) AS _pieces"),
        "crowded",
    )
    entries = keyed_join(entries, crowded, ["key"], "left").selectExpr(
        "word", "n", "last", "key", "coalesce(pmod(xxhash64(word), _pieces), 0L) AS _piece"
    )
    probes = keyed_join(probes, crowded, ["key"], "left").selectExpr(
        "w", "wn", "wlast", "key", "explode(sequence(0L, coalesce(_pieces, 1) - 1L)) AS _piece"
    )
    met = probes.join(entries, ["key", "_piece"]).where("wlast <= last AND w <> word AND levenshtein(w, word, 1) = 1")
    once = met.selectExpr("if(w < word, struct(w, wn, word, n), struct(word AS w, n AS wn, w AS word, wn AS n)) AS pair").distinct()
    both = "explode(array(struct(pair.w AS word, pair.wn AS n, pair.word AS other, pair.n AS other_n), struct(pair.word, pair.n, pair.w AS other, pair.wn AS other_n))) AS pair"
    return once.selectExpr(both).selectExpr("pair.*")


def follow(forms: DataFrame) -> DataFrame:
    """word and root, from word and form, by doubling: after k steps a root is 2^k forms away."""
    roots = stored(forms.selectExpr("word", "form AS root"), "roots")
    while True:
        further = roots.selectExpr("word AS root", "root AS next")
        # Words without a form are no rows here: a root that is none is final.
        stepped = stored(keyed_join(roots, further, ["root"], "left").selectExpr("word", "coalesce(next, root) AS root", "next IS NOT NULL AS moved"), "roots")
        if not stepped.where("moved").limit(1).count():
            return stepped.select("word", "root")
        roots = stepped.select("word", "root")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the documents."""
    words = word_counts(docs)
    pairs = near_pairs(words)
    best = pairs.groupBy("word").agg(
        F.expr("first(n) AS n"), F.expr("count(1) AS n_near"), F.expr("min(struct(-other_n AS m, other)) AS best")
    )
    near = stored(
        best.selectExpr("word", "n_near", "if(-best.m >= 2 * n, best.other, NULL) AS form", "if(-best.m >= 2 * n, -best.m, NULL) AS form_n"),
        "near-words",
    )
    roots = stored(follow(near.where("form IS NOT NULL")), "roots")
    return keyed_join(keyed_join(words, near, ["word"], "left"), roots, ["word"], "left").selectExpr(
        "word", "form", "coalesce(root, word) AS root", "n", "coalesce(n_near, 0L) AS n_near", "form_n"
    )
