"""Toxicity: misspelled terms found by Levenshtein automata on a lexicon trie, weighed by context.

The lexicon is learned from labelled texts: words, and beginnings of words, that toxic texts have
and others do not. Its terms form a trie. A word of a text runs through the union of the terms'
Levenshtein automata, intersected with that trie: a state is a set of (trie node, edits so far), and
states are built when they are first reached. The number of edits that a term allows follows from
its length. Digits and marks between letters are taken for letters too, each an edit ("idi0t", "tr@sh"). Inside quotation marks (of the
whole text), or with a word of reporting in the window around it, a hit counts as quotation; near a word of address it counts as aimed at someone. The
counted hits by kind and context are the features of a logistic model. A misspelled hit counts like any
other unless the labels say otherwise; terms that ordinary words look like are taken as they are.

Nulls and empty texts have no hits and get the score of a text without hits. Labels that are null
are not learned from. Without usable labels the lexicon is empty and every score is 0. What is learned is
bounded by parameters: TRAINING_ROWS labelled texts, LEXICON_TERMS terms of TERM_LETTERS letters. Of labelled rows that
share a doc_id one counts, and of near copies (five words, 0.8, found by the n-gram join) that with the smallest doc_id. Repeated rows
are scored each by itself; a long text is scored whole; all other columns pass through untouched, whatever their names.
"""

import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.ngram_join import ngram_components
from treeledger.llm.shared import free_name, keyed_join, of_worker, prepare, stored, texts, with_column_from_text

# Labelled texts that the lexicon and the model are learned from, at most: those first in hash order.
TRAINING_ROWS = 20_000
# Terms of the lexicon, at most: those with the strongest evidence; and their letters.
LEXICON_TERMS = 4096
TERM_LETTERS = (3, 40)
# A word, or a beginning of words, occurs in so many toxic texts at least, and so many times more often
# there than elsewhere.
SUPPORT, STEM_SUPPORT, RATIO = 4, 12, 20.0
# Lengths of the beginnings of words that may be terms.
STEMS = (4, 5, 6)
# Words before and after a hit that make up its context.
WINDOW = 8

# Words of reporting and of address, in the languages of the texts.
REPORTING = frozenset("said says wrote writes quoted quote called dijo dice escribió sagte schrieb nannte dit écrit".split())
ADDRESS = frozenset("you your youre ur u tú usted eres du dich dein ihr tu vous toi ton".split())

_WORD = re.compile(r"[^\W\d_]+")
# Words with digits and marks between letters: letters and digits in a row, joined by one or two marks.
_PIECE = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"(?:[^\w\s]|_){1,2}")
# Edits at most, and so digits and marks in a misspelled term at most; letters that such a word can have.
_MOST_EDITS = 2
_MOST_LETTERS = TERM_LETTERS[1] + 2 * _MOST_EDITS
# Quotation marks and what closes them.
_CLOSES = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
_QUOTES = re.compile('["“„«‘”»’]')
# Words with their matches that a worker keeps; members of all states of the automaton that it keeps.
_KEPT, _KEPT_MEMBERS = 1 << 17, 1 << 18


def edits_allowed(term: str, stem: bool) -> int:
    """The beginnings of words and short words allow no edit, words of five letters one, of eight two."""
    return 0 if stem or len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """The Levenshtein automata of all terms, run together along the trie of the terms."""

    def __init__(
        self,
        terms: list[tuple[str, bool]],
        exact: frozenset[str] = frozenset(),
        evidence: list[float] | None = None,
    ):
        """``terms``: each a word (False), or the beginning of words (True). ``exact`` ones allow no edit."""
        self.evidence: dict[tuple[int, bool], float] = {}
        self.children: list[dict[str, int]] = [{}]
        self.word_edits = [-1]  # edits allowed for the word that ends at the node, or -1
        self.stem_ends = [False]
        self.words: dict[int, str] = {}
        self.most = [0]  # edits allowed anywhere below
        for term_number, (term, stem) in enumerate(terms):
            node, allowed = 0, 0 if term in exact else edits_allowed(term, stem)
            self.most[0] = max(self.most[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.word_edits.append(-1)
                    self.stem_ends.append(False)
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], allowed)
            self.evidence[node, stem] = evidence[term_number] if evidence else 1.0
            if stem:
                self.stem_ends[node] = True
            else:
                self.word_edits[node] = allowed
                self.words[node] = term
        self._reset()

    def _reset(self) -> None:
        self.members = 0  # of all states
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of the state with these nodes at these least edits, terms' letters left out included."""
        work = list(reached)
        while work:
            node = work.pop()
            edits = reached[node] + 1
            for child in self.children[node].values():
                if edits <= self.most[child] and edits < reached.get(child, 99):
                    reached[child] = edits
                    work.append(child)
        key = frozenset(reached.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.members += len(key) + 4
            self.moves.append({})
            ends = [e for node, e in key if e <= self.word_edits[node]]
            self.accepts.append(min(ends, default=-1))
        return self.numbers[key]

    def _move(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.states[state]:
            for other, child in self.children[node].items():
                cost = edits + (other != letter)
                if cost <= self.most[child] and cost < reached.get(child, 99):
                    reached[child] = cost
            if edits < self.most[node] and edits + 1 < reached.get(node, 99):
                reached[node] = edits + 1
        number = self._state(reached) if reached else -1
        self.moves[state][letter] = number
        return number

    def _run(self, word: str) -> int:
        state = self.start
        for letter in word:
            following = self.moves[state].get(letter)
            state = self._move(state, letter) if following is None else following
            if state < 0:
                break
        return state

    def near(self, word: str) -> list[str]:
        """The terms that the word is a misspelling of, other than itself."""
        state = self._run(word)
        if state < 0:
            return []
        return [self.words[n] for n, e in self.states[state] if n in self.words and 0 < e <= self.word_edits[n]]

    def match(self, word: str) -> tuple[int, float]:
        """What the word is, and the evidence of the strongest term that makes it so.

        0, 1, 2: edits to the nearest term; 3: the word begins with a term; -1: neither.
        """
        if self.members > _KEPT_MEMBERS:
            self._reset()
        state = self._run(word)
        if state >= 0 and self.accepts[state] >= 0:
            edits = self.accepts[state]
            ends = [self.evidence[n, False] for n, e in self.states[state] if e == edits and e <= self.word_edits[n]]
            return edits, max(ends)
        node, found = 0, 0.0
        for letter in word:
            node = self.children[node].get(letter, -1)
            if node < 0:
                break
            if self.stem_ends[node]:
                found = max(found, self.evidence[node, True])
        return (3, found) if found else (-1, 0.0)


class Matches(dict):
    """What each word matches, None for most; kept for the words a worker has met lately."""

    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton
        self.masked = MaskedWords(self)

    def __missing__(self, word: str) -> tuple[int, float] | None:
        if len(self) >= _KEPT:
            self.clear()
        kind, evidence = self.automaton.match(word)
        found = self[word] = None if kind < 0 else (kind, evidence)
        return found


def masked_hits(text: str, matches: Matches) -> list[tuple[int, int, tuple[int, float]]]:
    """Begin, end and match of each word that only its digits and marks, taken for letters, make a misspelled term.

    Each digit or mark is an edit, so words with more of them than edits are not looked at.
    """
    found, last = [], 0
    pieces = [m.span() for m in _PIECE.finditer(text)]
    for i, (begin, end) in enumerate(pieces):
        if begin < last:
            continue
        for j in range(i, min(i + _MOST_EDITS + 1, len(pieces))):
            if j > i and not _MARKS.fullmatch(text, pieces[j - 1][1], pieces[j][0]):
                break
            end = pieces[j][1]
            if end - begin > _MOST_LETTERS:
                break
            word = text[begin:end]
            letters = _WORD.findall(word)
            others = len(word) - sum(map(len, letters))
            if others > _MOST_EDITS:
                break
            if not others or not letters or any(matches[part] is not None for part in letters):
                continue
            match = matches[word]
            if match is not None and match[0] in (1, 2):
                found.append((begin, end, match))
                last = end
                break
    return found


class MaskedWords(dict):
    """Whether text without white space has masked hits; kept for what a worker has met lately."""

    def __init__(self, matches: Matches):
        super().__init__()
        self.matches = matches

    def __missing__(self, token: str) -> bool:
        found = not token.isalpha() and bool(masked_hits(token, self.matches))
        if len(token) <= 2 * _MOST_LETTERS:
            if len(self) >= _KEPT:
                self.clear()
            self[token] = found
        return found


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations begin and end, in one pass over all marks; what is never closed is no quotation."""
    found, begin, opened = [], -1, ""
    for m in _QUOTES.finditer(text):
        at, mark = m.start(), m[0]
        before, after = text[max(0, at - 1) : at], text[at + 1 : at + 2]
        if mark == "’" and before.isalnum() and after.isalnum():
            continue
        # A straight mark in front of a word begins anew: the one before was never closed.
        anew = mark == opened == '"' and (not before or before.isspace()) and after.isalnum()
        if begin >= 0 and mark in _CLOSES[opened] and not anew:
            found.append((begin, at))
            begin, opened = -1, ""
        elif anew or mark in _CLOSES and (begin < 0 or mark == opened):
            # Behind a number or a word a straight mark opens nothing.
            if anew or mark != '"' or not (before.isascii() and before.isalnum()):
                begin, opened = at, mark
    return found


# Strongest evidence of a plain hit; number of plain hits; whether all are misspelled, or beginnings;
# quoted hits; aimed hits; any plain hit; plain hits per word.
N_FEATURES = 8


def hit_features(text: bytes, matches: Matches) -> np.ndarray:
    """What the model sees of a text."""
    features = np.zeros(N_FEATURES)
    lowered = text.decode("utf-8", "replace").lower()
    words = _WORD.findall(lowered)
    hits = {i: matches[word] for i, word in enumerate(words) if matches[word] is not None}
    masked = matches.masked
    any_masked = any([masked[token] for token in lowered.split()])
    if not hits and not any_masked:
        return features
    starts = [m.start() for m in _WORD.finditer(lowered)]
    if any_masked:
        for begin, _, match in masked_hits(lowered, matches):
            hits[bisect_left(starts, begin)] = match
    quoted = quotations(lowered)
    begins = [begin for begin, _ in quoted]
    kinds = set()
    for i, (kind, evidence) in sorted(hits.items()):
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        quote = bisect_left(begins, starts[i]) - 1
        marked = quote >= 0 and starts[i] < quoted[quote][1]
        if marked or REPORTING.intersection(near):
            features[4] += 1
        else:
            features[0] = max(features[0], evidence)
            features[1] += 1
            kinds.add(kind)
            features[5] += bool(ADDRESS.intersection(near))
    features[7] = features[1] / len(words)
    features[6] = features[1] > 0
    features[2] = bool(kinds) and kinds <= {1, 2}
    features[3] = kinds == {3}
    for i in (1, 4, 5):
        features[i] = np.log1p(features[i])
    return features


class ToxicityModel(NamedTuple):
    terms: list[tuple[str, bool]]
    weights: list[float]  # of the features, and the constant
    exact: frozenset[str] = frozenset()  # terms whose misspellings are ordinary words
    evidence: tuple[float, ...] = ()  # of each term: the logarithm of how much likelier toxic texts have it

    def automaton(self) -> LexiconAutomaton:
        return LexiconAutomaton(self.terms, self.exact, list(self.evidence))

    def scorer(self):
        """A function from texts to scores, for one worker."""
        matches = Matches(self.automaton())
        weights = np.array(self.weights)

        def score(found: list[bytes]) -> np.ndarray:
            if not self.terms:
                return np.zeros(len(found))
            rows = np.array([hit_features(text, matches) for text in found]).reshape(-1, N_FEATURES)
            return 1 / (1 + np.exp(-np.clip(rows @ weights[:-1] + weights[-1], -30, 30)))

        return score


def fit_logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the constant of a logistic model, by Newton's steps."""
    rows = np.hstack([rows, np.ones((len(rows), 1))])
    weights = np.zeros(rows.shape[1])
    penalty = np.full(rows.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (labels - chance) - penalty * weights
        curve = (rows * (chance * (1 - chance))[:, None]).T @ rows + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: bool = True) -> DataFrame:
    """text, label (0 or 1), doc_id of a bounded number of labelled rows; those held out never take part.

    Of rows that share a doc_id the one with the least text counts, so there are no more texts than labels.
    """
    usable = labels.selectExpr("CAST(doc_id AS LONG) AS doc_id", f"CAST({label} AS INT) AS label").where(
        "doc_id IS NOT NULL AND label IN (0, 1)"
    )
    if held_out:
        usable = usable.where(f"NOT {HELD_OUT}")
    chosen = usable.orderBy(F.expr("xxhash64(doc_id)"), "doc_id", "label").limit(TRAINING_ROWS)
    return (
        docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.expr("min(struct(coalesce(text, '') AS text, label)) AS kept"))
        .selectExpr("kept.text", "kept.label", "doc_id")
    )


HELD_OUT = "(crc32(CAST(doc_id AS STRING)) % 5 = 0)"


def _text_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts, and toxic texts, of this task each word and beginning occurs."""
    seen, toxic = Counter(), Counter()
    for batch in batches:
        for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
            words = {w for w in _WORD.findall(text.decode("utf-8", "replace").lower()) if TERM_LETTERS[0] <= len(w) <= TERM_LETTERS[1]}
            found = words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}
            seen.update(found)
            if label:
                toxic.update(found)
    kept = list(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(kept, pa.string()), pa.array([seen[t] for t in kept], pa.int64()), pa.array([toxic[t] for t in kept], pa.int64())],
        ["term", "n", "toxic"],
    )


def fit(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> ToxicityModel:
    """Learn lexicon and weights from at most TRAINING_ROWS labelled rows."""
    prepare(docs.sparkSession)
    # Copies would make all their words terms, so of near copies one counts.
    labelled = stored(training_rows(docs, labels, "toxic", held_out), "labelled")
    groups = ngram_components(labelled.select("doc_id", "text"), words=5, percent=80)
    first = stored(groups.where("doc_id = component_id").select("doc_id").distinct(), "distinct-texts")
    rows = stored(keyed_join(labelled, first, ["doc_id"], "left_semi").select("text", "label"), "training")
    counts = rows.agg(F.expr("count(1)"), F.expr("coalesce(sum(label), 0)")).first()
    total, bad = counts[0], counts[1]
    if not bad or bad == total:
        return ToxicityModel([], [0.0] * (N_FEATURES + 1))
    counted = rows.mapInArrow(_text_terms, "term string, n long, toxic long").groupBy("term").agg(
        F.expr("sum(n) AS n"), F.expr("sum(toxic) AS toxic")
    )
    ratio = f"((toxic + 0.5) / {bad + 1}) / ((n - toxic + 0.5) / {total - bad + 1})"
    found = (
        counted.where(f"toxic >= if(term LIKE '%*', {STEM_SUPPORT}, {SUPPORT}) AND {ratio} >= {RATIO}")
        .orderBy(F.expr(f"-toxic * ln({ratio})"), "term")
        .limit(LEXICON_TERMS)
        .selectExpr("term", "toxic", f"ln({ratio}) AS evidence")
        .collect()
    )
    # A beginning that one word explains says nothing about others.
    whole = [(row.term, row.toxic) for row in found if not row.term.endswith("*")]
    explained = lambda stem: any(w.startswith(stem.term[:-1]) and n >= 0.8 * stem.toxic for w, n in whole)
    found = [row for row in found if not (row.term.endswith("*") and explained(row))]
    terms = [(row.term.rstrip("*"), row.term.endswith("*")) for row in found]
    # A term that ordinary words look like allows no edit.
    ordinary = counted.where("term NOT LIKE '%*' AND n > toxic").mapInArrow(_near_terms(terms), "term string, n long")
    seen = {row.term: row.n for row in ordinary.groupBy("term").agg(F.expr("sum(n) AS n")).collect()}
    toxic = {row.term: row.toxic for row in found}
    exact = frozenset(term for term, n in seen.items() if n * RATIO > toxic[term])
    model = ToxicityModel(terms, [0.0] * (N_FEATURES + 1), exact, tuple(row.evidence for row in found))
    features = rows.mapInArrow(_featurize(model), "label int, features array<double>").toPandas()
    weights = fit_logistic(np.array(features["features"].tolist()).reshape(-1, N_FEATURES), features["label"].to_numpy(float))
    return model._replace(weights=[float(w) for w in weights])


def _near_terms(terms: list[tuple[str, bool]]):
    """How many ordinary texts have words that look like each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, found = LexiconAutomaton(terms), Counter()
        for batch in batches:
            for word, n, toxic in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for term in automaton.near(word):
                    found[term] += n - toxic
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"]
        )

    return run


def _featurize(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(model.automaton())
        for batch in batches:
            rows = [hit_features(text, matches).tolist() for text in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["label", "features"]
            )

    return run


def score(docs: DataFrame, model: ToxicityModel, name: str | None = None) -> DataFrame:
    """All columns of the documents and the chance that the text is toxic."""
    prepare(docs.sparkSession)
    key = ("toxicity", uuid.uuid4().hex)

    def values(found: list[bytes]) -> pa.Array:
        return pa.array(of_worker(key, model.scorer)(found), pa.float64())

    return with_column_from_text(docs, name or free_name(docs, "score"), "double", values)
