"""N-gram Jaccard join: near copies of texts, found exactly through prefix trees.

A text is the set of its distinct word n-grams, each a 58-bit hash. One order holds for all sets:
common n-grams last. How common an n-gram is comes from a count sketch of fixed size over all texts;
it only steers the order, so a wrong count costs time and no link. Two sets that are similar enough
share an n-gram among the first few of each (their prefixes). The steps:

1. Texts with equal sets form a class; from here on a class counts once.
2. Each class hands out its prefix. An n-gram that only one class hands out goes.
3. Each class is compared with one other class per n-gram. The links give first components, which
   settles large groups of copies with few comparisons.
4. Pairs that share an n-gram but lie in different components are compared, unless the number of
   n-grams in both prefixes, or the parities of the sets, already tell that too little can be
   shared. So no link between components is lost.

A comparison takes one set and puts its partners, in blocks of bounded size, into a prefix tree.
The tree is traversed once: what sets share at their start is intersected once, and a subtree is
left when the elements that remain cannot reach the threshold any more.

Nulls: a missing text is empty. A text without words has no n-gram, links with nothing, and is its
own component. Rows that share a doc_id count as one document with several texts. A row without
doc_id is returned with no component. Texts below n words are one n-gram. Any further columns are
ignored. An empty table gives an empty result.
"""

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.components import connected_components
from treeledger.llm.shared import keyed_join, prepare, stored, texts

# The count sketch: 2^20 counters, sent in pieces.
SKETCH_BITS = 20
_PIECE = 1 << 14
# An n-gram is a hash of this many bits; the rest of a word holds how common it is.
HASH_BITS = 58
# Words a worker remembers the hashes of.
_WORDS = 1 << 18
# N-grams in one prefix tree, about; of large sets as many as TREE_SETS of them have, up to LARGE_TREE.
TREE_SIZE, TREE_SETS, LARGE_TREE = 1 << 17, 4, 1 << 22
# Numbers of 64 bits that hold the parities of a set's elements, dealt over as many bits by hash.
PARITIES = 8
# Places of a document in one row, about, and rows of places that are broadcast, at most and if their bytes fit too.
PLACES = 512
BROADCAST_PLACES = 100_000
# Bytes of sets that are sent to blocks at once, unless a single set has more.
SENT_BYTES = 1 << 25
# Prefix n-grams that a task hands out at once.
_FLUSH = 1 << 21


class Shingles(NamedTuple):
    """How texts become sets, and when two sets are linked: 100 * shared >= percent * union."""

    words: int = 5
    percent: int = 80

    def shared_at_least(self, m, n):
        """The elements that linked sets of the sizes m and n share at least."""
        return -(-self.percent * (m + n) // (100 + self.percent))

    def prefix(self, n):
        """How many first elements of a set of n must hold one that any linked set's prefix holds too."""
        return n - -(-self.percent * n // 100) + 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingle_hashes(text: bytes, size: int, hashes: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams. Words are split at ASCII white space, A-Z lowered."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ values[i : i + count]) * _FACTORS[i % 4]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _FACTORS[1]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed >> np.uint64(64 - HASH_BITS))


def in_order(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The same n-grams in the order of all sets: less common first, then by hash."""
    level = levels[hashes >> np.uint64(HASH_BITS - SKETCH_BITS)].astype(np.uint64)
    return np.sort((level << np.uint64(HASH_BITS)) | hashes)


def parities(hashes: np.ndarray) -> list[int]:
    """Bit by bit, whether an odd number of elements fell there: sets differ by as many elements at least as bits."""
    counts = np.bincount((hashes & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).tolist()


def _set_key(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


_PARITY_NAMES = [f"s{i}" for i in range(PARITIES)]


def _describe(rule: Shingles):
    """Size and key of each text's set; and, per task, the sketch of the classes it saw."""
    names = ["doc_id", "n", "k1", "k2", "piece", "counts", *_PARITY_NAMES]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * PARITIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, hashes = np.zeros(1 << SKETCH_BITS, np.uint32), set(), _WordHashes()
        for batch in batches:
            sizes, keys, odd = [], [], []
            for text in texts(batch.column(1)):
                found = shingle_hashes(text, rule.words, hashes)
                key = _set_key(found)
                sizes.append(len(found))
                keys.append(key)
                odd.append(parities(found))
                if key not in seen:
                    seen.add(key)
                    np.add.at(sketch, (found >> np.uint64(HASH_BITS - SKETCH_BITS)).astype(np.int64), 1)
            empty = [None] * len(sizes)
            if not keys:
                continue
            columns = [batch.column(0).cast(pa.int64()), sizes, [k[0] for k in keys], [k[1] for k in keys], empty, empty, *zip(*odd)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
        if seen:
            # As the last rows: what this task counted.
            for piece, counts in enumerate(sketch.reshape(-1, _PIECE)):
                columns = [[None]] * 4 + [[piece], [counts.tobytes()]] + [[None]] * PARITIES
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            values = np.frombuffer(counts, np.uint64 if len(counts) == 8 * _PIECE else np.uint32)
            total[piece] = total[piece] + values if piece in total else values.astype(np.uint64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
        ["piece", "counts"],
    )


def _levels(described: DataFrame) -> np.ndarray:
    """How much more common than by chance the n-grams of each counter are, as a power of two.

    The sketch has a fixed size; the tasks' sketches are added in two steps, a piece at a time.
    """
    pieces = described.where("piece IS NOT NULL").select("piece", "counts")
    salted = pieces.withColumn("salt", F.expr("pmod(spark_partition_id(), 8)")).repartition("piece", "salt")
    once = salted.select("piece", "counts").mapInArrow(_sum_pieces, "piece int, counts binary")
    rows = once.repartition("piece").mapInArrow(_sum_pieces, "piece int, counts binary").collect()
    counts = np.zeros(1 << SKETCH_BITS)
    for row in rows:
        counts[row.piece * _PIECE : (row.piece + 1) * _PIECE] = np.frombuffer(row.counts, np.uint64)
    usual = np.median(counts)
    above = np.maximum(0, counts - usual - 6 * np.sqrt(usual) - 8)
    return np.ceil(np.log2(above + 1)).astype(np.uint8)


def _hand_out(rule: Shingles, levels):
    """The prefix of each class: n-gram, class key and set size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen, hashes = levels.value, set(), _WordHashes()
        grams, keys, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in (grams, keys, sizes)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "k1", "n"])

        for batch in batches:
            for text in texts(batch.column(0)):
                found = shingle_hashes(text, rule.words, hashes)
                key = _set_key(found)
                if not len(found) or key in seen:
                    continue
                seen.add(key)
                first = in_order(found, level)[: rule.prefix(len(found))]
                grams.append(first.astype(np.int64))
                keys.append(np.full(len(first), key[0]))
                sizes.append(np.full(len(first), len(found)))
                held += len(first)
            if held > _FLUSH:
                yield flush()
                grams, keys, sizes, held = [], [], [], 0
        if held:
            yield flush()

    return run


class _Node(NamedTuple):
    run: np.ndarray  # elements between the node above and this one
    end: int  # elements from the root to here
    ending: list[int]  # places of the sets that end here
    below: list[int]  # subtrees, as numbers of nodes
    sizes: list[int]  # of the smallest and the largest set in this subtree


class PrefixTree:
    """Ordered sets in a compressed trie. The sets are given in lexicographical order."""

    def __init__(self, sets: Sequence[np.ndarray]):
        self.nodes: list[_Node] = []
        above: list[int] = []
        work = [(0, len(sets), 0, -1)]
        while work:
            first, last, depth, parent = work.pop()
            # Sets between two sets share what these two share.
            low, high = sets[first], sets[last - 1]
            most = min(len(low), len(high))
            differ = np.flatnonzero(low[depth:most] != high[depth:most])
            end = depth + int(differ[0]) if len(differ) else most
            number, node = len(self.nodes), _Node(low[depth:end], end, [], [], [end, end])
            self.nodes.append(node)
            above.append(parent)
            if parent >= 0:
                self.nodes[parent].below.append(number)
            while first < last and len(sets[first]) == end:
                node.ending.append(first)
                first += 1
            if not node.ending:
                node.sizes[:] = [len(low), len(low)]
            while first < last:
                # All sets with the same next element form a subtree; its end is found by halving.
                element, lo, hi = sets[first][end], first + 1, last
                while lo < hi:
                    middle = (lo + hi) // 2
                    lo, hi = (middle + 1, hi) if sets[middle][end] == element else (lo, middle)
                work.append((first, lo, end, number))
                first = lo
        for node, parent in zip(reversed(self.nodes), reversed(above)):
            if parent >= 0:
                sizes = self.nodes[parent].sizes
                sizes[:] = [min(sizes[0], node.sizes[0]), max(sizes[1], node.sizes[1])]

    def linked(self, query: np.ndarray, rule: Shingles) -> list[int]:
        """The places of the sets that are linked with the query."""
        found: list[int] = []
        work = [(0, 0)]
        while work:
            number, shared = work.pop()
            node = self.nodes[number]
            left = len(query)
            if len(node.run):
                at = np.searchsorted(query, node.run)
                shared += int(np.count_nonzero(query[np.minimum(at, len(query) - 1)] == node.run))
                left -= int(np.searchsorted(query, node.run[-1], "right"))
            if node.ending and shared >= rule.shared_at_least(len(query), node.end):
                found += node.ending
            for below in node.below:
                low, high = self.nodes[below].sizes
                # The size that gets there most easily has as many elements left as the query.
                size = min(max(node.end + left, low), high)
                if shared + min(left, size - node.end) >= rule.shared_at_least(len(query), size):
                    work.append((below, shared))
        return found


def _compare(rule: Shingles):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """One block: the set of ``a`` in the rows without ``b``, and its partners."""
        decode = [np.frombuffer(value, ">u8") for value in group["grams"]]
        own = group["b"].isna().to_numpy()
        queries = {group["grams"].iloc[i]: decode[i].astype(np.uint64) for i in np.flatnonzero(own)}
        # As bytes, most significant first, sets sort like sequences of numbers.
        partners = sorted((group["grams"].iloc[i], int(group["b"].iloc[i])) for i in np.flatnonzero(~own))
        links = set()
        if partners and queries:
            tree = PrefixTree([np.frombuffer(s, ">u8").astype(np.uint64) for s, _ in partners])
            for query in queries.values():
                links.update(partners[i][1] for i in tree.linked(query, rule))
        return pd.DataFrame({"a": group["a"].iloc[:1].repeat(len(links)).to_numpy(), "b": sorted(links)}).astype("int64")

    return run


def _sets_for_blocks(rule: Shingles, levels):
    """The ordered set of each document, once for each block that it has to go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for text, places in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                found = in_order(shingle_hashes(text, rule.words, hashes), levels.value).astype(">u8").tobytes()
                step = max(1, SENT_BYTES // max(1, len(found)))
                for first in range(0, len(places), step):
                    some = places[first : first + step]
                    columns = [pa.array([p[name] for p in some], pa.int64()) for name in ("a", "block", "b")]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array([found] * len(some), pa.binary())], ["a", "block", "b", "grams"]
                    )

    return run


def _verify(pairs: DataFrame, docs: DataFrame, rule: Shingles, levels) -> DataFrame:
    """Which of the pairs (a, b, and the size of b's set) are linked."""
    pairs = stored(pairs, "pairs")
    # A set is repeated for each block of its partners, so large sets get few large blocks.
    most = f"greatest({TREE_SIZE}, least({TREE_SETS} * max(n), {LARGE_TREE}))"
    blocks = pairs.groupBy("a").agg(F.expr(f"1 + sum(n) DIV {most} AS blocks"))
    dealt = pairs.join(blocks, "a").selectExpr("a", "b", "CAST(pmod(xxhash64(b), blocks) AS LONG) AS block")
    own = dealt.select("a", "block").distinct().selectExpr("a", "CAST(NULL AS LONG) AS b", "block")
    every = stored(dealt.select("a", "b", "block").union(own).selectExpr("coalesce(b, a) AS doc_id", "a", "block", "b"), "every")
    many = every.groupBy("doc_id").agg(F.expr(f"1 + count(1) DIV {PLACES} AS parts")).where("parts > 1")
    part = "if(parts IS NULL, 0L, pmod(xxhash64(a, block), parts)) AS part"
    places = (
        keyed_join(every, stored(many, "many"), ["doc_id"], "left")
        .groupBy("doc_id", F.expr(part))
        .agg(F.expr("collect_list(struct(a, block, b)) AS places"))
        .drop("part")
    )
    sent = keyed_join(docs, stored(places, "places"), ["doc_id"], most=BROADCAST_PLACES).select("text", "places")
    both = sent.mapInArrow(_sets_for_blocks(rule, levels), "a long, block long, b long, grams binary")
    return stored(both.groupBy("a", "block").applyInPandas(_compare(rule), "a long, b long"), "verified")


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of each row."""
    spark = docs.sparkSession
    prepare(spark)
    rule = Shingles(words, percent)
    docs = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    described = stored(
        docs.mapInArrow(
            _describe(rule),
            "doc_id long, n long, k1 long, k2 long, piece int, counts binary, "
            + ", ".join(f"{name} long" for name in _PARITY_NAMES),
        ),
        "described",
    )
    rows = described.where("piece IS NULL").drop("piece", "counts")
    named = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(named.groupBy("k1", "k2").agg(*[F.expr(f"min({c}) AS {name}") for c, name in (("doc_id", "rep"), ("n", "n"), *zip(_PARITY_NAMES, _PARITY_NAMES))]), "classes")
    levels = spark.sparkContext.broadcast(_levels(described))

    # What two classes or more hand out.
    handed = stored(
        docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_hand_out(rule, levels), "gram long, k1 long, n long"),
        "handed",
    )
    ends = handed.groupBy("gram").agg(F.expr("min(k1) AS low"), F.expr("max(k1) AS high"))
    met = stored(
        handed.join(ends.where("low < high").select("gram"), "gram").dropDuplicates(["gram", "k1"]), "met"
    )
    reps = classes.select("k1", "rep", "n", *_PARITY_NAMES)

    def named_pairs(pairs: DataFrame) -> DataFrame:
        """Pairs of class keys, with the n-grams that both hand out counted, as pairs that may be linked."""
        left = pairs.join(_side(reps.withColumnsRenamed({"k1": "x", "rep": "a"}), "x"), "x")
        right = left.join(_side(reps.withColumnsRenamed({"k1": "y", "rep": "b"}), "y"), "y").where("a <> b")
        near = right.where(_possible("x_n", "y_n", "both", rule)).where(_near_parities(rule))
        return near.selectExpr("a", "b", "y_n AS n").distinct()

    # The one class that all others of an n-gram are compared with: that which shares most of its prefix,
    # as the text does that the others were copied from.
    shared = met.groupBy("k1").agg(F.expr(f"(count(1) * 1000 DIV {_prefix('min(n)', rule)} << 40) + pmod(k1, 1L << 40) AS rank"))
    ranked = met.join(shared, "k1")
    hubs = ranked.groupBy("gram").agg(F.expr("max_by(k1, rank) AS hub"))
    first = (
        ranked.join(hubs, "gram").where("k1 <> hub")
        .groupBy(F.expr("hub AS x"), F.expr("k1 AS y"))
        .agg(F.expr("count(1) AS both"))
    )
    links = _verify(named_pairs(first), docs, rule, levels)
    # Rows that share a doc_id.
    several = named.groupBy("doc_id").agg(F.expr("count(1) AS c")).where("c > 1")
    repeated = named.join(several, "doc_id").join(classes, ["k1", "k2"]).selectExpr("doc_id AS a", "rep AS b")
    links = links.union(repeated)
    labels = connected_components(links)

    # What lies in different components and could still be linked.
    labelled = reps.join(labels, reps["rep"] == labels["node"], "left").selectExpr(
        "k1", "n", *_PARITY_NAMES, "coalesce(component, rep) AS label"
    )
    placed = stored(met.select("gram", "k1").join(labelled.select("k1", "label").dropDuplicates(["k1"]), "k1"), "placed")
    mixed = placed.groupBy("gram").agg(F.expr("min(label) AS low"), F.expr("max(label) AS high")).where("low < high")
    open_ = placed.join(mixed.select("gram"), "gram", "left_semi").select("gram", "k1")
    open_ = stored(open_.join(labelled.dropDuplicates(["k1"]), "k1"), "open")
    x, y = (_side(open_.withColumnRenamed("k1", side), side) for side in ("x", "y"))
    similar = f"least(x_n, y_n) * 100 >= greatest(x_n, y_n) * {percent}"
    second = (
        x.join(y, "gram")
        .where(f"x < y AND x_label <> y_label AND {similar} AND {_near_parities(rule)}")
        .groupBy("x", "y")
        .agg(F.expr("count(1) AS both"))
    )
    more = _verify(named_pairs(second), docs, rule, levels)
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    by_class = classes.join(labels, classes["rep"] == labels["node"], "left").selectExpr(
        "k1", "k2", "coalesce(component, rep) AS component_id"
    )
    linked = named.join(by_class, ["k1", "k2"]).selectExpr("doc_id", "n AS n_shingles", "component_id")
    alone = rows.where("n = 0 OR doc_id IS NULL").selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id")
    return linked.unionByName(alone)


def _side(df: DataFrame, name: str) -> DataFrame:
    """A side of a join, with its size, label and parities named after it."""
    own = [c for c in df.columns if c in ("n", "label", *_PARITY_NAMES)]
    return df.withColumnsRenamed({c: f"{name}_{c}" for c in own})


def _near_parities(rule: Shingles) -> str:
    """Whether the sets differ in no more elements than linked ones may, as far as the parities tell."""
    differ = " + ".join(f"bit_count(x_{c} ^ y_{c})" for c in _PARITY_NAMES)
    return f"(x_n + y_n - ({differ})) * {100 + rule.percent} >= {2 * rule.percent} * (x_n + y_n)"


def _prefix(n: str, rule: Shingles) -> str:
    return f"({n} - ({rule.percent} * {n} + 99) DIV 100 + 1)"


def _possible(m: str, n: str, both: str, rule: Shingles) -> str:
    """Whether sets of these sizes may be linked whose prefixes share so many n-grams.

    Of the set whose prefix ends first in the common order, what else is shared lies behind its prefix.
    """
    behind = " , ".join(f"{size} - {_prefix(size, rule)}" for size in (m, n))
    return f"least({m}, {n}, {both} + greatest({behind})) * {100 + rule.percent} >= {rule.percent} * ({m} + {n})"
