"""Spelling variants, the external shuffle and whitening against plain versions and on hard rows."""

import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from treeledger.llm import bpe, embedding_join, external_shuffle, packing, pfor, pii, pivotal_grams, quality, queries, secret_scan, toxicity, whitening, word_ids  # noqa: E402
from treeledger.llm.shared import fits, stored  # noqa: E402
from treeledger.llm.sql_text import below, running  # noqa: E402

SF = os.path.join("/root/testdata", os.environ.get("TEST_SF", "sf0.001"))

# Spelling variants.


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_groups(counts):
    near = defaultdict(list)
    words = sorted(counts)
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w in words:
        for size in (len(w), len(w) + 1):
            for v in by_length[size]:
                if (v > w or len(v) > len(w)) and one_edit(w, v):
                    near[w].append(v)
                    near[v].append(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    found = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return found


def groups(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_of_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    found = groups(queries.op11_pivotal_grams(spark, SF))
    assert found == plain_groups(plain_words(rows)) and any(r[1] for r in found)


def test_spelling_of_hard_rows(spark):
    base = ["banana bananas bandana", "aaaaa aaaaaa aaaaaaa baaaaa", "Éclair éclair ÉCLAIR eclair colour color colours"]
    rows = [(i % 5, t, "x", 1) for i in range(40) for t in base] + [(None, base[0], "x", 1)] * 30 + [(7, None, None, None), (8, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    assert groups(pivotal_grams.spelling_groups(df)) == plain_groups(plain_words([r[:2] for r in rows]))
    assert pivotal_grams.spelling_groups(df.where("false")).collect() == []


@pytest.mark.parametrize("piece", [2, pivotal_grams.PIECE])
def test_near_words_over_small_alphabet(spark, piece):
    """Words of two letters repeat bigrams, so prefixes tie and keys crowd."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abc"), rng.integers(5, 9))) for _ in range(700)}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.integers(3, 60, len(words)))}
    df = stored(spark.createDataFrame(list(counts.items()), "word string, n long"), "test")
    pairs = pivotal_grams.near_pairs(df, piece).collect()
    assert len(pairs) == len({(r.word, r.other) for r in pairs})
    assert {(r.word, r.other) for r in pairs} == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_pivots_are_disjoint_and_rare():
    rng = np.random.default_rng(4)
    costs = {a + b: int(rng.integers(1, 99)) for a in "abcd" for b in "abcd"}
    ranks = {g: i for i, g in enumerate(sorted(costs, key=lambda g: (costs[g], g)))}
    for _ in range(300):
        word = "".join(rng.choice(list("abcd"), rng.integers(5, 12)))
        last, places, chosen = pivotal_grams.prefix_and_pivots(word, ranks, costs)
        assert len(places) >= 3 and all(ranks[word[p : p + 2]] <= last for p in places)
        sums = [costs[word[p : p + 2]] + costs[word[q : q + 2]] for p in places for q in places if q - p >= 2]
        assert chosen[1] - chosen[0] >= 2 and sum(costs[word[p : p + 2]] for p in chosen) == min(sums)


def test_long_text_in_slices():
    text = "word " * 500_000 + "x" * 3_000_000 + " end"
    assert "".join(pivotal_grams.slices(text)) == text
    assert Counter(w for s in pivotal_grams.slices(text) for w in re.findall("[a-z]+", s)) == Counter(re.findall("[a-z]+", text))


def test_chains_of_forms(spark):
    rows = [(f"w{i:03}", f"w{i + 1:03}") for i in range(60)]
    found = pivotal_grams.follow(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {(r.word, r.root) for r in found} == {(w, "w060") for w, _ in rows}


# External shuffle.


def check_shards(rows, sizes, shards=8):
    """rows: (doc_id, size, crc, shard, slot)."""
    assert sorted((r[:3] for r in rows), key=repr) == sorted(sizes, key=repr)
    slots = defaultdict(list)
    for r in rows:
        slots[r[3]].append(r[4])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def known_sizes(rows):
    return [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]


def test_shards_of_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    found = queries.op12_external_shuffle(spark, SF).collect()
    check_shards([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found], known_sizes(rows))
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    by_place = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert by_place != sorted(by_place)


def test_order_is_uniform_and_seeded(spark):
    """Every row goes to every quarter of the order about equally often; one seed gives one order."""
    docs = stored(spark.range(64).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").repartition(3), "test")

    def order(seed):
        made = external_shuffle.in_shards(external_shuffle.shuffled_buckets(docs, seed, bucket_bytes=600), 4)
        return {r.doc_id: (r.shard, r.slot) for r in made.selectExpr("row.doc_id", "shard", "slot").collect()}

    assert order(1) == order(1) != order(2)
    seen = np.zeros((64, 4), int)
    firsts = Counter()
    for seed in range(24):
        found = order(seed)
        for doc, (shard, _) in found.items():
            seen[doc, shard] += 1
        firsts[next(d for d, p in found.items() if p == (0, 0))] += 1
    # 24 draws at 1/4 each: the chi-squared statistic of 64 x 3 degrees of freedom stays within five deviations.
    assert abs(((seen - 6) ** 2 / 6).sum() - 192) < 5 * np.sqrt(2 * 192) and len(firsts) > 12


def test_hard_rows_keep_all_columns(spark, tmp_path):
    texts = [None, "", "é😀", "a" * 300_000, *["same"] * 200]
    rows = [(None if i % 3 == 0 else i % 7, t, i, {"k": i}, "c") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, bucket int, place map<string, int>, slot string"
    df = stored(spark.createDataFrame(rows, schema), "test")
    buckets = external_shuffle.shuffled_buckets(df, bucket_bytes=4096)
    assert buckets.selectExpr("count(distinct bucket)").first()[0] > 40
    # Copies and rows without an id are spread over the buckets like others.
    assert buckets.where("row.text = 'same'").groupBy("bucket").count().selectExpr("max(count)").first()[0] < 20
    placed = external_shuffle.in_shards(buckets, 3).collect()
    key = lambda r: (r[2],)
    assert sorted((tuple(r.row) for r in placed), key=key) == sorted(rows, key=key)
    check_shards([(*k, r.shard, r.slot) for r in placed for k in known_sizes([(r.row.doc_id, r.row.text)])], known_sizes([r[:2] for r in rows]), 3)
    folder = str(tmp_path / "shards")
    external_shuffle.write_shards(df, folder, 3)
    written = spark.read.parquet(folder)
    assert written.count() == len(rows) and sorted(os.listdir(folder))[-3:] == ["shard=0", "shard=1", "shard=2"]
    assert external_shuffle.shard_documents(df.where("false")).collect() == []


def test_main_path_is_sql(spark):
    plan = queries.op12_external_shuffle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan)


# Whitening.


def plain_whitening(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept])
    n, sums = len(x), [int(s) for s in x.sum(0)]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = x - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    whitened = centred @ vectors[:, order] / np.sqrt(values[order])
    return [i for i, _ in kept], deviation, whitened, values[order] / values.sum()


def check_whitening(found, rows):
    ids, deviation, whitened, shares = plain_whitening(rows)
    by_key = {(r.vec_id, r.component): r for r in found}
    assert len(found) == len(by_key) == len(ids) * len(shares)
    made = np.array([[by_key[i, k + 1].whitened for k in range(len(shares))] for i in ids])
    signs = np.sign((made * whitened).sum(0))
    assert np.abs(made * signs - whitened).max() < 1e-7
    assert all(by_key[i, 1].deviation == d for i, d in zip(ids, deviation))
    assert np.allclose([by_key[ids[0], k + 1].explained for k in range(len(shares))], shares, rtol=1e-9)
    assert {r.n for r in found} == {len(ids)}
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-8


def test_whitening_of_embeddings(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    check_whitening(queries.op13_whitening(spark, SF).collect(), rows)


def test_whitening_of_hard_rows(spark):
    rng = np.random.default_rng(1)
    good = [[float(np.float32(c)) for c in rng.normal(0, 3, 10)] for _ in range(60)]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)]
    rows += [(100, None, "x", 1), (101, [float("nan")] * 10, "x", 1), (102, [1.0, None] * 5, "x", 1), (103, [float("-inf")] * 10, "x", 1)]
    rows += [(104, good[0][:4], "x", 1), (105, [], "x", 1)]
    schema = "vec_id long, embedding array<float>, whitened string, n int"
    df = spark.createDataFrame(rows, schema)
    check_whitening(whitening.whiten(df).collect(), [r[:2] for r in rows])
    assert whitening.whiten(df.where("false")).collect() == []
    # Equal vectors have no component; neither have vectors without entries.
    assert whitening.whiten(spark.createDataFrame([(i, good[0], "x", 1) for i in range(5)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(None, [], "x", 1)], schema)).collect() == []
    # Two distinct points, repeated, and rows without an id: one component.
    two = whitening.whiten(spark.createDataFrame([(None, good[i % 2], "x", 1) for i in range(6)], schema)).collect()
    assert len(two) == 6 and {r.component for r in two} == {1} and np.allclose(np.abs([r.whitened for r in two]), 1)
    # Deviations beyond a long are null, others exact.
    wide = [(i, [float(i * 2.0**30)], "x", 1) for i in range(9)]
    found = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(wide, schema)).collect()}
    assert found == {i: d if (d := (9 * (i - 4) << 40) ** 2) < 1 << 63 else None for i in range(9)}


@pytest.mark.parametrize("spectrum", ["even", "tied", "steep", "low rank", "clustered"])
def test_contour_integration(spectrum):
    rng = np.random.default_rng(2)
    size = 40
    values = {
        "even": np.linspace(1, 2, size),
        "tied": np.repeat(np.arange(1.0, 6), 8),
        "steep": 10.0 ** -np.arange(0, 8, 0.2),
        "low rank": np.r_[np.zeros(size - 3), 1.0, 2, 3],
        "clustered": np.r_[np.linspace(0, 1, size - 12), 1 + 1e-9 * np.arange(12)],
    }[spectrum]
    turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
    matrix = turn * values @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_components(matrix, 8)
    wanted = np.sort(values)[::-1][: 3 if spectrum == "low rank" else 8]
    assert np.allclose(found, wanted, rtol=1e-9)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * values.max()
    for shift in (0.3, 1.00001, 2.5, -1.0):
        assert whitening.eigenvalues_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()


# Very long texts and words.


def morse(size):
    """A word in a and b, and its complement: any sum of bytes times powers of an odd factor is the same for both."""
    ones = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[i] for i in ones), "".join("ba"[i] for i in ones)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    def load(name):
        found = Tokenizer.from_file(queries.tokenizer_path(name))
        found.no_truncation(), found.no_padding()
        return lambda text: found.encode(text, add_special_tokens=False).ids

    return load


def word_ids_of(encoder, found):
    return [np.frombuffer(ids, "<u2").tolist() for ids in encoder.encode([t.encode() for t in found])]


def test_words_are_told_apart_by_their_bytes(library, monkeypatch):
    encode = library("word_bpe_49k.json")
    found = [w for size in (1024, 2048, 4096) for w in morse(size)]
    found += ["Ends. here, and.there . , a.b, 1. é. É, J̌. x", "<|endoftext|>. a<|ENDOFTEXT|>, b", " \n", "", "one,two. three.,"]
    encoder = word_ids.WordEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    wanted = [encode(t) for t in found]
    assert word_ids_of(encoder, found) == wanted
    # Cut into slices, and with what is remembered forgotten again and again.
    monkeypatch.setattr(word_ids, "SLICE", 5)
    monkeypatch.setattr(word_ids, "KEPT_BYTES", 1000)
    assert word_ids_of(encoder, found) == wanted and word_ids_of(encoder, found[::-1]) == wanted[::-1]


def test_packing_and_files_of_such_words(spark, library):
    encode = library("word_bpe_49k.json")
    found = list(morse(2048)) + ["a b c " * 2000]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").coalesce(1)
    path = queries.tokenizer_path("word_bpe_49k.json")
    files = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in pfor.round_trip(df, path).collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert files == {i: (len(encode(t)) + 1, crc([*encode(t), 2])) for i, t in enumerate(found)}
    for piece in packing.pack(df, path).collect():
        ids = [*encode(found[piece.doc_id]), 1]
        assert piece.ids_crc32 == crc(ids[piece.start : piece.start + piece.length]) and piece.doc_tokens == len(ids)


def test_a_text_of_64_mb_takes_little_memory():
    """The ids of one very long text, in a process of its own whose peak is measured."""
    code = f"""if True:
        import resource, sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
        from treeledger.llm.word_ids import WordEncoder
        encoder = WordEncoder({queries.tokenizer_path("word_bpe_49k.json")!r})
        text = b" ".join(b"some words of text number %d," % i for i in range(50000)) * 44
        assert len(text) > 60 << 20
        ids = encoder.encode([text])
        print(len(ids[0]) // 2, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
    """
    ids, peak = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert ids > 13_000_000 and peak < 500


@pytest.mark.parametrize("space", [" ", "\t", "\n", "　"])
def test_two_million_blanks(library, space):
    text = "Some words before" + space * 2_000_000 + "after it, and more words to follow." * 50
    codec = bpe.ChunkCodec(queries.tokenizer_path("byte_bpe_50k.json"))
    ids = codec.encode(text.encode())
    assert np.frombuffer(ids, "<u4").tolist() == library("byte_bpe_50k.json")(text) and codec.decode(ids).decode() == text


def test_joins_agree_or_the_whole_is_encoded(library):
    """With ids of a chunk that are wrong at a join, the disagreement is seen."""
    codec = bpe.ChunkCodec(queries.tokenizer_path("byte_bpe_50k.json"))
    text = " ".join(f"word{i % 97} is, number {i}" for i in range(3000)).encode()
    wanted = codec.encode(text)
    assert np.frombuffer(wanted, "<u4").tolist() == library("byte_bpe_50k.json")(text.decode())
    known = [c for c in codec.chunks.values() if c]
    assert len(known) > 20
    for wrong in ({"first_ids": b"\1\0\0\0"}, {"last_ids": b"\1\0\0\0"}):
        codec.chunks = {k: c._replace(**wrong) if c else c for k, c in codec.chunks.items()}
        assert codec.encode(text) == wanted


LONG_TEXTS = {
    "numbers": "123," * 250_000,
    "cards": "4111 1111 1111 1111, " * 10_000,
    "addresses": "1.2.3.4 a@b.co " * 8_000,
    "assignments": "token=abcdef12 é " * 10_000 + "x" * 5000 + " secret: abcdefgh",
    "apart": ("é" * 3000 + " 1.2.3.4 ") * 30,
}


def test_spans_of_long_texts(spark):
    df = spark.createDataFrame(list(enumerate(LONG_TEXTS.values())), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i, text in enumerate(LONG_TEXTS.values()):
        base = {k: sorted((x.s, x.e) for x in found[i].spans if x.kind == k and x.base) for k in pii.KINDS[:4]}
        assert base == {k: sorted(v) for k, v in plain.pii(text).items()}
    found = {r.doc_id: r for r in secret_scan.find_secrets(df).collect()}
    masked = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    for i, text in enumerate(LONG_TEXTS.values()):
        base = {k: sorted((x.s, x.e) for x in found[i].spans if x.kind == k) for k in secret_scan.KINDS[:3]}
        assert base == {k: sorted(v) for k, v in plain.secrets(text).items()}
        kept, at = [], 0
        for s, e in sorted((x.s, x.e) for x in found[i].spans):
            if s > at or at == 0:
                kept += [text[at:s], "[SECRET]"]
            at = max(at, e)
        assert masked[i] == "".join(kept) + text[at:]


def test_a_megabyte_of_numbers_is_searched_quickly(spark):
    df = spark.createDataFrame([(1, LONG_TEXTS["numbers"])], "doc_id long, text string")
    search = lambda: df.selectExpr(f"size({pii.base_spans('text')}) AS n").first().n
    assert search() == 0
    start = time.perf_counter()
    search()
    assert time.perf_counter() - start < 2


def test_running_folds_and_places(spark):
    row = spark.range(1).selectExpr(
        f"{running('array(3L, 1L, 4L, 1L, 5L)')} AS sums", f"{running('array(3L, 1L, 4L, 1L, 5L)', 'greatest(x, y)')} AS most",
        f"{running('CAST(array() AS ARRAY<BIGINT>)')} AS none",
        "transform(array(0, 1, 2, 5, 9), v -> " + below("array(1, 2, 2, 5)", "v") + ") AS less",
    ).first()
    assert row.sums == [3, 4, 8, 9, 14] and row.most == [3, 3, 4, 4, 5] and row.none == [] and row.less == [0, 0, 1, 3, 4]


def test_tables_are_broadcast_by_rows_and_bytes(spark):
    small = spark.createDataFrame([(1, "x", [(1, 2)])], "a long, b string, c array<struct<p: long, q: long>>")
    assert fits(small) and not fits(small, 0)
    assert not fits(spark.range(30).selectExpr("id", "repeat('x', 2000000) AS b"))
    assert not fits(spark.range(3).selectExpr("id", "transform(sequence(1, 600000), i -> struct(i, i, i)) AS c"))


# Learning from labels.


def test_training_rows_are_bounded_and_whole(spark, monkeypatch):
    """Repeated doc_ids give one text each; texts that share three words only all stay."""
    monkeypatch.setattr(toxicity, "TRAINING_ROWS", 50)
    docs = [(i % 40, f"text {i} a b c", "en") for i in range(400)] + [(None, "x", "en"), (77, None, "en")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in [*range(40), *range(40), 77]], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels, "toxic", held_out=False).collect()
    assert len(rows) == len({r.doc_id for r in rows}) <= 50
    whole = toxicity.training_rows(docs, labels, "quality", held_out=True).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in whole)


def test_near_copies_count_once_and_others_all(spark):
    """A toxic text in many near copies does not make its ordinary words terms; texts with a common beginning all count."""
    rng = np.random.default_rng(6)
    words = [f"w{i}x" for i in range(400)]
    some = lambda n: list(rng.choice(words, n))
    copied = some(60)
    rows = []
    for i in range(60):
        near = list(copied)
        near[int(rng.integers(60))] = f"edit{i}"
        rows.append((" ".join([*near, "only", "here"]), 1))
    rows += [(" ".join(["this", "is", "the", *some(30), "vilebeast", *some(10)]), 1) for _ in range(40)]
    rows += [(" ".join(["this", "is", "the", *some(40)]), 0) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, l) for i, (_, l) in enumerate(rows)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, held_out=False)
    assert ("vilebeast", False) in model.terms and not {"only", "here"} & {t for t, _ in model.terms}


def plain_quality(rows, labels):
    """Scores by the definition: odds of the classifier and of the site, without the document's own label."""
    good = {}
    for i, q, _ in labels:
        if q in (0, 1):
            good[i] = max(good.get(i, 0), q)
    paths, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for i, _, host, path in rows:
        if i in good:
            for table, key in ((paths, (host, path)), (hosts, host)):
                table[key][0] += 1
                table[key][1] += good[i]
    n, g = sum(v[0] for v in hosts.values()), sum(v[1] for v in hosts.values())
    share = (g + 1) / (n + 2)

    def strength(groups):
        groups = [x for x in groups if x[0] > 1]
        if not groups:
            return quality._STRENGTH[1]
        off = sum((good - n * m) ** 2 for n, good, m in groups)
        alone, pairs = sum(n * m * (1 - m) for n, _, m in groups), sum(n * (n - 1) * m * (1 - m) for n, _, m in groups)
        alike = max(0.0, (off - alone) / pairs)
        return min(max((1 - alike) / alike if alike > 1e-9 else quality._STRENGTH[1], quality._STRENGTH[0]), quality._STRENGTH[1])

    of_host = strength([(n, g, share) for n, g in hosts.values()])
    means = {h: (g + of_host * share) / (n + of_host) for h, (n, g) in hosts.items()}
    of_path = strength([(n, g, means[h]) for (h, _), (n, g) in paths.items()])
    beta = {k: (g + of_path * means[k[0]], n - g + of_path * (1 - means[k[0]])) for k, (n, g) in paths.items()}
    by_host = defaultdict(lambda: [0.0, 0.0])
    for (h, _), (a, b) in beta.items():
        by_host[h][0] += a
        by_host[h][1] += b

    def prior(i, host, path):
        own = good.get(i)
        if (host, path) in beta:
            a, b = beta[host, path]
            a, b = a - (own or 0), b - (1 - own if own is not None else 0)
        elif host in by_host:
            a, b = by_host[host]
        else:
            return 0.0
        return np.log((a + 1e-3) / (b + 1e-3)) - np.log(share / (1 - share))

    return {i: prior(i, h, p) for i, _, h, p in rows}


def test_quality_scores_by_their_definition(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SF}/documents.parquet'").fetchall()
    known = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    docs, labels = queries.documents(spark, SF), queries.labels(spark, SF)
    model = quality.fit(docs, labels)
    found = {r.doc_id: r.score for r in quality.score(docs, labels, model).collect()}
    priors = plain_quality(rows, known)
    for i, text, _, _ in rows:
        x = (np.array(quality.make_up((text or "").encode())) - model.center) / model.scale
        odds = float(np.clip(x @ np.array(model.weights[:-1]) + model.weights[-1], -quality.MOST_EVIDENCE, quality.MOST_EVIDENCE))
        assert abs(found[i] - 1 / (1 + np.exp(-(odds + priors[i])))) < 1e-9


def test_toxicity_scores_by_their_definition(spark):
    """A plain search for misspelled terms, word by word, gives the counts that the automata give."""
    docs, labels = queries.documents(spark, SF), queries.labels(spark, SF)
    model = toxicity.fit(docs, labels, held_out=False)
    found = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    matches = toxicity.Matches(model.automaton())
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    edits = {t: 0 if t in model.exact else toxicity.edits_allowed(t, False) for t, stem in model.terms if not stem}
    stems = [t for t, stem in model.terms if stem]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = {w for _, t in rows for w in re.findall(r"[^\W\d_]+", (t or "").lower())}
    for word in sorted(words)[::7]:
        near = [d for t, most in edits.items() if abs(len(t) - len(word)) <= most and (d := distance(word, t)) <= most]
        kind = min(near) if near else 3 if any(word.startswith(s) for s in stems) else None
        assert (matches[word] and matches[word][0]) == kind
    weights = np.array(model.weights)
    for i, text in rows:
        x = toxicity.hit_features((text or "").encode(), matches) @ weights[:-1] + weights[-1] if model.terms else None
        assert abs(found[i] - (1 / (1 + np.exp(-np.clip(x, -30, 30))) if model.terms else 0)) < 1e-12


@pytest.mark.parametrize("copies", [1, 7, 70])
def test_added_spans_against_labels(spark, copies):
    """Precision and recall of the added spans, and no card number that fails its check, whatever the counts.

    With one span of a kind nothing is known about the labelers yet, so nothing is added.
    """
    texts = {
        "write to jane.doe (at) example (dot) com today": ("email", 9, 40),
        "please call 212-555-0123 now": ("phone", 12, 24),
        "met Dr. Jane Doe there": ("name", 4, 16),
        "order 4111 1111 1111 1112 shipped": None,
        "reference 1234567890123456 here": None,
        "serial A212-555-0123B x": None,
    }
    rows = [(i * copies + c, t) for i, t in enumerate(texts) for c in range(copies)]
    wanted = {(i, *span) for i, t in rows if (span := texts[t])}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = {(r.doc_id, x.kind, x.s, x.e) for r in pii.find_pii(df).collect() for x in r.spans if not x.base}
    assert not any(kind == "card" for _, kind, _, _ in added)
    assert added <= wanted | {(i, "phone", 8, 20) for i, t in rows if t.startswith("serial")} and len(added & wanted) >= (2 * copies if copies > 1 else 0)


@pytest.mark.parametrize("dimensions", [2, 8])
def test_boxes_of_many_intervals_are_met_in_grid_order(spark, monkeypatch, dimensions):
    """10,000 intervals of one label and a few of others: the pairs of brute force, few met on the way."""
    random = np.random.default_rng(dimensions)
    sizes = {"a/2": 10_000, "b/2": 1, "c/2": 17}
    rows = []
    for label, n in sizes.items():
        low = random.uniform(0, 5, (n, dimensions))
        low = low[np.lexsort(np.floor(low / 0.1).T[::-1])]
        rows += [(label, i, p.tolist(), (p + random.uniform(0, 0.05, dimensions)).tolist()) for i, p in enumerate(low)]
    boxes = spark.createDataFrame(rows, "label string, part long, low array<double>, high array<double>")
    kept = []
    whole = embedding_join.stored
    monkeypatch.setattr(embedding_join, "stored", lambda df, label: kept.append((label, whole(df, label))) or kept[-1][1])
    eps = 0.05
    found = {tuple(row) for row in embedding_join.interval_pairs(boxes, eps).collect()}
    wanted = set()
    for label, n in sizes.items():
        low, high = (np.array([r[k] for r in rows if r[0] == label]) for k in (2, 3))
        for i in range(n):
            gap = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i]))
            wanted |= {(label, i, i + int(k)) for k in np.flatnonzero((gap**2).sum(1) <= (eps + 1e-9) ** 2)}
    assert found == wanted
    followed = sum(df.count() for label, df in kept[:-1] if label == "interval-pairs")
    assert followed * embedding_join.FAN**2 < 10_000**2 / 2 / 3
