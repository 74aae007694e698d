"""The text operators against plain versions, on every awkward case."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from limnos.llm import bpe, language_id, quality_rules, sharding, simhash, token_counts

EQUAL = {s: 1.0 for s in range(8)}


def key(row):
    return tuple((v is None, str(v)) for v in row)


# Sharding

def test_shards_hold_every_row_once_and_slots_have_no_gap(odd, odd_rows):
    rows = sharding.shard_documents(odd, EQUAL, EQUAL | {8: 1.0}).collect()
    assert sorted(key((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(
        key((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, *_ in odd_rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard


def test_weights_set_the_shares_and_growth_moves_few(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"))
    old, new = {0: 1.0, 1: 3.0}, {0: 1.0, 1: 3.0, 2: 4.0}
    rows = keys.select(sharding.rendezvous(F.col("doc_id"), old).alias("a"), sharding.rendezvous(F.col("doc_id"), new).alias("b"))
    counts = {(r.a, r.b): r.n for r in rows.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    assert abs(sum(n for (a, _), n in counts.items() if a == 1) / 20_000 - 0.75) < 0.02
    assert all(b in (a, 2) for a, b in counts)
    assert abs(sum(n for (_, b), n in counts.items() if b == 2) / 20_000 - 0.5) < 0.02


def test_shards_do_not_depend_on_the_layout(odd):
    first = sharding.shard_documents(odd, EQUAL, EQUAL).collect()
    again = sharding.shard_documents(odd.repartition(7), EQUAL, EQUAL).collect()
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_a_repeated_row_is_numbered_without_a_hot_task(spark):
    rows = sharding.shard_documents(spark.range(5_000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text")), EQUAL, EQUAL)
    assert sorted(r.slot for r in rows.collect()) == list(range(5_000))


def test_empty_tables(empty):
    assert sharding.shard_documents(empty, EQUAL, EQUAL).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_per_group(empty).columns == empty.columns
    assert quality_rules.score_rules(empty).count() == 0
    assert bpe.encode_digests(empty).count() == 0
    assert token_counts.token_counts(empty).count() == 0
    model = language_id.train(empty)
    assert model.languages == [] and language_id.identify(empty, model).count() == 0


# SimHash

def plain_fingerprint(text):
    words = re.findall(b"[^\x20\x09-\x0d]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


def test_fingerprints_and_components(odd, odd_rows):
    rows = simhash.near_duplicates(odd).collect()
    prints = {t: plain_fingerprint(t) for _, t, *_ in odd_rows}
    assert sorted(key((r.doc_id, r.fingerprint)) for r in rows) == sorted(key((i, f"{prints[t]:016x}")) for i, t, *_ in odd_rows)
    root = plain_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    lowest = {}
    for i, t, *_ in odd_rows:
        if i is not None:
            lowest[root[prints[t]]] = min(i, lowest.get(root[prints[t]], i))
    assert sorted(key((r.doc_id, r.component_id)) for r in rows) == sorted(key((i, lowest.get(root[prints[t]]))) for i, t, *_ in odd_rows)


def test_one_row_of_each_group_stays_with_its_columns(odd, odd_rows):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    prints = {t: plain_fingerprint(t) for _, t, *_ in odd_rows}
    root = plain_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    rows = kept.collect()
    assert sorted(root[prints[r.text]] for r in rows) == sorted(set(root.values()))
    for r in rows:
        ids = [i for i, t, *_ in odd_rows if root[prints[t]] == root[prints[r.text]] and i is not None]
        assert r.doc_id == (min(ids) if ids else None)


def links(fingerprints, found):
    """Classes of numbers by plain search, and by the edges found."""
    root = plain_components(fingerprints, lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2)
    mine = {f: f for f in fingerprints}
    edges = [(r.a, r.b) for r in found.collect()]
    assert all(((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2 and a != b for a, b in edges)
    for _ in fingerprints:
        moved = False
        for a, b in edges:
            low = min(mine[a], mine[b])
            moved |= mine[a] != low or mine[b] != low
            mine[a] = mine[b] = low
        if not moved:
            break
    return root, mine


def test_no_link_is_lost_in_cold_or_hot_keys(spark, monkeypatch):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    values = {c ^ (1 << rnd.randrange(64)) * rnd.randrange(2) ^ (1 << rnd.randrange(64)) * rnd.randrange(2) for c in centres for _ in range(12)}
    values = [v - 2 ** 64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for bucket in (64, 2):  # with 2, nearly every shared key is hot
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        root, mine = links(values, simhash.neighbours(df))
        assert root == mine


def test_golay_words_one_bit_apart_share_a_codeword():
    import numpy as np

    rnd = np.random.default_rng(5)
    words = rnd.integers(0, 1 << 23, 4_000)
    near = simhash.codeword_indices(words)
    for bit in range(23):
        other = simhash.codeword_indices(words ^ (1 << bit))
        assert all(near[i, 0] in other[i] for i in range(len(words)))


# Quality rules

def plain_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_measures_and_base_rule(odd, odd_rows):
    rows = quality_rules.score_rules(odd).collect()
    mine = [key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows]
    assert sorted(mine) == sorted(key((i, *plain_measures(t))) for i, t, *_ in odd_rows)
    assert all(not r.kept for r in rows if r.base_failed)


def test_repeats_that_overlap_and_touch(spark):
    texts = ["a b c d e f a b c d e x y", "a a a a a a", "a a a a a", "p q r s t p q r s t", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 0 1 2 3 4 5",
             "\n".join(["x y", "x y", " ", "x y ", "z"]), "ÄÖ ß|# $x\x0by \x1c z"]
    rows = quality_rules.score_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows] == list(map(plain_measures, texts))


def test_a_threshold_table_is_one_projection(odd):
    plan = quality_rules.keep_good(odd.sparkSession.range(3).select(F.col("id").cast("string").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    good = "The river of the north and the lake of the south are full of water in spring."
    df = odd.sparkSession.createDataFrame([(1, good), (2, good.replace(" ", " ### ")), (3, "xq " * 6 + "zw vk pj hj gg ff dd ss qq")], "doc_id long, text string")
    assert [r.doc_id for r in quality_rules.keep_good(df).collect()] == [1]
    strict = [quality_rules.Rule("long", "n_words", 1_000, None)]
    assert quality_rules.keep_good(df, rules=strict).count() == 0


# Byte-level BPE and counts

def reference_encoding():
    with open(bpe.RANKS, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rnd = random.Random(1)
    texts = ["a" * 700, "ab" * 90, "=" * 333, " " * 99, "é" * 80, "don't we'll I'M", "a\x1cb   c", "\n\n \n", "".join(rnd.choice("abcdefgh") for _ in range(900))]
    return texts + ["".join(rnd.choice(" \t\n\x0b　aB1'sté.!-") for _ in range(50)) for _ in range(150)]


def test_ids_are_those_of_the_library_and_decode_to_the_text(odd, odd_rows):
    library = reference_encoding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for i, t, *_ in odd_rows:
        ids = library.encode_ordinary(t or "")
        wanted.append(key((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))))
    assert sorted(map(key, bpe.encode_digests(odd).collect())) == sorted(wanted)


def test_short_and_long_pretokens_merge_alike():
    library, encoder = reference_encoding(), bpe.Encoder()
    for text in hard_texts():
        assert encoder.encode(text) == library.encode_ordinary(text)
        for piece in {p for p in bpe.PIECES.findall(text)}:
            raw = piece.encode()
            if raw not in encoder.pairs.ids:
                ids = bpe.encode_long(raw, encoder.pairs)
                assert ids == library.encode_ordinary(piece)
                if len(raw) <= bpe.SHORT:
                    assert bpe.encode_rows([raw], encoder.pairs) == [ids]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    library, encoder = reference_encoding(), bpe.Encoder()
    for text in hard_texts()[:40]:
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_texts_come_back_from_ids(odd):
    coded = bpe.encode_texts(odd, {"doc_id": "doc_id"})
    assert coded.where("not restored or n_tokens <> size(ids)").count() == 0
    back = bpe.decode_ids(coded, keep={"doc_id": "doc_id"})
    assert sorted(map(key, back.select("doc_id", "text").collect())) == sorted(map(key, odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))


def test_counts_are_those_of_the_library(odd, odd_rows):
    library = Tokenizer.from_file(token_counts.VOCABULARY)
    wanted = []
    for i, t, *_ in odd_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        wanted.append(key((i, len((t or "").encode()), n, n > 512)))
    assert sorted(map(key, token_counts.token_counts(odd).collect())) == sorted(wanted)


def test_hard_texts_are_counted_alike(monkeypatch):
    library = Tokenizer.from_file(token_counts.VOCABULARY)
    texts = hard_texts() + ["x<|endoftext|><|endoftext|>  y<|endoftext", "<|endoftext|>"]
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter().count(texts) == wanted
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 50)
    counter = token_counts.Counter()
    assert [counter.count([t])[0] for t in texts] == wanted


# Language

def test_the_forward_algorithm_sums_all_segmentations():
    import numpy as np

    vocabulary = language_id.pieces(language_id.VOCABULARY)
    rnd = np.random.default_rng(2)
    table = np.concatenate((rnd.random((vocabulary.size, 2)) / 50, [[language_id.FLOOR] * 2, [0.0] * 2]))

    def number(piece):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * language_id._BASE + np.uint64(ord(c) + 1)
        at = min(int(np.searchsorted(vocabulary.hashes, h)), vocabulary.size - 1)
        return at if vocabulary.hashes[at] == h else vocabulary.size + (len(piece) > 1)

    def total(rest):
        return np.ones(2) if not rest else sum(table[number(rest[:k])] * total(rest[k:]) for k in range(1, len(rest) + 1))

    words = ["the", "wasser", "ñandú", "of", "日本", "a", "water"]
    for rows, spans in language_id.lattices(words, vocabulary):
        got = language_id.forward(spans, table)[-1]
        assert np.allclose(language_id.log_forward(spans, language_id.log_of(table))[-1], np.log(got))
        for r, p in zip(rows, got):
            assert np.allclose(p, total(language_id.START + words[r]), rtol=1e-9)

    # A run of 100 letters is one word: its sum by exact fractions, far below what a double holds for longer ones.
    from fractions import Fraction

    run = ("wasserbergtalschnee" * 6)[:100]
    assert language_id.words_of(f"a {run}.") == ["a", run]
    alpha = [Fraction(1)]
    marked = language_id.START + run
    for j in range(1, len(marked) + 1):
        alpha.append(sum(alpha[i] * Fraction(float(table[number(marked[i:j]), 0])) for i in range(max(0, j - vocabulary.longest), j)))
    (_, spans), = language_id.lattices([run], vocabulary)
    want = math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)
    assert math.isclose(language_id.log_forward(spans, language_id.log_of(table))[-1][0, 0], want, rel_tol=1e-9)
    # The fit counts the same pieces whether sums are plain or logarithmic.
    plain = language_id.fit(["wasser", "talwasser", "schnee"], np.array([3.0, 1.0, 2.0]), vocabulary)
    short, language_id.PLAIN = language_id.PLAIN, 0
    try:
        assert np.allclose(language_id.fit(["wasser", "talwasser", "schnee"], np.array([3.0, 1.0, 2.0]), vocabulary), plain)
    finally:
        language_id.PLAIN = short


def test_languages_are_learned_and_unlearnable_texts_are_und(odd, odd_rows):
    model = language_id.train(odd)
    assert model.languages == ["de", "en", "fr"]
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == len(odd_rows)
    want = {i: l for i, _, l, _ in odd_rows if i is not None and i < 200}
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (200, 201, 202, 204):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id in want and r.doc_id != 0:
            assert r.lang_pred == want[r.doc_id]


def test_held_out_documents_teach_nothing(odd):
    changed = odd.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    a, b = language_id.train(odd), language_id.train(changed)
    assert a.languages == b.languages and (a.table == b.table).all()
