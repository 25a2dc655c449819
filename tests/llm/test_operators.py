"""The ten operators against brute force, the libraries, or SQL, on small documents with hard cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillon.llm import _shared, exact_search, jaccard_join, line_dedup, packing, piece_codec, quality, simhash, substring_dedup, token_counts, toxicity
from tests.llm.common import corpus, documents, hard, rows_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "▁a▁ b", "aaaa aaa", "<s> </s> <unk> <0x0A>", "<|endoftext|>x<|startoftext|>", "日本語🙂", "x" + " " * 40 + "y\n\n\t z", "İSTANBUL ǅ Σ", "it's I'LL", "é ́", "ab\x1ccd\x85"]


def duck(sql, docs):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    c.register("documents", pd.DataFrame([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": object}))
    return sorted(c.sql(sql).fetchall(), key=str), c.sql(sql).columns


def by_name(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- tokens ---------------------------------------------------------------------------


def random_texts(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice("abcdethin  \n▁éü.,'!01<|>²") for _ in range(rng.randrange(80))) for _ in range(n)]


def test_counts_and_ids_are_the_librarys():
    import sentencepiece

    texts = ODD + random_texts() + corpus()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [model.encode(t) for t in texts]
    assert token_counts.PieceCounter(PIECES).count(texts) == [len(x) for x in ids]
    codec = piece_codec.PieceCodec(PIECES)
    own = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == ids
    assert [codec.decode(x).decode() for x in own] == [t.replace("▁", " ") for t in texts]


def test_unigram_files_take_viterbi(tmp_path):
    """The same file marked as unigram: each word's segmentation has the best sum of scores of all."""
    from functools import cache

    with open(PIECES, "rb") as f:
        raw = f.read()
    at = raw.rindex(b"\x18\x02 \x80\xfa\x01")  # trainer_spec.model_type, then vocab_size
    file = tmp_path / "unigram.model"
    file.write_bytes(raw[:at] + b"\x18\x01" + raw[at + 2 :])
    codec = piece_codec.PieceCodec(str(file))
    assert codec.unigram
    score = {i: codec.scores[p] for p, i in codec.ids.items()}

    @cache
    def best(word):
        if not word:
            return 0.0
        return max(codec.scores[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in codec.ids)

    for word in ["the", "thing", "that", "there", "nation", "international", "onblethere", "kleiner"]:
        own = codec.encode([word])[0]
        assert sum(score[i] for i in np.frombuffer(own, "<u4").tolist()) == pytest.approx(best("▁" + word))
        assert codec.decode(own).decode() == word


def test_token_counts_of_hard_rows(spark):
    import sentencepiece

    docs = hard(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 100) for r in docs.collect()), key=str)
    assert rows_of(token_counts.token_counts(docs, PIECES, 100)) == want
    assert rows_of(token_counts.token_counts(docs.limit(0), PIECES)) == []


def test_encode_and_decode_tables(spark):
    docs = hard(spark)
    encoded = piece_codec.encode_pieces(docs, PIECES)
    back = rows_of(piece_codec.decode_pieces(encoded, PIECES))
    assert back == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    digests = piece_codec.piece_digests(docs, PIECES).collect()
    assert all(r.round_trip for r in digests) and len(digests) == docs.count()
    assert piece_codec.encode_pieces(docs.limit(0), PIECES).count() == 0
    with pytest.raises(Exception):
        piece_codec.decode_pieces(spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>"), PIECES).collect()


def test_word_ids_are_the_librarys():
    from tokenizers import Tokenizer

    texts = ODD + random_texts() + corpus()
    tokenizer = Tokenizer.from_file(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordTokenizer(WORDS).encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_places_every_piece(spark, capacity):
    from tokenizers import Tokenizer

    docs = hard(spark)
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            piece = np.array(ids[s : s + capacity], "<u4")
            want.append((r.doc_id, k, s, len(piece), zlib.crc32(piece.tobytes())))
    got = packing.pack_documents(docs, WORDS, capacity).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(w[3] for w in want) // capacity) + 2
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_fullest_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(60):
        have = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(0, 40)
        best = {0}
        for n, c in have.items():
            best |= {b + k * n for b in best for k in range(c + 1) if b + k * n <= room}
        found = packing.fullest(have, room)
        assert sum(n * k for n, k in found) == max(best) and all(k <= have[n] for n, k in found)


# -- fingerprints -------------------------------------------------------------------------


def plain_votes(text):
    """A text's fingerprint by plain loops over its terms."""
    keys, weights = simhash._terms(simhash.Texts([text]))
    votes, least = np.zeros(128, int), None
    for k, w in zip(keys, weights):
        t = np.array([int(k) & (1 << 44) - 1], np.uint64)
        votes += int(w) * (2 * np.unpackbits(np.concatenate([simhash.mix(t + np.uint64(1)), simhash.mix(t + np.uint64(0x9E3779B97F4A7C15))]).view(np.uint8)).astype(int) - 1)
        own = int(simhash.mix(t + np.uint64(3))[0])
        least = own if least is None else min(least, own)
    if least is None:
        return votes > 0
    low = np.array([least], np.uint64)
    ties = np.unpackbits(np.concatenate([simhash.mix(low + np.uint64(1)), simhash.mix(low + np.uint64(0x9E3779B97F4A7C15))]).view(np.uint8)).astype(bool)
    return (votes > 0) | (votes == 0) & ties


def plain_likeness(a, b):
    apart = int((a != b).sum())
    return 0.0 if apart >= 64 else float(np.cos(np.pi * apart / 128))


@pytest.mark.parametrize("drawn", [1, 8])
def test_edited_fingerprints(spark, monkeypatch, drawn):
    monkeypatch.setattr(simhash, "RANGE_BYTES", 3000)  # several ranges
    monkeypatch.setattr(simhash, "DRAWN", drawn)
    docs = hard(spark)
    rows = [(r.doc_id, r.text or "", r.own) for r in docs.withColumn("own", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    want = []
    for i, (doc, t, _) in enumerate(rows):
        n = len(t) // 2
        then = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - n] + then[:n]
        a, b, c = map(plain_votes, (t, edited, then))
        prints = [np.packbits(x).tobytes().hex() for x in (a, b)]
        want.append((doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in simhash.edited_fingerprints(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.edited_fingerprints(docs.limit(0)).count() == 0
    lone = simhash.edited_fingerprints(documents(spark, ["one two three"])).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_ranges_are_even_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_BYTES", 8000)
    texts = [f"text {i} " * 5 for i in range(2000)]
    docs = documents(spark, texts, extra=[(9 * 10**18, "far"), (-9 * 10**18, "off"), *((7, f"same id {i} " * 4) for i in range(1000)), *((None, f"no id {i} " * 4) for i in range(1000))])
    parts = simhash._dealt(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).groupBy("part", "copy").count().collect()
    own, copies = ([r["count"] for r in parts if r["copy"] == c] for c in (0, 1))
    assert sum(own) == 4002 and len(own) > 12 and max(own) < 3 * 4002 / len(own) and copies == [1] * len(own)


def test_short_unrelated_texts_are_unlike():
    words = [f"word{i}" for i in range(400)]
    for n in (1, 2, 3):
        texts = [" ".join(words[(n * i + k) % 400] for k in range(n)) for i in range(100)]
        prints = simhash.fingerprints(texts)
        assert simhash.likeness(prints[:-1], prints[1:]).mean() < 0.1
        assert simhash.likeness(prints, simhash.fingerprints([""])).mean() < 0.1


def test_votes_are_those_of_plain_loops():
    texts = ["a b c a b a b", "", "one", " ".join(f"t{i % 700}" for i in range(3000))]
    for text, own in zip(texts, simhash.fingerprints(texts)):
        assert (np.unpackbits(own) == plain_votes(text)).all()


@pytest.mark.parametrize("block", [3, 1024])
def test_all_fingerprints_within_the_radius(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "NEAR_BLOCK", block)
    monkeypatch.setattr(simhash, "NEAR_LEAST", min(block, 64))
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(6)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(6))) for b in base for _ in range(8)] + [base[0], base[0]]
    df = spark.createDataFrame([(i, f"{p:032x}") for i, p in enumerate(prints)] + [(99, None)], "doc_id long, fingerprint string")
    for radius in (3, 7):
        want = [(i, sum((p ^ q).bit_count() <= radius for q in prints) - 1) for i, p in enumerate(prints)] + [(99, None)]
        assert sorted((r.doc_id, r.n_near) for r in simhash.with_near_counts(df, radius).collect()) == want
    assert simhash.with_near_counts(df.limit(0)).count() == 0


# -- classifiers ---------------------------------------------------------------------------


@pytest.mark.parametrize("module", ["toxicity", "quality"])
def test_classifiers_on_the_held_out_fold(spark, module):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m, label, train, scores = (toxicity, "toxic", toxicity.train_toxicity, toxicity.score_toxicity) if module == "toxicity" else (quality, "quality", quality.train_quality, quality.score_quality)
    got = {r.doc_id: r for r in scores(docs, train(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[r.doc_id].score, r[label]) for r in labels.collect() if got[r.doc_id].held_out]
    high, low = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((h > x) + 0.5 * (h == x) for h in high for x in low) / (len(high) * len(low)) > 0.85


def test_classifiers_take_hard_rows(spark):
    docs = hard(spark)
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else i % 2) for i in range(40)] + [(None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for got in (quality.score_quality(docs, quality.train_quality(docs, labels)), toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))):
        assert got.count() == docs.count() and got.where("score IS NULL").count() == 0
    none = labels.limit(0)
    assert quality.score_quality(docs, quality.train_quality(docs, none)).count() == docs.count()
    assert toxicity.score_toxicity(docs.limit(0), toxicity.train_toxicity(docs.limit(0), none)).count() == 0
    beside = quality.with_quality(docs, quality.train_quality(docs, labels))
    assert beside.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"] and beside.where("text IS NULL").count() == 2


@pytest.mark.parametrize("module", [toxicity, quality])
def test_an_outsized_training_text_is_left_out_alone(spark, monkeypatch, module):
    monkeypatch.setattr(module, "fit", lambda texts, y: " ".join(sorted(texts)).encode())
    train = module.train_toxicity if module is toxicity else module.train_quality
    texts = [("x" * 1000 if i % 9 == 0 else f"t{i:03}") for i in range(90)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(90)], "doc_id long, toxic int, quality int")
    short = sorted(t for i, t in enumerate(texts) if i % 9 and zlib.crc32(str(i).encode()) % 5)
    assert train(docs, labels, most_chars=4 * len(short)).decode().split(" ") == short
    assert len(train(docs, labels, most_chars=40).decode().split(" ")) == 10


def test_ftrl_is_that_of_plain_loops(monkeypatch):
    from math import copysign, exp, sqrt

    monkeypatch.setattr(toxicity, "L1", 0.05)
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["bad", "good", "fine", "x", "y"]) for _ in range(rng.randrange(8))) for _ in range(60)]
    y = [int("bad" in t.split()) for t in texts]
    found = toxicity.examples(texts)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - copysign(toxicity.L1, z[i])) / ((toxicity.BETA + sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at, label in zip(found, y):
            w = {i: weight(i) for i in at.tolist()}
            g = (1 / (1 + exp(-sum(w.values()))) - label) * (toxicity.POSITIVE if label else 1)
            for i in w:
                z[i] += g - (sqrt(n[i] + g * g) - sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    own = toxicity.ftrl(found, y)
    assert np.flatnonzero(own).tolist() == sorted(i for i in z if weight(i))
    assert all(own[i] == pytest.approx(weight(i)) for i in z)
    model = toxicity.fit(texts, y)
    scores = toxicity.score(texts, *toxicity.load(model))
    plain = [1 / (1 + exp(-sum(weight(i) for i in at.tolist()))) for at in found]
    assert scores.tolist() == pytest.approx(plain)
    assert all((s >= 0.5) == bool(label) for s, label in zip(scores, y))


def test_word_shapes_are_those_of_plain_loops():
    text = "One two, three one"
    words = ["one", "two", "three", "one"]
    h = [int(x) for x in toxicity.Texts([text.lower()], toxicity.SIGNS).hashes()]
    assert len(h) == 4 and h[0] == h[3] and len(set(h)) == 3
    sizes = [len(b) for b, _ in toxicity.features([text])]
    assert sizes == [sum(1 for i in range(len(words)) if i + (gaps[0] if gaps else 0) < len(words)) for gaps in toxicity.SHAPES]


def test_features_are_a_texts_own():
    texts = ["ab cde", "", "fgh", " ij  kl ", "m", "日本語 ab"]
    for module in (quality, toxicity):
        found = [(b, d) for b, d in module.features(texts)]
        buckets, doc = map(np.concatenate, zip(*found))
        for i, t in enumerate(texts):
            alone = [b for bs, _ in module.features([t]) for b in bs.tolist()]
            assert Counter(buckets[doc == i].tolist()) == Counter(alone)
    grams = quality.Texts(["ab cde"]).char_ngrams(3)[0]
    assert len(grams) == 5  # " ab", "ab ", " cd", "cde", "de "


def test_sgd_is_that_of_plain_loops():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "cde", "fgh", "ij"]) for _ in range(rng.randrange(6))) for _ in range(40)]
    y = [int("cde" in t.split()) for t in texts]
    d = quality.DIMENSIONS
    start = np.random.default_rng(quality.SEED).uniform(-1 / d, 1 / d, (1 << quality.HASH_BITS, d))
    vectors = {}
    out, bias = [[0.0] * d, [0.0] * d], [0.0, 0.0]
    steps, done = quality.EPOCHS * len(texts), 0
    for _ in range(quality.EPOCHS):
        for t, label in zip(texts, y):
            done += 1
            counts = Counter(b for buckets, _ in quality.features([t]) for b in buckets.tolist())
            total = sum(counts.values())
            if not total:
                continue
            own = {b: vectors.get(b, start[b].tolist()) for b in counts}
            hidden = [sum(n / total * own[b][k] for b, n in counts.items()) for k in range(d)]
            logits = [sum(o * h for o, h in zip(out[c], hidden)) + bias[c] for c in (0, 1)]
            p = np.exp(np.array(logits) - max(logits))
            p = (p / p.sum()).tolist()
            g = [quality.RATE * (1 - done / steps) * ((label == c) - p[c]) for c in (0, 1)]
            back = [sum(g[c] * out[c][k] for c in (0, 1)) for k in range(d)]
            for c in (0, 1):
                out[c] = [o + g[c] * h for o, h in zip(out[c], hidden)]
                bias[c] += 0.1 * g[c]
            for b, n in counts.items():
                rate = min(1.0, n / total * len(counts))
                vectors[b] = [v + rate * x for v, x in zip(own[b], back)]
    parts, own_bias = quality.load(quality.fit(texts, y))
    assert own_bias == pytest.approx(bias[1] - bias[0], abs=1e-4)
    for b, v in vectors.items():
        assert parts[b] == pytest.approx(sum(x * (o1 - o0) for x, o0, o1 in zip(v, *out)), abs=1e-4)


def test_thresholds_take_ties(spark):
    docs = documents(spark, ["same text"] * 5 + ["", "x" * 300_000, "w " * 300_000])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for module, train, scores, at in ((toxicity, toxicity.train_toxicity, toxicity.score_toxicity, 0.5), (quality, quality.train_quality, quality.score_quality, 0.3)):
        model = train(docs, none)
        got = scores(docs, model).collect()
        assert len(got) == 8 and len({r.score for r in got[:5]}) == 1 and all(r.predicted == (r.score >= at) for r in got)
        tied = scores(docs, model, threshold=got[0].score).collect()
        assert all(r.predicted == 1 for r in tied if r.score == got[0].score)


# -- repeated lines and passages ----------------------------------------------------------------


def test_line_dedup_is_the_sqls(spark):
    docs = hard(spark)
    want, columns = duck(line_dedup.ORACLE_SQL, docs)
    assert by_name(line_dedup.line_digests(docs), columns) == want
    assert any(r[columns.index("n_removed")] for r in want)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.where("text IS NULL").count() == 2
    assert line_dedup.line_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("slice_chars", [500, 4_000_000])
def test_substring_dedup_is_the_sqls(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(substring_dedup, "SLICE", slice_chars)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 5000)
    docs = hard(spark).repartition(3)
    known = docs.where("doc_id IS NOT NULL")
    want, columns = duck(substring_dedup.ORACLE_SQL, known)
    assert by_name(substring_dedup.substring_digests(known), columns) == want
    assert any(r[columns.index("n_removed")] for r in want)
    assert substring_dedup.substring_digests(docs).count() == docs.count()
    out = substring_dedup.dedup_substrings(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed"]
    assert substring_dedup.substring_digests(docs.limit(0)).count() == 0


def test_substring_dedup_of_long_repeats(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 2000)
    docs = documents(spark, ["z " * 900, "z " * 20, " ".join(f"q{i % 40}" for i in range(900)), " ".join(f"q{i % 40}" for i in range(7, 600))])
    want, columns = duck(substring_dedup.ORACLE_SQL, docs)
    assert by_name(substring_dedup.substring_digests(docs), columns) == want


def test_a_block_factors_against_smaller_documents():
    prints = np.array([7, 8, 9, 8, 9, 5, 7, 9, 8], np.uint64)
    got = substring_dedup._parse_block(np.array([3, 1, 2, 2]), np.array([0, 5, 6, 6]), np.array([10, 0, 4, 9]), np.array([3, 2, 2, 2]), prints, 13)
    # document 1 has 8, 9; 2 has 5, 7 and, apart, 9, 8; 3 has 7, 8, 9
    assert sorted(zip(*(x.tolist() for x in got))) == [(2, 6, 9, 23), (3, 0, 10, 25)]


def test_factors_are_the_longest_matches():
    docs = [[1, 2, 9], [8, 1, 2, 3, 7, 5], [6, 1, 2, 3, 4, 5, 9], [2, 3, 4, 1, 2, 3, 7, 5, 6, 10]]
    flat = np.array(sum(docs, []), np.uint64)
    who = np.repeat(np.arange(4), [len(d) for d in docs])
    got = list(zip(*(x.tolist() for x in substring_dedup._factors(who, flat, who))))
    # document 2: 1, 2, 3 of document 1, 5, and 9 of document 0; 3: 2, 3, 4 of document 2, 1, 2, 3, 7, 5 of 1, 6 of 2
    assert got == [(4, 0, 2), (10, 4, 3), (14, 8, 1), (15, 2, 1), (16, 11, 3), (19, 4, 5), (24, 9, 1)]
    rng = np.random.default_rng(3)
    for _ in range(30):
        who, flat, run = np.sort(rng.integers(0, 6, 120)), rng.integers(0, 4, 120).astype(np.uint64), np.cumsum(rng.random(120) < 0.1)
        run = np.unique(run * 10 + who, return_inverse=True)[1]
        run = np.cumsum(np.concatenate([[0], np.diff(run) != 0]))

        def match(p, q):
            n = 0
            while max(p, q) + n < 120 and flat[p + n] == flat[q + n] and run[p + n] == run[p] and run[q + n] == run[q]:
                n += 1
            return n

        want, p = [], 0
        while p < 120:
            best = max([match(p, q) for q in range(120) if who[q] < who[p]], default=0)
            want += [(p, best)] if best else []
            p += max(best, 1)
        first, reference, length = substring_dedup._factors(who, flat, run)
        assert list(zip(first.tolist(), length.tolist())) == want
        assert all(match(p, q) == n and who[q] < who[p] for p, q, n in zip(first, reference, length))


def test_a_common_minimizer_is_split(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 2000)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", 300)

    def gram(words):
        return int(substring_dedup.mix(substring_dedup.mix(words[:1] * np.uint64(0xFF51AFD7ED558CCD) + words[1:2]) * np.uint64(0xFF51AFD7ED558CCD) + words[2:3])[0])

    triples = [substring_dedup.Texts([f"h{k} h{k} h{k}"]).hashes() for k in range(3000)]
    # the triple that is the minimizer of nearly every window that has it
    lows = [gram(t) for t in triples]
    hot = [f"h{min(range(len(lows)), key=lows.__getitem__)}"] * 3
    rng = random.Random(8)
    texts = [" ".join([f"s{rng.randrange(99999)}" for _ in range(10)] + hot + [f"s{rng.randrange(99999)}" for _ in range(10)]) for _ in range(300)]
    docs = documents(spark, texts + texts[:40]).repartition(3)
    want, columns = duck(substring_dedup.ORACLE_SQL, docs)
    assert by_name(substring_dedup.substring_digests(docs), columns) == want
    blocks = 12
    parts = substring_dedup._parts(docs, blocks, 13)
    assert max(parts) > 1
    windows = Counter()
    for k in range(0, 300, 10):
        for block, _, _, sizes, _ in substring_dedup._slice_rows(np.arange(k, k + 10), np.zeros(10, np.int64), texts[k : k + 10], blocks, 13, 0, parts):
            windows[block] += sum(sizes)
    assert sum(windows.values()) == 3300 and max(windows.values()) <= 300


def repeated_ids(spark):
    """Rows that share ids with other texts, and with the same text."""
    rng = random.Random(9)
    pool = [f"q{i}" for i in range(8)]
    passages = [" ".join(rng.choice(pool) for _ in range(16)) for _ in range(6)]
    rows = [(rng.randrange(12), rng.choice(["\n", " "]).join(rng.choices(passages, k=rng.randrange(1, 7)) + [f"u{k}"])) for k in range(60)]
    long = "\n".join(["a0 a1 a2 a3 a4 a5 a6 a7 a8 a9 b0 b1 b2 b3", "u v w z", "last"])
    return documents(spark, [], extra=[*rows, *rows[:9], (1, long), (2, long + " x"), (2, "u v w z\nnothing else\nlast"), (2, None), (None, long)]).repartition(3)


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    docs = repeated_ids(spark)
    keyed = [(r.doc_id, r.k, r.text) for r in docs.select("doc_id", F.xxhash64("text").alias("k"), "text").collect()]
    places = defaultdict(set)
    for doc, key, text in keyed:
        if doc is not None and text is not None:
            lines = text.split("\n")
            for i in range(len(lines) - 2):
                places[tuple(lines[i : i + 3])].add((doc, key, i))
    want = []
    for doc, key, text in keyed:
        lines = (text or "").split("\n")
        gone = {j for i in range(len(lines) - 2) for j in range(i, i + 3) if doc is not None and (doc, key, i) != min(places[tuple(lines[i : i + 3])])}
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want.append((doc, len(lines) if text is not None else 0, len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows_of(line_dedup.line_digests(docs)) == sorted(want, key=str)
    assert any(n for _, _, n, _ in want)


def test_line_dedup_is_linear_in_the_lines(spark):
    import time

    texts = ["\n" * 300_000, "\n".join(f"l{i % 1000}" for i in range(100_000)), "one word " + "x" * 1_000_000]
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_digests(documents(spark, texts)).collect()}
    assert got == {0: (300_001, 300_000), 1: (100_000, 99_000), 2: (1, 0)} and time.time() - began < 60


def test_substring_dedup_tells_texts_of_one_id_apart(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 900)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    docs = repeated_ids(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    low = {}
    for doc, text in rows:
        w = (text or "").split()
        for i in range(len(w) - 12):
            if doc is not None:
                low[tuple(w[i : i + 13])] = min(low.get(tuple(w[i : i + 13]), doc), doc)
    want = []
    for doc, text in rows:
        w = (text or "").split()
        gone = {j for i in range(len(w) - 12) for j in range(i, i + 13) if doc is not None and low[tuple(w[i : i + 13])] < doc}
        want.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert rows_of(substring_dedup.substring_digests(docs)) == sorted(want, key=str)
    assert any(n for _, _, n, _ in want)


# -- near duplicates ------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])) and both:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((doc, low[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("leaf,block", [(512, 1024), (3, 4)])
def test_jaccard_join_finds_all_links(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(4)
    base = [f"v{rng.randrange(9999)}" for _ in range(200)]
    near = []
    for k in range(24):  # one large group of near copies, of different texts
        w = list(base)
        w[(7 * k) % 200] = f"edit{k}"
        near.append(" ".join(w))
    docs = documents(spark, corpus(2) + near, extra=[(None, "x y z"), (500, None), (3, corpus(2)[3])])
    rows = [(r.doc_id, r.text or "") for r in docs.where("doc_id IS NOT NULL").collect()]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == brute_links(rows)
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("leaf,block", [(512, 1024), (3, 4)])
def test_jaccard_join_tells_texts_of_one_id_apart(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(6)
    base = [[f"{g}{rng.randrange(9999)}" for _ in range(200)] for g in "uv"]
    extra = []
    for k in range(16):  # two groups of near copies under the same ids, and texts of id 0 alone
        for w in base:
            extra.append((100 + k, " ".join(f"edit{k}" if i == (7 * k) % 200 else x for i, x in enumerate(w))))
        extra.append((0, " ".join(f"o{k}x{i}" for i in range(50))))
    docs = documents(spark, [], extra=[*extra, extra[1], (200, extra[0][1])]).repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = jaccard_join.jaccard_join(docs).collect()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in found)
    assert got == brute_links(rows)
    # one document of each of the 18 groups stays, in one row, but for the repeated one
    staying = [(r.doc_id, r.text_key) for r in found if r.stays]
    assert len(set(staying)) == 18 and all(r.doc_id == r.class_id for r in found if r.stays)


def test_pairs_at_the_threshold_meet_with_the_recall():
    pairs, runs = 20_000, jaccard_join.RUNS
    codes = np.random.default_rng(1).integers(0, 2**64, (pairs, 10), np.uint64)
    sets = np.stack([codes[:, :9], codes[:, 1:]], 1)  # 8 of 10 members in common
    nodes = jaccard_join.paths(sets.ravel(), np.arange(2 * pairs + 1) * 9, runs).reshape(pairs, 2, jaccard_join.DEPTH, runs)
    missed = (nodes[:, 0] != nodes[:, 1]).all(axis=2).mean(axis=0)
    assert missed[-1] < 1.5 * (1 - jaccard_join.RECALL) and missed[1] < 0.0005 and missed[0] < 0.0005


def test_pairs_at_the_threshold_are_found(spark, monkeypatch):
    """600 pairs of similarity 0.80 to 0.85 whose sets share a common passage, so that nodes split to the last depth."""
    monkeypatch.setattr(jaccard_join, "LEAF", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(600):
        own = [f"{k}x{i}" for i in range(64)]
        changed = 8 + k % 3  # of 90 shingles: (90 - changed) / (90 + changed)
        texts += [" ".join(passage + own), " ".join(passage + own[:-changed] + [f"{k}y{i}" for i in range(changed)])]
    rng.shuffle(texts)
    docs = documents(spark, texts).repartition(4)
    want = brute_links_of_pairs(texts)
    got = {r.doc_id: r.class_id for r in jaccard_join.jaccard_join(docs).collect()}
    found = sum(got[a] == got[b] for a, b in want)
    assert len(want) == 600 and found >= 0.99 * len(want)
    assert len({got[i] for i in got}) >= 600  # and nothing else is linked


def brute_links_of_pairs(texts):
    own = defaultdict(list)
    for i, t in enumerate(texts):
        own[t.split(" ")[30].split("x")[0]].append(i)
    pairs = [tuple(sorted(p)) for p in own.values()]
    for a, b in pairs:
        x, y = shingles(texts[a]), shingles(texts[b])
        assert 0.8 <= len(x & y) / len(x | y) < 0.86
    return pairs


def test_heavy_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HEAVY_ROWS", 5)
    rows = spark.createDataFrame([(i, i % 3 if i < 60 else i) for i in range(100)], "i long, k long")
    table = spark.createDataFrame([(k, k * 10) for k in range(0, 90) if k != 2], "k long, v long")
    for size in (1000, 0):
        monkeypatch.setattr(_shared, "BROADCAST_BYTES", size)
        heavy = _shared.heavy_keys(rows, "k", "k")
        assert sorted(r.k for r in heavy.collect()) == [0, 1, 2]
        for how in ("inner", "left"):
            got = sorted(((r.i, r.k, r.v) for r in _shared.looked_up(rows, table, "k", heavy, F.lit(16), how).select("i", "k", "v").collect()), key=str)
            assert got == sorted(((r.i, r.k, r.v) for r in rows.join(table, "k", how).select("i", "k", "v").collect()), key=str)


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HEAVY_ROWS", 5)
    monkeypatch.setattr(_shared, "BROADCAST_BYTES", 0)
    edges = [(i, 100) for i in range(20, 60)] + [(200 + i, 201 + i) for i in range(30)] + [(100, 7)]
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 7 for i in [7, 100, *range(20, 60)]}, **{200 + i: 200 for i in range(31)}}


def test_runs_reach_the_recall():
    n = jaccard_join.runs_needed(0.8, 0.999, 3)
    assert 1 - (1 - 0.8**3) ** n >= 0.999 > 1 - (1 - 0.8**3) ** (n - 1)


# -- search -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(60, 20, 10**6), (8192, 4096, 600)])
def test_exact_search_is_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("CANDIDATES", "FIRST", "CHUNK_BYTES"), sizes):
        monkeypatch.setattr(exact_search, name, size)
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 8)) * 0.1, 2).tolist()
    x += [x[50]] * 30 + [x[7]] * 20  # a hot vector, and ties
    rows = list(enumerate(x)) + [(None, x[0]), (900, None), (950, [*x[0][:7], None]), (1000, [*x[0][:7], float("nan")]), (1050, [*x[0][:7], float("inf")]), (0, x[0]), (7, x[7]), (1100, []), (1150, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    v = np.floor(256 * np.array(x)).astype(int)
    want = []
    for q in range(0, len(x), 50):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(len(x)) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, exact_search.top_k(df).collect())) == sorted(want)
    assert exact_search.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert list(map(tuple, exact_search.top_k(few).collect())) == [(0, 1, 1, 256 * 512)]


def test_exact_search_of_other_vectors_under_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in exact_search.top_k(df).orderBy("rank").collect()]
    # each vector of 0 asks, and each of 1 answers
    assert got == [(1, 1, 131072), (2, 1, 131072), (3, 2, 131072), (4, 1, 65536), (5, 1, 65536)]


def test_large_components_are_exact_or_refused(spark):
    big = [(0, [3.0e6, 1.0]), (1, [3.0e6, 2.0]), (2, [3.0e6, 1.0]), (3, [-3.0e6, 1.0]), (4, [2.9e6, 9.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    v = [[int(256 * c) for c in x] for _, x in big]
    want = sorted((-sum(a * b for a, b in zip(v[0], v[i])), i) for i in range(1, 5))
    assert [(-r.score, r.vec_id) for r in exact_search.top_k(df).orderBy("rank").collect()] == want
    wide = [(0, [4e6] * 2), (50, [4e6, -4e6]), *((i, [4e6, float(i)]) for i in range(1, 9))]
    v = {i: [int(256 * c) for c in x] for i, x in wide}
    want = sorted((q, -sum(a * b for a, b in zip(v[q], v[i])), i) for q in (0, 50) for i in v if i != q)
    want = [w for q in (0, 50) for w in [w for w in want if w[0] == q][:5]]
    assert [(r.query_id, -r.score, r.vec_id) for r in exact_search.top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()] == want
    with pytest.raises(Exception, match="too large"):
        exact_search.top_k(spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 64))
    v = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids = np.arange(len(v))
    search = exact_search._Search(v[::50], ids[::50], np.full(400, -np.inf), 5)
    for a in range(0, len(v), 4096):
        search.add(ids[a : a + 4096], v[a : a + 4096])
    first, rest = 4096, len(v) - 4096
    assert search.read < (first + 0.65 * rest) * 64 * 400  # the first block is read whole
    scores = v[::50] @ v.T
    for i in range(400):
        scores[i, 50 * i] = -(10**9)
        assert search.best[i][0][0] == -scores[i].max() and search.best[i][4][0] == -np.sort(scores[i])[-5]


# -- very long texts ----------------------------------------------------------------------------------


def test_very_long_texts_come_through(spark):
    """Megabytes of words, one word of a million letters, blanks and line ends alone, by every operator over texts."""
    rng = random.Random(1)
    prose = " ".join(f"w{rng.randrange(40_000)}" for _ in range(200_000))
    texts = [prose, prose + " end", "x" * 1_000_000, " " * 1_000_000, "\n" * 300_000, "é" * 200_000, "a b c", ""]
    docs = documents(spark, texts, extra=[(20, None)]).select("doc_id", "text")
    assert {r.doc_id: r.n_bytes for r in token_counts.token_counts(docs, PIECES).collect()} == {**{i: len(t.encode()) for i, t in enumerate(texts)}, 20: 0}
    links = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()}
    assert links[0] == links[1] == (0, 1) and links[2] == (2, 0) and {links[i][0] for i in (3, 4, 7, 20)} == {3}
    prints = {r.doc_id: r for r in simhash.with_near_counts(simhash.edited_fingerprints(docs)).collect()}
    assert len(prints) == 9 and prints[0].n_chars == len(prose) and prints[2].edited_sha256 == hashlib.sha256(("x" * 500_000 + (prose + " end")[:500_000]).encode()).hexdigest()
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, quality.train_quality(docs, labels)).where("score BETWEEN 0 AND 1").count() == 9
    assert toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).where("score BETWEEN 0 AND 1").count() == 9
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_digests(docs).collect()}
    assert lines[4] == (300_001, 300_000) and lines[0] == (1, 0)
    pieces = packing.pack_documents(docs, WORDS).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == {*range(8), 20} and {r.n for r in pieces if r.doc_id in (7, 20)} == {1}
    assert all(r.round_trip for r in piece_codec.piece_digests(docs, PIECES).collect())
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_digests(docs).collect()}
    assert cut[1] == (200_001, 200_000) and cut[0] == (200_000, 0) and cut[2] == (1, 0) and cut[3] == (0, 0)
