"""Trained models against plain computations: the lattice's expectation steps, decoding, the logistic optimum, shard places."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayrow.llm import language_id, lattice_lm, packing, quality, sharding
from strayrow.llm.queries import PACK_TOKENIZER, PIECES, tokenizer_path


def test_lattice_score_after_training_by_brute_force(spark):
    texts = [(0, "the theme of the"), (1, "Them théâtre"), (2, "theory"), (3, None), (4, "of unseen of"), (9, "the end")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lattice_lm.score(docs, tokenizer_path(PIECES), F.col("doc_id") == 4).collect()
    first = lattice_lm.first_lattice(tokenizer_path(PIECES))
    number = {p: n for n, p in enumerate(first.pieces)}

    def arcs(word):
        for end in range(1, len(word) + 1):
            yield end - 1, end, len(first.pieces) + word[end - 1]
            for start in range(end):
                if word[start:end] in number:
                    yield start, end, number[word[start:end]]

    def forward(word, share):
        sums = [1.0] + [0.0] * len(word)
        for start, end, piece in sorted(arcs(word), key=lambda a: a[1]):
            sums[end] += sums[start] * share[piece]
        return sums

    words = {i: [lattice_lm.WORD_START + w.encode() for w in (t or "").translate(str.maketrans("T", "t")).split()] for i, t in texts}
    taught = [w for i, ws in words.items() if i != 4 for w in ws]
    start_share = np.exp(first.log_share)
    share, end_share = start_share, None
    for _ in range(lattice_lm.ROUNDS):
        counts = start_share * lattice_lm.PRIOR_COUNT
        for word in taught:
            ahead = forward(word, share)
            behind = [0.0] * len(word) + [1.0]
            for start, end, piece in sorted(arcs(word), key=lambda a: -a[0]):
                behind[start] += share[piece] * behind[end]
            for start, end, piece in arcs(word):
                counts[piece] += ahead[start] * share[piece] * behind[end] / ahead[-1]
        ends = len(texts) - 1
        whole = counts.sum() + ends + 1
        share, end_share = counts / whole, (ends + 1) / whole
    for r in rows:
        want = math.log10(end_share) + sum(math.log10(forward(w, share)[-1]) for w in words[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-6)


def test_very_long_words_are_scored(spark):
    docs = spark.createDataFrame([(0, "a" * 200_000), (1, "a a")], "doc_id long, text string")
    rows = {r.doc_id: r for r in lattice_lm.score(docs, tokenizer_path(PIECES), F.lit(False)).collect()}
    assert rows[0].n_tokens == 2 and -1e6 < rows[0].score < rows[1].score < 0


def test_decoding_by_brute_force():
    draw = np.random.default_rng(4)
    for classes in (2, 4, 9):
        code = language_id.codewords(classes)
        bits = code.shape[1]
        model = language_id.LanguageModel(
            [str(c) for c in range(classes)], code, draw.normal(size=(5, bits)), draw.normal(size=bits), draw.random(bits)
        )
        features = draw.normal(size=(40, 5))
        best, score, unsure = model.predict(features)
        for row, x in enumerate(features):
            losses = []
            for word in code:
                loss = 0.0
                for bit, sign in enumerate(word):
                    margin = sum(a * w for a, w in zip(x, model.weights[:, bit], strict=True)) + model.bias[bit]
                    loss += model.trust[bit] * math.log1p(math.exp(-sign * margin))
                losses.append(loss)
            assert best[row] == losses.index(min(losses))
            chance = 1 / sum(math.exp(min(losses) - v) for v in losses)
            assert score[row] == pytest.approx(chance) and bool(unsure[row]) == (chance < 0.6)


def test_pairwise_weights_are_the_optimum():
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(500, 4)) + np.array([0.8, -0.5, 0.0, 0.1])
    decay = 1e-3

    def loss(weights):
        margins = [sum(a * w for a, w in zip(r, weights, strict=True)) for r in rows]
        return sum(math.log1p(math.exp(-m)) for m in margins) / len(rows) + decay / 2 * sum(w * w for w in weights)

    best = quality._newton(rows, decay).tolist()
    least = loss(best)
    for n in range(4):
        for step in (1e-3, -1e-3):
            moved = list(best)
            moved[n] += step
            assert loss(moved) > least


def test_a_score_reaches_the_threshold_at_the_quantile():
    draw = np.random.default_rng(8)
    labels = np.repeat([0, 1], 200)
    features = draw.normal(size=(400, 3)) + labels[:, None] * np.array([2.0, 0.0, -1.0])
    model = quality.fit(features, labels)
    strength = ((features - model.mean) / model.scale) @ model.weights
    accepted = model.score(features) >= quality.ACCEPT
    assert (accepted == (strength >= model.threshold - 1e-12)).all()
    order = np.argsort(strength)
    assert (np.diff(model.score(features)[order]) >= 0).all() and (accepted == labels).mean() > 0.85


def test_shard_places_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shards = defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]))
        shards[r.shard].append(r)
    whole = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    assert sorted(shards) == list(range(24))
    for found in shards.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
        assert abs(sum(r["size"] for r in found) - whole / 24) <= largest


def test_sequences_are_few(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, tokenizer_path(PACK_TOKENIZER)).collect()
    least = -(-sum(r.length for r in rows) // 2048)
    assert len({r.sequence_id for r in rows}) <= 1.05 * least
