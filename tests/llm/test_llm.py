"""Every operator against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strayrow.llm import bytetext as bt
from strayrow.llm import (
    decontamination,
    jaccard_join,
    kdtree_search,
    language_id,
    lattice_lm,
    packing,
    quality,
    sharding,
    suffix_repeats,
    token_counts,
)
from strayrow.llm.queries import COUNT_TOKENIZER, PACK_TOKENIZER, PIECES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "a passage of some sixty bytes that several documents happen to share, word by word. "
TEXTS = [
    (1, "One short text."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "It's 's OK!! déjà vu Éa 123 <|endoftext|> x  y \n z"),
    (6, "Start here. " + PASSAGE + "the end of six"),
    (7, PASSAGE + "another end " + PASSAGE),
    (8, "x" * 5000),
    (9, "be " * 400),
    (10, "be " * 400),
    (11, "日本語 テキスト και λίγα ελληνικά"),
    (12, " ".join(f"word{n}" for n in range(60))),
    (13, " ".join(f"word{n}" for n in range(58)) + " other end"),
    (14, " ".join(f"Word{n}" for n in range(60))),
    (15, "12345 !!! ---"),
    (15, "12345 !!! ---"),
    (None, PASSAGE + "no id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "block", 0.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block string, score double")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def raw(text):
    return (text or "").encode()


def test_repeats_removed_as_by_brute_force(docs, nothing):
    first = {}
    named = sorted((i, raw(t)) for i, t in TEXTS if i is not None)
    for i, x in named:
        for at in range(len(x) - 49):
            first.setdefault(x[at : at + 50], i)
    want = Counter()
    for i, t in TEXTS:
        x = raw(t)
        gone = bytearray(len(x))
        for at in range(len(x) - 49):
            if i is not None and first[x[at : at + 50]] < i:
                gone[at : at + 50] = b"\x01" * 50
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(b for b, z in zip(x, gone, strict=True) if not z)
        want[(i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_repeats.remove_repeats(docs, keep=("block",)).drop("block").collect()
    assert Counter(map(tuple, got)) == want
    assert suffix_repeats.remove_repeats(nothing).count() == 0


def test_maximal_repeats_have_all_their_places(docs):
    rows = suffix_repeats.maximal_repeats(docs).collect()
    texts = {i: raw(t) for i, t in TEXTS if i is not None}
    found = defaultdict(set)
    for r in rows:
        found[r["repeat"]].add(texts[r.doc_id][r.start : r.start + r.length])
    assert rows and all(len(bodies) == 1 for bodies in found.values())
    assert {r.doc_id for r in rows} >= {6, 7, 9, 10}


@pytest.mark.parametrize("crowd", [suffix_repeats.CROWD, 2, 1])
def test_maximal_repeats_as_by_brute_force(spark, docs, nothing, monkeypatch, crowd):
    monkeypatch.setattr(suffix_repeats, "CROWD", crowd)
    once = "a passage that stands three times in this document and in no other one, word by word. "
    more = [(20, f"{once}first {once}second {once[:70]}"), (21, "abc" * 40)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = suffix_repeats.maximal_repeats(table).collect()
    texts = {i: raw(t) for i, t in [*TEXTS, *more] if i is not None}
    windows, found = defaultdict(set), defaultdict(set)
    for i, x in texts.items():
        for at in range(len(x) - 49):
            windows[x[at : at + 50]].add((i, at))
    for r in rows:
        found[texts[r.doc_id][r.start : r.start + r.length]].add((r.doc_id, r.start))
    covered = {(i, at + n) for x, places in found.items() for i, at in places for n in range(len(x) - 49)}
    assert covered == {p for places in windows.values() if len(places) > 1 for p in places}
    for body, places in found.items():
        every = {(i, at) for i, at in windows[body[:50]] if texts[i][at : at + len(body)] == body}
        assert places == every and len(every) > 1
    assert suffix_repeats.maximal_repeats(nothing).count() == 0


def test_a_passage_in_very_many_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_repeats, "CROWD", 20)
    texts = [(i, f"text number {i} starts here. {PASSAGE}and goes on {i * 7919} in its own way {i}") for i in range(1500)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    first = {}
    for i, t in texts:
        x = raw(t)
        for at in range(len(x) - 49):
            first.setdefault(x[at : at + 50], i)
    for r in suffix_repeats.remove_repeats(table).collect():
        x = raw(texts[r.doc_id][1])
        gone = bytearray(len(x))
        for at in range(len(x) - 49):
            if first[x[at : at + 50]] < r.doc_id:
                gone[at : at + 50] = b"\x01" * 50
        assert r.n_removed == sum(gone)


def test_crowded_grams_are_split_until_they_are_not():
    texts = [f"{i:05d} {PASSAGE}{i:05d} tail {i}" for i in range(300)]
    table = pa.table({"doc_id": list(range(300)), "_text_key": list(range(300)), "text": texts})
    block = suffix_repeats.Block(table, 50)
    block.find()
    limit, marks = 25, {}

    def rows(values, counts):
        state = np.where(counts > limit, 2, 1).astype(np.uint8)
        order, edges = suffix_repeats._by_bucket(values, 4)
        return [(n, suffix_repeats._packed(state[order[edges[n] : edges[n + 1]]], np.uint8)) for n in range(4)]

    values, _, _, counts = block.anchor_table()
    marks[0] = rows(values, counts)
    keys, bodies = suffix_repeats.Deal(block, marks, 4).nodes()
    values, _, codes = bt.distinct(keys)
    marks[1] = rows(values, suffix_repeats._distinct_pairs(codes, bodies, len(values)))
    deal = suffix_repeats.Deal(block, marks, 4)
    assert len(deal.crowded) and len(keys)
    starts, lengths, _, keys = deal.pieces()
    different = {}
    for start, length, key in zip(starts.tolist(), lengths.tolist(), keys.tolist(), strict=True):
        different.setdefault(key, set()).add(block.buffer[start : start + length].tobytes())
    assert max(map(len, different.values())) <= limit
    windows = Counter(s + n for s, size in zip(starts.tolist(), lengths.tolist(), strict=True) for n in range(size - 49))
    want = Counter(o + n for o, e in zip(block.offsets, block.offsets[1:], strict=False) for n in range(e - o - 49))
    assert windows == want


def test_intervals_are_left_diverse():
    # Suffixes b.., b.. after different letters, and c.. always after b: only the first repeats by itself.
    assert suffix_repeats.intervals([0, 60, 0, 59], [97, 98, 98, 98], 50) == [(0, 1, 60)]
    assert suffix_repeats.intervals([0, 52, 60], [1, 2, 2], 50) == [(0, 2, 52)]


def test_shards_are_even_and_gapless(spark, docs, nothing):
    for table in (docs, spark.read.parquet(f"{FOLDER}/documents.parquet")):
        rows = sharding.shard(table, shards=6).collect()
        assert len(rows) == table.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    largest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    crc = {r.doc_id: r.text_crc32 for r in sharding.shard(docs).collect()}
    assert crc[2] == 0 and crc[1] == zlib.crc32(b"One short text.")
    assert sharding.shard(nothing).count() == 0


def test_overfull_ranges_are_subdivided(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("size"), F.lit(7).cast("long").alias("key")
    )
    splitters, sizes = sharding.key_ranges(rows, 40_000, 32, "bigint")
    assert max(size for _, size in sizes.values()) < 2.5 * 40_000 / 32
    assert sum(count for count, _ in sizes.values()) == 4000


def test_token_counts_equal_the_library(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path(COUNT_TOKENIZER)
    library = Tokenizer.from_file(path)
    table = docs.select("doc_id", "text").union(
        spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    )
    want = Counter(
        (r.doc_id, len(raw(r.text)), len(library.encode(r.text or "", add_special_tokens=False))) for r in table.collect()
    )
    got = token_counts.count_tokens(table, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(nothing, path).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 7, 50])
def test_chunk_maps_compose(chunk):
    from tokenizers import Tokenizer

    path = tokenizer_path(COUNT_TOKENIZER)
    library, counter = Tokenizer.from_file(path), token_counts.TokenCounter(path)
    for _, text in TEXTS:
        want = len(library.encode(text or "", add_special_tokens=False))
        assert token_counts.count_long(raw(text), counter, chunk) == want


def test_quality_ranks_held_out_documents(spark, docs, nothing):
    folder = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.train(table, labels, held_out=fold)
    scored = quality.score(table, model).join(labels, "doc_id").where(fold).collect()
    right = sum(r.predicted == r.quality for r in scored)
    assert right >= 0.95 * len(scored)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.train(nothing, labels) is None and quality.score(nothing, model).count() == 0


def brute_contamination(texts, items, size=13):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))

    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(size, len(w))
        for at in range(len(w) - n + 1) if n else ():
            windows[tuple(w[at : at + n])].add(item)
    out = Counter()
    for i, text in texts:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[tuple(w[at : at + n])]
        names = ",".join(sorted(map(str, found)))
        dirty = bool(hit) and 20 * len(hit) >= len(w)
        out[(i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), dirty)] += 1
    return out


def test_contamination_as_by_brute_force(spark, docs, nothing, monkeypatch):
    items = [
        (1, "Word3 word4 word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15 word16"),
        (2, "déjà vu"),
        (3, "be be be be be"),
        (4, None),
        (5, ""),
        (6, "x"),
        (7, PASSAGE),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, bench).collect()
    assert Counter(map(tuple, got)) == brute_contamination(TEXTS, items)
    assert decontamination.contamination(nothing, bench).count() == 0
    # A benchmark, and hits, beyond the broadcast limits.
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_DOCUMENTS", 0)
    got = decontamination.contamination(docs, bench).collect()
    assert Counter(map(tuple, got)) == brute_contamination(TEXTS, items)
    clean = decontamination.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(TEXTS) and not any(r.contaminated for r in clean)


def test_lattice_sums_all_segmentations(spark, docs, nothing):
    lattice = lattice_lm.first_lattice(tokenizer_path(PIECES))
    share = dict(zip(lattice.pieces, lattice.log_share, strict=False))

    def every(word):
        text = lattice_lm.WORD_START + word
        sums = [1.0] + [0.0] * len(text)
        for end in range(1, len(text) + 1):
            sums[end] = sums[end - 1] * math.exp(lattice.log_share[len(lattice.pieces) + text[end - 1]])
            for start in range(end):
                if text[start:end] in share:
                    sums[end] += sums[start] * math.exp(share[text[start:end]])
        return math.log(sums[-1])

    tried = [w.encode() for w in ("the", "lattice", "déjà", "日本", "x" * 40)]
    ends = np.cumsum([len(w) for w in tried])
    starts = ends - np.array([len(w) for w in tried])
    got = lattice.log_words(np.frombuffer(b"".join(tried), np.uint8), starts, ends)
    assert np.allclose(got, [every(w) for w in tried])

    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = lattice_lm.score(docs, tokenizer_path(PIECES), fold).collect()
    taught = [(i, t) for i, t in TEXTS if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for _, t in taught for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in TEXTS:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        want[(i, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lattice_lm.score(nothing, tokenizer_path(PIECES), fold).count() == 0


def brute_components(texts, n, threshold):
    sets, named = {}, {}
    for i, text in texts:
        w = words(text)
        grams = [tuple(w[at : at + n]) for at in range(max(len(w) - n + 1, 1))] if w else []
        sets[i] = frozenset(grams)
        named[i] = i
    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                old, new = max(named[a], named[b]), min(named[a], named[b])
                named = {k: new if v == old else v for k, v in named.items()}
    return Counter((i, len(sets[i]), named[i]) for i, _ in texts)


@pytest.mark.parametrize(("n", "threshold"), [(4, 85), (5, 80)])
def test_near_duplicates_as_by_brute_force(spark, docs, nothing, n, threshold):
    texts = [(i, t) for i, t in TEXTS if i is not None]
    named = docs.where("doc_id is not null")
    found = jaccard_join.near_duplicates(named, words=n, threshold=threshold).drop("text_key", "group_key").collect()
    assert Counter(map(tuple, found)) == brute_components(texts, n, threshold)
    unnamed = jaccard_join.near_duplicates(docs, words=n, threshold=threshold).where("doc_id is null").collect()
    assert [r.component_id for r in unnamed] == [None]
    assert jaccard_join.near_duplicates(nothing, words=n, threshold=threshold).count() == 0


def test_a_large_group_of_near_copies_loses_no_link(spark):
    draw = np.random.default_rng(3)
    base = [f"w{n}" for n in range(80)]
    texts = []
    for i in range(60):
        changed = list(base)
        for at in draw.choice(80, int(draw.integers(0, 4)), replace=False):
            changed[at] = f"other{i}x{at}"
        texts.append((i, " ".join(changed)))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    got = jaccard_join.near_duplicates(table, words=4, threshold=85).drop("text_key", "group_key").collect()
    assert Counter(map(tuple, got)) == brute_components(texts, 4, 85)


def test_topk_as_by_brute_force(spark):
    draw = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(400, 6)))]
    vectors += [(500 + i, vectors[3][1]) for i in range(30)]
    bad = [(600, None), (700, [1.0, None] * 3), (800, [float("nan")] * 6), (900, []), (None, vectors[0][1])]
    table = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>")
    rows = kdtree_search.top_k(table, F.col("vec_id") % 100 == 0, shard_rows=60).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors}
    want = set()
    for q in [i for i in whole if i % 100 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])}
    assert set(map(tuple, rows)) == want
    assert kdtree_search.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_of_repeated_ids(spark):
    vectors = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [-1.0, -1.0])]
    vectors += [(200, [1.0, 0.0]), (200, [1.0, 0.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = kdtree_search.top_k(table, F.col("vec_id") % 100 == 0, k=3, shard_rows=2).collect()
    want = Counter()
    for n, (q, v) in enumerate(vectors):
        if q % 100 == 0:
            scores = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q)
            want.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:3]))
    assert Counter(map(tuple, rows)) == want


def test_near_duplicates_of_repeated_ids(spark):
    def text(name, changed=()):
        return " ".join(f"{name}{n}" if n not in changed else f"new{name}{n}" for n in range(60))

    rows = [(3, text("a")), (3, text("b")), (2, text("b", [59])), (4, text("a", [0])), (3, text("c")), (3, text("c"))]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.lit(0))
    got = jaccard_join.near_duplicates(table, words=5, threshold=80).drop("text_key", "group_key").collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == {(3, 3): 3, (3, 2): 1, (2, 2): 1, (4, 3): 1}
    kept = corpus_pipeline.jaccard_stage(spark, table, FOLDER)
    assert kept.columns == table.columns and {r.text_key for r in kept.collect()} == {0}
    assert Counter((r.doc_id, r.text[:1]) for r in kept.collect()) == {(2, "b"): 1, (3, "a"): 1, (3, "c"): 1}


def test_language_of_held_out_documents(spark, docs, nothing):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.train(table, held_out=fold)
    found = language_id.identify(table, model, keep=("lang",)).where(fold).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    rows = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert {rows[i].lang_pred for i in (2, 3, 4, 15)} == {"und"} and rows[2].score == 0
    assert rows[11].lang_pred in model.languages and all(0 <= r.score <= 1 for r in rows.values())
    assert language_id.train(nothing) is None and language_id.identify(nothing, None).count() == 0


def test_every_label_is_taught(spark):
    draw = np.random.default_rng(5)
    letters = np.array([chr(n) for n in range(0x4E00, 0x4E00 + 2000)])
    rows = []
    for label in range(130):
        own = ["".join(draw.choice(letters, 3)) for _ in range(6)]
        for n in range(3 + (label < 100)):
            rows.append((len(rows), " ".join(draw.choice(own, 30)), f"l{label:03}"))
    rows += [(len(rows) + n, f"{n} !!!", "l000") for n in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for model in (language_id.train(table), language_id.train(table, rows_per_language=1, sample_rows=1)):
        assert model.languages == [f"l{label:03}" for label in range(130)]
    found = language_id.identify(table, language_id.train(table), keep=("lang",)).where("lang_pred <> 'und'")
    assert found.where("lang_pred <> lang").count() == 0 and found.count() == len(rows) - 400


@pytest.mark.parametrize("classes", [2, 3, 4, 9])
def test_codewords_differ(classes):
    code = language_id.codewords(classes)
    assert len({tuple(c) for c in code.tolist()}) == classes


def test_packing_holds_every_id_once(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path(PACK_TOKENIZER)
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=64).collect()
    want = Counter()
    for i, text in TEXTS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want[(i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(nothing, path).count() == 0


def test_rows_of_one_id_are_dealt_to_all_groups(spark):
    path = tokenizer_path(PACK_TOKENIZER)
    ids = F.when(F.col("id") < 1000, F.lit(7).cast("long"))
    texts = F.when(F.col("id") % 2 == 0, F.lit("a copy")).otherwise(F.concat(F.lit("text "), "id"))
    rows = packing.pack(spark.range(2000).select(ids.alias("doc_id"), texts.alias("text")), path).collect()
    groups = Counter(r.sequence_id % packing.MIN_GROUPS for r in rows)
    assert len(rows) == 2000 and max(groups.values()) < 2 * 2000 / packing.MIN_GROUPS


def test_best_fit_closes_the_fullest_first():
    bins, offsets, fills = packing.best_fit([6, 5, 4, 3, 5], 10, 1)
    assert fills == [10, 8, 5] or sum(fills) == 23
    bins, offsets, fills = packing.best_fit([7, 6, 3, 4], 10, 8)
    assert bins == [0, 1, 0, 1] and offsets == [0, 0, 7, 6] and fills == [10, 10]


def test_language_stage_keeps_texts_whatever_the_labels(spark, docs):
    kept = Counter(i for i, _ in TEXTS if i not in (2, 3, 4, 15))
    usable = F.when(F.col("doc_id").isin(4, 15), "en")
    for label in (F.lit(None).cast("string"), usable, F.lit("und")):
        rows = corpus_pipeline.language_stage(spark, docs.withColumn("lang", label), FOLDER)
        assert rows.columns == docs.columns and Counter(r.doc_id for r in rows.collect()) == kept


def test_pipeline_stages(spark, docs):
    columns = ["doc_id", "text", "lang", "block", "score"]
    kept = corpus_pipeline.language_stage(spark, docs, FOLDER)
    assert kept.columns == columns
    assert not {r.doc_id for r in kept.collect()} & {2, 3, 4, 15}
    single = corpus_pipeline.jaccard_stage(spark, docs, FOLDER).collect()
    assert {9, 10} & {r.doc_id for r in single} == {9} and {12, 14} & {r.doc_id for r in single} == {12}
    assert any(r.doc_id is None for r in single) and {1, 5, 11} <= {r.doc_id for r in single}
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeats_stage(spark, docs, FOLDER).collect()}
    assert len(cut) == len({i for i, _ in TEXTS}) and cut[1] == TEXTS[0][1] and PASSAGE not in cut[7]
    assert corpus_pipeline.decontamination_stage(spark, docs, FOLDER).columns == columns
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.count() > 100
