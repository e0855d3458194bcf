"""What one task holds or computes at once is bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa

from strayrow.llm import bytetext as bt
from strayrow.llm import jaccard_join, language_id, lattice_lm, packing
from strayrow.llm.queries import PACK_TOKENIZER, PIECES, tokenizer_path


def test_sets_of_a_large_batch_are_held_slice_by_slice():
    draw = np.random.default_rng(5)
    letters = draw.integers(97, 123, (4000, 2048), dtype=np.uint8)
    letters[:, ::6] = 32
    batch = pa.RecordBatch.from_arrays([pa.array([row.tobytes().decode() for row in letters])], ["text"])
    want = jaccard_join.set_digests(*jaccard_join.distinct_shingles(letters.ravel()[: 2048 * 9], np.arange(10) * 2048, 5))
    tracemalloc.start()
    rows, first = 0, []
    for part, sizes, digests in jaccard_join.sliced_sets(iter([batch]), 5):
        rows += part.num_rows
        first += digests[: 9 - len(first)]
        assert len(sizes) == len(digests) == part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and first == want
    assert peak < 64 << 20


def test_words_of_usual_length_need_no_logs_and_long_ones_agree(monkeypatch):
    lattice = lattice_lm.first_lattice(tokenizer_path(PIECES))
    tried = [w.encode() for w in ("the", "lattice", "déjà", "日本", "a", "unhappiness", "x" * 25, "ab" * 400)]
    ends = np.cumsum([len(w) for w in tried])
    starts = ends - np.array([len(w) for w in tried])
    buffer, counts = np.frombuffer(b"".join(tried), np.uint8), np.arange(1, len(tried) + 1)
    assert lattice._plain(20) and not lattice._plain(800)
    mixed = lattice.log_words(buffer, starts, ends), lattice.expected(buffer, starts, ends, counts)
    monkeypatch.setattr(lattice_lm, "_PLAIN_RANGE", 0.0)
    logs = lattice.log_words(buffer, starts, ends), lattice.expected(buffer, starts, ends, counts)
    assert np.isfinite(mixed[0]).all() and np.allclose(mixed[0], logs[0], rtol=1e-12)
    assert np.allclose(mixed[1], logs[1], rtol=1e-9, atol=1e-12)


def _predicted(texts: list[str], rows: int | None) -> tuple[list, int, int]:
    draw = np.random.default_rng(3)
    weights, code = draw.normal(size=(language_id.FEATURES, 3)), language_id.codewords(3)
    model = language_id.LanguageModel(["a", "b", "c"], code, weights, np.zeros(3), np.ones(3))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    found, most = [], 0
    tracemalloc.start()
    for part in bt.slices(iter([batch]), "text", language_id.SLICE_BYTES, rows):
        most = max(most, part.num_rows)
        found += model.predict(language_id.ngram_features(*bt.text_buffer(part.column("text"))))[0].tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, most, peak


def test_languages_of_long_and_of_many_short_texts_take_little_memory():
    long = ["the quick brown fox " * 400] * 400
    assert _predicted(long, language_id.SLICE_ROWS)[2] < 32 << 20
    short = [f"word {n}" for n in range(4000)]
    found, most, peak = _predicted(short, language_id.SLICE_ROWS)
    assert found == _predicted(short, None)[0] and len(found) == 4000
    assert most <= language_id.SLICE_ROWS and peak < 48 << 20


def test_tables_of_powers_do_not_outlive_a_task():
    want = bt.powers(1000).copy()
    list(bt.slices(iter([pa.RecordBatch.from_arrays([pa.array(["a"])], ["text"])]), "text"))
    assert not bt._POWERS and (bt.powers(1000) == want).all()


def test_remembered_words_are_small():
    tokenizer = packing.WordTokenizer(tokenizer_path(PACK_TOKENIZER))
    text = " ".join("".join(chr(97 + n // 26**k % 26) for k in range(6)) for n in range(20_000)).encode()
    buffer, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    tracemalloc.start()
    ids, _ = tokenizer.buffer(buffer, offsets)
    bt.release()
    held = tracemalloc.get_traced_memory()[0] - ids.nbytes
    tracemalloc.stop()
    assert (tokenizer.buffer(buffer, offsets)[0] == ids).all()
    units = len(tokenizer._plain)
    assert units > 5_000 and held < 160 * units
