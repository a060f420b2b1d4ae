import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from heliograph.llm.packing import CAPACITY, _places, configurations, pack_documents, sequences
from heliograph.llm.queries import tokenizer_path


def test_pieces_and_places(docs, awkward):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    parts, placed = pack_documents(docs, tokenizer_path())
    want = Counter()
    for i, t, _ in awkward:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), CAPACITY):
            piece = np.array(ids[p : p + CAPACITY], "<u4")
            want[(i, p // CAPACITY, p, len(piece), zlib.crc32(piece.tobytes()))] += 1
    rows = placed.collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= CAPACITY
    assert len(filled) <= -(-sum(r.length for r in rows) // CAPACITY) + 1
    whole = {r.sequence_id: len(r.ids) // 4 for r in sequences(parts, placed).collect()}
    assert whole == {s: sum(n for _, n in p) for s, p in filled.items()}


def test_plan_uses_each_piece_once():
    rng = random.Random(2)
    for _ in range(20):
        histogram = dict(Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 40), 100]) for _ in range(rng.randint(1, 400))))
        plan = configurations(dict(histogram), 100, rounds=40)
        used = Counter()
        for chosen, times in plan:
            assert times > 0 and sum(n * c for n, c in chosen.items()) <= 100
            for n, c in chosen.items():
                used[n] += c * times
        assert used == histogram
        assert sum(t for _, t in plan) <= 1.1 * sum(n * c for n, c in histogram.items()) / 100 + 2 or max(histogram) > 50
    assert len(_places([])["length"]) == 0


def test_empty_table(no_docs):
    assert pack_documents(no_docs, tokenizer_path())[1].collect() == []


def test_an_encoder_forgets_words_met_once_and_keeps_the_ids_of_others():
    from heliograph.llm.packing import _Encoder
    from heliograph.llm.queries import tokenizer_path

    encoder = _Encoder(tokenizer_path())
    encoder.places(["unbelievable", "beta"])
    encoder.places(["unbelievable", "gamma"])
    encoder.forget()
    assert list(encoder.known) == ["unbelievable"]
    words = ["gamma", "unbelievable", "beta"]
    for word, at in zip(words, encoder.places(words).tolist(), strict=True):
        want = encoder.tokenizer.encode(word, add_special_tokens=False).ids
        assert encoder.ids[encoder.ends[at] : encoder.ends[at + 1]].tolist() == want


def test_words_of_latin_letters_go_to_the_model_with_the_ids_of_the_tokenizer():
    from heliograph.llm.packing import _LETTERS, _Encoder

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.met = tokenizer, []

        def encode_batch_fast(self, words, **options):
            self.met += words
            return self.tokenizer.encode_batch_fast(words, **options)

    rng = random.Random(7)
    pools = ["abcdefghijklmnopqrstuvwxyz", _LETTERS, "aZéÄß'st", "ab1.é中́İKſŀµªº×÷", "ab<|>startofex"]
    words = sorted({"".join(rng.choice(p) for _ in range(rng.randint(1, 30))) for p in pools for _ in range(500)} | {"a" * 9000, "é" * 5000})
    encoder = _Encoder(tokenizer_path())
    full, encoder.tokenizer = encoder.tokenizer, Counting(encoder.tokenizer)
    at = encoder.places(words)
    for word, i in zip(words, at.tolist(), strict=True):
        assert encoder.ids[encoder.ends[i] : encoder.ends[i + 1]].tolist() == full.encode(word, add_special_tokens=False).ids
    assert encoder.tokenizer.met == [w for w in words if not set(w) <= set(_LETTERS)]


def test_signs_and_words_met_before_cost_no_new_words():
    import pyarrow as pa

    from heliograph.llm import packing

    path = tokenizer_path()
    full = Tokenizer.from_file(path)
    rng = random.Random(11)
    parts = ["a", "B", "é", "Ã", "ß", "1", "'", "'s", "$", "%%", "-", "_", "<", "|", "́", "̸", "İ", "中", ".", "×", " ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, starts = packing.encoded(pa.array(texts), path)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == full.encode(t, add_special_tokens=False).ids
    encoder = packing._Encoder(path)
    packing._encoders["signs"] = encoder
    try:
        packing.encoded(pa.array(["alpha$$$ (beta) alpha*** beta%%%", "(alpha) $$$ beta"]), "signs")
        assert "alpha" in encoder.known and not {"alpha$$$", "alpha***", "beta%%%"} & encoder.known.keys()
        packing.encoded(pa.array(["alpha gamma"]), "signs")
        encoder.forget()
        assert list(encoder.known) == ["alpha"]
        ids, _ = packing.encoded(pa.array(["gamma alpha"]), "signs")
        assert ids.tolist() == full.encode("gamma alpha", add_special_tokens=False).ids
    finally:
        del packing._encoders["signs"]
