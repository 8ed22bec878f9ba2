"""What a worker holds while it encodes: it outlives its tasks, and keeps what it has once taken."""

import tracemalloc

from lexspark.llm import bpe


def test_words_of_many_texts_are_not_held_at_once():
    v = bpe.Vocabulary(bpe.default_path())
    texts = [" ".join(f"word{(i * 7 + k) % 900} of text" for k in range(900)) for i in range(260)]
    assert sum(map(len, texts)) > 3_500_000
    whole = v.encode_batch(texts[:3])
    first = next(bpe.encoded(v, texts))
    assert first[:2] != (0, len(texts)) and first[2][:3] == whole
    tracemalloc.start()
    try:
        n = 0
        for lo, hi, coded in bpe.encoded(v, texts):
            assert lo == n and len(coded) == hi - lo
            n = hi
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(texts)
    assert peak < 24 << 20  # all at once: 51 MB


def test_pairs_of_tokens_remembered_have_a_bound(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 50)
    v = bpe.Vocabulary(bpe.default_path())
    words = [f" quaint{i}ish" for i in range(400)]
    once = v.encode_words(words)
    assert len(v.pairs) > 50
    assert {w: v.encode_words([w])[w] for w in words} == once
    assert len(v.pairs) < 400
