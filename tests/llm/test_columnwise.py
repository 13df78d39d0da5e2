"""Column-wise forms and bounded caches against the plain ones."""

import numpy as np
import public_tokenizers
import tiktoken

from gridlens.llm import bpe, langid
from gridlens.llm.chunks import ChunkEncoder

WORDS = ["a", "ab", "straße", "日本語", "𝒳x", "déjà", "hello", "ß" * 300, "x" * 5000]


def test_subwords_of_equals_subwords():
    for buckets in (7, 1 << 16):
        place, bucket = langid.subwords_of(WORDS, buckets)
        for k, w in enumerate(WORDS):
            assert sorted(bucket[place == k].tolist()) == sorted(langid.subwords(w, buckets))


def test_word_scores_do_not_depend_on_what_is_held():
    scores = np.random.default_rng(3).normal(size=(1 << 10, 3)).astype(np.float32)
    rng = np.random.default_rng(4)
    names = [f"w{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(4000)] + WORDS
    texts = [[], *([names[j] for j in rng.integers(0, len(names), n)] for n in (1, 5, 3000, 0, 2500)), ["hello"]]
    want = np.zeros((len(texts), 4))
    for k, words in enumerate(texts):
        for w in words:
            ids = langid.subwords(w, len(scores))
            want[k] += [*scores[ids].astype(float).sum(0), len(ids)]
    small = langid.WordScores(scores, held_bytes=0)
    assert small.limit == 1000
    for known in (langid.WordScores(scores), small):
        for step in (1 << 19, 700):
            np.testing.assert_allclose(known.totals(texts, step), want, atol=1e-8)
    one, all_ = langid.WordScores(scores), langid.WordScores(scores).totals(texts)
    for k, words in enumerate(texts):  # bit by bit: equal texts get equal sums
        assert (one.totals([words])[0] == all_[k]).all()


def test_two_generations_change_no_ids():
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    codec.chunks = ChunkEncoder(codec.encode_units, limit=3)
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = ["one two three four five one two six's, 77seven one", "déjà  vu\n two one", "one " * 9, "", None,
             "Donaudampfschifffahrtsgesellschaftskapitän " * 3, "ａ１ ٣٤ x"]
    for text in texts + texts[::-1]:
        assert np.frombuffer(codec.chunks.encode(text), "<u4").tolist() == plain.encode_ordinary(text or "")
    codec.chunks.warm([t for t in texts if t])
    for text in texts:
        assert np.frombuffer(codec.chunks.encode(text), "<u4").tolist() == plain.encode_ordinary(text or "")
    assert len(codec.chunks) <= 3 and len(codec.chunks.older) <= 3
