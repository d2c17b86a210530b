"""The wavelet file's directories, lookups that unpack no more than they need, and tokens counted and located over all shards."""

import numpy as np
import public_tokenizers
import pytest

from learngraph.llm import shared, token_store
from learngraph.llm.wavelet import WaveletMatrix

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("n", "top", "bits"), [(0, 5, 3), (1, 5, 3), (511, 8, 3), (512, 8, 4), (5000, 1000, 10), (3000, 2, 17)])
def test_lookups_of_a_file_equal_plain_ones(n, top, bits):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.integers(0, top, n), rng.integers(0, top, n)).astype(np.uint32)
    starts = np.array([0, n // 3, n])
    blob = WaveletMatrix.build(ids, bits).to_bytes(starts, np.array([4, 9]), np.array([True, False]))
    matrix, at, doc_ids, known = WaveletMatrix.from_bytes(blob)
    assert matrix.loaded() == 0 and at.tolist() == starts.tolist() and doc_ids.tolist() == [4, 9] and known.tolist() == [True, False]
    for t in {0, 1, top - 1, top // 2, (1 << bits) - 1, *ids[:5].tolist()}:
        want = np.flatnonzero(ids == t)
        assert matrix.count(t) == len(want) and matrix.places(t).tolist() == want.tolist()
        for k in (0, len(want) // 2, len(want) - 1):
            assert matrix.select(t, k) == (want[k] if 0 <= k < len(want) else -1)
        for i in (0, 1, n // 2, n):
            assert matrix.rank(t, i) == np.count_nonzero(ids[:i] == t)
    for i in range(0, n, max(1, n // 40)):
        assert matrix.access(i) == ids[i]
    assert matrix.decode().tolist() == ids.tolist()


def test_absent_tokens_and_counts_unpack_few_planes():
    ids = np.arange(4096, dtype=np.uint32) % 7
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 16).to_bytes(np.array([0, 4096]), np.array([1]), np.array([True])))[0]
    assert matrix.count(60_000) == 0 and matrix.loaded() == 0  # the first plane's directory says it
    assert matrix.count(3) == np.count_nonzero(ids == 3)
    with pytest.raises(ValueError, match="truncated"):
        WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 16).to_bytes(np.array([0, 4096]), np.array([1]), np.array([True]))[:-3])


def test_tokens_over_all_shards(spark):
    from tokenizers import Tokenizer

    texts = [(3, "one two one"), (1, "two two"), (None, "one"), (2, None), (7, " ".join(f"w{i % 9} one" for i in range(300))), (7, "one")]
    path = shared.new_path(spark, "shards")
    token_store.write_shards(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), path, BYTE_BPE, shard_tokens=40)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    coded = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts]
    one, end, rare = tokenizer.encode(" one").ids[0], 0, 49_999
    want = {t: sum(ids.count(t) for _, ids in coded) for t in (one, end, rare)}
    assert {r["token"]: r["n"] for r in token_store.count_tokens(spark, path, [one, end, rare, one]).collect()} == want and want[end] == 6
    starts = {(r["doc_id"], r["n_tokens"]): r["start"] for r in token_store.read_documents(spark, path).collect()}
    places = sorted(((i, k, starts[i, len(ids)] + k) for i, ids in coded for k, t in enumerate(ids) if t == one), key=lambda x: x[2])
    assert sorted((tuple(r) for r in token_store.locate_token(spark, path, one).collect()), key=lambda x: x[2]) == places
    assert token_store.locate_token(spark, path, rare).count() == 0
