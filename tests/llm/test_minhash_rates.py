"""Measured misses of the MinHash functions against their stated bounds."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import jaccard_join, licenses
from ledgerlake.llm.shingles import ASCII_LETTERS, hashed_words


def missed_pairs(shared, own, n):
    """Of n pairs of texts with ``shared`` common shingles and ``own`` others each, those without a common prefix."""
    r = np.random.default_rng(0)
    texts = []
    for _ in range(n):
        w = [f"{x:x}" for x in r.integers(0, 1 << 40, shared + 4 + 2 * own)]
        texts += [" ".join(w[: shared + 4 + own]), " ".join(w[: shared + 4] + w[shared + 4 + own :])]
    depths = jaccard_join.levels()
    names = ["d1", "d2", "n", *[f"p{x}" for x in depths]]
    got = pa.Table.from_batches(jaccard_join._label(iter([pa.record_batch({"text": texts})]), names, depths))
    p = np.array(got[f"p{depths[-1]}"].combine_chunks().flatten()).reshape(n, 2, -1)
    return int((p[:, 0] != p[:, 1]).all(axis=1).sum())


@pytest.mark.parametrize("shared, own", [(80, 10), (102, 9), (90, 5), (114, 3)])
def test_isolated_pairs_are_found_at_the_stated_recall(shared, own):
    n, s = 12_000, shared / (shared + 2 * own)
    bound = (1 - s ** jaccard_join.levels()[-1]) ** jaccard_join.TREES
    assert bound <= 1 - jaccard_join.RECALL
    assert missed_pairs(shared, own, n) <= n * bound + 3 * (n * bound) ** 0.5 + 1


@pytest.mark.parametrize("share", [1.0, 0.8])
def test_notices_are_retrieved_at_the_stated_rate(share):
    values, offsets = hashed_words(pa.array([t for _, t in licenses.TEMPLATES]), ASCII_LETTERS)
    classes = licenses._classes([values[i:j] for i, j in zip(offsets, offsets[1:], strict=False)])
    r, n, missed = np.random.default_rng(1), 5_000, 0
    for c in classes:
        for t, (_, shingles) in enumerate(c.templates):
            h = r.integers(0, 1 << 64, (n, 2 * c.g), np.uint64)
            at = r.integers(0, 2 * c.g - len(shingles) + 1, n)
            for w in range(n):
                kept = r.permutation(len(shingles))[: int(np.ceil(share * len(shingles)))]
                h[w, at[w] + kept] = shingles[kept]
            found = licenses._candidates(h.ravel(), np.ones(h.size, bool), np.array([0, h.size]), [c])[0][1]  # windows start every g places, so these are the even ones
            missed += sum((2 * w, t) not in found for w in range(n))
    bound = n * len(licenses.TEMPLATES) * (17 / 21) ** licenses.BANDS
    assert missed <= bound + 3 * bound**0.5
