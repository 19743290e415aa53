"""Quality scores do not depend on the texts that share a batch."""

import numpy as np
import pytest

from tallychain.llm import quality


@pytest.mark.parametrize("seed", [3, 7])
def test_a_text_scores_the_same_alone_and_in_company(seed):
    r = np.random.default_rng(seed)
    net = quality.Network(seed)
    texts = ["".join(map(chr, r.integers(32, 500, n))) for n in r.integers(0, 4000, 200)] + ["", None, "é" * 300_000]
    together = net.scores(texts)
    assert np.array_equal(together, [net.scores([t])[0] for t in texts])
    turned = r.permutation(len(texts))
    assert np.array_equal(net.scores([texts[i] for i in turned]), together[turned])
    assert together[-3] == together[-2] and net.scores([]).shape == (0,)
