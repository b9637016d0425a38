"""Large buckets are parted by segments of the fingerprints without losing a link."""

import numpy as np
import pytest

from orbweaver.llm import simhash


def component_of(fps, pairs):
    up = {int(f): int(f) for f in fps}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(int(a)), root(int(b))
        up[max(a, b)] = min(a, b)
    return {int(f): root(int(f)) for f in fps}


@pytest.mark.parametrize("seed", range(4))
def test_parts_keep_every_link(seed):
    rng = np.random.default_rng(seed)
    fps = set()
    for base in rng.integers(0, 1 << 63, 3, dtype=np.uint64):
        for _ in range(150):
            x = int(base)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    want = component_of(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 3]])
    rows, keys = simhash.bucket_keys(fps)
    order = np.argsort(keys, kind="stable")
    a, b = simhash.bucket_links(keys[order], fps[rows[order]], 3, small=2, large=4)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    assert component_of(fps, zip(a, b, strict=True)) == want
