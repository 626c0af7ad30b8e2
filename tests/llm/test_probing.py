"""Probing decides which rows get a full distance."""

import numpy as np

from hazegrid.llm import mih


def test_full_distances_are_of_probed_rows_only(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    m = mih.Model(np.zeros(64), np.concatenate([mih._rotation(x, s) for s in range(4)], axis=1), 40)
    c, seen, count = m.codes(x), [], np.bitwise_count

    def counted(v):
        if v.dtype == np.uint64:
            seen.append(v.size // (mih.BITS // 64))
        return count(v)

    monkeypatch.setattr(np, "bitwise_count", counted)
    got = mih.search_shard(np.arange(300), x, c, np.arange(1000, 1010), x[:10], c[:10], 40, 1)
    assert [int(f[1][0]) for f in got] == list(range(10)) and sum(seen) < 300
