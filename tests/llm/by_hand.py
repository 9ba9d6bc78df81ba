"""Components of fingerprints by comparing all pairs."""

from __future__ import annotations


def components_by_hand(fps: dict[int, int], distance: int = 2) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
