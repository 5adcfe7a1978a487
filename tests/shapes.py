"""Corpora for search tests: five shapes from one seed, and the brute-force oracle."""

from bitlark.functions import metrics
from bitlark.functions.rng import SplitMix64

SHAPES = ("balanced", "sparse", "clustered", "degenerate", "runs")


def corpus(shape: str, dims: int, n: int, seed: int) -> list[list[int]]:
    """Sets of positions."""
    rng = SplitMix64(seed)
    out = []
    for i in range(n):
        if shape == "balanced":
            bits = [p for p in range(dims) if rng.u64() & 1]
        elif shape == "sparse":
            bits = [p for p in range(dims) if rng.u64() % 64 == 0]
        elif shape == "clustered":
            start, length = rng.u64() % dims, rng.u64() % (dims // 8 + 1)
            bits = [p for p in range(dims) if start <= p < start + length]
        elif shape == "degenerate":
            rate = (0, 512, 1, 511)[i % 4]
            bits = [p for p in range(dims) if rng.u64() % 512 < rate]
        else:
            band = i // 16
            bits = [p for p in range(dims) if (p + band) % 7 == 0 or rng.u64() % 97 == 0]
        out.append(bits)
    return out


def brute(codes: dict[int, list[int]], query: list[int], metric: str, k: int) -> list[tuple]:
    q = set(query)
    found = []
    for doc, bits in codes.items():
        a, w, m = len(q & set(bits)), len(bits), len(q)
        s = metrics.score(metric, a, w, m)
        found.append((-s.key, doc, a, w, s.num, s.den))
    return [(doc, a, w, num, den) for _, doc, a, w, num, den in sorted(found)[:k]]
