"""One-dimensional Gaussian mixtures of the distances of a link."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, CLOSE, LEAST_WEIGHT, NEAR = 1000, 1e-4, 0.1, 0.2


def fit(x: np.ndarray, n: np.ndarray, k: int, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, deviations, weights and BIC of k components of values x that occur n times, begun at even steps over the range. ``delta`` fixes the deviation if over 0.01."""
    size = n.sum()
    centre = (n * x).sum() / size
    spread = max(np.sqrt((n * (x - centre) ** 2).sum() / size), 1e-9)
    if k == 1:
        mean, dev, weight = np.array([centre]), np.array([spread]), np.ones(1)
    else:
        mean = np.linspace(x.min(), x.max(), k)
        dev = np.full(k, delta if delta > 0.01 else spread)
        weight = np.full(k, 1 / k)
        for _ in range(ROUNDS):
            share = np.exp(_log(x, mean, dev, weight))
            share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
            mass = np.maximum(share.sum(0), 1e-300)
            moved = (share * x[:, None]).sum(0) / mass
            weight = mass / size
            if delta <= 0.01:
                dev = np.maximum(np.sqrt((share * (x[:, None] - moved) ** 2).sum(0) / mass), 1e-9)
            change = abs(moved - mean).sum() / max(abs(moved).sum(), 1e-300)
            mean = moved
            if change < CLOSE:
                break
    logs = _log(x, mean, dev, weight)
    top = logs.max(1)
    likelihood = (n * (top + np.log(np.exp(logs - top[:, None]).sum(1)))).sum()
    return mean, dev, weight, 2 * k * np.log(size) - 2 * likelihood


def _log(x, mean, dev, weight):
    return np.log(np.maximum(weight, 1e-300)) - ((x[:, None] - mean) / dev) ** 2 / 2 - np.log(dev)


def peaks(values, times, delta: float, most: int = 3) -> list[tuple[float, float, float]]:
    """(mean, deviation, weight) of the fit of least BIC to values that occur so many times.

    In order of the fit, a peak that is light by then is dropped, one near a later one gives its weight to it, however light that is, and any other stays.
    """
    x, n = np.asarray(values, float), np.asarray(times, float)
    if not len(x):
        return []
    fits = [fit(x, n, k, delta) for k in range(1, min(most, int(n.sum())) + 1)]
    mean, dev, weight, _ = min(fits, key=lambda f: f[3])
    rows = [[m, d, w] for m, d, w in zip(mean, dev, weight, strict=True)]
    out = []
    for i, row in enumerate(rows):
        if row[2] < LEAST_WEIGHT:
            continue
        later = next((r for r in rows[i + 1 :] if abs(r[0] - row[0]) < NEAR * row[0]), None)
        if later is not None:
            later[2] += row[2]
        else:
            out.append(tuple(row))
    return out


def multi_peak(links: DataFrame, delta: float, mean_samples: int, most: int = 3) -> DataFrame:
    """(src, dst, n_peaks, distance): links of enough samples with several peaks; the distance is the heaviest peak's mean times kmer_cov.

    A link's samples are in its row already, so links are fitted batch by batch without a shuffle.
    """
    if delta <= 0.01:
        return links.select("src", "dst", F.lit(0).alias("n_peaks"), F.lit(0).cast("long").alias("distance")).limit(0)
    each = F.transform("distances", lambda x: x["distance"]).alias("x"), F.transform("distances", lambda x: x["n"]).alias("n")
    rows = links.where(F.col("kmer_cov") > max(100, mean_samples)).select("src", "dst", *each, "kmer_cov")

    def run(batches):
        for pdf in batches:
            found = [peaks(x, n, delta, most) for x, n in zip(pdf.x, pdf.n, strict=True)]
            pdf["n_peaks"] = [len(f) for f in found]
            pdf["distance"] = [int(max(f, key=lambda p: p[2])[0] * c) if f else 0 for f, c in zip(found, pdf.kmer_cov, strict=True)]
            yield pdf[pdf.n_peaks > 1][["src", "dst", "n_peaks", "distance"]]

    return rows.mapInPandas(run, "src long, dst long, n_peaks int, distance long")
