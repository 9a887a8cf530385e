"""Neighbourhood filters on dense rows."""

import math

from pyspark.sql import functions as F

from voxframe.operators import kernels


def gaussian_taps(sigma, radius):
    """Normalised Gaussian weights from -radius to radius, as numbers."""
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(weights)
    return [w / total for w in weights]


def _apply(patches, taps, edge, out):
    return kernels.pin(patches).withColumn(
        out, kernels.separable(F.col("data"), F.col("dz"), F.col("dy"), F.col("dx"), taps, edge)
    )


def gaussian_filter(patches, sigma=0.7, truncate=4.0, out="data"):
    """Separable Gaussian, reflected edges, radius int(truncate * sigma + .5)."""
    taps = gaussian_taps(sigma, int(truncate * sigma + 0.5))
    return _apply(patches, F.array(*[F.lit(w) for w in taps]), "reflect", out)


def uniform_filter(patches, size=15, out="data"):
    """Separable local mean, reflected edges."""
    return _apply(patches, F.array_repeat(F.lit(1.0 / size), size), "reflect", out)


def blur_taps(sigma):
    """Five normalised Gaussian weights for a sigma column."""
    s = F.greatest(sigma, F.lit(1e-8))
    near, far = F.exp(F.lit(-0.5) / (s * s)), F.exp(F.lit(-2.0) / (s * s))
    total = near * 2.0 + far * 2.0 + 1.0
    return F.array(far / total, near / total, F.lit(1.0) / total, near / total, far / total)


def gaussian_blur_5(patches, sigma, out="data"):
    """Five taps normalised, replicated edges; ``sigma`` is a column or number."""
    sigma = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else sigma
    return _apply(patches, blur_taps(sigma), "replicate", out)
