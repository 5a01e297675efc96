"""Fits end at the maximum, wherever they begin."""

import math

import numpy as np
import pytest

from detectra.operators import errors, likelihood


@pytest.mark.parametrize("family", ["gumbel_r", "gumbel_l", "logistic"])
def test_fits_from_samples_end_at_the_maximum(family):
    for seed in range(8):
        r = np.random.default_rng(seed)
        z = r.gamma(1.2, 40, 20_000)
        own = errors.moments_of(z)
        begin = [x for x in errors.starts(*own) if x[0] == family]
        near = likelihood.climb(1000, own[2], own[3], begin, likelihood.over_array(r.choice(z, 1000)))
        (loc, scale), _ = likelihood.climb(len(z), own[2], own[3], [(family, near[family][0])], likelihood.over_array(z), errors.PASSES)[family]
        place = np.array([likelihood.KERNELS[family][1] * loc, math.log(scale)])
        _, grad, hess = likelihood.derivatives(len(z), family, likelihood.natural(place), likelihood.sums(z, family, likelihood.natural(place)))
        assert np.abs(np.linalg.solve(hess, grad) / [scale, 1.0]).max() < 1e-9
