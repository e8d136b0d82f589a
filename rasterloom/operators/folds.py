"""Accumulators for neighbourhoods that are no weighted sum: how far samples spread, and how many outshine the centre."""

from __future__ import annotations

import numpy as np

from rasterloom.operators.engine import FoldOp, MapOp


class Spread(FoldOp):
    """The largest weighted sample minus the smallest."""

    def init(self, shape):
        return np.full(shape, 2**30), np.full(shape, -(2**30))

    def accumulate(self, state, samples, weight):
        return np.minimum(state[0], samples * weight), np.maximum(state[1], samples * weight)

    def finalize(self, state):
        return (state[1] - state[0]).astype(np.int32)


class Brighter(MapOp):
    """How many active cells are brighter than the centre."""

    def init(self, centre):
        return np.zeros(centre.shape, np.int32)

    def accumulate(self, state, centre, samples):
        return state + (samples > centre)

    def finalize(self, state, centre):
        return state
