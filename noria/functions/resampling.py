"""Change of sampling rate by a rational factor: a low-pass filter split into its phases.

Output number m is the sum over inputs k of x[k] h(m * down - k * up), where h is a windowed sinc around 0. Only ``up`` different
sets of taps occur, one for each (m * down) mod up; the outputs of a phase take windows of the input that lie ``down`` apart, so
each phase is one matrix product. Any range of outputs needs a bounded range of inputs, so that a long recording can be
resampled block by block.
"""

from __future__ import annotations

import functools
import math

import numpy as np

#: Zero crossings of the sinc on each side, and the shape of its Kaiser window.
CROSSINGS, BETA = 10, 5.0


def ratio(source: int, target: int) -> tuple[int, int]:
    """(up, down) in lowest terms."""
    g = math.gcd(source, target)
    return target // g, source // g


def low_pass(up: int, down: int) -> np.ndarray:
    """The filter at the rate times ``up``: unit gain at 0 for the input, cut off at the lower of both rates' limits."""
    widest = max(up, down)
    t = np.arange(-CROSSINGS * widest, CROSSINGS * widest + 1)
    h = np.sinc(t / widest) * np.kaiser(len(t), BETA)
    return h * (up / h.sum())


@functools.lru_cache(maxsize=16)
def phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """(taps by phase, reach): row p, column reach + j is the weight of the input j after the one at or before the output."""
    h = low_pass(up, down)
    half = len(h) // 2
    reach = -(-half // up)
    t = half + np.arange(up)[:, None] - np.arange(-reach, reach + 1)[None, :] * up
    return np.where((t >= 0) & (t < len(h)), h[np.clip(t, 0, len(h) - 1)], 0.0), reach


def outputs(n: int, up: int, down: int) -> int:
    """How many outputs n inputs have."""
    return -(-n * up // down)


def inputs_of(first: int, stop: int, up: int, down: int) -> tuple[int, int]:
    """The range of inputs that outputs first to stop (exclusive) need; it may reach beyond the ends, where there are zeros."""
    reach = phases(up, down)[1]
    return first * down // up - reach, (max(first, stop - 1) * down) // up + reach + 1


def resample_range(x: np.ndarray, begins: int, first: int, stop: int, up: int, down: int) -> np.ndarray:
    """Outputs first to stop (exclusive) of a signal of which x has the samples from number ``begins`` on; what x lacks is zero."""
    if stop <= first:
        return np.zeros(0)
    taps, reach = phases(up, down)
    low, high = inputs_of(first, stop, up, down)
    held = np.zeros(high - low)
    a, b = max(low, begins), min(high, begins + len(x))
    if b > a:
        held[a - low : b - low] = x[a - begins : b - begins]
    windows = np.lib.stride_tricks.sliding_window_view(held, 2 * reach + 1)
    out = np.empty(stop - first)
    for k in range(min(up, stop - first)):  # a phase each
        m = first + k
        at = m * down // up - reach - low
        out[k::up] = windows[at :: down][: len(range(k, stop - first, up))] @ taps[m * down % up]
    return out


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """x at another rate, as float32; at the same rate as it is."""
    up, down = ratio(source, target)
    if up == down or not len(x):
        return x
    return resample_range(np.asarray(x, float), 0, 0, outputs(len(x), up, down), up, down).astype(np.float32)
