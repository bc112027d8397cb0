"""Linear-chain conditional random field in numpy: fitting, and Viterbi decoding of many sequences at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    weight: np.ndarray  # features x labels
    step: np.ndarray  # labels x labels, from the label before to this one
    begin: np.ndarray  # labels


def blocks(lengths: np.ndarray, cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Indices of sequences of similar length, so that a padded block has about ``cells`` cells; empty ones are left out."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and int(lengths[order[end]]) * (end + 1 - at) <= cells:
            end += 1
        yield order[at:end]
        at = end


def _padded(score: np.ndarray, first: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = int(lengths[pick].max())
    place = first[pick][:, None] + np.arange(longest)
    real = np.arange(longest) < lengths[pick][:, None]
    return score[np.where(real, place, 0)], real, place


def viterbi(crf: Crf, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of every row of ``x`` (rows of all sequences, one after the other). Ties go to the smaller label."""
    score = x @ crf.weight
    out = np.zeros(len(x), np.int8)
    first = np.cumsum(lengths) - lengths
    for pick in blocks(lengths):
        s, real, place = _padded(score, first, lengths, pick)
        best = s[:, 0] + crf.begin
        back = np.zeros((s.shape[1], len(pick), s.shape[2]), np.int8)
        for t in range(1, s.shape[1]):
            ways = best[:, :, None] + crf.step
            back[t] = ways.argmax(1)
            on = real[:, t, None]
            best = np.where(on, ways.max(1) + s[:, t], best)
            back[t] = np.where(on, back[t], np.arange(s.shape[2]))  # past the end, a label points to itself
        label = best.argmax(1)
        rows = np.arange(len(pick))
        for t in range(s.shape[1] - 1, -1, -1):
            on = real[:, t]
            out[place[on, t]] = label[on]
            label = back[t][rows, label]
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, labels: int, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with a quadratic penalty, by Adam on all sequences; deterministic."""
    shape = [(x.shape[1], labels), (labels, labels), (labels,)]
    theta = [np.zeros(s) for s in shape]
    m, v = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape]
    first, n = np.cumsum(lengths) - lengths, max(1, len(x))
    for step in range(1, rounds + 1):
        weight, trans, begin = theta
        score, seen = x @ weight, np.zeros((len(x), labels))
        g_trans, g_begin = np.zeros_like(trans), np.zeros_like(begin)
        for pick in blocks(lengths, 1 << 15):
            s, real, place = _padded(score, first, lengths, pick)
            size, longest = s.shape[:2]
            ahead = np.empty_like(s)
            ahead[:, 0] = s[:, 0] + begin
            for t in range(1, longest):
                ahead[:, t] = np.where(real[:, t, None], _log_sum(ahead[:, t - 1, :, None] + trans, 1) + s[:, t], ahead[:, t - 1])
            total = _log_sum(ahead[:, -1], 1)
            after = np.zeros((size, labels))
            for t in range(longest - 1, -1, -1):
                on = real[:, t]
                p = np.exp(ahead[:, t] + after - total[:, None])
                seen[place[on, t]] = p[on]
                if t:
                    both = np.exp(ahead[:, t - 1, :, None] + trans + (s[:, t] + after)[:, None, :] - total[:, None, None])
                    g_trans += both[on].sum(0)
                    after = np.where(on[:, None], _log_sum(trans + (s[:, t] + after)[:, None, :], 2), after)
            g_begin += np.exp(ahead[:, 0] + after - total[:, None]).sum(0) if longest == 1 else seen[place[:, 0]].sum(0)
        truth = np.eye(labels)[y]
        starts = first[lengths > 0]
        inner = np.ones(len(x), bool)
        inner[starts] = False
        pairs = np.flatnonzero(inner)
        want = np.zeros_like(trans)
        np.add.at(want, (y[pairs - 1], y[pairs]), 1)
        grads = [x.T @ (seen - truth) / n + decay * weight, (g_trans - want) / n + decay * trans,
                 (g_begin - truth[starts].sum(0)) / n + decay * begin]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Crf(*theta)
