"""Linear-chain conditional random field over many short and long sequences at once.

Sequences stand one after another in flat arrays. The recursions run over chunks side by side: the
first sweep gives each chunk's transfer matrix, a short walk over the chunks gives what enters each,
and a second sweep fills in the messages. A sequence may be as long as it likes.
"""

from __future__ import annotations

import numpy as np

CHUNK = 128


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-30)


def _messages(emit: np.ndarray, start: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward messages, scaled: m[t] = (m[t - 1] @ step) * emit[t], or first * emit[t] where start[t]."""
    n, k = emit.shape
    chunks = -(-n // CHUNK)
    pad = chunks * CHUNK - n
    e = np.concatenate([emit, np.ones((pad, k), emit.dtype)]).reshape(chunks, CHUNK, k)
    s = np.concatenate([start, np.zeros(pad, bool)]).reshape(chunks, CHUNK)
    transfer = np.broadcast_to(np.eye(k, dtype=emit.dtype), (chunks, k, k)).copy()
    for t in range(CHUNK):
        transfer = transfer @ step
        begins = s[:, t]
        if begins.any():  # what came before does not matter
            transfer[begins] = first
        transfer *= e[:, t, None, :]
        transfer /= np.maximum(transfer.sum(axis=(1, 2), keepdims=True), 1e-30)
    enter = np.empty((chunks, k), emit.dtype)
    now = np.full(k, 1 / k, emit.dtype)
    for c in range(chunks):
        enter[c] = now
        now = _scaled(now @ transfer[c])
    out = np.empty((chunks, CHUNK, k), emit.dtype)
    now = enter
    for t in range(CHUNK):
        now = now @ step
        now[s[:, t]] = first
        now = _scaled(now * e[:, t])
        out[:, t] = now
    return out.reshape(-1, k)[:n]


def posteriors(scores: np.ndarray, start: np.ndarray, moves: np.ndarray, opens: np.ndarray):
    """Label probabilities of every position, and the expected counts of moves and of first labels.

    scores: per position and label; start: whether a sequence begins; moves[a, b], opens[a]: log weights.
    """
    emit = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))
    step, first = np.exp(moves - moves.max()), np.exp(opens - opens.max())
    ahead = _messages(emit, start, step, first)
    # Backward, on the reversed arrays: the emission times what follows, and from that what follows alone.
    last = np.r_[start[1:], True]
    after = _messages(emit[::-1], last[::-1], step.T.copy(), np.ones_like(first))[::-1]
    beyond = np.ones_like(after)
    beyond[:-1] = after[1:] @ step.T
    beyond[last] = 1
    label = _scaled(ahead * beyond)
    inside = np.flatnonzero(~start)
    both = ahead[inside - 1][:, :, None] * step[None] * after[inside][:, None, :]
    both /= np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-30)
    return label, both.sum(axis=0), label[start].sum(axis=0)
