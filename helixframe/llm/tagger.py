"""A bidirectional LSTM over characters with a linear-chain CRF on top, in numpy.

Windows are rows of character classes, all of one length.  Both directions run
side by side; the CRF's sums and products are scaled step by step.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def created(classes: int, hidden: int, tags: int, seed: int = 0) -> Params:
    """Parameters to begin with.  ``inputs`` holds each class's contribution to the gates (in, forget, out, cell)."""
    rng = np.random.default_rng(seed)
    inputs = rng.normal(0, 0.3, (2, classes, 4 * hidden))
    inputs[:, :, hidden : 2 * hidden] += 1.0  # remember at first
    return {
        "inputs": inputs.astype(np.float32),
        "hidden": (rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden))).astype(np.float32),
        "out": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, tags)).astype(np.float32),
        "bias": np.zeros(tags, np.float32),
        "moves": np.zeros((tags, tags), np.float32),
        "first": np.zeros(tags, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _states(p: Params, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, direction, window, hidden) of ids (window, time); the second direction is in reversed time."""
    n, steps = ids.shape
    size = p["hidden"].shape[1]
    both = np.stack([ids.T, ids.T[::-1]], 1)  # time, direction, window
    h = c = np.zeros((2, n, size), p["hidden"].dtype)
    out, past = np.empty((steps, 2, n, size), p["hidden"].dtype), []
    for t in range(steps):
        z = np.matmul(h, p["hidden"])
        z[0] += p["inputs"][0][both[t, 0]]
        z[1] += p["inputs"][1][both[t, 1]]
        gates = _sigmoid(z[..., : 3 * size])
        cell = np.tanh(z[..., 3 * size :])
        before, c = c, gates[..., size : 2 * size] * c + gates[..., :size] * cell
        bent = np.tanh(c)
        if keep:
            past.append((both[t], h, gates, cell, before, bent))
        out[t] = h = gates[..., 2 * size :] * bent
    return out, past


def _scores(p: Params, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag scores (time, window, tag), and both directions' states next to each other."""
    joined = np.concatenate([states[:, 0], states[::-1, 1]], -1)
    return joined @ p["out"] + p["bias"], joined


def _chain(p: Params, scores: np.ndarray, allowed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward weights, local weights and scales of the chain, and the log of the sum over all taggings."""
    steps, n, tags = scores.shape
    move = np.exp(p["moves"]) * allowed
    top = scores.max(-1, keepdims=True)
    local = np.exp(scores - top)
    a, b, scale = np.empty_like(local), np.empty_like(local), np.empty((steps, n, 1), local.dtype)
    for t in range(steps):
        a[t] = (np.exp(p["first"]) * begins if t == 0 else a[t - 1] @ move) * local[t]
        scale[t] = a[t].sum(-1, keepdims=True)
        a[t] /= scale[t]
    b[-1] = 1
    for t in range(steps - 2, -1, -1):
        b[t] = (b[t + 1] * local[t + 1] / scale[t + 1]) @ move.T
    return a, b, local, scale, (np.log(scale) + top).sum((0, 2))


def loss_and_gradients(p: Params, ids: np.ndarray, tags: np.ndarray, allowed: np.ndarray, begins: np.ndarray) -> tuple[float, Params]:
    """Mean negative log likelihood of ``tags`` (window, time), and its gradients."""
    n, steps = ids.shape
    size = p["hidden"].shape[1]
    states, past = _states(p, ids, True)
    scores, joined = _scores(p, states)
    a, b, local, scale, whole = _chain(p, scores, allowed, begins)
    y = tags.T
    right = np.take_along_axis(scores, y[..., None], -1)[..., 0].sum(0) + p["first"][y[0]] + p["moves"][y[:-1], y[1:]].sum(0)
    wrong = a * b  # probability of each tag
    g: Params = {"first": wrong[0].sum(0) - np.bincount(y[0], minlength=scores.shape[2])}
    ahead = b[1:] * local[1:] / scale[1:]
    pairs = np.einsum("tni,tnj->ij", a[:-1], ahead, optimize=True) * np.exp(p["moves"]) * allowed
    seen = np.zeros_like(pairs)
    np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
    g["moves"] = pairs - seen
    np.put_along_axis(wrong, y[..., None], np.take_along_axis(wrong, y[..., None], -1) - 1, -1)
    g["bias"] = wrong.sum((0, 1))
    g["out"] = joined.reshape(-1, 2 * size).T @ wrong.reshape(-1, wrong.shape[2])
    back = wrong @ p["out"].T
    d_states = np.stack([back[..., :size], back[::-1, :, size:]], 1)
    g["hidden"], g["inputs"] = np.zeros_like(p["hidden"]), np.zeros_like(p["inputs"])
    dh, dc = np.zeros((2, n, size), scores.dtype), np.zeros((2, n, size), scores.dtype)
    dz = np.empty((steps, 2, n, 4 * size), scores.dtype)
    turned = p["hidden"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        _, h, gates, cell, before, bent = past[t]
        i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - bent * bent)
        z = dz[t]
        z[..., :size] = dc * cell * i * (1 - i)
        z[..., size : 2 * size] = dc * before * f * (1 - f)
        z[..., 2 * size : 3 * size] = dh * bent * o * (1 - o)
        z[..., 3 * size :] = dc * i * (1 - cell * cell)
        g["hidden"] += np.matmul(h.transpose(0, 2, 1), z)
        dh, dc = np.matmul(z, turned), dc * f
    classes = p["inputs"].shape[1]
    for d in (0, 1):
        flat = np.concatenate([step[0][d] for step in past])
        order = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[order], np.arange(classes))
        met = np.flatnonzero(np.bincount(flat, minlength=classes))
        g["inputs"][d][met] = np.add.reduceat(dz[:, d].reshape(-1, 4 * size)[order], cuts[met], 0)
    return float((whole - right).mean()), {k: v / n for k, v in g.items()}


def trained(ids: np.ndarray, tags: np.ndarray, weights: Params, allowed: np.ndarray, begins: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 0) -> Params:
    """``weights`` after Adam steps over minibatches, with a falling rate and gradients of a bounded length."""
    p = {k: v.copy() for k, v in weights.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    rng = np.random.default_rng(seed)
    step, steps = 0, epochs * -(-len(ids) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(ids), batch):
            own = order[at : at + batch]
            _, g = loss_and_gradients(p, ids[own], tags[own], allowed, begins)
            length = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in p:
                x = g[k] * min(1.0, 5.0 / max(length, 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(p[k].dtype)
    return p


def decoded(p: Params, ids: np.ndarray, allowed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest tagging (window, time) and the probability of each of its tags."""
    scores, _ = _scores(p, _states(p, ids, False)[0])
    a, b, *_ = _chain(p, scores, allowed, begins)
    steps, n, tags = scores.shape
    move = np.where(allowed > 0, p["moves"], -1e9)
    best, came = np.where(begins > 0, p["first"], -1e9) + scores[0], np.empty((steps, n, tags), np.int8)
    for t in range(1, steps):
        ways = best[:, :, None] + move
        came[t] = ways.argmax(1)
        best = ways.max(1) + scores[t]
    path = np.empty((steps, n), np.int64)
    path[-1] = best.argmax(-1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = came[t][np.arange(n), path[t]]
    return path.T, np.take_along_axis(a * b, path[..., None], -1)[..., 0].T
