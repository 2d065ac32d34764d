"""A bidirectional LSTM in numpy that labels the blocks of a page, with document-wide context from both directions."""

from __future__ import annotations

import numpy as np

HIDDEN = 20
CELLS = 60_000


def fresh(width: int, seed: int = 1, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out: dict[str, np.ndarray] = {}
    for d in "fb":
        out[f"w{d}"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * hidden)).astype(np.float32)
        out[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden:2 * hidden] = 1
        out[f"c{d}"] = bias
    out["v"] = rng.normal(0, 1 / np.sqrt(2 * hidden), 2 * hidden).astype(np.float32)
    out["v0"] = np.zeros(1, np.float32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, page, hidden); padding leaves the state as it is. Input is taken in order of axis 0."""
    steps, pages, _ = x.shape
    hidden = u.shape[0]
    into = x @ w + c
    h, s = np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32)
    out, held = np.zeros((steps, pages, hidden), np.float32), []
    for t in range(steps):
        gates = into[t] + h @ u
        i, f, o = (_sigmoid(gates[:, k * hidden:(k + 1) * hidden]) for k in range(3))
        g = np.tanh(gates[:, 3 * hidden:])
        m = live[t][:, None]
        s2 = np.where(m, f * s + i * g, s)
        th = np.tanh(s2)
        h2 = np.where(m, o * th, h)
        if keep:
            held.append((h, s, i, f, o, g, th, m))
        h, s = h2, s2
        out[t] = h
    return out, held


def _back(dh_out: np.ndarray, x: np.ndarray, held: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hidden = u.shape[0]
    du = np.zeros_like(u)
    dgates_all = np.zeros((x.shape[0], x.shape[1], 4 * hidden), np.float32)
    dh, ds = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
    for t in range(x.shape[0] - 1, -1, -1):
        h, s, i, f, o, g, th, m = held[t]
        dh = dh + dh_out[t]
        live_dh = np.where(m, dh, 0)
        do = live_dh * th
        dcell = np.where(m, ds, 0) + live_dh * o * (1 - th * th)
        dg = np.concatenate([dcell * g * i * (1 - i), dcell * s * f * (1 - f), do * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
        dgates_all[t] = dg
        du += h.T @ dg
        dh = np.where(m, 0, dh) + dg @ u.T
        ds = np.where(m, dcell * f, ds)
    flat = dgates_all.reshape(-1, 4 * hidden)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward input, backward input, live) with time first; the backward input is every page in reverse."""
    steps = max(len(p) for p in pages)
    fwd = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    bwd, live = np.zeros_like(fwd), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        fwd[:len(p), k], bwd[:len(p), k], live[:len(p), k] = p, p[::-1], True
    return fwd, bwd, live


def _flip(h: np.ndarray, pages: list[np.ndarray]) -> np.ndarray:
    out = np.zeros_like(h)
    for k, p in enumerate(pages):
        out[:len(p), k] = h[:len(p), k][::-1]
    return out


def scores(model: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of main text for every block of every page. Pages are run in groups of like length and bounded size."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= CELLS:
            end += 1
        group = [pages[k] for k in order[at:end]]
        fwd, bwd, live = _batch(group)
        hf, _ = _run(fwd, live, model["wf"], model["uf"], model["cf"], False)
        hb, _ = _run(bwd, live, model["wb"], model["ub"], model["cb"], False)
        both = np.concatenate([hf, _flip(hb, group)], axis=2) @ model["v"] + model["v0"]
        for n, k in enumerate(order[at:end]):
            out[k] = _sigmoid(both[:len(pages[k]), n])
        at = end
    return out


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 1) -> dict[str, np.ndarray]:
    """Adam on the cross entropy of all blocks."""
    model = fresh(pages[0].shape[1], seed)
    rng = np.random.default_rng(seed)
    m1, m2, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    order = np.array(sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k])))
    for epoch in range(epochs):
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            chosen = [pages[k] for k in groups[g]]
            fwd, bwd, live = _batch(chosen)
            want = np.zeros(live.shape, np.float32)
            for n, k in enumerate(groups[g]):
                want[:len(labels[k]), n] = labels[k]
            hf, keep_f = _run(fwd, live, model["wf"], model["uf"], model["cf"], True)
            hb, keep_b = _run(bwd, live, model["wb"], model["ub"], model["cb"], True)
            both = np.concatenate([hf, _flip(hb, chosen)], axis=2)
            diff = np.where(live, _sigmoid(both @ model["v"] + model["v0"]) - want, 0) / live.sum()
            dboth = diff[:, :, None] * model["v"]
            n = hf.shape[2]
            grad = {"v": np.einsum("tp,tph->h", diff, both), "v0": diff.sum(keepdims=True).reshape(1)}
            grad["wf"], grad["uf"], grad["cf"] = _back(dboth[:, :, :n], fwd, keep_f, model["wf"], model["uf"])
            grad["wb"], grad["ub"], grad["cb"] = _back(_flip(dboth[:, :, n:], chosen), bwd, keep_b, model["wb"], model["ub"])
            step += 1
            pace = rate * (1 - epoch / epochs) + 0.0005
            for k in model:
                gk = np.clip(grad[k], -1, 1)
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
                model[k] = (model[k] - pace * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model
