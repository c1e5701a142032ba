"""A one-layer causal self-attention model over subword ids, in numpy.

The SIDE * SIDE most frequent ids, the end of a text among them, have an input and an output vector each;
they are the slots 0, 1, ... by frequency. An output is chosen in two steps that both depend on the context:
a class of SIDE neighbouring slots, then the slot within it. The ids beyond them share one more class and one
input vector, and are told apart by their smoothed corpus frequency, so P(id) is a proper distribution over
the whole vocabulary. Contexts are overlapping windows of 2 * HALF inputs; each window predicts what follows
its last HALF inputs, so every token is scored once, with at least HALF inputs of context where the text has
them. Positions act through a bias on the attention scores.
"""

from __future__ import annotations

import numpy as np

HALF = 16
DIM = 16
SIDE = 64
HEAD = SIDE * SIDE  # ids with a slot of their own
REST, START, PAD = HEAD, HEAD + 1, HEAD + 2
CLIP = 30  # bound of an attention score

_causal = np.where(np.arange(2 * HALF)[None, :] > np.arange(HALF, 2 * HALF)[:, None], np.float32(-1e9), np.float32(0))
_flat = np.arange((HEAD + 3) * DIM).reshape(-1, DIM)  # places of an input vector's numbers


class Slots:
    """Slot of each id (the last id is the end of a text); log probability of an id within its slot."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype(np.float64) + 0.1
        order = np.lexsort((np.arange(len(c)), -c))
        self.of = np.full(len(c), REST, dtype=np.int16)
        self.of[order[:HEAD]] = np.arange(min(HEAD, len(c)))
        rest = self.of == REST
        self.within = np.where(rest, np.log(c) - np.log(c[rest].sum() if rest.any() else 1.0), 0.0)
        self.end = int(self.of[-1])
        self.bias = np.log(np.bincount(np.minimum(self.of // SIDE, SIDE), c, SIDE + 1) + 1e-9)
        own = np.log(np.append(c[order[:HEAD]], np.full(max(0, HEAD - len(c)), 1e-9))).reshape(SIDE, SIDE)
        self.member_bias = own - own.max(axis=1, keepdims=True)


def windows(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, 2 * HALF), targets (n, HALF; -1: none) and text number of each window, from slots."""
    n = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    blocks = -(-n // HALF)
    size = (blocks + 1) * HALF
    base = size.cumsum() - size
    inputs = np.full(int(size.sum()), PAD, dtype=np.int16)
    targets = np.full(int(size.sum()), -1, dtype=np.int16)
    at = np.repeat(base + HALF - (n.cumsum() - n), n) + np.arange(int(n.sum()))
    flat = np.full(int(n.sum()), end, dtype=np.int16)
    inside = np.ones(len(flat), dtype=bool)
    inside[n.cumsum() - 1] = False
    flat[inside] = np.concatenate(texts) if len(texts) else flat[:0]
    targets[at] = flat
    inputs[at[1:]] = flat[:-1]
    inputs[base + HALF] = START
    first = np.repeat(base - (blocks.cumsum() - blocks) * HALF, blocks) + np.arange(int(blocks.sum())) * HALF
    span = np.arange(2 * HALF)
    return inputs[first[:, None] + span], targets[first[:, None] + HALF + np.arange(HALF)], np.repeat(np.arange(len(texts)), blocks)


def initial(slots: Slots | None = None, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights before training; with `slots` the outputs start at the corpus frequencies."""
    rng = np.random.default_rng(seed)
    shape = {"e": (HEAD + 3, DIM), "r": (HALF, 2 * HALF), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "c": (DIM, SIDE + 1), "u": (SIDE, DIM, SIDE)}
    m = {n: rng.normal(0, 0.3 if n == "e" else 0.1, s).astype(np.float32) for n, s in shape.items()}
    m["cb"] = (slots.bias if slots else np.zeros(SIDE + 1)).astype(np.float32)
    m["ub"] = (slots.member_bias if slots else np.zeros((SIDE, SIDE))).astype(np.float32)
    return m


def _attend(m: dict, inputs: np.ndarray, q: np.ndarray, keys: np.ndarray):
    """Exponentials of the scores, one over their sums, and which scores are within CLIP, if not all; the others
    are cut to it."""
    a, inside = q @ keys.transpose(0, 2, 1), None
    if max(a.max(initial=0), -a.min(initial=0)) >= CLIP:
        inside = np.abs(a) < CLIP
        np.clip(a, -CLIP, CLIP, out=a)
    a += m["r"] + _causal
    np.exp(a, out=a)
    short = np.flatnonzero((inputs[:, 0] == PAD) | (inputs[:, -1] == PAD))  # a window's pads are at its ends
    if len(short):
        a[short] *= (inputs[short] != PAD)[:, None, :]
    total = a.reshape(-1, 2 * HALF) @ np.ones(2 * HALF, dtype=a.dtype)
    return a, (1 / np.maximum(total, 1e-30)).reshape(a.shape[:2])[:, :, None], inside  # inputs past a text's end see nothing


def _with_bias(w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights and bias in one, for inputs that end in a 1."""
    return np.concatenate([w, bias[..., None, :]], axis=-2)


def _exp_sums(logits: np.ndarray):
    """Sum of each row's exponentials and what was taken from the row before; the logits become exponentials."""
    top = None
    if max(logits.max(initial=0), -logits.min(initial=0)) > 60:
        top = logits.max(axis=1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], dtype=logits.dtype), top


def _log(total: np.ndarray, top: np.ndarray | None) -> np.ndarray:
    return np.log(total) if top is None else np.log(total) + top


def _by_class(t: np.ndarray):
    """Places of the targets by class, their classes and members, (class, first, last + 1) of each class of own
    slots, and how many targets have one."""
    group = (t // SIDE).astype(np.int8)  # -1: no target
    rows = np.argsort(group, kind="stable")
    edge = np.searchsorted(group[rows], np.arange(SIDE + 1, dtype=np.int8))
    rows, edge = rows[edge[0] :], edge - edge[0]
    group = group[rows].astype(np.int64)
    return rows, group, t[rows] % SIDE, [(g, edge[g], edge[g + 1]) for g in np.flatnonzero(np.diff(edge)).tolist()], int(edge[-1])


def log_probs(m: dict, inputs: np.ndarray, targets: np.ndarray, batch: int = 256) -> np.ndarray:
    """Natural log probability of each window's targets, summed per window in double precision."""
    out = np.empty(len(inputs))
    e, ask, keys, values = m["e"], m["e"] @ m["q"], m["e"] @ m["k"], m["e"] @ m["v"]
    c, u = _with_bias(m["c"], m["cb"]), _with_bias(m["u"], m["ub"])
    for at in range(0, len(inputs), batch):
        some = inputs[at : at + batch]
        late = some[:, HALF:].ravel()
        a, scale, _ = _attend(m, some, ask.take(late, axis=0).reshape(-1, HALF, DIM), keys.take(some, axis=0))
        seen = a @ values.take(some, axis=0)
        seen *= scale
        y = seen.reshape(-1, DIM)
        y += e.take(late, axis=0)
        t = targets[at : at + batch].ravel()
        rows, group, member, parts, own = _by_class(t)
        y1 = np.ones((len(rows), DIM + 1), dtype=y.dtype)
        y1[:, :DIM] = y.take(rows, axis=0)
        logits = y1 @ c
        hit = logits.ravel().take(np.arange(len(rows)) * (SIDE + 1) + group).astype(np.float64)
        hit -= _log(*_exp_sums(logits))
        logits = np.empty((own, SIDE), dtype=y.dtype)
        for g, first, last in parts:
            np.matmul(y1[first:last], u[g], out=logits[first:last])
        hit[:own] += logits.ravel().take(np.arange(own) * SIDE + member[:own])
        hit[:own] -= _log(*_exp_sums(logits))
        whole = np.zeros(len(t))
        whole[rows] = hit
        out[at : at + batch] = whole.reshape(-1, HALF).sum(axis=1)
    return out


def _residuals(logits: np.ndarray, at: np.ndarray, n: int) -> float:
    """Loss of the rows, whose targets are the flat places `at`; the logits become its gradient over n."""
    flat = logits.ravel()
    loss = -float(flat.take(at).sum(dtype=np.float64))
    total, top = _exp_sums(logits)
    loss += float(_log(total, top).sum(dtype=np.float64))
    total *= n
    logits *= (1 / total)[:, None]
    flat[at] -= logits.dtype.type(1 / n)
    return loss


def gradients(m: dict, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss per token and its gradients."""
    place = inputs.ravel()
    x = m["e"].take(place, axis=0)
    late = x.reshape(-1, 2, HALF, DIM)[:, 1].reshape(-1, DIM)
    keys, values = (x @ m["k"]).reshape(-1, 2 * HALF, DIM), (x @ m["v"]).reshape(-1, 2 * HALF, DIM)
    q = (late @ m["q"]).reshape(-1, HALF, DIM)
    a, scale, inside = _attend(m, inputs, q, keys)
    a *= scale
    seen = (a @ values).reshape(-1, DIM)
    seen += late
    t = targets.ravel()
    rows, group, member, parts, own = _by_class(t)
    n = max(1, len(rows))
    y1 = np.ones((len(rows), DIM + 1), dtype=x.dtype)
    y1[:, :DIM] = seen.take(rows, axis=0)
    p = y1 @ _with_bias(m["c"], m["cb"])
    loss = _residuals(p, np.arange(len(rows)) * (SIDE + 1) + group, n)
    gc, d = (p.T @ y1).T, p @ np.ascontiguousarray(m["c"].T)
    p, u = np.empty((own, SIDE), dtype=x.dtype), _with_bias(m["u"], m["ub"])
    for k, first, last in parts:
        np.matmul(y1[first:last], u[k], out=p[first:last])
    loss += _residuals(p, np.arange(own) * SIDE + member[:own], n)
    gu = np.zeros_like(u)
    for k, first, last in parts:
        np.matmul(y1[first:last].T, p[first:last], out=gu[k])
        d[first:last] += p[first:last] @ m["u"][k].T
    g = {"c": gc[:DIM], "cb": gc[DIM], "u": gu[:, :DIM], "ub": gu[:, DIM]}
    dy = np.zeros((len(t), DIM), dtype=x.dtype)
    dy[rows] = d
    wide = dy.reshape(-1, HALF, DIM)
    da = wide @ values.transpose(0, 2, 1)
    dv = (a.transpose(0, 2, 1) @ wide).reshape(-1, DIM)
    da *= a
    a *= (da.reshape(-1, 2 * HALF) @ np.ones(2 * HALF, dtype=a.dtype)).reshape(a.shape[:2])[:, :, None]
    da -= a
    g["r"] = da.sum(axis=0)
    if inside is not None:
        da *= inside
    dk, dq = (da.transpose(0, 2, 1) @ q).reshape(-1, DIM), (da @ keys).reshape(-1, DIM)
    dx = dk @ m["k"].T
    dx += dv @ m["v"].T
    dy += dq @ m["q"].T
    dx.reshape(-1, 2, HALF, DIM)[:, 1] += dy.reshape(-1, HALF, DIM)
    g |= {"k": x.T @ dk, "v": x.T @ dv, "q": late.T @ dq}
    g["e"] = np.bincount(_flat.take(place, axis=0).ravel(), dx.ravel(), m["e"].size).reshape(m["e"].shape).astype(dx.dtype)
    return loss / n, g


class Adam:
    def __init__(self, m: dict, rate: float):
        self.rate, self.n = rate, 0
        self.one = {k: np.zeros_like(v) for k, v in m.items()}
        self.two = {k: np.zeros_like(v) for k, v in m.items()}

    def step(self, m: dict, g: dict, scale: float = 1.0) -> None:
        self.n += 1
        rate = np.float32(self.rate * scale * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n))
        for k in m:  # one and two are 10 and 100 times the usual means, which cancels out below
            one, two = self.one[k], self.two[k]
            one *= np.float32(0.9)
            one += g[k]
            two *= np.float32(0.99)
            some = g[k] * g[k]
            two += some
            np.sqrt(two, out=some)
            some += np.float32(1e-7)
            np.divide(one, some, out=some)
            some *= rate
            m[k] -= some


def pack_model(m: dict) -> bytes:
    return np.concatenate([m[k].ravel() for k in sorted(m)]).astype(np.float64).tobytes()


def unpack_model(flat: np.ndarray) -> dict[str, np.ndarray]:
    like, out, at = initial(), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
