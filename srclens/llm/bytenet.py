"""A byte-level convolutional network in numpy: forward, backward, Adam.

Bytes are embedded; filters of ``WIDTH`` bytes slide over them by ``STEP``.  A
chunk is two neighbouring halves of ``HALF`` bytes, so chunks overlap by half
and cover the whole text.  Each filter is max-pooled over a chunk; the maximum
and the mean of the chunks feed one hidden layer and one logistic output.
"""

from __future__ import annotations

import numpy as np

DIM, WIDTH, STEP, HALF, FILTERS, HIDDEN = 8, 8, 4, 128, 24, 16
SLOTS = HALF // STEP
#: Bytes convolved at a time.
SEGMENT = 1 << 17
Params = dict[str, np.ndarray]


def init(seed: int) -> Params:
    r = np.random.default_rng(seed)
    p = {
        "e": r.normal(0, 0.5, (256, DIM)),
        "w": r.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)),
        "b": np.zeros(FILTERS),
        "h": r.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)),
        "c": np.zeros(HIDDEN),
        "o": r.normal(0, 0.3, HIDDEN),
        "d": np.zeros(1),
    }
    p["e"][0] = 0
    return {k: v.astype(np.float32) for k, v in p.items()}


def pack(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each padded with STEP zero bytes at least to whole halves; and the first half of each."""
    halves = np.array([-(-(len(t) + STEP) // HALF) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(halves)])
    data = np.zeros(first[-1] * HALF + WIDTH, np.uint8)
    for t, at in zip(texts, first[:-1] * HALF, strict=True):
        data[at : at + len(t)] = t
    return data, first


def unfold(p: Params, data: np.ndarray) -> np.ndarray:
    """(halves * SLOTS, WIDTH * DIM): what each filter sees at each step."""
    n = (len(data) - WIDTH) // STEP
    x = np.take(p["e"], data, axis=0).ravel()
    s = x.itemsize
    return np.lib.stride_tricks.as_strided(x, (n, WIDTH * DIM), (STEP * DIM * s, s))


def conv(p: Params, data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(halves, SLOTS, FILTERS).  last: the last half of each text, whose last step sees padding and not the next text."""
    z = (np.ascontiguousarray(unfold(p, data)) @ p["w"] + p["b"]).reshape(-1, SLOTS, FILTERS)
    z[last, -1] = p["b"]
    return z


def head(p: Params, high: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = np.concatenate([high, mean], 1)
    hidden = np.tanh(f @ p["h"] + p["c"])
    return f, hidden, 1 / (1 + np.exp(-(hidden @ p["o"] + p["d"][0])))


def pool(m: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per half the pooled chunk that starts with it, and which half won; per text the maximum and the mean of its chunks."""
    after = np.arange(1, len(m) + 1)
    after[first[1:] - 1] -= 1
    won = m[after] > m
    chunk = np.maximum(np.where(won, m[after], m), 0)
    high = np.maximum.reduceat(chunk, first[:-1], axis=0)
    mean = np.add.reduceat(chunk, first[:-1], axis=0) / np.diff(first)[:, None]
    return chunk, won, high, mean.astype(np.float32)


def score(p: Params, texts: list[np.ndarray]) -> np.ndarray:
    """Probability of label 1 for each text, all of it; memory follows SEGMENT and one row of FILTERS a half."""
    data, first = pack(texts)
    m, last = np.empty((first[-1], FILTERS), np.float32), first[1:] - 1
    for at in range(0, first[-1] * HALF, SEGMENT):
        end = min(at + SEGMENT, first[-1] * HALF)
        a, b = at // HALF, end // HALF
        inside = last[(last >= a) & (last < b)] - a
        conv(p, data[at : end + WIDTH], inside).max(axis=1, out=m[a:b])
    _, _, high, mean = pool(m, first)
    return head(p, high, mean)[2].astype(np.float64)


def gradients(p: Params, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    data, first = pack(texts)
    z = conv(p, data, first[1:] - 1)
    best = z.argmax(axis=1)
    m = np.take_along_axis(z, best[:, None], 1)[:, 0]
    chunk, won, high, mean = pool(m, first)
    f, hidden, prob = head(p, high, mean)
    loss = float(-(weight * np.where(y == 1, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).mean())
    g = (weight * (prob - y) / len(y)).astype(np.float32)
    out: Params = {"d": np.array([g.sum()]), "o": hidden.T @ g}
    dh = g[:, None] * p["o"] * (1 - hidden**2)
    out |= {"h": f.T @ dh, "c": dh.sum(0)}
    df = dh @ p["h"].T
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    dchunk = (df[:, FILTERS:] / np.diff(first)[:, None])[text]
    top = chunk == high[text]
    ties = np.add.reduceat(top, first[:-1], axis=0)[text]
    dchunk = (dchunk + df[text, :FILTERS] * top / ties) * (chunk > 0)
    # a half that lost gives its share to the next one; a text's last half has none
    dm = np.where(won, 0, dchunk)
    dm[1:] += np.where(won, dchunk, 0)[:-1]
    half, filt = np.nonzero(dm)
    d = dm[half, filt]
    step = half * SLOTS + best[half, filt]
    padding = np.isin(step, first[1:] * SLOTS - 1)
    d = np.where(padding, 0, d)
    seen = unfold(p, data)[step]
    order = np.argsort(filt, kind="stable")
    dw = np.zeros((FILTERS, WIDTH * DIM), np.float32)
    if len(filt):
        own, begin = np.unique(filt[order], return_index=True)
        dw[own] = np.add.reduceat((seen * d[:, None])[order], begin, axis=0)
    out |= {"w": dw.T, "b": dm.sum(0)}
    de = np.zeros((256, DIM), np.float32)
    back = (d[:, None] * p["w"].T[filt]).reshape(-1, WIDTH, DIM)
    bytes_ = data[(step * STEP)[:, None] + np.arange(WIDTH)]
    for k in range(DIM):
        de[:, k] = np.bincount(bytes_.ravel(), back[:, :, k].ravel(), 256)
    de[0] = 0
    out["e"] = de
    return loss, out


def train(texts: list[np.ndarray], y: np.ndarray, steps: int = 550, batch: int = 32, rate: float = 4e-3, seed: int = 1, crop: float = 0.35) -> Params:
    """Adam over seeded batches.  Of the texts of label 1 a share ``crop`` is shown as a short passage, which is of label 1 too."""

    def shown(i: int) -> np.ndarray:
        if y[i] == 1 and len(texts[i]) > 200 and r.random() < crop:
            at = r.integers(0, len(texts[i]) - 200)
            return texts[i][at : at + int(10 * 20 ** r.random())]
        return texts[i]

    p, r = init(seed), np.random.default_rng(seed)
    if not len(y):
        return p
    weight = np.ones(len(y), np.float32)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, r.permutation(len(y))])
        pick, order = order[:batch], order[batch:]
        _, g = gradients(p, [shown(i) for i in pick], y[pick], weight[pick])
        lr = rate * min(1, t / 20) * (1 - t / (steps + 1)) ** 0.5
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - lr * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return p
