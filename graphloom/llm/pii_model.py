"""A character-level bidirectional LSTM with a CRF on top, in numpy.

Training and decoding work on windows of equal length, time first.  Gates and
candidates are piecewise linear, which costs a tenth of exponentials; decoding
looks for the best path only where an exact bound doesn't show it to be outside.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

TYPES = ("email", "phone", "id_number", "address", "name")
#: Tag 0 is outside; tag 1 + 2k begins type k, tag 2 + 2k continues it.
N_TAGS = 1 + 2 * len(TYPES)
_NEVER = np.float32(-1e4)

_OWN = "".join(chr(c) for c in range(33, 127)) + "абвгдежзийклмнопрстуфхцчшщъыьэюяё" + "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ" + "äöüßÄÖÜćĆ№—–"
_CLASSES = ("newline", "blank", "upper", "lower", "letter", "digit", "mark", "sign", "other")
N_SYMBOLS = 1 + len(_CLASSES) + len(_OWN)


def _symbol(ch: str) -> int:
    folded = unicodedata.normalize("NFKC", ch)
    if len(folded) == 1:
        ch = folded
    at = _OWN.find(ch)
    if at >= 0:
        return 1 + len(_CLASSES) + at
    kind = unicodedata.category(ch)
    if ch in "\n\r  ":
        name = "newline"
    elif ch.isspace():
        name = "blank"
    elif kind == "Lu":
        name = "upper"
    elif kind == "Ll":
        name = "lower"
    elif kind[0] == "L":
        name = "letter"
    elif kind[0] == "N":
        name = "digit"
    elif kind[0] == "M":
        name = "mark"
    elif kind[0] in "PS":
        name = "sign"
    else:
        name = "other"
    return 1 + _CLASSES.index(name)


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point of the first plane; all others count as ``other``."""
    return np.array([_symbol(chr(c)) if not 0xD800 <= c < 0xE000 else 1 + _CLASSES.index("other") for c in range(0x10000)], np.int16)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x10000, symbol_table()[np.minimum(points, 0xFFFF)], 1 + _CLASSES.index("other")).astype(np.int16)


@dataclass
class Model:
    """Weights by name: embedding, then (input, recurrent, bias) of both directions, output, transitions."""

    w: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.w["hf"].shape[0]

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.w.items()})

    @classmethod
    def load(cls, path: str) -> Model:
        with np.load(path) as f:
            return cls({k: f[k].astype(np.float32) for k in f.files})

    @classmethod
    def fresh(cls, hidden: int, width: int, seed: int) -> Model:
        r = np.random.default_rng(seed)

        def m(a: int, b: int) -> np.ndarray:
            return (r.standard_normal((a, b)) * np.sqrt(1.0 / a)).astype(np.float32)

        w = {"emb": (r.standard_normal((N_SYMBOLS, width)) * 0.3).astype(np.float32)}
        for d in "fb":
            w["x" + d], w["h" + d], w["b" + d] = 0.4 * m(width, 4 * hidden), 0.4 * m(hidden, 4 * hidden), np.full(4 * hidden, 0.5, np.float32)
            w["b" + d][hidden : 2 * hidden], w["b" + d][3 * hidden :] = 0.8, 0
        w["out"], w["bias"] = m(2 * hidden, N_TAGS), np.zeros(N_TAGS, np.float32)
        w["trans"] = np.zeros((N_TAGS, N_TAGS), np.float32)
        return cls(w)


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative number."""
    t = np.zeros((N_TAGS, N_TAGS), np.float32)
    for k in range(len(TYPES)):
        inside = 2 + 2 * k
        t[:, inside] = _NEVER
        t[inside - 1, inside] = t[inside, inside] = 0
    return t


def _run(ids: np.ndarray, w: dict[str, np.ndarray], d: str, keep: bool):
    """One direction over (time, batch) symbols; for ``b`` the caller reverses time.

    Gates are sums clipped to 0 and 1, candidates to -1 and 1, and the cell is
    read through x / (1 + abs(x)).  The input gate of padding is shut, so that
    padding before a text leaves the state at zero.
    """
    steps, batch = ids.shape
    wh = w["h" + d]
    n, kind = wh.shape[0], wh.dtype
    table = w["emb"] @ w["x" + d] + w["b" + d]
    table[0, :n] = _NEVER
    least = np.r_[np.zeros(3 * n), -np.ones(n)].astype(kind)
    h, c = np.zeros((batch, n), kind), np.zeros((batch, n), kind)
    z, x, part = np.empty((batch, 4 * n), kind), np.empty((batch, 4 * n), kind), np.empty((batch, n), kind)
    hs = np.empty((steps, batch, n), kind)
    saved = []
    for t in range(steps):
        if keep:
            z = np.empty_like(x)
        np.matmul(h, wh, out=z)
        np.take(table, ids[t], 0, out=x, mode="clip")
        z += x
        np.maximum(z, least, out=z)
        np.minimum(z, 1, out=z)
        if keep:
            saved.append((z, c.copy(), h))
        c *= z[:, n : 2 * n]
        np.multiply(z[:, :n], z[:, 3 * n :], out=part)
        c += part
        np.abs(c, out=part)
        part += 1
        np.divide(c, part, out=part)
        if keep:
            saved[-1] += (part.copy(),)
        h = np.multiply(z[:, 2 * n : 3 * n], part, out=hs[t])
    return hs, saved


def _scores(model: Model, ids: np.ndarray) -> np.ndarray:
    """(tag, time, batch) scores of (time, batch) symbols; 0 is padding."""
    hf, _ = _run(ids, model.w, "f", False)
    hb, _ = _run(ids[::-1], model.w, "b", False)
    n, out = model.hidden, model.w["out"]
    e = out[:n].T @ hf.reshape(-1, n).T
    e = e.reshape(N_TAGS, *ids.shape)
    e += (out[n:].T @ hb.reshape(-1, n).T).reshape(e.shape)[:, ::-1]
    e += model.w["bias"][:, None, None]
    return e


def emissions(model: Model, ids: np.ndarray) -> np.ndarray:
    """(time, batch, tag) scores of (time, batch) symbols."""
    return _scores(model, ids).transpose(1, 2, 0)


def _open_places(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """(time, batch): False where the best path is surely outside.

    A stretch of items that isn't better than staying outside isn't on the best
    path.  What a stretch gains is at most the sum over its places of its tag's
    score less that of outside, plus for each transition the most that one may
    give over staying outside.  The best stretch through each place and tag is
    bounded by the best one that comes to it and the best one that goes on from
    it; in both an item is continued only if it began.
    """
    rest = trans.copy()
    rest[0, 0] = _NEVER
    most = max(0.0, float(rest.max() - trans[0, 0]))
    gain = e[1:] - e[0]
    gain += np.asarray(most, e.dtype)
    begin, inside = gain[0::2], gain[1::2]
    come_b, come_i, go_b, go_i = begin.copy(), inside.copy(), begin.copy(), inside.copy()
    for t in range(1, gain.shape[1]):
        best = np.maximum(come_b[:, t - 1], come_i[:, t - 1])
        come_i[:, t] += best
        come_b[:, t] += np.maximum(best.max(0), 0)
        best = np.maximum(go_i[:, -t], np.maximum(go_b[:, -t].max(0), 0))
        go_b[:, -t - 1] += best
        go_i[:, -t - 1] += best
    come_b += go_b
    come_b -= begin
    come_i += go_i
    come_i -= inside
    return np.maximum(come_b, come_i, out=come_b).max(0) >= -most


def _best_tags(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(time, run) best tags of runs of ``sizes`` places; ``first`` and ``last`` are (tag, run) scores of coming from and going to what is beside them."""
    k, steps, runs = e.shape
    scores = np.empty((steps, k, runs), e.dtype)
    scores[0] = e[:, 0] + first
    for t in range(1, steps):
        np.max(scores[t - 1][:, None, :] + trans[:, :, None], axis=0, out=scores[t])
        scores[t] += e[:, t]
    tags, each = np.zeros((steps, runs), np.int8), np.arange(runs)
    now = (scores[sizes - 1, :, each].T + last).argmax(0)
    for t in range(steps - 1, -1, -1):
        back = t < sizes - 1
        if back.any():
            came = (scores[t] + trans[:, now]).argmax(0)
            now = np.where(back, came, now)
        tags[t] = np.where(t < sizes, now, 0)
    return tags


def decode(model: Model, ids: np.ndarray, at_once: int = 512) -> np.ndarray:
    """The best tags, (time, batch): outside where that is sure, the best path through each run of other places."""
    e = _scores(model, ids)
    real = ids > 0
    trans = model.w["trans"] + allowed()
    whole = int(np.argmin(real.all(1))) if not real.all() else len(real)
    e[0, whole:][~real[whole:]] = 0
    np.copyto(e[1:, whole:], _NEVER, where=~real[None, whole:])
    places = (_open_places(e, trans) & real).T
    tags = np.zeros(ids.shape, np.int8)
    flat = places.ravel()
    if not flat.any():
        return tags
    steps = ids.shape[0]
    at = np.flatnonzero(flat)
    new = np.r_[True, (np.diff(at) > 1) | (at[1:] % steps == 0)]
    starts = at[new]
    sizes = np.diff(np.r_[np.flatnonzero(new), len(at)])
    column, time = starts // steps, starts % steps
    ends = time + sizes
    final = (ends == steps) | ~real[np.minimum(ends, steps - 1), column]
    order, wide, flat_e, flat_tags = np.argsort(sizes, kind="stable"), ids.shape[1], e.reshape(N_TAGS, -1), tags.reshape(-1)
    for k in range(0, len(order), at_once):
        some = order[k : k + at_once]
        n = sizes[some]
        where = np.minimum(time[some] + np.arange(n[-1])[:, None], steps - 1) * wide + column[some]
        first = np.where(time[some] == 0, 0, trans[0][:, None])
        last = np.where(final[some], 0, trans[:, 0][:, None])
        got = _best_tags(np.take(flat_e, where, 1), n, trans, first, last)
        inside = np.arange(n[-1])[:, None] < n
        flat_tags[where[inside]] = got[inside]
    return tags


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf(e: np.ndarray, tags: np.ndarray, mask: np.ndarray, trans: np.ndarray):
    """Loss, and its gradients by emissions and transitions."""
    steps, batch, k = e.shape
    alpha = np.empty_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        a = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        alpha[t] = np.where(mask[t][:, None] > 0, a, alpha[t - 1])
    total = _logsumexp(alpha[-1], 1)
    beta = np.zeros((batch, k), np.float32)
    de, dt = np.zeros_like(e), np.zeros_like(trans)
    rows = np.arange(batch)
    gold = np.zeros(batch, np.float32)
    for t in range(steps - 1, -1, -1):
        live = mask[t] > 0
        p = np.exp(alpha[t] + beta - total[:, None])
        p[rows, tags[t]] -= 1
        de[t] = p * live[:, None]
        gold += np.where(live, e[t, rows, tags[t]], 0)
        if t:
            right = e[t] + beta
            pair = np.exp(alpha[t - 1][:, :, None] + trans + right[:, None, :] - total[:, None, None]) * live[:, None, None]
            dt += pair.sum(0)
            np.add.at(dt, (tags[t - 1][live], tags[t][live]), -1)
            gold += np.where(live, trans[tags[t - 1], tags[t]], 0)
            beta = np.where(live[:, None], _logsumexp(trans[None] + right[:, None, :], 2), beta)
    return float((total - gold).sum()), de, dt


def gradients(model: Model, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The summed loss of a batch of windows and its gradients."""
    w, n = model.w, model.hidden
    mask = (ids > 0).astype(np.float32)
    hf, sf = _run(ids, w, "f", True)
    hb, sb = _run(ids[::-1], w, "b", True)
    both = np.concatenate([hf, hb[::-1]], 2)
    e = both @ w["out"] + w["bias"]
    loss, de, dt = _crf(e, tags, mask, w["trans"] + allowed())
    g = {"out": both.reshape(-1, 2 * n).T @ de.reshape(-1, N_TAGS), "bias": de.sum((0, 1)), "trans": dt, "emb": np.zeros_like(w["emb"])}
    dboth = de @ w["out"].T
    for d, saved, seq, dh_all in (("f", sf, ids, dboth[:, :, :n]), ("b", sb, ids[::-1], dboth[::-1, :, n:])):
        dz_all = np.empty((*seq.shape, 4 * n), e.dtype)
        gh = np.zeros_like(w["h" + d])
        dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
        for t in range(len(saved) - 1, -1, -1):
            z, c_old, h_old, read = saved[t]
            i, f, o, gg = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - np.abs(read)) ** 2
            dz = dz_all[t]
            dz[:, :n] = dc * gg
            dz[:, n : 2 * n] = dc * c_old
            dz[:, 2 * n : 3 * n] = dh * read
            dz[:, 3 * n :] = dc * i
            dz[:, : 3 * n] *= z[:, : 3 * n] > 0
            dz[:, 3 * n :] *= gg > -1
            dz *= z < 1
            gh += h_old.T @ dz
            dh = dz @ w["h" + d].T
            dc = dc * f
        flat, sym = dz_all.reshape(-1, 4 * n), seq.reshape(-1)
        by_symbol = np.zeros((N_SYMBOLS, 4 * n), e.dtype)
        order = np.argsort(sym, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(sym[order]) != 0])
        by_symbol[sym[order][starts]] = np.add.reduceat(flat[order], starts, 0)
        by_symbol[0] = 0
        g["x" + d], g["h" + d], g["b" + d] = w["emb"].T @ by_symbol, gh, by_symbol.sum(0)
        g["emb"] += by_symbol @ w["x" + d].T
    return loss, g


def _worker(pipe, windows: np.ndarray, tags: np.ndarray) -> None:
    """Sends back the loss and gradients of the windows it is told, until told nothing."""
    while (told := pipe.recv()) is not None:
        w, pick = told
        pipe.send(gradients(Model(w), windows[pick].T.astype(np.int64), tags[pick].T.astype(np.int64)))


def train(windows: np.ndarray, tags: np.ndarray, hidden: int = 24, width: int = 20, epochs: int = 40, batch: int = 96, workers: int = 8, rate: float = 1e-2, seed: int = 7, say=print, seconds: float = 1e9, start: Model | None = None) -> Model:
    """Fit to (window, time) symbols and tags with Adam and a falling rate, from ``start`` or anew; each worker takes ``batch`` windows a step."""
    import multiprocessing
    import time

    fork = multiprocessing.get_context("fork")
    pipes, hands = [], []
    for _ in range(workers):
        here, there = fork.Pipe()
        hands.append(fork.Process(target=_worker, args=(there, windows, tags), daemon=True))
        hands[-1].start()
        pipes.append(here)
    model, r = start or Model.fresh(hidden, width, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    whole = batch * workers
    total, step, began, done = epochs * -(-len(windows) // whole), 0, time.time(), 0.0
    for epoch in range(epochs):
        order, losses, n = r.permutation(len(windows)), 0.0, 0
        for at in range(0, len(order), whole):
            pick = order[at : at + whole]
            parts = [p for p in np.array_split(pick, workers) if len(p)]
            for pipe, part in zip(pipes, parts, strict=False):
                pipe.send((model.w, part))
            got = [pipe.recv() for pipe, _ in zip(pipes, parts, strict=False)]
            losses, n = losses + sum(x for x, _ in got), n + len(pick)
            g = {k: sum(x[k] for _, x in got) / len(pick) for k in model.w}
            step += 1
            norm = np.sqrt(sum(float(x.ravel() @ x.ravel()) for x in g.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            done = min(1.0, max(step / total, (time.time() - began) / seconds))
            now = rate * min(1.0, step / 100) * (0.5 + 0.5 * np.cos(np.pi * done)) + 1e-5
            for k, x in g.items():
                x = x * scale
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                model.w[k] = model.w[k] - (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if done >= 1:
                break
        say(f"epoch {epoch}: loss per window {losses / n:.4f}, {n} windows, {time.time() - began:.0f} s", flush=True)
        if done >= 1:
            break
    for pipe in pipes:
        pipe.send(None)
    return model
