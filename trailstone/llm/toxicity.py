"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Input of a step is a word: a hashed word embedding beside the mean embedding of its character 3- to 5-grams, so unseen
forms of a known stem are close to it. A text's words are read in overlapping windows (WINDOW words, half of it apart,
all of them, to the last word); a text scores as its worst window, through a logistic curve fitted on the sample's texts.

Training (driver, numpy, seeded) uses at most SAMPLE texts of each class. Labels are by text, so each round takes the
windows of toxic texts that look worst so far and, of clean texts, the worst and a random one; the first rounds judge
windows by how much more often a word or its stem occurs in toxic texts.

Defined cases: null and empty texts have one empty window and get the score that gives; with no labelled rows, or of one
class only, every score is the smoothed share of label 1; repeated rows score alike; other columns of the input don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_blocks
from .labelled import class_counts, labelled_sample

WINDOW, STEP = 32, 16
#: Labelled texts of each class that training sees at most; least rounds over their chosen windows, and least steps in all.
SAMPLE, ROUNDS, STEPS = 2000, 7, 330
#: Bytes of the longest text that is learned from.
LONGEST = 1 << 17
SLICE = 8192  # words whose n-grams are held at once
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN = 1 << 13, 1 << 13, 12, 8
_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”„’…"


class _Numbered(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self) + 1  # 0 is the padding
        return n


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word's embedding, the rows of its character n-grams back to back, and len+1 offsets into those."""
    framed = [b"\x02" + w.lower().strip(_STRIP).encode() + b"\x03\x03" for w in words]
    rows = np.fromiter((zlib.crc32(w) for w in framed), np.int64, len(framed)) % WORD_ROWS
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    data = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    found, owners, code = [], [], np.zeros(len(data), np.uint32)
    for n in range(1, 6):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint32(16777619) + data[n - 1 :]
        if n >= 3:
            inside = owner[: len(code)] == owner[n - 1 :]
            found.append(((code[inside] * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int32) % CHAR_ROWS)
            owners.append(owner[: len(code)][inside])
    grams, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows, grams[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows over one text's word numbers, padded with 0; the last ends at the last word."""
    if len(ids) <= WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None]
    starts = np.arange(0, len(ids) - WINDOW, STEP)
    starts = np.append(starts, len(ids) - WINDOW)
    return ids[starts[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class ToxicityModel:
    """Parameters and the two passes of the network; float32 throughout."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": draw(WORD_ROWS, DIM, scale=0.1), "char": draw(CHAR_ROWS, DIM, scale=0.3)}
        for side in "fb":
            self.p |= {f"in_{side}": draw(2 * DIM, 3 * HIDDEN, scale=0.2), f"rec_{side}": draw(HIDDEN, 3 * HIDDEN, scale=0.2), f"bias_{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"look": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "shift": np.zeros(1, np.float32)}
        self.curve = (1.0, 0.0)
        self.constant: float | None = None

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of words; row 0 is the padding."""
        out = np.zeros((len(words) + 1, 2 * DIM), np.float32)
        for i in range(0, len(words), SLICE):  # n-grams of a slice of words at a time
            rows, grams, at = word_inputs(words[i : i + SLICE])
            part = out[i + 1 : i + 1 + SLICE]
            part[:, :DIM] = self.p["word"][rows]
            part[:, DIM:] = np.add.reduceat(self.p["char"][grams], at[:-1], axis=0) / np.diff(at)[:, None]
        return out

    def _run(self, side: str, projected: np.ndarray, grid: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states of one direction, batch x WINDOW x HIDDEN."""
        rec, h = self.p[f"rec_{side}"], np.zeros((len(grid), HIDDEN), np.float32)
        out = np.empty((len(grid), grid.shape[1], HIDDEN), np.float32)
        for t in range(grid.shape[1]) if side == "f" else range(grid.shape[1] - 1, -1, -1):
            here = (grid[:, t] > 0)[:, None]
            a, r = projected[grid[:, t]], h @ rec
            gates = _sigmoid(a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
            fresh = np.tanh(a[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
            new = np.where(here, fresh + update * (h - fresh), h)
            if keep is not None:
                keep.append((t, here, h, reset, update, fresh, r[:, 2 * HIDDEN :]))
            h = out[:, t] = new
        return out

    def _pool(self, states: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = states @ self.p["look"]
        seen = np.where(grid > 0, seen, -30).astype(np.float32)
        share = np.exp(seen - seen.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        pooled = (share[:, None] @ states)[:, 0]
        return pooled @ self.p["out"] + self.p["shift"], share, pooled

    def logits(self, inputs: np.ndarray, grid: np.ndarray, batch: int = 2048) -> np.ndarray:
        projected = {s: inputs @ self.p[f"in_{s}"] + self.p[f"bias_{s}"] for s in "fb"}
        out = [np.empty(0, np.float32)]
        for i in range(0, len(grid), batch):
            g = grid[i : i + batch]
            out.append(self._pool(np.concatenate([self._run(s, projected[s], g, None) for s in "fb"], 2), g)[0])
        return np.concatenate(out)

    def gradients(self, words: list[str], grid: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over these windows; grid counts words from 1."""
        rows, grams, at = word_inputs(words)
        x = self.inputs(words)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(s, x @ self.p[f"in_{s}"] + self.p[f"bias_{s}"], grid, kept[s]) for s in "fb"], 2)
        z, share, pooled = self._pool(states, grid)
        d = ((_sigmoid(z) - y) / len(y)).astype(np.float32)
        g["out"], g["shift"] = d @ pooled, d.sum(keepdims=True)
        dp = d[:, None] * self.p["out"]
        da = (states @ dp[:, :, None])[:, :, 0]
        ds = share * (da - (share * da).sum(1, keepdims=True))
        g["look"] = np.einsum("bt,bth->h", ds, states)
        dstates = share[:, :, None] * dp[:, None] + ds[:, :, None] * self.p["look"]
        dx = np.zeros_like(x)
        for k, s in enumerate("fb"):
            rec, carried = self.p[f"rec_{s}"], np.zeros((len(grid), HIDDEN), np.float32)
            dproj = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, here, h, reset, update, fresh, hn in reversed(kept[s]):
                dh = carried + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                live = np.where(here, dh, 0)
                dn = live * (1 - update) * (1 - fresh**2)
                dz = live * (h - fresh) * update * (1 - update)
                dr = dn * hn * reset * (1 - reset)
                back = np.concatenate([dr, dz, dn * reset], 1)
                g[f"rec_{s}"] += h.T @ back
                carried = np.where(here, live * update, dh) + back @ rec.T
                np.add.at(dproj, grid[:, t], np.concatenate([dr, dz, dn], 1))
            dproj[0] = 0
            g[f"in_{s}"], g[f"bias_{s}"] = x.T @ dproj, dproj.sum(0)
            dx += dproj @ self.p[f"in_{s}"].T
        np.add.at(g["word"], rows, dx[1:, :DIM])
        n = np.diff(at)
        np.add.at(g["char"], grams, np.repeat(dx[1:, DIM:] / n[:, None], n, axis=0))
        return g

    def text_scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        number, grids = _Numbered(), []
        for text in texts:
            words = text.split()
            grids.append(windows(np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
        worst = self._worst(list(number), grids)[0]
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * worst + self.curve[1], -30, 30)))

    def _worst(self, words: list[str], grids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Highest logit of each text's windows, and which window has it."""
        inputs = self.inputs(words) if words else np.zeros((1, 2 * DIM), np.float32)
        z, at = self.logits(inputs, np.concatenate(grids)), np.cumsum([0, *map(len, grids)])
        place = np.array([z[a:b].argmax() for a, b in zip(at[:-1], at[1:], strict=True)])
        return z[at[:-1] + place], place


STEM_ROWS = 1 << 20


def _stems(word: str) -> list[int]:
    """Hashed rows of a word and of its beginnings."""
    w = word.lower().strip(_STRIP).encode()
    return [zlib.crc32(w) % STEM_ROWS, *(zlib.crc32(b"^" + w[:n]) % STEM_ROWS for n in (4, 5, 6))]


def train(texts: list[str], y: np.ndarray, share: float, seed: int = 11) -> ToxicityModel:
    """The network from texts with 0/1 labels; share: of label 1 among all rows, for the score's curve."""
    model, rng, number = ToxicityModel(seed), np.random.default_rng(seed), _Numbered()
    ids = []
    for text in texts:
        words = text.split()
        ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    words, grids = list(number), list(map(windows, ids))

    of_word = np.zeros((len(words) + 1, 4), np.int32)
    for i, w in enumerate(words, 1):
        of_word[i] = _stems(w)
    counts = np.zeros((2, STEM_ROWS))
    for i, label in zip(ids, y, strict=True):
        counts[int(label), np.unique(of_word[i])] += 1
    rates = np.log((counts[1] + 0.5) / (y.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - y).sum() + 1))
    suspect = rates[of_word].max(1)
    suspect[0] = -9
    ranked = [np.argsort(-suspect[g].max(1), kind="stable")[:2] for g in grids]

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    steps = 0
    worst = None
    turn = 0
    while turn < ROUNDS or steps < STEPS:
        if turn >= 2 and turn % max(1, turn // ROUNDS) == 0:
            worst = model._worst(words, grids)[1]
        chosen, labels = [], []
        for i, g in enumerate(grids):
            picks = [ranked[i][0] if worst is None else worst[i]]
            if y[i] == 0:
                picks.append(rng.integers(len(g)))
            chosen += [g[k] for k in picks]
            labels += [y[i]] * len(picks)
        grid, target = np.stack(chosen), np.array(labels, np.float32)
        order, batch = rng.permutation(len(grid)), int(np.clip(len(grid) // 24, 16, 128))
        turn += 1
        for i in range(0, len(order), batch):
            part = grid[order[i : i + batch]]
            uniques, local = np.unique(part, return_inverse=True)
            local = local.reshape(part.shape) + (uniques[0] != 0)
            present = [words[k - 1] for k in uniques if k]
            steps += 1
            if not present:
                continue
            g = model.gradients(present, local, target[order[i : i + batch]])
            for k, v in model.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.002 * (g[k] ** 2 - s)
                v -= 0.01 * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.998**steps)) + 1e-7)

    z = model._worst(words, grids)[0].astype(float)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    soft = np.where(y == 1, 1 - 0.5 / (y.sum() + 1), 0.5 / ((1 - y).sum() + 1))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton on two numbers
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        e, h = weight * (p - soft), weight * p * (1 - p) + 1e-9
        grad = np.array([(e * z).sum() + 0.1 * (a - 1), e.sum()])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    model.curve = (max(float(a), 0.05), float(b))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = SAMPLE) -> ToxicityModel:
    """The network from at most `rows` labelled texts of each class; `learn` selects on doc_id which labels may be seen.

    Texts of more than LONGEST bytes are scored like all others but not learned from, so that the sample has
    2 * rows * LONGEST bytes at most.
    """
    zeros, ones = class_counts(labels, label, learn)
    sample = labelled_sample(docs, labels, label, learn, rows).where(F.octet_length("text") <= LONGEST)
    frame = sample.toPandas().sort_values("doc_id") if zeros and ones else None
    if frame is None or frame["label"].nunique() < 2:
        model = ToxicityModel()
        model.constant = (ones + 0.5) / (zeros + ones + 1)
        return model
    return train(frame["text"].tolist(), frame["label"].to_numpy(float), ones / (zeros + ones))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (worst window) for each row; the model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(shared.value.text_scores(block.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = pick(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
