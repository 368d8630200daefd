"""Quality classifier: a byte-level convolutional network in NumPy (operator 1).

A text's UTF-8 bytes pass learned filters of four bytes, every two bytes; their
rectified answers are averaged over overlapping chunks of 64 bytes that begin every
32 bytes and cover the whole text.  A second layer reads each chunk's averages and
their squares, its units are max-pooled over all chunks, and a logistic unit combines
them into one probability.

Filters and weights are learned by Adam, with the gradient through each pooled
unit's winning chunk of the whole text.  The fit uses a bounded sample: the whole texts
of at most ``sample`` labelled documents (chosen by the hash of their id), which the
driver holds; every text is scored whole.  The fitted model (some 70 kB) goes to the
tasks.

Training reads labels of documents whose crc32 of the id's text is not 0 modulo 5;
labels, language, source and id never reach a score.

Defined cases: null texts are empty texts, which have one chunk of padding; with no
usable label every score is 0.5; labels that are null or not 0/1 are left out;
repeated rows are scored each, and of rows with one id only one text (that with the
smallest hash) is learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import by_batch, hash_sample, keep_rows

BLOCK = 32
STEPS = BLOCK // 2
FILTERS = 16
UNITS = 24
SEGMENT = 2048  # blocks that pass the network at once
SAMPLE = 12_000
EPOCHS = 8
BATCH = 64
#: A text scored lower than this is junk.
KEEP = 0.3


class Network:
    """Weights, scoring, and the gradient of one step."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.w = {
            "filters": draw.normal(0, 0.5, (4, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "units": draw.normal(0, 0.3, (2 * FILTERS, UNITS)).astype(np.float32),
            "lift": np.zeros(UNITS, np.float32),
            "out": draw.normal(0, 0.3, UNITS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }
        self.tabled = None

    def tables(self) -> np.ndarray:
        """Answers to every pair of bytes: as a filter's first and last half."""
        if self.tabled is None:
            f = self.w["filters"]
            first = f[0][:, None, :] + f[1][None, :, :]
            last = f[2][:, None, :] + f[3][None, :, :] + self.w["bias"]
            self.tabled = np.ascontiguousarray(np.concatenate([first, last], axis=2).reshape(65536, 2 * FILTERS))
        return self.tabled

    def averages(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of rectified answers over each block, and the blocks' byte pairs."""
        flat = blocks.reshape(-1)
        pairs = flat[0::2].astype(np.intp) << 8 | flat[1::2]
        both = self.tables()[pairs]
        answers = both[:, :FILTERS].copy()
        answers[:-1] += both[1:, FILTERS:]
        np.maximum(answers, 0, out=answers)
        return answers.reshape(len(blocks), STEPS, FILTERS).sum(axis=1), pairs

    def pooled(self, blocks: np.ndarray, first: np.ndarray, chunks: np.ndarray):
        """Per segment (its first block and number of chunks): the chunks' features
        in a row, each segment's offset among them, and its pooled units."""
        sums, pairs = self.averages(blocks)
        at = np.repeat(first - np.concatenate([[0], np.cumsum(chunks)[:-1]]), chunks) + np.arange(int(chunks.sum()))
        mean = (sums[at] + sums[at + 1]) / (2 * STEPS)
        features = np.concatenate([mean, mean * mean], axis=1)
        z = features @ self.w["units"] + self.w["lift"]
        offset = np.concatenate([[0], np.cumsum(chunks)[:-1]]).astype(np.int64)
        return features, z, at, offset, np.maximum.reduceat(z, offset, axis=0), pairs

    def combine(self, pooled: np.ndarray) -> np.ndarray:
        x = np.maximum(pooled, 0) @ self.w["out"] + self.w["shift"][0]
        return 1 / (1 + np.exp(-np.clip(x.astype(float), -60, 60)))

    def gradient(self, parts, label, weight) -> dict[str, np.ndarray]:
        """The step's gradient over whole documents.  ``parts``: what ``segments``
        gives; a document's units are pooled over all its segments."""
        seen = [self.pooled(blocks, first, chunks) for blocks, first, chunks, _ in parts]
        row = np.concatenate([p[3] for p in parts])
        each = np.concatenate([x[4] for x in seen])  # segments x units
        pooled = np.full((len(label), UNITS), -np.inf, np.float32)
        np.maximum.at(pooled, row, each)
        hidden = np.maximum(pooled, 0)
        error = ((self.combine(pooled) - label) * weight / len(label)).astype(np.float32)
        back = error[:, None] * self.w["out"] * (pooled > 0)  # docs x units
        # Of a document's segments the first that reaches a unit's maximum takes its gradient.
        wins = each == pooled[row]
        order = np.zeros(len(row), np.int64)
        order[1:] = np.cumsum(row[1:] != row[:-1])
        start = np.flatnonzero(np.diff(order, prepend=-1))
        before = np.cumsum(wins, axis=0) - wins
        wins &= before == before[start][order]
        grad = {"out": hidden.T @ error, "shift": error.sum(keepdims=True), "lift": back.sum(axis=0)}
        at = 0
        for (blocks, first, chunks, _), found in zip(parts, seen):
            n = len(chunks)
            part = self._through(blocks, chunks, found, back[row[at : at + n]] * wins[at : at + n])
            for name, value in part.items():
                grad[name] = grad[name] + value if name in grad else value
            at += n
        return grad

    def _through(self, blocks, chunks, found, back) -> dict[str, np.ndarray]:
        """What passes from the pooled units of some segments to the weights below."""
        features, z, at, offset, pooled, pairs = found
        grad = {}
        # each unit's winning chunk
        win = np.empty(pooled.shape, np.int64)
        for i, (o, n) in enumerate(zip(offset.tolist(), chunks.tolist())):
            win[i] = o + z[o : o + n].argmax(axis=0)
        grad["units"] = np.einsum("du,duf->fu", back, features[win])
        through = back[:, :, None] * self.w["units"].T[None]  # segments x units x features
        mean = features[win][:, :, :FILTERS]
        chunk_grad = ((through[:, :, :FILTERS] + 2 * mean * through[:, :, FILTERS:]) / (2 * STEPS)).reshape(-1, FILTERS)
        # Chunks share blocks: gather the gradient by block first.
        spots = at[win.reshape(-1)]
        by_block = np.zeros((len(blocks), FILTERS), np.float32)
        np.add.at(by_block, spots, chunk_grad)
        np.add.at(by_block, spots + 1, chunk_grad)
        used = np.flatnonzero(np.abs(by_block).sum(axis=1))
        steps = (used[:, None] * STEPS + np.arange(STEPS)).reshape(-1)
        nxt = np.minimum(steps + 1, len(pairs) - 1)
        table = self.tables()
        alive = table[pairs[steps], :FILTERS] + table[pairs[nxt], FILTERS:] > 0
        step_grad = np.repeat(by_block[used], STEPS, axis=0) * alive
        grad["bias"] = step_grad.sum(axis=0)
        four = (pairs[steps] >> 8, pairs[steps] & 255, pairs[nxt] >> 8, pairs[nxt] & 255)
        filters = np.zeros_like(self.w["filters"])
        for j, byte in enumerate(four):
            order = np.argsort(byte, kind="stable")
            kinds, start = np.unique(byte[order], return_index=True)
            filters[j, kinds] = np.add.reduceat(step_grad[order], start, axis=0)
        grad["filters"] = filters
        return grad


def segments(data: np.ndarray, offsets: np.ndarray):
    """Texts cut into segments of at most ``SEGMENT`` blocks, each with the two
    blocks that follow: ``(blocks, first, chunks, row)`` for about ``SEGMENT`` blocks
    at a time.  Bytes past a text's end are zero."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // BLOCK))
    pieces = -(-count // SEGMENT)
    row = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
    chunks = np.minimum(SEGMENT, count[row] - nth * SEGMENT)
    start, stop = offsets[:-1][row] + nth * SEGMENT * BLOCK, offsets[1:][row]
    held = np.cumsum(chunks + 2)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + 2 * SEGMENT, side="right")))
        wide = chunks[lo:hi] + 2
        first = np.concatenate([[0], np.cumsum(wide)[:-1]])
        nth_block = np.arange(int(wide.sum())) - np.repeat(first, wide)
        at = np.repeat(start[lo:hi], wide) + nth_block * BLOCK
        index = at[:, None] + np.arange(BLOCK)
        inside = index < np.repeat(stop[lo:hi], wide)[:, None]
        if len(data):
            blocks = data[np.minimum(index, len(data) - 1)] * inside
        else:
            blocks = np.zeros(index.shape, np.uint8)
        yield blocks, first, chunks[lo:hi], row[lo:hi]
        lo = hi


def score_bytes(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    best = np.full((len(offsets) - 1, UNITS), -np.inf, np.float32)
    for blocks, first, chunks, row in segments(data, offsets):
        np.maximum.at(best, row, net.pooled(blocks, first, chunks)[4])
    return net.combine(best)


def train(texts: list[bytes | bytearray], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adam on class-balanced log loss; deterministic for its inputs."""
    net = Network(seed)
    if not len(texts) or labels.min() == labels.max():
        for name in ("out", "shift"):
            net.w[name][:] = 0
        return net
    share = labels.mean()
    # Balanced classes, halfway: junk is rare, and clean documents should stay.
    weight = np.where(labels == 1, 1.0, np.sqrt(share / (1 - share)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    draw = np.random.default_rng(seed + 1)
    moment = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    steps, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            part = np.concatenate([data[ends[i] : ends[i + 1]] for i in pick])
            offsets = np.concatenate([[0], np.cumsum(ends[pick + 1] - ends[pick])])
            grads = net.gradient(list(segments(part, offsets)), labels[pick], weight[pick])
            steps += 1
            rate = 0.01 * (1 - steps / (total + 1))
            for name, value in net.w.items():
                grad = grads[name]
                moment[name] = 0.9 * moment[name] + 0.1 * grad
                square[name] = 0.99 * square[name] + 0.01 * grad * grad
                value -= (rate * (moment[name] / (1 - 0.9**steps)) / (np.sqrt(square[name] / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
            net.tabled = None
    return net


def held_out(id_col: str):
    """Whether a document's id falls into the fold that labels are not read from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network from at most ``sample`` labelled documents outside the held fold."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~held_out("id"))
    chosen = hash_sample(known, ["id", "label"], sample, 1)
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("raw")).join(F.broadcast(chosen.distinct()), "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("raw", F.xxhash64("raw")).alias("raw")).collect()
    rows.sort(key=lambda r: (r["id"], r["label"], r["raw"]))
    return train([r["raw"] for r in rows], np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' ids with ``score``, the probability of label 1, for whole texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = W.text_buffers(batch.column(1))
        return pa.record_batch([batch.column(0), pa.array(score_bytes(net, data, offsets))], names=["out_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("out_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(by_batch(run), f"out_id {kind}, score double").withColumnRenamed("out_id", id_col)


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", least: float = KEEP) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns."""

    def good(column: pa.Array) -> np.ndarray:
        return score_bytes(net, *W.text_buffers(column)) >= least

    return keep_rows(docs, text_col, good)
