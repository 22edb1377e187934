"""Toxicity from a bidirectional gated recurrent network over windows of words."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from demescope.llm.common import PUNCTUATION, column_bytes, mix64, word_hashes

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 6, 8, 8
VOCABULARY = 8192
CHAR_BITS = 12
TRAIN_ROWS = 1500  # of either label
TRAIN_BYTES = 32 << 10  # of one training text; windows of longer ones are spread over the whole text
CACHE_BITS = 17


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Words:
    """The words of a string column: hash, row and bytes, in the order of the text."""

    def __init__(self, column: pa.Array):
        self.data, offsets = column_bytes(column)
        hashes, counts = [], []
        for _, h, c in word_hashes(column, PUNCTUATION):
            hashes.append(h)
            counts.append(c)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        gap = PUNCTUATION[self.data[lo:hi]]
        first = ~gap
        first[1:] &= gap[:-1] | np.isin(np.arange(lo + 1, hi), offsets)
        last = ~gap
        last[:-1] &= gap[1:] | np.isin(np.arange(lo + 1, hi), offsets)
        self.start, self.end = np.flatnonzero(first) + lo, np.flatnonzero(last) + lo + 1

    def trigrams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the byte trigrams of the chosen words (with an edge before and after), and how many each has."""
        n = self.end[which] - self.start[which]
        at = np.repeat(self.start[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        letters = self.data[at].astype(np.uint64)
        letters += np.where((letters >= 65) & (letters <= 90), np.uint64(32), np.uint64(0))
        ends = np.cumsum(n)
        before = np.concatenate([[0], letters[:-1]]).astype(np.uint64)
        after = np.concatenate([letters[1:], [0]]).astype(np.uint64)
        if len(letters):
            before[ends - n], after[ends - 1] = 0, 0
        return (mix64(before * np.uint64(65536) + letters * np.uint64(256) + after) >> np.uint64(64 - CHAR_BITS)).astype(np.int64), n


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of all windows: every STRIDE words, and one that ends with the row; an empty row has none."""
    firsts = np.cumsum(counts) - counts
    extra = np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    n = np.where(counts > 0, 1 + extra, 0)
    row = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(k * STRIDE, np.maximum(0, counts[row] - WINDOW))
    return row, firsts[row] + begin, np.minimum(WINDOW, counts[row])


@dataclass
class Network:
    """Word and character embeddings, two gated recurrent layers, attention pooling and a logistic output."""

    words: np.ndarray  # sorted hashes of the vocabulary; row 0 of its embeddings is for all others
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, words: np.ndarray, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        dim, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {"word": 0.3 * rng.normal(size=(len(words) + 1, WORD_DIM)).astype(np.float32), "char": 0.3 * rng.normal(size=(1 << CHAR_BITS, CHAR_DIM)).astype(np.float32)}
        for side in "fb":
            p |= {f"W{side}": draw(dim, 3 * h), f"c{side}": np.zeros(3 * h, np.float32), f"U{side}": draw(h, 2 * h), f"V{side}": draw(h, h)}
        p |= {"A": draw(2 * h, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION, 1)[:, 0], "o": draw(2 * h, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        return cls(words, p)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)

    def characters(self, buckets: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((len(n), CHAR_DIM), np.float32)
        if len(n):
            out = np.add.reduceat(self.p["char"][buckets], np.cumsum(n) - n, axis=0) / n[:, None]
        return out.astype(np.float32)

    def recur(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (time, batch, HIDDEN) from projected inputs (time, batch, 3 HIDDEN); masked steps keep the state."""
        h = HIDDEN
        state = np.zeros((x.shape[1], h), np.float32)
        states = np.empty((x.shape[0], x.shape[1], h), np.float32)
        for t in range(x.shape[0]) if side == "f" else reversed(range(x.shape[0])):
            gates = _sigmoid(x[t, :, : 2 * h] + state @ self.p["U" + side])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + (r * state) @ self.p["V" + side])
            if keep is not None:
                keep.append((t, state, z, r, new))
            state = state + mask[t][:, None] * (1 - z) * (new - state)
            states[t] = state
        return states

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        e = np.where(mask > 0, u @ self.p["v"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[:, :, None] * states).sum(axis=0)
        return pooled @ self.p["o"] + self.p["bias"][0], (u, w, pooled)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, words=self.words, **{"p_" + k: v for k, v in self.p.items()})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        held = np.load(io.BytesIO(data))
        return cls(held["words"], {k[2:]: held[k] for k in held.files if k.startswith("p_")})

    def logits(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.recur(forward, mask, "f"), self.recur(backward, mask, "b")], axis=2)
        return self.pool(states, mask)[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean log loss: for the dense parameters, and for the inputs (time, batch, dims)."""
        p, h, g, kept, states = self.p, HIDDEN, {}, {}, []
        for side in "fb":
            kept[side] = []
            states.append(self.recur(x @ p["W" + side] + p["c" + side], mask, side, kept[side]))
        both = np.concatenate(states, axis=2)
        logit, (u, w, pooled) = self.pool(both, mask)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["bias"], g["o"] = np.array([d.sum()]), pooled.T @ d
        d_pooled = d[:, None] * p["o"]
        d_w = (both * d_pooled).sum(axis=2)
        d_both = w[:, :, None] * d_pooled
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["v"] = np.tensordot(d_e, u, 2)
        d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
        g["A"], g["a"] = np.tensordot(both, d_u, ([0, 1], [0, 1])), d_u.sum(axis=(0, 1))
        d_both = d_both + d_u @ p["A"].T
        d_x = np.zeros_like(x)
        for side, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            g["U" + side], g["V" + side] = np.zeros_like(p["U" + side]), np.zeros_like(p["V" + side])
            d_in = np.zeros((*x.shape[:2], 3 * h), np.float32)
            d_state = np.zeros((x.shape[1], h), np.float32)
            for t, before, z, r, new in reversed(kept[side]):
                m = mask[t][:, None]
                d_state = d_state + part[t]
                d_new = d_state * m * (1 - z) * (1 - new * new)
                d_z = -d_state * m * (new - before) * z * (1 - z)
                d_rs = d_new @ p["V" + side].T
                d_r = d_rs * before * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], axis=1)
                g["U" + side] += before.T @ d_gates
                g["V" + side] += (r * before).T @ d_new
                d_in[t] = np.concatenate([d_gates, d_new], axis=1)
                d_state = d_state * (1 - m * (1 - z)) + d_rs * r + d_gates @ p["U" + side].T
            g["W" + side], g["c" + side] = np.tensordot(x, d_in, ([0, 1], [0, 1])), d_in.sum(axis=(0, 1))
            d_x += d_in @ p["W" + side].T
        return g, d_x


def train(
    texts: list[str], labels: list[int], share: float = 0.5, epochs: int = 10, seed: int = 7, batch: int = 256, rate: float = 0.01, trim: float = 0.06
) -> Network:
    """Fits the network to labelled texts; ``share`` is how often label 1 is met where the texts come from.

    A text of label 1 is represented by its most suspicious windows: at first by the log odds of their
    words, later by the network's own score; one of label 0 by its most suspicious one and drawn ones. The
    share ``trim`` of the texts of label 1 that look least like it, by now, is left out as mislabelled.
    """
    rng = np.random.default_rng(seed)
    words = Words(pa.array(texts, pa.large_string()))
    y = np.array(labels)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    pairs = np.unique(np.stack([words.hash, doc.astype(np.uint64)], axis=1), axis=0)
    names, inverse = np.unique(pairs[:, 0], return_inverse=True)
    in_toxic = np.bincount(inverse, y[pairs[:, 1].astype(np.int64)], len(names))
    in_all = np.bincount(inverse, minlength=len(names))
    odds = np.log((in_toxic + 0.5) / (y.sum() + 1)) - np.log((in_all - in_toxic + 0.5) / ((1 - y).sum() + 1))
    common = np.sort(np.argsort(-in_all, kind="stable")[:VOCABULARY])
    common = common[in_all[common] >= 5]
    net = Network.fresh(names[common], seed)
    which, first_of = np.unique(words.hash, return_index=True)
    buckets, sizes = words.trigrams(first_of)
    bucket_at = np.cumsum(sizes) - sizes
    word_of = np.searchsorted(which, words.hash)
    number_of = net.numbers(which)
    row, begin, length = windows_of(words.counts)
    suspicion = np.concatenate([[0], np.cumsum(np.maximum(odds[np.searchsorted(names, words.hash)], 0))])
    score = (suspicion[begin + length] - suspicion[begin]).astype(np.float64)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def inputs(chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        at = begin[chosen][None, :] + np.arange(WINDOW)[:, None]
        mask = (np.arange(WINDOW)[:, None] < length[chosen][None, :]).astype(np.float32)
        w = word_of[np.minimum(at, len(word_of) - 1)]
        used, back = np.unique(w, return_inverse=True)
        back = back.reshape(w.shape)
        n = sizes[used]
        b = buckets[np.repeat(bucket_at[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        vectors = np.concatenate([net.p["word"][number_of[used]], net.characters(b, n)], axis=1)
        return vectors[back] * mask[:, :, None], mask, used, back, b, n

    for _ in range(epochs):
        order = np.lexsort((-score, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        best, second = order[rank == 0], order[rank == 1]
        toxic = best[y[row[best]] == 1]
        weak = toxic[np.argsort(score[toxic], kind="stable")[: int(trim * len(toxic))]]
        best = np.setdiff1d(best, weak)
        clean = np.flatnonzero(y[row] == 0)
        drawn = rng.choice(clean, min(len(clean), 2 * len(best)), replace=False)
        chosen = np.concatenate([best, second[y[row[second]] == 0], drawn])
        rng.shuffle(chosen)
        for k in range(0, len(chosen), batch):
            part = chosen[k : k + batch]
            x, mask, used, back, b, n = inputs(part)
            g, d_x = net.gradients(x, mask, y[row[part]].astype(np.float32))
            d_x *= mask[:, :, None]
            each = np.zeros((len(used), d_x.shape[2]), np.float32)
            np.add.at(each, back.ravel(), d_x.reshape(-1, d_x.shape[2]))
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], number_of[used], each[:, :WORD_DIM])
            np.add.at(g["char"], b, np.repeat(each[:, WORD_DIM:] / n[:, None], n, axis=0))
            step += 1
            for name, grad in g.items():
                m, s = moments[name]
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                net.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        for k in range(0, len(row), 4096):
            part = np.arange(k, min(k + 4096, len(row)))
            x, mask, *_ = inputs(part)
            score[part] = net.logits(x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"], mask)
    # The highest window decides, so the output is shifted to where most texts are judged as labelled.
    top = np.full(len(texts), float(net.p["bias"][0]))
    np.maximum.at(top, row, score)
    edges = np.sort(top)
    cuts = (edges[1:] + edges[:-1]) / 2
    worth = [share * (top[y == 1] >= c).mean() + (1 - share) * (top[y == 0] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(worth) >= max(worth) - 1e-9)
    net.p["bias"] = net.p["bias"] - np.float32((cuts[best[0]] + cuts[best[-1]]) / 2)
    return net


class Scorer:
    """Scores texts with a network; projected inputs of words met before are kept in a table of fixed size."""

    def __init__(self, net: Network):
        self.net = net
        self.key = np.zeros(1 << CACHE_BITS, np.uint64)
        self.held = np.zeros((1 << CACHE_BITS, 6 * HIDDEN), np.float32)
        self.side = np.concatenate([net.p["Wf"], net.p["Wb"]], axis=1)
        self.shift = np.concatenate([net.p["cf"], net.p["cb"]])

    def project(self, words: Words) -> np.ndarray:
        slot = (words.hash >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.held[slot]
        missing = np.flatnonzero(self.key[slot] != words.hash)
        if len(missing):
            new, first, back = np.unique(words.hash[missing], return_index=True, return_inverse=True)
            vectors = np.concatenate([self.net.p["word"][self.net.numbers(new)], self.net.characters(*words.trigrams(missing[first]))], axis=1)
            made = vectors @ self.side + self.shift
            out[missing] = made[back]
            at = (new >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.key[at], self.held[at] = new, made
        return out

    def __call__(self, column: pa.Array) -> np.ndarray:
        """A score for every text: the highest of its windows; without words, the one of no evidence."""
        words = Words(column)
        best = np.full(len(column), float(self.net.p["bias"][0]))
        if len(words.hash):
            x = np.concatenate([self.project(words), np.zeros((WINDOW, 6 * HIDDEN), np.float32)])
            row, begin, length = windows_of(words.counts)
            top = np.full(len(column), -np.inf)
            for k in range(0, len(row), 4096):
                at = begin[k : k + 4096][None, :] + np.arange(WINDOW)[:, None]
                mask = (np.arange(WINDOW)[:, None] < length[k : k + 4096][None, :]).astype(np.float32)
                part = x[at]
                np.maximum.at(top, row[k : k + 4096], self.net.logits(part[:, :, : 3 * HIDDEN], part[:, :, 3 * HIDDEN :], mask))
            best = np.where(np.isfinite(top), top, best)
        return _sigmoid(best)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> tuple[DataFrame, float]:
    """(doc_id, toxic, text) and the share of label 1 among all such rows: at most ``rows`` texts of either label, the first by a hash of doc_id, whose crc32 modulo 5 is not 0.

    A text of more than ``text_bytes`` gives evenly spread windows of that many bytes in all.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    share = marked.agg(F.avg("toxic").alias("share")).first()["share"] or 0.0
    sample = [marked.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                if len(text) > text_bytes:
                    size = 1024
                    n = text_bytes // size
                    text = " ".join(text[k * (len(text) - size) // (n - 1) :][:size] for k in range(n))
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["doc_id", "toxic", "text"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample[0].union(sample[1])), "doc_id")
    texts = texts.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(spread, "doc_id bigint, toxic int, text string"), share


def fitted(docs: DataFrame, labels: DataFrame) -> bytes | float:
    """The network trained by one task on ``training_rows``, as bytes; a number where they don't have both labels.

    The sample is bounded, so the task is too; the driver sees the weights alone.
    """
    texts, share = training_rows(docs, labels)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        marks = [r[1] for r in got]
        both = len(set(marks)) == 2
        net = train([r[2] for r in got], marks, share).to_bytes() if both else None
        only = float(marks[0]) if marks and not both else 0.0
        yield pa.RecordBatch.from_arrays([pa.array([net], pa.binary()), pa.array([only])], names=["net", "only"])

    row = texts.repartition(1).mapInArrow(learn, "net binary, only double").first()
    return 0.0 if row is None else row["only"] if row["net"] is None else bytes(row["net"])


CHUNK_BYTES = 1 << 20


def with_scores(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row and ``score``: 0 to 1, higher where ``labels.toxic`` is likelier 1.

    The network is fitted by one task to a bounded sample (``training_rows``) and sent to the others, which
    score all windows of ``WINDOW`` words, ``STRIDE`` apart, of every whole text; a document's score is its
    highest window's. Only the text counts. Null and blank texts get the score of no evidence. Where the
    sample lacks a label, every score is the sample's share of label 1 (0 without a sample). A column named
    score is replaced.
    """
    net = fitted(docs, labels)
    names = [c for c in columns if c != "score"]
    if isinstance(net, float):
        return docs.select(*names, F.lit(net).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.select(*[c for c in names if c != "text"], "text")
    schema = StructType([source.schema[n] for n in names] + [StructField("score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network.from_bytes(sent.value))
        for batch in batches:
            text = batch.column("text")
            offsets = column_bytes(text)[1]
            parts, row = [], 0
            while row < batch.num_rows:
                to = min(batch.num_rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1))
                parts.append(scorer(text.slice(row, to - row)))
                row = to
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(np.concatenate(parts) if parts else [], pa.float64())], [*names, "score"])

    return source.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (see ``with_scores``).

    held_out: crc32 of doc_id as text modulo 5 is 0, or doc_id is null; such rows are never learned from.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    return with_scores(docs, labels, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below 0.5, with their columns."""
    names = docs.columns
    if "score" in names:
        docs = docs.withColumnRenamed("score", "_score")
    kept = with_scores(docs, labels, docs.columns).filter("score < 0.5").drop("score")
    return (kept.withColumnRenamed("_score", "score") if "score" in names else kept).select(names)
