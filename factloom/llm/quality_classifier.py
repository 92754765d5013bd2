"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer.

Eleven overlapping heuristics vote bad or nothing on every document. The votes form a pattern; all
documents are counted by pattern, and expectation-maximisation on these counts (2**11 patterns at most)
estimates the share of good documents and how often each labeller objects to good and to bad ones. The
posterior of a document's pattern is its weak label. On a bounded sample of documents a logistic
scorer over hashed word shapes, shape pairs and repeats is fitted to the posteriors; the scorer then judges
every document by its whole text.

Bounds: `sample_rows` documents are fitted on (about as many: those whose hashed id is below a
threshold), chosen by hash of the id. All counts cover all documents.

Nulls: a null text is empty; empty texts (no words) are rejected with score 0. A null doc_id is kept
as it is and never in the sample. Ties: a score of just `least` is kept. Repeated rows are judged each
for itself and count each for itself. Very long texts are taken whole, one at a time. Ids may be of any
type. An empty table gives no rows. Only doc_id and text are read; clashing further columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BYTE_CODE, CHUNK_BYTES, column_bytes, id_type, lean, mix, pieces, powers, prefix_sums, store, word_bounds, word_hashes

LABELLERS = ("symbols", "symbol_words", "odd_signs", "letterless", "capital_words", "capitals", "exclamation", "again", "runs", "pairs", "variety")
N_FEATURES = 1 << 16

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ODD = ~(_LOWER | _UPPER)
_ODD[48:58] = False
_ODD[[9, 10, 11, 12, 13, 32]] = False
# Shape of a byte: letters, capitals and digits become one sign each, others stay.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_LOWER] = ord("a")
_SHAPE[_UPPER] = ord("A")
_SHAPE[48:58] = ord("0")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


class Words:
    """Words of a piece of a column: bounds, hashes, and the figures the labellers use."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.rows = word_bounds(data, offsets)
        self.hashes, _ = word_hashes(data, offsets)
        self.n = np.diff(self.rows)
        self.row_of = np.repeat(np.arange(len(self.n)), self.n)

    def shapes(self) -> np.ndarray:
        """Hash of each word's shape: runs of one class count as one."""
        s = _SHAPE[self.data]
        keep = np.ones(len(s), bool)
        keep[1:] = s[1:] != s[:-1]
        keep[self.starts] = True
        place = np.concatenate(([0], np.cumsum(keep)))
        sums, (_, down) = prefix_sums(s[keep], BYTE_CODE), powers(len(s) + 1)
        a, b = place[self.starts], place[self.ends]
        return mix((sums[b] - sums[a]) * down[a])

    def again(self) -> np.ndarray:
        """Whether a word repeats the word before it."""
        out = np.zeros(len(self.hashes), bool)
        out[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.row_of[1:] == self.row_of[:-1])
        return out

    def votes(self) -> np.ndarray:
        """Row by labeller: whether it objects. Each kind of junk is seen by two labellers or more; texts under ten words by none."""
        data, off, n = self.data, self.offsets, self.n
        words = np.maximum(n, 1)
        size = np.maximum(off[1:] - off[:-1], 1)
        share = lambda flags: np.bincount(self.row_of, flags, len(n)) / words
        held = lambda table: (lambda c: c[self.ends] > c[self.starts])(np.concatenate(([0], np.cumsum(table[data]))))
        lower, upper = _per_row(_LOWER[data], off), _per_row(_UPPER[data], off)
        has_lower, has_upper = held(_LOWER), held(_UPPER)
        order = np.lexsort((self.hashes, self.row_of))
        h, r = self.hashes[order], self.row_of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        # Long texts repeat words anyway: the distinct ones are set against the square root of all.
        variety = np.bincount(r, new, len(n)) / np.maximum(np.minimum(words, 5 * np.sqrt(words)), 1)
        again = self.again()
        third = again.copy()
        third[1:] &= again[:-1]
        inside = self.row_of[1:] == self.row_of[:-1]
        pair = mix(self.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[1:])[inside] >> np.uint64(24)
        pair = np.sort(pair | (self.row_of[1:][inside].astype(np.uint64) << np.uint64(40)))
        first = np.ones(len(pair), bool)
        first[1:] = pair[1:] != pair[:-1]
        pairs = np.bincount((pair >> np.uint64(40)).astype(np.int64), first, len(n)) / np.maximum(n - 1, 1)
        many = n >= 10
        return np.stack(
            [
                _per_row(_SYMBOL[data], off) / words > 0.1,
                share(held(_SYMBOL)) > 0.05,
                _per_row(_ODD[data], off) / size > 0.09,
                share(~(has_lower | has_upper)) > 0.15,
                share(has_upper & ~has_lower & (self.ends - self.starts > 1)) > 0.1,
                upper / np.maximum(lower + upper, 1) > 0.2,
                _per_row(data == ord("!"), off) / words > 0.1,
                share(again) > 0.08,
                share(third) > 0.04,
                pairs < 0.6,
                variety < 0.35,
            ],
            axis=1,
        ) & many[:, None]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of every word: its shape, the pair of its and the next word's shape, whether it repeats."""
        shape = self.shapes()
        pair = mix(shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:])
        inside = self.row_of[1:] == self.row_of[:-1]
        one = (shape >> np.uint64(49)).astype(np.int64)  # the lower half of the features
        two = (pair[inside] >> np.uint64(50)).astype(np.int64) + N_FEATURES // 2
        return np.concatenate((self.row_of, self.row_of[1:][inside], self.row_of)), np.concatenate((one, two, np.where(self.again(), N_FEATURES - 1, N_FEATURES - 2)))


def _each(batches: Iterator) -> Iterator[tuple[object, Words]]:
    for b in batches:
        data, offsets = column_bytes(b.column("text"))
        for i, j in pieces(offsets, CHUNK_BYTES):
            yield b.slice(i, j - i), Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _patterns(votes: np.ndarray) -> np.ndarray:
    """Votes as one number, a bit for each labeller."""
    return (votes.astype(np.int64) << np.arange(len(LABELLERS))).sum(axis=1)


def _vote(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b, w in _each(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_patterns(w.votes()).astype(np.int32))], ["doc_id", "pattern"])


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM: (posterior of good for each pattern, share of good, objects[class, labeller])."""
    votes = (patterns[:, None] >> np.arange(len(LABELLERS))[None, :] & 1).astype(bool)
    share = 0.9
    objects = np.empty((2, len(LABELLERS)))
    objects[0], objects[1] = 0.3, 0.01  # how often labellers object to bad and to good documents, to begin with
    post = np.ones(len(patterns))
    total = max(counts.sum(), 1)
    for _ in range(rounds):
        ll = [np.where(votes, np.log(objects[c]), np.log1p(-objects[c])).sum(axis=1) + np.log(p) for c, p in ((0, 1 - share), (1, share))]
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -700, 700)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        share = min(max(float((post * counts).sum() / total), 1e-4), 1 - 1e-4)
        for c, weight in ((0, (1 - post) * counts), (1, post * counts)):
            objects[c] = ((weight[:, None] * votes).sum(axis=0) + (0.3, 0.01)[c]) / (weight.sum() + 1)
        if done:
            break
    return post, share, objects


def _sampled(batches: Iterator) -> Iterator:
    """Features of a text with their shares of its words."""
    import pyarrow as pa

    for b, w in _each(batches):
        row, feature = w.features()
        keys, counts = np.unique(row * N_FEATURES + feature, return_counts=True)
        share = counts / np.maximum(w.n[keys // N_FEATURES], 1)
        cuts = np.searchsorted(keys, np.arange(len(w.n) + 1) * N_FEATURES)
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.astype(t)))
        yield pa.RecordBatch.from_arrays([pa.array(_patterns(w.votes()).astype(np.int32)), lists(keys % N_FEATURES, np.int32), lists(share, np.float32)], ["pattern", "feature", "share"])


def fit_scorer(rows: list, posterior: dict[int, float], rounds: int = 300, rate: float = 2.0) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic scorer, by gradient steps scaled per feature."""
    weights = np.zeros(N_FEATURES + 1)
    if not rows:
        weights[-1] = 1.0
        return weights
    size = np.array([len(r["feature"]) for r in rows])
    feature = np.concatenate([np.array(r["feature"], np.int64) for r in rows])
    share = np.sqrt(np.concatenate([np.array(r["share"]) for r in rows]))
    row = np.repeat(np.arange(len(rows)), size)
    y = np.array([posterior.get(r["pattern"], 0.5) for r in rows])
    seen = np.full(N_FEATURES, 1e-8)
    bias_seen = 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights[feature] * share, len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        gradient = np.bincount(feature, error[row] * share, N_FEATURES) + 1e-6 * weights[:-1]
        seen += gradient**2
        bias_seen += error.sum() ** 2
        weights[:-1] -= rate * 0.05 * gradient / np.sqrt(seen)
        weights[-1] -= rate * 0.05 * error.sum() / np.sqrt(bias_seen)
    return weights


def _scorer(weights: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b, w in _each(batches):
            row, feature = w.features()
            # Features count by the square root of their share, so common words do not drown the rest.
            keys, counts = np.unique(row * N_FEATURES + feature, return_counts=True)
            r = keys // N_FEATURES
            z = np.bincount(r, weights[keys % N_FEATURES] * np.sqrt(counts / np.maximum(w.n[r], 1)), len(w.n)) + weights[-1]
            p = np.where(w.n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_patterns(w.votes()).astype(np.int32)), pa.array(np.round(p, 6))], ["doc_id", "pattern", "score"])

    return run


def fit(docs: DataFrame, sample_rows: int) -> tuple[dict[int, float], np.ndarray]:
    """(posterior of good for each vote pattern, weights of the scorer)."""
    votes = store(docs.select("doc_id", "text").mapInArrow(lean(_vote), f"doc_id {id_type(docs)}, pattern int"), "quality-votes")
    counts = votes.groupBy("pattern").count().orderBy("pattern").collect()  # 2**11 rows at most
    patterns, n = np.array([r["pattern"] for r in counts], np.int64), np.array([r["count"] for r in counts], np.float64)
    post, _, _ = label_model(patterns, n)
    posterior = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    share = min(1.0, sample_rows / max(n.sum(), 1))
    picked = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    rows = picked.select("doc_id", "text").mapInArrow(lean(_sampled), "pattern int, feature array<int>, share array<float>").collect()
    rows.sort(key=lambda r: (r["pattern"], r["feature"], r["share"]))  # one result whatever the order of tasks
    return posterior, fit_scorer(rows, posterior)


def quality_scores(docs: DataFrame, sample_rows: int = 4000, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, weak_label (posterior of its votes), score, kept."""
    posterior, weights = fit(docs, sample_rows)
    scored = docs.select("doc_id", "text").mapInArrow(lean(_scorer(weights)), f"doc_id {id_type(docs)}, pattern int, score double")
    table = docs.sparkSession.createDataFrame([(k, round(v, 9)) for k, v in posterior.items()], "pattern int, weak_label double")
    out = scored.join(F.broadcast(table), "pattern", "left")  # 2**11 rows at most
    return out.select("doc_id", "weak_label", "score", (F.col("score") >= least).alias("kept"))


def _keep(weights: np.ndarray, least: float):
    score = _scorer(weights)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            p = pa.chunked_array([x.column("score") for x in score([b])], pa.float64()).combine_chunks() if b.num_rows else pa.array([], pa.float64())
            yield b.filter(pc.greater_equal(p, least))

    return run


def quality_kept(docs: DataFrame, sample_rows: int = 4000, least: float = 0.5) -> DataFrame:
    """The documents that the scorer keeps, with the columns they came with."""
    _, weights = fit(docs, sample_rows)
    return docs.mapInArrow(lean(_keep(weights, least)), docs.schema)
