"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The metadata are what the table says of a text besides the text: its length in
characters (``n_chars``), which is counted where the table does not say it.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
so pairwise interactions cost time linear in a document's distinct words.

Defined cases: a null text counts as empty; an empty text gets a score from its
statistics like any other; rows without a label are not learnt from; without any
label every score is 0.5, and ``keep_good`` keeps all documents; repeated rows
give equal scores; a null or missing length is counted; an empty table gives an
empty result; other columns (labels, language, source and id among them) are
never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textkit import LOWER, byte_chunks, crc_mod, segment_sums, span_hashes, text_rows, word_spans

#: Labelled rows that are learnt from at most, chosen by a hash of their id; the model is a few MB whatever the corpus.
SAMPLE_ROWS = 6000
BUCKET_BITS = 15
RANK = 8
#: Scores from here on count as good.
THRESHOLD = 0.7
_STATS = 18


def _classes() -> np.ndarray:
    """Per byte: upper, lower, digit, symbol, sentence end, pipe, newline, non-ASCII."""
    t = np.zeros((256, 8), np.int64)
    t[65:91, 0] = t[97:123, 1] = t[48:58, 2] = t[128:, 7] = 1
    t[[b for b in b"!#$%&*+/<=>@\\^_`{|}~"], 3] = 1
    t[[b for b in b".,;:?"], 4] = 1
    t[ord("|"), 5] = t[10, 6] = 1
    return t


_CLASS_COLUMNS = _classes()


def features(texts: pa.Array, chars: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of documents: (first row, statistics, bucket of each entry, its share of the words, entries' firsts)."""
    said = chars.to_numpy(zero_copy_only=False)
    for a, b, buf, offsets in byte_chunks(texts):
        n = b - a
        starts, ends, firsts = word_spans(buf, offsets)
        h = span_hashes(LOWER[buf], starts, ends)
        doc = np.repeat(np.arange(n), np.diff(firsts))
        words, size = np.diff(firsts), np.diff(offsets)
        per_word, per_byte = 1 / np.maximum(words, 1), 1 / np.maximum(size, 1)
        stats = np.zeros((n, _STATS), np.float32)
        for k in range(8):
            stats[:, k] = segment_sums(_CLASS_COLUMNS[:, k].astype(np.int8)[buf], offsets) * per_byte
        same = np.zeros(len(h), np.int8)
        same[1:] = h[1:] == h[:-1]
        stats[:, 8] = segment_sums(same, firsts) * per_word
        stats[:, 9] = size * per_word / 10
        stats[:, 10] = np.log1p(words) / 5
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        top = np.flatnonzero(new)
        count = np.diff(np.append(top, len(hs)))
        entry_doc = ds[top]
        entries = np.searchsorted(entry_doc, np.arange(n + 1))
        distinct = np.diff(entries)
        stats[:, 11] = distinct * per_word
        some = distinct > 0
        if some.any():
            stats[some, 12] = np.maximum.reduceat(count, entries[:-1][some]) * per_word[some]
            stats[some, 13] = segment_sums((count > 1).astype(np.int8), entries)[some] / distinct[some]
            stats[some, 14] = np.sqrt(segment_sums((count * count).astype(np.int64), entries)[some]) * per_word[some]
        stats[:, 15] = np.minimum(words, 50) / 50
        length = np.maximum(said[a:b], 0)
        stats[:, 16] = np.log1p(length) / 10
        stats[:, 17] = np.minimum(size / np.maximum(length, 1), 8)
        # words of a text: shares that sum to one in squares, so that long texts weigh as short ones do
        share = count / np.sqrt(np.maximum(segment_sums((count * count).astype(np.int64), entries), 1))[entry_doc]
        yield a, stats, (hs[top] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), share.astype(np.float32), entries


class FactorisationMachine:
    """Weights of the statistics (standardised) and of the word buckets."""

    def __init__(self, rng_seed: int = 7):
        rng = np.random.default_rng(rng_seed)
        n = _STATS + (1 << BUCKET_BITS)
        self.w0, self.w = np.float32(0), np.zeros(n, np.float32)
        self.v = rng.normal(0, 0.03, (n, RANK)).astype(np.float32)
        self.mean, self.scale = np.zeros(_STATS, np.float32), np.ones(_STATS, np.float32)
        self.learnt = 0

    def _margin(self, stats, bucket, share, entries):
        z = np.clip((stats - self.mean) * self.scale, -6, 6)
        at = bucket + _STATS
        vx = self.v[at] * share[:, None]
        first = segment_sums(vx, entries) + z @ self.v[:_STATS]
        second = segment_sums(vx * vx, entries).sum(1) + (z * z) @ (self.v[:_STATS] ** 2).sum(1)
        linear = segment_sums(self.w[at] * share, entries) + z @ self.w[:_STATS]
        return self.w0 + linear + 0.5 * ((first * first).sum(1) - second), z, vx, first

    def score(self, stats, bucket, share, entries) -> np.ndarray:
        margin = self._margin(stats, bucket, share, entries)[0]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 0.02, batch: int = 128, decay: float = 1e-4) -> FactorisationMachine:
        """Adam on the log loss, rows in a fixed random order."""
        if not len(labels):
            return self
        self.learnt = len(labels)
        stats = np.stack([r[0] for r in rows]).astype(np.float32)
        self.mean, self.scale = stats.mean(0), (1 / (stats.std(0) + 1e-3)).astype(np.float32)
        share_of_ones = np.clip(labels.mean(), 0.01, 0.99)
        self.w0 = np.float32(np.log(share_of_ones / (1 - share_of_ones)))
        rng = np.random.default_rng(11)
        params = {"w": self.w, "v": self.v}
        m = {k: np.zeros_like(p) for k, p in params.items()}
        s = {k: np.zeros_like(p) for k, p in params.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                bucket = np.concatenate([rows[j][1] for j in part])
                share = np.concatenate([rows[j][2] for j in part])
                entries = np.cumsum([0, *(len(rows[j][1]) for j in part)])
                margin, z, vx, first = self._margin(stats[part], bucket, share, entries)
                g = ((1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[part]) / len(part)).astype(np.float32)
                gx = np.repeat(g, np.diff(entries))
                u, inverse = np.unique(bucket + _STATS, return_inverse=True)
                at = np.concatenate([np.arange(_STATS), u])
                gw = np.concatenate([z.T @ g, np.bincount(inverse, gx * share, len(u))])
                rowsum = np.repeat(first.astype(np.float32), np.diff(entries), axis=0)
                inner = (gx * share)[:, None] * (rowsum - vx)
                gv = np.concatenate([z.T @ (g[:, None] * first) - ((z * z).T @ g)[:, None] * self.v[:_STATS], np.stack([np.bincount(inverse, inner[:, f], len(u)) for f in range(RANK)], axis=1)])
                step += 1
                for k, grad in (("w", gw), ("v", gv)):
                    grad = grad + decay * params[k][at]
                    m[k][at] = 0.9 * m[k][at] + 0.1 * grad
                    s[k][at] = 0.99 * s[k][at] + 0.01 * grad * grad
                    params[k][at] -= rate * (m[k][at] / (1 - 0.9 ** min(step, 200))) / (np.sqrt(s[k][at] / (1 - 0.99 ** min(step, 2000))) + 1e-6)
                self.w0 = np.float32(self.w0 - rate * 0.5 * g.sum())
        return self


def _length(docs: DataFrame, text_col: str, chars_col: str) -> Column:
    """The length that the table states, or else that of the text."""
    counted = F.coalesce(F.char_length(docs[text_col]), F.lit(0)).cast("long")
    return F.coalesce(docs[chars_col].cast("long"), counted) if chars_col in docs.columns else counted


def learning_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, chars_col: str = "n_chars") -> DataFrame:
    """(label, stats, bucket, share) of at most ``sample_rows`` labelled rows whose crc32(id) mod 4 is not 2."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 4) != 2))
    chosen = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, stats, bucket, share, entries in features(batch.column(1), batch.column(2)):
                ends = entries.astype(np.int32)
                n = len(stats)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.ListArray.from_arrays(np.arange(0, n * _STATS + 1, _STATS, dtype=np.int32), stats.ravel()), pa.ListArray.from_arrays(ends, bucket), pa.ListArray.from_arrays(ends, share)], names=["label", "stats", "bucket", "share"])

    texts = text_rows(docs, docs[id_col].alias("id"), docs[text_col].alias("text"), _length(docs, text_col, chars_col).alias("chars"))
    return texts.join(F.broadcast(chosen), "id").select("label", "text", "chars").mapInArrow(run, "label int, stats array<float>, bucket array<int>, share array<float>")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, chars_col: str = "n_chars") -> FactorisationMachine:
    """A machine learnt on the driver from the features of the bounded sample."""
    got = learning_rows(docs, labels, label_col, id_col, text_col, sample_rows, chars_col).toArrow()
    rows = [(np.asarray(s.values.to_numpy()), np.asarray(b.values.to_numpy()), np.asarray(x.values.to_numpy())) for s, b, x in zip(got["stats"], got["bucket"], got["share"])]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0].tobytes(), rows[i][1].tobytes()))  # whatever order the tasks end in
    labels_ = got["label"].to_numpy().astype(np.float32)
    return FactorisationMachine().fit([rows[i] for i in order], labels_[order])


def with_scores(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", score_col: str = "score", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1 for their whole texts; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name != score_col]
    at, n = docs.columns.index(text_col), len(docs.columns)
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, stats, bucket, share, entries in features(batch.column(at), batch.column(n)):
                out[a : a + len(stats)] = shared.value.score(stats, bucket, share, entries)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out)], names=[*(f.name for f in fields), score_col])

    rows = text_rows(docs, F.col("*"), _length(docs, text_col, chars_col)).toDF(*(f"c{i}" for i in range(n + 1)))  # names with backticks would stop mapInArrow
    return rows.mapInArrow(run, StructType([*fields, StructField(score_col, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the classifier scores below the threshold; all of them if there was nothing to learn from."""
    model = fit(docs, labels)
    if not model.learnt:
        return docs
    name = "_quality_score"
    while name in docs.columns:
        name += "_"
    return with_scores(docs, model, score_col=name).where(F.col(name) >= threshold).drop(name)
