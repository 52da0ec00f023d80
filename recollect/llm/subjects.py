"""Subject areas of documents: complement naive Bayes refined by expectation-maximization, calibrated per subject.

Texts become lists of hashed words in segments (sentences and lines). A first model is trained on the labelled documents,
where a segment of a document counts for each of its labels; "none" is a class of its own. A round of
expectation-maximization then gives every segment of every document its posterior under the model and counts the words anew
by posterior, beside the labelled ones. A document's share of a subject is the part of its words in segments about it, and a logistic curve per subject, fitted to the labels, turns shares into independent posteriors.

How far a word must lean to a subject to count and the advantage of "none" are not set by hand: they are those with the least loss
on labelled documents under models trained on the others, in FOLDS parts.

Only the labelled sample is bounded (MAX_LABELLED documents, of which up to MAX_TUNED are held out in turn); rounds, shares and posteriors
cover all documents. The model is a table of BUCKETS x classes, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.text import strip_layout
from recollect.session import shared_checkpoint

BUCKETS = 1 << 17
MAX_LABELLED = 200_000
MAX_TUNED = 20_000
ROUNDS = 1
FOLDS = 3
PRIOR = 2.0
# What is tried on held-out labels.
LEANS = (0.2, 0.4, 0.6)
NONES = (0.5, 1.5, 3.0)
_TOKENS = re.compile(r"[^\W\d_]{2,}|[.!?\n]")
_ENDS = {".", "!", "?", "\n"}


class _Buckets(dict):
    """Word -> bucket; -1 ends a segment."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = b = -1 if word in _ENDS else zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words): the words' buckets in order, segments ended by -1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets()
        for b in batches:
            rows = [[bucket[w] for w in _TOKENS.findall(strip_layout(t).lower())] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["id", "words"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text <> ''")
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, words array<int>")


def segments(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each segment, document of each segment), without empty segments."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    end = flat < 0
    word = ~end
    seg = np.cumsum(end)[word] * (len(column) + 1) + doc[word] if len(flat) else np.zeros(0, np.int64)
    w = flat[word]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(w) else np.zeros(0, np.int64)
    return w, first, doc[word][first] if len(w) else first


def weights(counts: np.ndarray, lean: float) -> np.ndarray:
    """The model of complement naive Bayes: by word and class, the log of how much more often the word occurs in the class than in
    its complement, the documents of all other classes; both counts have PRIOR occurrences more, spread like all words.

    A word spread over the classes about as all words are says nothing of a subject. It weighs nothing if its divergence from that
    lies below ``lean`` and fully from twice that on; else the chance imbalance of phrases common to all
    subjects would outweigh the few words that tell."""
    total, size = counts.sum(0), counts.sum(1)
    usual = (size + 1) / (size.sum() + len(size))
    own = counts + PRIOR * usual[:, None]
    rest = (total - counts) + PRIOR * (1 - usual)[:, None]
    w = np.log(own / (size + 1)[:, None]) - np.log(rest / (size.sum() - size + len(size))[:, None])
    share = own / (total + PRIOR)
    divergence = (share * np.log(share / usual[:, None])).sum(0)
    gate = np.clip(divergence / lean - 1, 0, 1)
    return np.ascontiguousarray((w * gate).T.astype(np.float32))


def posteriors(w: np.ndarray, first: np.ndarray, model: np.ndarray, none: float) -> np.ndarray:
    """Of each segment, the probability of each class; the last, none, has it where no word tells otherwise."""
    if not len(first):
        return np.zeros((0, model.shape[1]), np.float32)
    score = np.add.reduceat(model[w], first, axis=0)
    score[:, -1] += none
    score -= score.max(1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(1, keepdims=True)


def in_context(p: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The segments' posteriors given the mixture of classes of their documents: a segment of words not known yet is most likely about
    what the rest of its document is about, which is how such words are learned."""
    n = int(doc.max(initial=-1)) + 1
    mixture = np.column_stack([np.bincount(doc, p[:, c] * size, n) for c in range(p.shape[1])])
    mixture /= np.maximum(np.bincount(doc, size, n), 1)[:, None]
    q = p * (mixture[doc] + 0.01)
    return q / q.sum(1, keepdims=True)


def _counts(classes: int, model=None, none: float = 0.0):
    """Sums of posteriors by word over a partition; without a model, rows bring their own class weights."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, BUCKETS))
        for b in batches:
            w, first, doc = segments(b.column(0))
            if not len(w):
                continue
            if model is None:
                own = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
                p = own[doc]
            else:
                p = in_context(posteriors(w, first, model.value, none), np.diff(np.append(first, len(w))), doc)
            each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
            for c in range(classes):
                total[c] += np.bincount(w, p[each, c], BUCKETS)
        at = np.flatnonzero(total.any(0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(at) + 1) * classes, classes, dtype=np.int32)), pa.array(np.ascontiguousarray(total[:, at].T).reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), lists], names=["word", "n"])

    return run


def _total(parts: DataFrame, classes: int) -> np.ndarray:
    """The sums of all partitions: at most BUCKETS rows reach the driver."""
    rows = parts.groupBy("word").agg(*[F.sum(F.col("n")[c]).alias(f"c{c}") for c in range(classes)]).toArrow()
    out = np.zeros((classes, BUCKETS))
    at = rows["word"].to_numpy()
    for c in range(classes):
        out[c, at] = rows[f"c{c}"].to_numpy()
    return out


def _calibrate(share: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve over the log share, by Newton's method; a weak prior puts its middle at 0.15."""
    x = np.log(share + 0.02) - np.log(0.17)
    a, b = 0.0, 3.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(y - p).sum() - 0.5 * a, ((y - p) * x).sum() - 0.5 * (b - 3)])
        v = p * (1 - p)
        h = np.array([[v.sum() + 0.5, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.5]])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -2, 2), max(0.5, b + np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-6:
            break
    return float(a), float(b)


def shares_of(column: pa.ListArray, model: np.ndarray, none: float) -> np.ndarray:
    """Of each document, the part of its words in segments of each class."""
    w, first, doc = segments(column)
    p = posteriors(w, first, model, none)
    size = np.diff(np.append(first, len(w)))
    out = np.column_stack([np.bincount(doc, p[:, c] * size, len(column)) for c in range(model.shape[1])])
    return out / np.maximum(np.bincount(doc, size, len(column)), 1)[:, None]


def _measured(docs: DataFrame, counts: list[np.ndarray], leans: list[float], nones: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(votes, shares) by document, lean with advantage of "none", class; ``docs`` (words, votes, fold) is a bounded sample;
    ``counts``: those of each fold's models, made where they are used."""
    shared = docs.sparkSession.sparkContext.broadcast([c.astype(np.float32) for c in counts])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, list[np.ndarray]] = {}
        for b in batches:
            fold = b.column(2).to_numpy()
            for f in np.unique(fold):
                part = b.filter(pa.array(fold == f))
                if f not in models:
                    models[f] = [weights(shared.value[f % len(counts)].astype(float), x) for x in leans]
                s = np.concatenate([shares_of(part.column(0), m, none) for m in models[f] for none in nones], axis=1)
                off = pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(off, pa.array(s.reshape(-1)))], names=["votes", "share"])

    t = docs.select("words", "votes", "fold").mapInArrow(run, "votes array<double>, share array<double>").toArrow()
    shared.destroy()
    k = len(counts[0])
    flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0)
    return flat("votes").reshape(-1, k), flat("share").reshape(t.num_rows, len(leans) * len(nones), k)


def _loss(vote: np.ndarray, share: np.ndarray) -> float:
    """The log loss of all subjects' curves."""
    total = 0.0
    for c in range(vote.shape[1] - 1):
        y = vote[:, c] > 0
        p = _curve(share[:, c], *_calibrate(share[:, c], y.astype(float))).clip(1e-6, 1 - 1e-6)
        total -= np.log(np.where(y, p, 1 - p)).sum()
    return total


def _curve(share: np.ndarray, a, b) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a + b * (np.log(share + 0.02) - np.log(0.17)), -30, 30)))


def subject_areas(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, names: list[str], rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, subject, share, posterior) for each document and each subject whose posterior is at least 0.5.

    ``labels``: (id, subject), with several rows per document where it has several subjects or annotators; a null subject
    says that none applies. Spelling may differ in case and outer blanks; other unknown subjects are ignored.

    - Up to ``max_labelled`` labelled documents (those with the smallest hash of the id) train the first model and the curves;
      everything else covers all documents.
    - Null and empty texts and null ids have no row; a document on several rows is one of each. Without any label
      no document has a subject. Other columns are ignored.
    """
    spark = docs.sparkSession
    k = len(names) + 1
    known = labels.select(F.col("id"), F.lower(F.trim("subject")).alias("s")).where("id is not null")
    known = known.where(F.col("s").isNull() | F.col("s").isin([n.lower() for n in names]))
    votes = known.groupBy("id").agg(*[F.sum(F.when(F.col("s") == n.lower(), 1.0).otherwise(0.0)).alias(f"v{i}") for i, n in enumerate(names)], F.sum(F.when(F.col("s").isNull(), 1.0).otherwise(0.0)).alias(f"v{k - 1}"))
    votes = votes.select("id", F.array(*[f"v{i}" for i in range(k)]).alias("votes")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    words = shared_checkpoint(tokens(docs, id_col, text_col))
    fold = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")
    some = shared_checkpoint(words.join(votes, "id").select("id", "words", "votes", fold))
    split = F.expr("transform(votes, x -> x / aggregate(votes, 0D, (a, y) -> a + y))")
    shape = "word int, n array<double>"
    by_fold = [_total(some.where(F.col("fold") == f).select("words", split.alias("votes")).mapInArrow(_counts(k), shape), k) for f in range(FOLDS)]
    labelled = sum(by_fold)
    tuned = some.orderBy(F.xxhash64("id"), "id").limit(MAX_TUNED)
    vote, share = _measured(tuned, [labelled - n for n in by_fold], list(LEANS), list(NONES))
    best = int(np.argmin([_loss(vote, share[:, i]) for i in range(share.shape[1])])) if len(vote) else 0
    lean, none = LEANS[best // len(NONES)], NONES[best % len(NONES)]
    counts = labelled
    model = weights(counts, lean)
    for _ in range(rounds if len(vote) else 0):
        shared = spark.sparkContext.broadcast(model)
        found = _total(words.select("words").mapInArrow(_counts(k, shared, none), shape), k)
        counts = labelled + found
        model = weights(counts, lean)
        shared.destroy()
    vote, share = _measured(some, [counts], [lean], [none])
    curves = [_calibrate(share[:, 0, c], (vote[:, c] > 0).astype(float)) if len(share) else (-30.0, 0.0) for c in range(k - 1)]
    shared = spark.sparkContext.broadcast(model)
    kind = words.schema["id"].dataType.simpleString()

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shares_of(b.column(1), shared.value, none)[:, : k - 1]
            p = _curve(s, *np.array(curves).T)
            i, c = np.nonzero(p >= 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array([names[x] for x in c], pa.string()), pa.array(s[i, c]), pa.array(p[i, c])], names=["id", "subject", "share", "posterior"])

    return words.select("id", "words").mapInArrow(decide, f"id {kind}, subject string, share double, posterior double")
