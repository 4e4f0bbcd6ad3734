"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash01, materialise, share, value_of

#: Labelled rows that the index holds, about so many of each label at most.
EXAMPLES = 3000
#: A term is one of the index if its association with the label reaches this chi-squared
#: value, and so many examples hold it; however many such terms there are, all are kept.
CHI2, LEAST_DF = 30.0, 5
#: Examples of a block of the index.
BLOCK = 64
#: Blocks that are visited first.
FIRST = 6
NEIGHBOURS = 25
#: Rows that one task scores.
TASK = 8192
#: All words outside the vocabulary are one term of this weight, so that a few chance
#: hits in a long text point elsewhere than the same hits in a short one.
OTHER = 1.0
_WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words count as terms as well: inflections and compounds share them.
STEMS = (5, 6, 7)


def _terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


class Index:
    """Examples as unit TF-IDF vectors in blocks; each term keeps its postings and its
    largest weight per block, which bound the score of every example of a block."""

    def __init__(self, ids, labels, weights, vectors, idf):
        self.idf = idf
        rows = [self.unit(t, c) for t, c in vectors]
        # Like examples side by side make the bounds tight.
        order = sorted((i for i in range(len(rows)) if len(rows[i][0])), key=lambda i: (rows[i][0][np.argmax(rows[i][1])], labels[i], ids[i]))
        self.ids, self.labels, self.weights = (np.array([x[i] for i in order]) for x in (ids, labels, weights))
        self.blocks = max(1, -(-len(order) // BLOCK))
        post: dict[int, list[tuple[int, float]]] = {}
        for at, i in enumerate(order):
            for t, w in zip(*rows[i]):
                post.setdefault(int(t), []).append((at, float(w)))
        self.post, self.bound = {}, {}
        for t, p in post.items():
            at, w = np.array([x[0] for x in p]), np.array([x[1] for x in p])
            top = np.zeros(self.blocks)
            np.maximum.at(top, at // BLOCK, w)
            self.post[t], self.bound[t] = (at, w), top
        empty = [i for i in range(len(rows)) if not len(rows[i][0])]
        total = sum(weights[i] for i in empty)
        self.no_terms = (sum(weights[i] * labels[i] for i in empty) + 0.1) / (total + 1.0)
        self.prior = (sum(w * y for w, y in zip(weights, labels)) + 0.1) / (sum(weights) + 1.0)
        self.curve = None
        self.rows = [rows[i] for i in order]

    def unit(self, terms, counts):
        """Terms and weights of a unit vector; terms that no document has are left out."""
        t, c = np.asarray(terms, int), np.asarray(counts, float)
        w = (1 + np.log(c)) * self.idf[t]
        ok = w > 0
        t, w = t[ok], w[ok]
        n = np.sqrt((w * w).sum())
        return (t, w / n) if n > 0 else (t[:0], w[:0])

    def nearest(self, t: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the nearest examples, exact; ties to the smaller id.

        Blocks of the highest bounds are visited first, and then all whose bound
        reaches the least of the nearest so far: no other can hold a nearer example.
        """
        known = [(int(x), y) for x, y in zip(t, w) if int(x) in self.post]
        if not known:
            return np.empty(0, int), np.empty(0)
        bound = sum(y * self.bound[x] for x, y in known)
        at = np.concatenate([self.post[x][0] for x, _ in known])
        weight = np.concatenate([y * self.post[x][1] for x, y in known])
        block = at // BLOCK
        got_at, got = np.empty(0, int), np.empty(0)
        seen, least = bound <= 0, 0.0
        # The most promising blocks give a threshold; then all that can reach it, then no more.
        for most in (FIRST, len(bound)):
            live = ~seen & (bound >= least - 1e-9)
            order = np.flatnonzero(live)
            live[order[np.argsort(-bound[order], kind="stable")[most:]]] = False
            seen |= live
            own = live[block]
            score = np.bincount(at[own], weight[own], len(self.ids))
            hit = np.flatnonzero(score > 0)
            hit = hit[hit != skip]
            got_at, got = np.concatenate([got_at, hit]), np.concatenate([got, score[hit]])
            if len(got) > NEIGHBOURS:
                near = got >= np.partition(got, len(got) - NEIGHBOURS)[len(got) - NEIGHBOURS] - 1e-8
                got_at, got = got_at[near], got[near]
            best = np.lexsort((self.ids[got_at], -np.round(got, 9)))[:NEIGHBOURS]
            got_at, got = got_at[best], got[best]
            if len(got) == NEIGHBOURS:
                least = got[-1]
        return got_at, got

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        """The share of label 1 among the neighbours, by closeness and by how many rows each stands for."""
        if not len(at):
            return self.no_terms
        w = cos**2 * self.weights[at] / self.weights.max()
        return float(((w * self.labels[at]).sum() + 0.02 * self.prior) / (w.sum() + 0.02))

    def calibrate(self) -> None:
        """Votes of the examples, each left out in turn, against their labels: a rising
        step curve by pooling adjacent violators, read with linear interpolation."""
        if not self.rows:
            return
        raw = np.array([self.vote(*self.nearest(*r, skip=i)) for i, r in enumerate(self.rows)])
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []
        for part in np.array_split(order, min(40, len(order))):
            w = self.weights[part]
            pools.append([float((w * raw[part]).sum()), float((w * self.labels[part]).sum()), float(w.sum())])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                x = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], x)]
        xs = [0.0, *(p[0] / p[2] for p in pools), 1.0]
        ys = [p[1] / p[2] for p in pools]
        self.curve = (np.array(xs), np.array([min(ys[0], xs[1]), *ys, max(ys[-1], xs[-2])]))

    def score(self, terms, counts) -> tuple[float, list[int], list[float]]:
        at, cos = self.nearest(*self.unit(terms, counts))
        raw = self.vote(at, cos)
        s = raw if self.curve is None or not len(at) else float(np.interp(raw, *self.curve))
        return min(1.0, max(0.0, s)), self.ids[at[:3]].tolist(), [round(float(x), 6) for x in cos[:3]]


def labelled_sample(labels: DataFrame, *, id_col: str, label_col: str, learn_from, examples: int) -> tuple[DataFrame, dict[int, float]]:
    """id, label of about `examples` rows of each label, chosen by a hash of the id;
    and how many rows one of each label stands for."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).filter(learn_from("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rates = {y: min(1.0, examples / n) for y, n in sizes.items()}
    keep = F.lit(False)
    for y, r in rates.items():
        keep = keep | ((F.col("label") == y) & (hash01(F.col("id"), F.lit(9)) < r))
    return known.filter(keep), {y: 1 / r for y, r in rates.items()}


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, learn_from, examples: int):
    """The vocabulary and the examples as (ids, labels, weights, (terms, counts))."""
    chosen, weight = labelled_sample(labels, id_col=id_col, label_col=label_col, learn_from=learn_from, examples=examples)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The sample is bounded by `examples` for each label, so it may be broadcast.
    texts = texts.join(F.broadcast(chosen), "id")
    # Copies of a text are one example: the label of most of them.
    texts = texts.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("same")).agg(F.min("id").alias("id"), F.first("text").alias("text"), F.round(F.avg("label")).cast("int").alias("label"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list({t for w in _counts(text) for t in _terms(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], ["term", "label"])

    texts = materialise(texts.select("id", "text", "label"))
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    seen = texts.select("text", "label").mapInArrow(explode, "term string, label int")
    df = seen.groupBy("term").agg(F.sum(F.col("label")).alias("b"), F.count("*").alias("df"))
    a, b = (F.col("df") - F.col("b")).cast("double"), F.col("b").cast("double")
    c, d = n0 - a, n1 - b
    total = float(n0 + n1)
    chi2 = total * (a * d - b * c) ** 2 / F.nullif((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0))
    best = df.withColumn("chi2", chi2).filter((F.col("df") >= LEAST_DF) & (F.col("chi2") >= CHI2)).orderBy("term")
    vocabulary = {r["term"]: i for i, r in enumerate(best.collect())}
    rows = texts.select("id", "text", "label").mapInArrow(vectoriser(vocabulary, "label int"), "id long, terms array<int>, counts array<int>, label int").orderBy("id").collect()
    return vocabulary, rows, weight


def vectoriser(vocabulary: dict[str, int], more: str = ""):
    """Batches (id, text, ...) -> (id, terms, counts, ...) over the vocabulary and the term of other words, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        other = (len(vocabulary),)
        for b in batches:
            terms, counts = [], []
            for text in b.column(1):
                own: Counter = Counter()
                for w, n in _counts(text.as_py()).items():
                    ids = memo.get(w)
                    if ids is None:
                        if len(memo) > 500_000:
                            memo.clear()
                        ids = memo[w] = tuple(vocabulary[t] for t in _terms(w) if t in vocabulary)
                    for i in ids or other:
                        own[i] += n
                terms.append(sorted(own))
                counts.append([own[i] for i in terms[-1]])
            cols = [b.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, ["id", "terms", "counts", *b.schema.names[2:]])

    return run


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    learn_from=lambda c: crc_mod(c, 3) != 1,
    threshold: float = 0.7,
    examples: int = EXAMPLES,
) -> DataFrame:
    """doc_id, score, predicted, evidence (ids of the nearest examples), closeness for every row of `docs`.

    The index holds a sample of about `examples` labelled rows of each label
    (bounded, chosen by a hash of the id, copies once) over all terms that go with
    the label among them; document frequencies cover all of `docs`. Scores are
    calibrated votes of the nearest examples by exact TF-IDF cosine. Texts without
    words, null and empty ones included, get the rate of label 1 among such
    examples. Without any labelled rows every score is 0.1. Repeated rows score alike; null ids stay.
    """
    vocabulary, rows, weight = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, learn_from=learn_from, examples=examples)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    vectors = materialise(texts.mapInArrow(vectoriser(vocabulary), f"id {kind}, terms array<int>, counts array<int>"))
    n = vectors.count()
    size = len(vocabulary) + 1
    df = np.zeros(size)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, "i8")
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["t", "n"])

    for r in vectors.select("terms").mapInArrow(frequencies, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        df[r["t"]] = r["n"]
    idf = np.where(df > 0, np.log((n + 1) / (df + 0.5)), 0.0)
    idf[-1] = OTHER
    index = Index([r["id"] for r in rows], [r["label"] for r in rows], [weight[r["label"]] for r in rows], [(r["terms"], r["counts"]) for r in rows], idf)
    index.calibrate()
    shared = share(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = value_of(shared), {}
        for b in batches:
            out = []
            for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                key = (tuple(t), tuple(c) if len(t) > 1 else ())  # one term: the same unit vector
                if key not in memo:
                    if len(memo) > 20_000:
                        memo.clear()
                    memo[key] = index.score(t, c)
                out.append(memo[key])
            cols = [b.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "score", "evidence", "closeness"])

    # Vectors are small on disk but not small to score: tasks are cut by rows.
    out = vectors.repartition(1 + n // TASK).mapInArrow(run, f"id {kind}, score double, evidence array<long>, closeness array<double>")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "closeness")
