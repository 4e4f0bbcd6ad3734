"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash01, materialise, share, value_of

#: About so many training documents of each language at most, chosen by a hash of the id.
PER_LANGUAGE = 400
#: Words of up to so many characters (with their mark) are segmented side by side, longer ones one by one.
WORD = 64
EM_STEPS = 4
#: Added to each piece's expected count; share of probability for any other character.
PSEUDO, OTHER = 0.05, 1e-5
#: Probabilities of pieces of n characters are kept times SCALE^n: the same for all
#: languages, so it cancels, and products stay in range.
SCALE = 16.0
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The fixed vocabulary as a hash table from code points to piece numbers. Beginnings
    of pieces are in it too, so that a search ends where no piece goes on."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.number = {p: n for n, p in enumerate(pieces)}
        self.begins = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(self.begins)) * 8))))
        self.keys, self.ids = np.zeros(1 << self.bits, "u8"), np.full(1 << self.bits, -2, "i4")  # -2: free, -1: a beginning
        for p in self.begins:
            h = np.uint64(0)
            for c in p:
                h = self.grow(h, np.uint64(ord(c)))
            s = int(self.slot(h))
            while self.ids[s] > -2:
                s = (s + 1) % len(self.ids)
            self.keys[s], self.ids[s] = h, self.number.get(p, -1)

    @staticmethod
    def grow(h, code):
        with np.errstate(over="ignore"):
            return (h ^ (code + np.uint64(1))) * _MUL + np.uint64(0x632BE59BD9B4E019)

    def slot(self, h):
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(31))) * _MUL) >> np.uint64(64 - self.bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; -1 for what only begins one, -2 for others."""
        s = self.slot(h).astype("i8")
        out = np.where(self.keys[s] == h, self.ids[s], -2)
        open_ = np.flatnonzero((out == -2) & (self.ids[s] > -2))
        while len(open_):
            s[open_] = (s[open_] + 1) % len(self.ids)
            t = s[open_]
            hit = (self.keys[t] == h[open_]) & (self.ids[t] > -2)
            out[open_[hit]] = self.ids[t[hit]]
            open_ = open_[~hit & (self.ids[t] > -2)]
        return out

    def found(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, rows, numbers) of the pieces in a matrix of words of one length;
        number len(pieces) stands for any other single character."""
        out = []
        for i in range(codes.shape[1]):
            rows, h = np.arange(len(codes)), np.zeros(len(codes), "u8")
            for n in range(1, codes.shape[1] - i + 1):
                h = self.grow(h, codes[rows, i + n - 1])
                ids = self.find(h)
                hit = np.flatnonzero(ids >= 0)
                if n == 1:
                    out.append((i, n, rows, np.where(ids < 0, len(self.pieces), ids)))
                elif len(hit):
                    out.append((i, n, rows[hit], ids[hit]))
                on = ids > -2
                rows, h = rows[on], h[on]
                if not len(rows):
                    break
        return out

    def found_in(self, word: str) -> list[list[tuple[int, int]]]:
        """For each place of a word, (length, number) of the pieces that begin there."""
        out = []
        for i in range(len(word)):
            own, n = [(1, self.number.get(word[i], len(self.pieces)))], 1
            while i + n <= len(word) and word[i : i + n] in self.begins:
                if n > 1 and word[i : i + n] in self.number:
                    own.append((n, self.number[word[i : i + n]]))
                n += 1
            out.append(own)
        return out


def by_length(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """(owner, code points) for each length of the words with a word mark in front; and the long ones."""
    lens = np.fromiter((len(w) + 1 for w in words), "i8", len(words))
    order = np.argsort(lens, kind="stable")
    order, rest = order[lens[order] <= WORD], order[lens[order] > WORD]
    codes = np.frombuffer("".join("▁" + words[i] for i in order).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    out, at = [], 0
    sizes, first = np.unique(lens[order], return_index=True)
    for n, rows in zip(sizes.tolist(), np.split(order, first[1:])):
        out.append((rows, codes[at : at + n * len(rows)].reshape(-1, n)))
        at += n * len(rows)
    return out, rest.tolist()


def _forward(found, length: int, p: np.ndarray, rows: int) -> np.ndarray:
    """alpha[j]: the sum over all segmentations of the first j characters."""
    alpha = np.zeros((length + 1, rows, p.shape[1]))
    alpha[0] = 1.0
    for i, n, hit, ids in found:
        alpha[i + n][hit] += alpha[i][hit] * p[ids]
    return alpha


def _log_forward(found: list[list[tuple[int, int]]], log_p: np.ndarray) -> Iterator[np.ndarray]:
    """The logarithm of alpha[j] for each j in turn; only what pieces still reach is held."""
    held: dict[int, np.ndarray] = {0: np.zeros(log_p.shape[1])}
    for i, own in enumerate(found):
        alpha = held.pop(i)
        yield alpha
        for n, k in own:
            x = alpha + log_p[k]
            held[i + n] = np.logaddexp(held[i + n], x) if i + n in held else x
    yield held[len(found)]


def log_likelihoods(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """(words, languages): the logarithm of each word's probability, up to what all languages share."""
    out = np.zeros((len(words), p.shape[1]))
    groups, long = by_length(words)
    for owner, codes in groups:
        for a in range(0, len(owner), 20_000):
            c = codes[a : a + 20_000]
            alpha = _forward(pieces.found(c), c.shape[1], p, len(c))
            out[owner[a : a + 20_000]] = np.log(np.maximum(alpha[-1], 1e-300))
    if long:
        log_p = np.log(p)
        for i in long:
            for alpha in _log_forward(pieces.found_in("▁" + words[i]), log_p):
                out[i] = alpha
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, `counts` times each, by the posterior of all segmentations."""
    total = np.zeros_like(p)
    groups, long = by_length(words)
    for owner, codes in groups:
        for a in range(0, len(owner), 10_000):
            c, n = codes[a : a + 10_000], codes.shape[1]
            found = pieces.found(c)
            alpha = _forward(found, n, p, len(c))
            beta = np.zeros_like(alpha)
            beta[n] = counts[owner[a : a + 10_000]] / np.maximum(alpha[n], 1e-300)
            for i, m, hit, ids in reversed(found):
                own = p[ids] * beta[i + m][hit]
                beta[i][hit] += own
                weight = alpha[i][hit] * own
                for k in range(p.shape[1]):
                    total[:, k] += np.bincount(ids, weight[:, k], len(p))
    log_p = np.log(p) if long else p
    for w in long:
        found = pieces.found_in("▁" + words[w])
        alpha = list(_log_forward(found, log_p))
        beta = [np.zeros(p.shape[1])] * len(alpha)
        for i in range(len(found) - 1, -1, -1):
            own = np.array([log_p[k] + beta[i + n] for n, k in found[i]])
            beta[i] = np.logaddexp.reduce(own)
            for (_, k), x in zip(found[i], own):
                total[k] += counts[w] * np.exp(alpha[i] + x - alpha[-1])
    return total


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without controls and bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def _normalised(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    p = counts + PSEUDO
    p[-1] = 0
    p = (1 - OTHER) * p / p.sum(0)
    p[-1] = OTHER
    return p * (SCALE ** sizes)[:, None]


def train(docs: DataFrame, pieces: Pieces, *, id_col: str, text_col: str, lang_col: str, learn_from, per_language: int):
    """(languages, log priors, piece probabilities) by expectation maximisation.

    A sample of about `per_language` documents of each language (bounded; chosen by
    a hash) gives distinct words with their counts. Each step's expected counts
    are summed by Spark; only sums per piece and language come to the driver.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(F.coalesce(learn_from("id"), F.lit(True)))
    sizes = sorted((r["lang"], r["count"]) for r in known.select("lang").groupBy("lang").count().collect())
    langs = [x[0] for x in sizes]
    if not langs:
        return [], np.zeros(0), np.zeros((len(pieces.pieces) + 1, 0))
    keep = F.lit(False)
    for lang, n in sizes:
        keep = keep | ((F.col("lang") == lang) & (hash01(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(5)) < per_language / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter((lang, w) for lang, t in zip(*(c.to_pylist() for c in b.columns)) for w in t.split())
            cols = [list(c) for c in zip(*n)] or [[], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    words = known.filter(keep).select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    words = words.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("double").alias(f"n{i}") for i, x in enumerate(langs)])
    words = materialise(words.select("word", F.array(*[f"n{i}" for i in range(len(langs))]).alias("n")))
    lengths = np.array([*map(len, pieces.pieces), 1])
    # The same start for all languages; the first step tells them apart.
    p = _normalised(np.ones((len(lengths), len(langs))), lengths)
    spark = docs.sparkSession
    for _ in range(EM_STEPS):
        shared = share(spark, (pieces, p))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, p = value_of(shared)
            total = np.zeros_like(p)
            for b in batches:
                total += expected_counts(b.column(0).to_pylist(), np.array(b.column(1).to_pylist()), pieces, p)
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["piece", "n"])

        sums = words.mapInArrow(step, "piece long, n array<double>").groupBy("piece").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(len(langs))])
        counts = np.zeros_like(p)
        for r in sums.collect():
            counts[r["piece"]] = r[1:]
        # Sums of doubles may differ in their last bits between runs; these don't.
        p = _normalised(np.round(counts, 6), lengths)
    prior = np.log(np.array([x[1] for x in sizes], float) / sum(x[1] for x in sizes))
    return langs, prior, p


def identify_language(
    docs: DataFrame,
    vocabulary_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    learn_from=lambda c: crc_mod(c, 5) != 0,
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs`.

    A text's probability in a language is the product over its words of the sum
    over all segmentations of the product of piece probabilities; score is the
    posterior of the best language (ties: the first by code point). A null text
    or one without a letter is `und` with score 0, as is any where no language
    could be learned. Whole texts count; repeated rows are predicted alike.
    Training reads text and language of the rows that `learn_from` chooses. All
    pieces and whole words take part, however long. An empty table gives an empty
    result; null ids stay; other columns are not read.
    """
    pieces = Pieces(vocabulary(vocabulary_path))
    langs, prior, p = train(docs, pieces, id_col=id_col, text_col=text_col, lang_col=lang_col, learn_from=learn_from, per_language=per_language)
    shared = share(docs.sparkSession, (pieces, p, prior, langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, p, prior, langs = value_of(shared)
        for b in batches:
            best: list[str] = []
            score: list[float] = []
            for a in range(0, b.num_rows, 1500):
                number: dict[str, int] = {}
                texts = [t or "" for t in b.column(1).slice(a, 1500).to_pylist()]
                own = [np.array([number.setdefault(w, len(number)) for w in t.split()], "i8") for t in texts]
                ll = log_likelihoods(list(number), pieces, p) if langs else np.zeros((len(number), 0))
                for t, at in zip(texts, own):
                    if not langs or not any(map(str.isalpha, t)):
                        best.append("und")
                        score.append(0.0)
                        continue
                    total = np.bincount(at, minlength=1).astype(float)
                    some = np.flatnonzero(total)
                    x = prior + total[some] @ ll[some]
                    i = int(np.argmax(x))
                    best.append(langs[i])
                    score.append(float(1 / np.exp(x - x[i]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
