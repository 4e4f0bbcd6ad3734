"""Cross-entropy difference of matched n-gram models over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small

#: Shares of the pair, word and even distributions in the mixed probability.
MIX = (0.7, 0.29, 0.01)
#: Words of a block; longer documents stand in several.
BLOCK = 500_000
#: Counts are summed in parts of about so many keys; parts are a power of two, PARTS at least.
PART, PARTS = 1_000_000, 64
#: Bytes of a key that are sent to its part, which tells its first bits.
KEY = 6
#: Tasks at most, however many parts or groups of blocks there are.
TASKS = 20_000
#: Characters of a text that are split into words at once.
SLICE = 1 << 22
#: What stands before the first and after the last word; no word has white space.
_EDGE = " "


def _loss(pair: np.ndarray, before: np.ndarray, word: np.ndarray, total: int, v: int) -> np.ndarray:
    """-log p(word | word before) from counts: relative frequencies of pairs, of words,
    and evenness, mixed. Over the vocabulary the probabilities after a word sum to 1."""
    single = word / total if total else np.full(len(word), 1.0 / v)
    seen = np.where(before > 0, pair / np.maximum(before, 1), single)
    return -np.log(MIX[0] * seen + MIX[1] * single + MIX[2] / v)


def words_of(text: str | None) -> Iterator[list[str]]:
    """Lower-cased runs between white space, of stretches cut at white space."""
    text, at = text or "", 0
    while at < len(text):
        to = at + SLICE
        while to < len(text) and not text[to].isspace():
            to += 1
        yield text[at:to].lower().split()
        at = to


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(place in its task, id, target, words, first, last) of each document, long ones in pieces
    that begin with the last word of the piece before."""
    place = 0
    for b in batches:
        for id_, text, target in zip(b.column(0), b.column(1), b.column(2)):
            place += 1
            held, first = [], True
            for words in words_of(text.as_py()):
                held += words
                while len(held) > BLOCK:
                    yield place, id_, target.as_py(), held[:BLOCK], first, False
                    held, first = held[BLOCK - 1 :], False
            yield place, id_, target.as_py(), held, first, True


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text, target) -> blocks: documents that follow each other, their words compressed."""
    import zstandard

    def packed(docs: list[tuple], words: list[str]) -> pa.RecordBatch:
        places, ids, targets, sizes, firsts, lasts = (list(c) for c in zip(*docs))
        cols = {
            "ids": pa.array([[x.as_py() for x in ids]], pa.list_(ids[0].type)),
            "places": pa.array([places], pa.list_(pa.int64())),
            "targets": pa.array([targets], pa.list_(pa.bool_())),
            "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "firsts": pa.array([firsts], pa.list_(pa.bool_())),
            "lasts": pa.array([lasts], pa.list_(pa.bool_())),
            "words": pa.array([zstandard.compress(" ".join(words).encode(), 6)], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    docs, words = [], []
    for place, id_, target, own, first, last in _pieces(batches):
        if docs and len(words) + len(own) > BLOCK:
            yield packed(docs, words)
            docs, words = [], []
        docs.append((place, id_, target, len(own), first, last))
        words += own
    if docs:
        yield packed(docs, words)


class Block:
    """Words and pairs of words of a block under sorted 64-bit keys.

    keys: the different ones. Each token (a word, or the end of a document) has its
    document `doc`, and where the pair that it ends, the word before, and itself
    stand in `keys`.
    """

    def __init__(self, words: bytes, sizes: np.ndarray, firsts: np.ndarray, lasts: np.ndarray):
        import xxhash
        import zstandard

        text = zstandard.decompress(words).decode()
        coded = pa.array(text.split(" ") if text else [], pa.string()).dictionary_encode()
        names = [_EDGE, *coded.dictionary.to_pylist()]
        with np.errstate(over="ignore"):
            h = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in names], "u8")
            codes = coded.indices.to_numpy(zero_copy_only=False).astype("i8") + 1
            firsts, lasts = firsts & (sizes > 0), lasts & (sizes > 0)
            # Each document's words between two edges; a piece in the middle has no edges, and its first word is only one before.
            doc = np.repeat(np.arange(len(sizes)), sizes + firsts + lasts)
            row = np.zeros(len(doc), "i8")
            starts = np.cumsum(sizes + firsts + lasts) - (sizes + firsts + lasts)
            inside = np.ones(len(doc), bool)
            inside[starts[firsts]] = False
            inside[(starts + sizes + firsts)[lasts]] = False
            row[inside] = codes
            token = np.ones(len(doc), bool)
            token[starts[sizes + firsts + lasts > 0]] = False
            at = np.flatnonzero(token)
            self.doc = doc[at]
            pairs, of_token = np.unique(row[at - 1] * len(names) + row[at], return_inverse=True)
            a, b = pairs // len(names), pairs % len(names)
            single = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            both = (h[a] * np.uint64(0xD6E8FEB86659FD93) ^ (h[b] >> np.uint64(31)) ^ (h[b] << np.uint64(33))) * np.uint64(0xBF58476D1CE4E5B9)
            both ^= both >> np.uint64(32)
            used = np.unique(np.concatenate([a, b]))
            keys, where = np.unique(np.concatenate([single[used], both]), return_inverse=True)
        self.keys = keys
        of_word = np.zeros(len(names), "i8")
        of_word[used] = where[: len(used)]
        self.is_word = np.zeros(len(keys), bool)
        self.is_word[of_word[used]] = True
        self.before, self.word, self.pair = of_word[row[at - 1]], of_word[row[at]], where[len(used) :][of_token]

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each key occurs in the tokens `of`."""
        return np.bincount(self.word[of], minlength=len(self.keys)) + np.bincount(self.pair[of], minlength=len(self.keys))


def _block(words, sizes, firsts, lasts) -> Block:
    return Block(words, np.asarray(sizes, "i8"), np.asarray(firsts, bool), np.asarray(lasts, bool))


def _small_ints(x: np.ndarray) -> bytes:
    """Non-negative integers in as many bytes as the largest needs, after a byte that says how many, compressed."""
    import zstandard

    wide = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * w) or w == 8)
    return zstandard.compress(bytes([wide]) + x.astype(f"<u{wide}").tobytes(), 3)


def _ints(x: bytes) -> np.ndarray:
    import zstandard

    x = zstandard.decompress(x)
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype("i8")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score for every row of `docs`.

    Losses are nats per token (a word, or a document's end) under bigram models of
    the target documents (those whose id is in `targets`) and of all documents, with
    the same vocabulary (all words of all documents and the edge), order and
    smoothing; score = background_loss - target_loss, higher for texts more like the
    targets. Words are lower-cased runs between white space. Null and empty texts
    have no words: losses null, score 0. Without target documents the target model
    is even. Repeated rows count and score as rows; repeated targets count once;
    null ids are no targets. An empty table gives an empty result; other columns
    are not read.

    Every word and pair is counted over all documents, in tables that grow with the
    input. So that they need not travel as rows, documents are written in blocks of
    at most BLOCK words; a block asks each part of the hashed keys, in one row, for
    all that it holds there, with its own counts. Parts sum these and answer in the
    same order, and answers meet their block. A frequent word is one key in each
    block, so no part is hot. Keys are 54 bits, and a bit more each time that the input
    doubles. Only totals come to the driver.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Counted, and broadcast if they are few: then texts don't shuffle.
    ids = materialise(targets.select(F.col(id_col).alias("t_id")).filter("t_id is not null").distinct())
    flagged = texts.join(small(ids), F.col("id") == F.col("t_id"), "left").select("id", "text", F.col("t_id").isNotNull().alias("target"))
    kind = texts.schema["id"].dataType.simpleString()
    made = f"ids array<{kind}>, places array<long>, targets array<boolean>, sizes array<int>, firsts array<boolean>, lasts array<boolean>, words binary"
    packed = flagged.mapInArrow(_packed, made).withColumn("task", F.spark_partition_id().cast("long"))
    # Numbers are drawn once, when the table is written.
    blocks = materialise(packed.withColumn("block", F.monotonically_increasing_id()))
    n_words = blocks.select(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))).first()[0]
    bits = PARTS.bit_length() - 1
    while n_words > PART << bits:
        bits += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sizes, firsts, lasts, flags, words in zip(*(c.to_pylist() for c in batch.columns)):
                own = _block(words, sizes, firsts, lasts)
                n, t = own.counts(np.arange(len(own.doc))), own.counts(np.flatnonzero(np.array(flags, bool)[own.doc]))
                part = (own.keys >> np.uint64(64 - bits)).astype("i8")
                parts, first = np.unique(part, return_index=True)
                cuts = [slice(a, e) for a, e in zip(first, [*first[1:], len(part)])]
                cols = (
                    pa.array(parts, pa.int64()),
                    pa.array(np.full(len(parts), number)),
                    pa.array([own.keys[c].view("u1").reshape(-1, 8)[:, :KEY].tobytes() for c in cuts], pa.binary()),
                    *(pa.array([_small_ints(x[c]) for c in cuts], pa.binary()) for x in (n, t, own.is_word)),
                )
                yield pa.RecordBatch.from_arrays(list(cols), ["part", "block", "key", "n", "t", "is_word"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums of a part's keys for each block; its first row has the part's own totals."""
        wide = [np.zeros((len(k) // KEY, 8), "u1") for k in pdf["key"]]
        for w, k in zip(wide, pdf["key"]):
            w[:, :KEY] = np.frombuffer(k, "u1").reshape(-1, KEY)
        cuts = np.cumsum([len(w) for w in wide])[:-1]
        keys, first, at = np.unique(np.concatenate(wide).view("<u8").ravel(), return_index=True, return_inverse=True)
        is_word = np.concatenate([_ints(x) for x in pdf["is_word"]])[first].astype(bool)
        sums = []
        for c in "nt":
            s = np.zeros(len(keys), "i8")
            np.add.at(s, at, np.concatenate([_ints(x) for x in pdf[c]]))
            sums.append(s)
        out = pdf[["part", "block"]].assign(words=0, total=0, targets=0)
        out.loc[out.index[0], ["words", "total", "targets"]] = [is_word.sum(), sums[0][is_word].sum(), sums[1][is_word].sum()]
        for c, s in zip("nt", sums):
            out[c] = [_small_ints(x) for x in np.split(s[at], cuts)]
        return out

    asked = blocks.select("block", "sizes", "firsts", "lasts", "targets", "words").mapInArrow(ask, "part long, block long, key binary, n binary, t binary, is_word binary")
    # Tasks grow in number with the input, not in size.
    asked = asked.repartition(min(1 << bits, TASKS), "part")
    answers = materialise(asked.groupBy("part").applyInPandas(answer, "part long, block long, words long, total long, targets long, n binary, t binary"))
    v, total, of_targets = (x or 0 for x in answers.agg(F.sum("words"), F.sum("total"), F.sum("targets")).first())

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, places, sizes, firsts, lasts = (left.column(c)[0].values for c in ("ids", "places", "sizes", "firsts", "lasts"))
        own = _block(left.column("words")[0].as_py(), *(x.to_numpy(zero_copy_only=False) for x in (sizes, firsts, lasts)))
        right = right.sort_by("part")
        n, t = (np.concatenate([np.empty(0, "i8"), *map(_ints, right.column(c).to_pylist())]) for c in "nt")
        if len(n) != len(own.keys):
            raise RuntimeError("a block has not got all its answers")
        losses = [np.bincount(own.doc, _loss(c[own.pair], c[own.before], c[own.word], s, v), len(sizes)).astype("f8") for c, s in ((t, of_targets), (n, total))]
        k = sizes.to_numpy().astype("i8") - 1 + firsts.to_numpy(zero_copy_only=False)
        task = pa.array(np.full(len(sizes), left.column("task")[0].as_py()))
        return pa.table({"id": ids, "task": task, "place": places, "k": k, "target": losses[0], "back": losses[1]})

    tasks = min(max(PARTS, n_words // (2 * BLOCK)), TASKS)
    left, right = blocks.repartition(tasks, "block"), answers.select("block", "part", "n", "t").repartition(tasks, "block")
    own = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(score, f"id {kind}, task long, place long, k long, target double, back double")
    # The pieces of a long document meet again.
    out = own.groupBy("task", "place").agg(F.first("id").alias("id"), *[F.sum(c).alias(c) for c in ("k", "target", "back")])
    loss = [F.when(F.col("k") > 0, F.col(c) / (F.col("k") + 1)).alias(f"{name}_loss") for c, name in (("target", "target"), ("back", "background"))]
    out = out.select(F.col("id").alias(id_col), F.col("k").alias("n_words"), *loss)
    return out.withColumn("score", F.coalesce(F.col("background_loss") - F.col("target_loss"), F.lit(0.0)))

