"""A search index over chunks, kept as Parquet tables, and searches that read only what their terms need.

    chunks     batch | no, document_id, chunk_index, chunk_id, content   numbered as they come
    postings   batch, bucket | word, base, at                            numbers of the chunks that hold a word
    forms      batch, bucket | word, raw                                 normalised words and the words they come from
    words      kind | size, word                                         distinct words

Words are of two kinds: `raw` ones are lower-cased stretches between white space, as
ILIKE sees them; `norm` ones are words of normalised text. Normalisation never joins what white space
parts, so the normalised words of a text are those of its raw words: chunks are listed by raw words alone, and only
distinct words are normalised. A list is one row for each 2^15 numbers, with two bytes a chunk. What a
term matches is found on distinct words, once, however many chunks hold them: they are few beside the text, so they are looked
through, by size where an edit or two are allowed. Buckets are folders, so a search opens those of
its own words; adding chunks appends files. Disk stays near that of the text: texts are stored once and never
dealt out, and lists are made by the task that reads the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.intent import Intent, global_terms, phrase_terms
from . import search as se

POSITION = ["document_id", "chunk_index", "chunk_id"]
#: Words that a search names in its filter; more are joined.
NAMED = 1000
#: Words up to which they are sent to every executor.
BROADCAST_WORDS = 200_000
#: Chunks up to which their bits are sent to every executor: 16 MB for each part of a query.
BROADCAST_CHUNKS = 1 << 27
#: A word's chunks with numbers that agree but for so many bits are one row.
SHIFT = 15
#: Words of texts that a task holds while it makes lists of them.
HELD = 1 << 22
#: Chunks in a file of chunks.
IN_FILE = 1 << 17


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), F.lit(buckets)).cast("int")


def _rows(columns: dict[str, pa.Array], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return (batch.slice(i, size) for i in range(0, batch.num_rows, size))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """raw: the words of the texts, each once for some millions of words."""
    held, n = [], 0

    def told() -> Iterator[pa.RecordBatch]:
        return _rows({"raw": pc.unique(pa.chunked_array(held, pa.string()))})

    for batch in batches:
        held.append(pc.unique(pc.list_flatten(pc.ascii_split_whitespace(batch["low"]))))
        n += len(held[-1])
        if n >= HELD // 4:
            yield from told()
            held, n = [], 0
    yield from told()


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, base, at: for the words of some millions the chunks that hold them, by `no`."""
    held, numbers, n = [], [], 0

    def told() -> Iterator[pa.RecordBatch]:
        if not n:
            return
        coded = pa.chunked_array(held, pa.string()).combine_chunks().dictionary_encode()
        code, no = coded.indices.to_numpy(), np.concatenate(numbers)
        order = np.argsort(code, kind="stable")
        code, no = code[order], no[order]
        # A chunk's words came together, so those that are equal are next to each other.
        first = np.append(True, (code[1:] != code[:-1]) | (no[1:] != no[:-1]))
        code, no = code[first], no[first]
        base = no >> SHIFT
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (base[1:] != base[:-1])))
        ends = pa.array(np.append(starts, len(no)).astype(np.int32))
        at = pa.ListArray.from_arrays(ends, pa.array((no & ((1 << SHIFT) - 1)).astype(np.int16)))
        yield from _rows({"word": coded.dictionary.take(pa.array(code[starts])), "base": pa.array(base[starts]), "at": at})

    for batch in batches:
        lists = pc.ascii_split_whitespace(batch["low"])
        words, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        some = pc.not_equal(words, "")
        held.append(words.filter(some))
        numbers.append(batch["no"].to_numpy()[of[some.to_numpy(zero_copy_only=False)]])
        n += len(held[-1])
        if n >= HELD:
            yield from told()
            held, numbers, n = [], [], 0
    yield from told()


class ChunkIndex:
    """An index in the folder `path`. `buckets` is fixed when it is made: about one for each
    hundred million postings, so that a folder's files stay of a size that a task reads well."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _append(self, df: DataFrame, name: str, folders: list[str], order: list[str]) -> None:
        # Rebalanced by folder: small folders get one file, a hot one is split; sorted, so that files' bounds tell words.
        dealt = df.hint("rebalance", *[F.col(c) for c in folders])
        dealt.sortWithinPartitions(*folders, *order).write.mode("append").option("compression", "zstd").partitionBy(*folders).parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        """`chunks` as they are searched: positions, content, norm, words; or `postings`: kind, word and
        positions, a row for each word of a chunk."""
        if name == "chunks":
            return se.prepared(self._read(name).select(*POSITION, "content"))
        held = self._read("postings").select("batch", "word", F.shiftleft("base", SHIFT).alias("no"), F.explode("at").alias("off")).select("batch", "word", (F.col("no") + F.col("off")).alias("no"))
        forms = self._read("forms").filter("word <> ''").select(F.col("word").alias("norm"), F.col("raw").alias("word")).distinct()
        norm = held.join(forms, "word").select(F.lit("norm").alias("kind"), F.col("norm").alias("word"), "batch", "no").distinct()
        both = held.select(F.lit("raw").alias("kind"), "word", "batch", "no").unionByName(norm)
        return both.join(self._read("chunks").select("batch", "no", *POSITION), ["batch", "no"]).select("kind", "word", *POSITION)

    def count(self) -> int:
        return self._read("chunks").count()

    def words(self, kind: str) -> DataFrame:
        """size, word: the distinct words of a kind; those of several batches are repeated."""
        return self._read("words").filter(F.col("kind") == kind)

    def add(self, chunks: DataFrame) -> ChunkIndex:
        """Append chunks (document_id, chunk_index, chunk_id, content), which the index doesn't hold yet.

        Null contents have no words. A word that is known already is listed again: lookups are distinct.
        """
        batch = f"b{uuid4().hex}"
        numbered = chunks.select(F.monotonically_increasing_id().alias("no"), *POSITION, "content")
        # Written as they lie, without a sort or shuffle of texts; small files, so that many tasks read what one wrote.
        numbered.write.option("compression", "zstd").option("maxRecordsPerFile", IN_FILE).parquet(f"{self.path}/chunks/batch={batch}")
        low = self._read("chunks").filter(F.col("batch") == batch).select("no", F.lower("content").alias("low")).filter("low IS NOT NULL")
        raw = low.select("low").mapInArrow(_distinct_words, "raw string").filter("raw <> ''").distinct()
        own = tx.once(raw, own=tx.tokens(tx.norm(F.col("raw"))))
        # Words without letters or digits come from no normalised word, but are raw ones.
        forms = own.select("raw", F.explode(F.when(F.size("own") > 0, F.array_distinct("own")).otherwise(F.array(F.lit("")))).alias("word"))
        self._append(forms.withColumns({"batch": F.lit(batch), "bucket": _bucket(F.col("word"), self.buckets)}), "forms", ["batch", "bucket"], ["word", "raw"])
        forms = self._read("forms").filter(F.col("batch") == batch)
        for kind, words in (("norm", forms.filter("word <> ''").select("word")), ("raw", forms.select(F.col("raw").alias("word")))):
            sized = words.distinct().select(F.lit(kind).alias("kind"), F.length("word").alias("size"), "word")
            self._append(sized, "words", ["kind"], ["size", "word"])
        lists = low.mapInArrow(_word_lists, "word string, base long, at array<smallint>")
        self._append(lists.withColumns({"batch": F.lit(batch), "bucket": _bucket(F.col("word"), self.buckets)}), "postings", ["batch", "bucket"], ["word", "base"])
        return self

    def _among(self, name: str, column: str, words: DataFrame) -> DataFrame:
        """Rows of a table with buckets whose `column` is one of `words`. A few words are named in the filter, so
        folders and files are pruned by literals; many are joined by folder and word."""
        named = [r["word"] for r in words.limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            buckets = sorted({crc32(w.encode()) % self.buckets for w in named})
            return self._read(name).filter(F.col("bucket").isin(buckets) & F.col(column).isin(named))
        keys = words.select(F.col("word").alias(column), _bucket(F.col("word"), self.buckets).alias("bucket"))
        if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
            keys = F.broadcast(keys)
        return self._read(name).join(keys, ["bucket", column], "left_semi")

    def words_with(self, kind: str, part: str) -> DataFrame:
        """word: the distinct words of a kind that hold `part`."""
        return self.words(kind).filter(F.col("word").contains(part)).select("word").distinct()

    def words_near(self, term: str) -> DataFrame:
        """word: normalised words of five characters or more within an edit of `term`, two for terms of nine."""
        edits = 2 if len(term) >= 9 else 1
        sized = self.words("norm").filter(F.col("size").between(max(5, len(term) - edits), len(term) + edits))
        return sized.filter(F.levenshtein("word", F.lit(term), edits) >= 0).select("word").distinct()

    def words_partly(self, term: str) -> DataFrame:
        """word: normalised words that `partial_match` takes for `term`."""
        return self.words("norm").filter(tx.partial_match(F.array("word"), term)).select("word").distinct()

    def rows_of(self, kind: str, words: DataFrame) -> DataFrame:
        """word, batch, base, at: the lists of chunks that hold one of `words`, by raw words."""
        if kind == "norm":
            words = self._among("forms", "word", words).select(F.col("raw").alias("word")).distinct()
        return self._among("postings", "word", words).select("word", "batch", "base", "at")

    def _held(self, parts: list[DataFrame]) -> DataFrame:
        """Stored chunks that lists of one of `parts` name, with held: for each part whether its lists do, 1 or 0.

        Lists become bits, 4 KB for each 2^15 numbers and part, which meet the chunks where they lie: texts are not dealt out."""
        rows = reduce(DataFrame.unionByName, [p.select("batch", "base", "at", F.lit(k).alias("part")) for k, p in enumerate(parts)])
        one = rows.select("batch", "base", "part", F.explode(F.col("at").cast("array<int>")).alias("off"))
        bits = [F.bit_or(F.when(F.col("part") == k, F.expr("shiftleft(1L, off & 63)")).otherwise(F.lit(0).cast("long"))) for k in range(len(parts))]
        cells = one.groupBy("batch", "base", F.shiftright("off", 6).alias("cell")).agg(F.array(*bits).alias("bits"))
        found = cells.groupBy("batch", "base").agg(F.map_from_entries(F.collect_list(F.struct("cell", "bits"))).alias("cells"))
        found = found.select("batch", "base", F.transform(F.sequence(F.lit(0), F.lit((1 << SHIFT - 6) - 1)), lambda i: F.try_element_at("cells", i)).alias("cells"))
        if self.count() <= BROADCAST_CHUNKS:
            found = F.broadcast(found)
        off = F.col("no").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int")
        stored = self._read("chunks").withColumns({"base": F.shiftright("no", SHIFT), "off": off}).join(found, ["batch", "base"])
        named = F.transform(F.get("cells", F.shiftright("off", 6)), lambda x: F.getbit(x, F.col("off").bitwiseAND(F.lit(63))))
        return tx.once(stored.drop("base"), held=named).drop("cells", "off").filter(F.exists("held", lambda x: x == 1))

    def _hits(self, parts: list[str]) -> DataFrame:
        """Stored chunks with the number of `parts` that lie in one of their words."""
        found = self._held([self.rows_of("raw", self.words_with("raw", p.lower())) for p in parts])
        return found.withColumn("score", F.aggregate("held", F.lit(0.0), lambda s, x: s + x)).drop("held")

    def global_search(self, query: str, limit: int = 20) -> DataFrame:
        """What `search.global_search` finds. Scores come from postings alone; contents are read for the
        chunks that are told. Terms with the wildcards % and _ may span words: they scan the chunks."""
        parts = global_terms(query)
        if any(c in p for p in parts for c in "%_\\"):
            return se.global_search(self._read("chunks"), query, limit).select(*POSITION, "content", "score")
        if not parts:
            return self._read("chunks").limit(0).select(*POSITION, "content", F.lit(0.0).alias("score"))
        order = [F.desc("score"), *POSITION]
        best = self._hits(parts).select("batch", "no", *POSITION, "score").orderBy(*order).limit(min(limit, 100)).select("batch", "no", "score").collect()
        scores = self.spark.createDataFrame(best, "batch string, no long, score double")
        told = self._read("chunks").filter(F.col("batch").isin([r["batch"] for r in best]) & F.col("no").isin([r["no"] for r in best]))
        return told.join(F.broadcast(scores), ["batch", "no"]).select(*POSITION, "content", "score").orderBy(*order)

    def phrase_matches(self, query: str) -> DataFrame:
        """Positions of chunks that hold the phrase or one of its words, in any case. What holds
        the phrase holds its words, so these are looked up."""
        parts = phrase_terms(query)
        words = [p for p in parts if not any(c.isspace() for c in p)]
        if any(c in p for p in parts for c in "%_\\"):
            return self._read("chunks").filter(tx.any_of([F.col("content").ilike(f"%{p}%") for p in parts])).select(*POSITION)
        return self._hits(words).select(*POSITION) if words else self._read("chunks").limit(0).select(*POSITION)

    def _candidates(self, i: Intent, partly: bool) -> DataFrame:
        """The stored chunks that a term of the intent can match at all."""
        words = [self.words_with("norm", t) for t in i.terms]
        if len(i.terms[0]) >= 5:
            words.append(self.words_near(i.terms[0]))
            if partly:
                words.append(self.words_partly(i.terms[0]))
        return self._held([self.rows_of("norm", reduce(DataFrame.unionByName, words).distinct())])

    def _scored(self, i: Intent, score: Column, partly: bool) -> DataFrame:
        if not i.terms:
            return self._read("chunks").limit(0).select(*POSITION, "content", F.lit(0.0).alias("score"))
        found = se.prepared(self._candidates(i, partly).select(*POSITION, "content"))
        return tx.once(found, score=score).filter("score > 0").select(*POSITION, "content", "score")

    def keyword_scores(self, i: Intent) -> DataFrame:
        """Chunks with a keyword score above zero: only those that hold a word which a term
        equals, lies in, or nearly equals are normalised and scored."""
        return self._scored(i, se.keyword_score(i), False)

    def relaxed_scores(self, i: Intent) -> DataFrame:
        return self._scored(i, se.relaxed_score(i), True)


class _Counter:
    """Counts, for all of a block's `n` chunks at once, how many of some words each holds.

    A word is a row of one bit a chunk; rows are added as bits of counters (sums and carries of threes
    of rows at a time), so 64 chunks cost one operation and no list of a frequent word is walked again.
    """

    def __init__(self, n: int, lists: np.ndarray, ends: np.ndarray, most: float):
        """lists: chunks by word, from ends[w] to ends[w + 1]; rows of words in more than `most` are kept."""
        self.lists, self.ends, self.often = lists, ends, np.diff(ends) > most
        self.size = (n + 63) >> 6
        self.place, self.kept = {}, np.zeros((16, self.size), np.uint64)
        self.rooms: list[np.ndarray] = []
        self.held, self.next = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)

    def _set(self, row: np.ndarray, w: int) -> None:
        one = self.lists[self.ends[w] : self.ends[w + 1]]
        np.add.at(row, one >> 6, np.left_shift(np.uint64(1), (one & 63).astype(np.uint64)))  # a chunk's bit comes once

    def _keep(self, w: int) -> int:
        if w not in self.place:
            if len(self.place) == len(self.kept):
                self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
            self.place[w] = len(self.place)
            self._set(self.kept[self.place[w]], w)
        return self.place[w]

    def _room(self, level: int, rows: int) -> np.ndarray:
        """Space of `rows` or more for a level's rows; what a question before left in it goes."""
        while level >= len(self.rooms):
            self.rooms.append(np.empty((0, self.size), np.uint64))
        if len(self.rooms[level]) < rows:
            self.rooms[level] = np.empty((rows, self.size), np.uint64)
        return self.rooms[level]

    def _sums(self, words: np.ndarray) -> list[np.ndarray]:
        """The counters' bits, low ones first."""
        often = [self._keep(w) for w in words[self.often[words]].tolist()]
        rows, n = self._room(0, len(words)), len(words)
        np.take(self.kept, often, axis=0, out=rows[: len(often)], mode="clip")
        rows[len(often) : n] = 0
        for i, w in enumerate(words[~self.often[words]].tolist(), len(often)):
            self._set(rows[i], w)
        planes, level = [], 0
        while n:
            carried, more = 0, self._room(level + 1, n)
            while n > 1:
                t, left = (n // 3, n % 3) if n > 2 else (1, 0)
                a, b, carry = rows[:t], rows[t : 2 * t], more[carried : carried + t]
                np.bitwise_and(a, b, out=carry)
                np.bitwise_xor(a, b, out=a)
                if n > 2:
                    c = rows[2 * t : 3 * t]
                    np.bitwise_and(a, c, out=b)
                    np.bitwise_or(carry, b, out=carry)
                    np.bitwise_xor(a, c, out=a)
                    rows[t : t + left] = rows[3 * t : n]
                carried, n = carried + t, t + left
            planes.append(rows[0])
            rows, n, level = more, carried, level + 1
        return planes

    def best(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `k` chunks with most of the words, one at least, and how many each holds."""
        tops, scores, lacking, bound = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], k, 0
        planes, held = self._sums(words), None
        for level in range(len(planes) - 1, -1, -1):
            some = planes[level] if held is None else np.bitwise_and(planes[level], held, out=self.next)
            if some.any():
                bound |= 1 << level
                held = self.held if held is None else held
                held[:] = some
        without: dict[int, np.ndarray] = {}
        while bound and lacking:
            cells = np.flatnonzero(held)[:lacking]
            if len(cells):
                bits = np.flatnonzero(np.unpackbits(held[cells].astype("<u8").view(np.uint8), bitorder="little"))[:lacking]
                tops.append(cells[bits >> 6] * 64 + (bits & 63))
                scores.append(np.full(len(bits), bound))
                lacking -= len(bits)
            bound -= 1
            if bound and lacking:
                held[:] = planes[bound.bit_length() - 1]
                for level, plane in enumerate(planes):
                    if bound >> level & 1:
                        np.bitwise_and(held, plane, out=held)
                    else:
                        if level not in without:
                            without[level] = np.bitwise_not(plane)
                        np.bitwise_and(held, without[level], out=held)
        return np.concatenate(tops), np.concatenate(scores)


def batch_search(questions: DataFrame, postings: DataFrame, chunks: DataFrame, k: int = 5, *, share: float = 0.0005, least: int = 128, block: int = 1 << 18, asked: int = 200_000, n: int | None = None) -> DataFrame:
    """question, rank, document_id, chunk_index, chunk_id, score: for each of many questions the `k` chunks
    that hold most of its terms as words; ties by position.

    questions: question, terms (distinct words; other columns are ignored, equal questions are
    all answered); postings: word, of which only those that are asked for and held are looked for;
    chunks: positions and `words`.

    Chunks are dealt to blocks of about `block`, questions to parts of about `asked`; each part meets each
    block in a task that counts terms for 64 chunks at a time (`_Counter`) and keeps k chunks a question. So only
    these leave a task, never a row for each question and chunk that share a word; every chunk is
    counted, and the result is exact. The bits of words in more than `share` of a block's chunks (and in more than
    `least`) are kept for all questions. `n` is the number of chunks, if it is known. Words are told apart by 64-bit hashes. Questions without terms have no rows.
    """
    qt = questions.select("question", F.explode(F.array_distinct("terms")).alias("word")).distinct()
    held = postings.join(qt.select("word").distinct(), "word", "left_semi").select("word").distinct()
    own = qt.join(held, "word", "left_semi").groupBy("question").agg(F.collect_set(F.xxhash64("word")).alias("terms"))
    # At least eight blocks, so that little input keeps several tasks busy; many are made to fill the cores each time.
    blocks, cores = max(8, -(-(chunks.count() if n is None else n) // block)), chunks.sparkSession.sparkContext.defaultParallelism
    blocks = -(-blocks // cores) * cores if blocks > cores else blocks
    parts = max(1, -(-questions.count() // asked))
    fields = chunks.select(*POSITION).schema.fields
    at = F.pmod(F.xxhash64(*POSITION), F.lit(blocks)).cast("int").alias("block")
    rows = chunks.select(at, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *POSITION, F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)).alias("words")).filter(F.size("words") > 0)
    part = F.pmod(F.xxhash64("question"), F.lit(parts)).cast("int").alias("part")
    sent = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part, "question", "terms")
    kind = own.schema["question"].dataType.simpleString()
    schema = ", ".join([f"question {kind}", *(f"{f.name} {f.dataType.simpleString()}" for f in fields), "score long"])
    position = list(POSITION)

    def best_of(own_chunks: pd.DataFrame, own_questions: pd.DataFrame) -> pd.DataFrame:
        found = own_chunks.sort_values(position, ignore_index=True)
        n, ids, places, scores = len(found), [], [], []
        if n and len(own_questions):
            words = np.concatenate(found["words"].to_numpy())
            lists = np.repeat(np.arange(n, dtype=np.int32), found["words"].map(len).to_numpy())
            order = np.argsort(words, kind="stable")
            words = words[order]
            starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            keys = words[starts]
            counter = _Counter(n, lists[order], np.append(starts, len(words)), max(n * share, least))
            for question, terms in zip(own_questions["question"], own_questions["terms"]):
                at_ = np.minimum(np.searchsorted(keys, terms), len(keys) - 1)
                top, score = counter.best(at_[keys[at_] == terms], k)
                ids += [question] * len(top)
                places.append(top)
                scores.append(score)
        out = found.loc[np.concatenate(places) if places else [], position].reset_index(drop=True)
        out.insert(0, "question", pd.Series(ids, dtype=own_questions["question"].dtype))
        out["score"] = np.concatenate(scores).astype(np.int64) if scores else np.zeros(0, np.int64)
        return out

    # Each part and block is a task of its own: by their hashes several would meet in one, and others be idle.
    task, tasks = (F.col("block") * parts + F.col("part")).cast("int").alias("task"), blocks * parts
    own_rows, own_sent = rows.select(task, *POSITION, "words").repartitionById(tasks, F.col("task")), sent.select(task, "question", "terms").repartitionById(tasks, F.col("task"))
    best = own_rows.groupBy("task").cogroup(own_sent.groupBy("task")).applyInPandas(best_of, schema)
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), *POSITION))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("question", "rank", *POSITION, "score")
