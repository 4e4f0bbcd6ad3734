"""Alignment of the tokens of two tokenizers by a sweep over their end positions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, share, value_of

#: Bytes of text whose end events travel in one row, for each side.
WINDOW = 1 << 16
#: Events that are swept at once.
SWEEP = 1 << 20
#: Links of the documents of one block.
BLOCK = 2_000_000
#: Remembered pieces per worker; the memo is emptied when it is full.
MEMO = 400_000
#: Pairs of ids up to which their counts are sent to every executor (12 bytes each).
PAIRS = 2_000_000
#: A pair of ids as one key: a * STEP + b.
STEP = 1 << 17


def _planes(x: np.ndarray) -> bytes:
    """Integers below 2^32: how many bytes they need, their first bytes together, then their second ones, compressed."""
    import zstandard

    wide = next(w for w in (1, 2, 4) if int(x.max(initial=0)) < 1 << (8 * w) or w == 4)
    x = x.astype(f"<u{wide}")
    return bytes([wide]) + zstandard.compress((x if wide == 1 else np.ascontiguousarray(x.view("u1").reshape(-1, wide).T)).tobytes(), 1)


def _plain(x: bytes) -> np.ndarray:
    import zstandard

    wide, x = x[0], np.frombuffer(zstandard.decompress(x[1:]), "u1")
    return (x if wide == 1 else np.ascontiguousarray(x.reshape(wide, -1).T).view(f"<u{wide}").ravel()).astype("i8")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level tokenizers: visible bytes stand for themselves,
    the others, in order, for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Two tokenizers, and what their tokens are in bytes.

    Texts are cut at single spaces between visible characters. A always starts a word
    there; B never joins across, as none of its pieces holds a space after something
    else (checked). So pieces encode alike alone and in place, and are remembered.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x([0-9A-F]{2})>", n)) else n.replace("▁", " ").encode() for n in names]
        self.cut = not any(re.search("[^▁]▁", n) for n in names)
        self._empty()

    def _empty(self) -> None:
        #: Piece -> its number; ids and byte ends by number; whether both give back the piece.
        self.memo: dict[str, int] = {}
        self.ids, self.ends, self.first, self.size = ([np.empty(0, "i8"), np.empty(0, "i8")] for _ in range(4))
        self.good, self.length = np.empty(0, bool), np.empty(0, "i8")

    def pieces(self, text: str) -> list[str]:
        """" " + text, cut before single spaces that have visible neighbours."""
        parts = text.split(" ")
        if not self.cut:
            return [" " + text]
        if all(parts) and list(map(str.strip, parts)) == parts:
            return [" " + p for p in parts]
        out, open_ = [" " + parts[0]], bool(parts[0]) and not parts[0][-1].isspace()
        for p in parts[1:]:
            if open_ and p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
            open_ = bool(p) and not p[-1].isspace()
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces; B adds the space that each begins with."""
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)  # without offsets
        sides = [[e.ids for e in encode(pieces, add_special_tokens=False)], self.b.encode([p[1:] for p in pieces], num_threads=1)]
        raw = [p.encode() for p in pieces]
        length = np.fromiter(map(len, raw), "i8", len(raw))
        good = np.ones(len(pieces), bool)
        for side, (ids, table) in enumerate(zip(sides, (self.a_bytes, self.b_bytes))):
            flat = list(chain.from_iterable(ids))
            parts = list(map(table.__getitem__, flat))
            flat, long = np.array(flat, "i8"), np.fromiter(map(len, parts), "i8", len(parts))
            size = np.fromiter(map(len, ids), "i8", len(ids))
            total = np.concatenate([[0], np.cumsum(long)])
            starts = np.cumsum(size) - size
            # All at once; one by one only where something differs.
            if b"".join(parts) != b"".join(raw) or (total[starts + size] - total[starts] != length).any():
                good &= [b"".join(map(table.__getitem__, own)) == whole for own, whole in zip(ids, raw)]
            ends = total[1:] - np.repeat(total[starts], size)
            self.first[side] = np.concatenate([self.first[side], starts + len(self.ids[side])])
            self.size[side] = np.concatenate([self.size[side], size])
            self.ids[side], self.ends[side] = np.concatenate([self.ids[side], flat]), np.concatenate([self.ends[side], ends])
        self.memo.update(zip(pieces, range(len(self.good), len(self.good) + len(pieces))))
        self.good, self.length = np.concatenate([self.good, good]), np.concatenate([self.length, length])

    def encode(self, texts: list[str]) -> list[list[tuple[np.ndarray, np.ndarray]] | None]:
        """For each text its (ends, ids) by A and by B; None if a side's bytes are not the text's."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self._empty()
        new = list(set().union(*cut).difference(self.memo))
        for i in range(0, len(new), 50_000):
            self.learn(new[i : i + 50_000])
        get, out = self.memo.__getitem__, []
        for ps in cut:
            at = np.fromiter(map(get, ps), "i8", len(ps))
            if not len(at) or not self.good[at].all():
                out.append(None)
                continue
            base = np.cumsum(self.length[at]) - self.length[at]
            sides = []
            for side in (0, 1):
                n = self.size[side][at]
                where = np.repeat(self.first[side][at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                sides.append((self.ends[side][where] + np.repeat(base, n), self.ids[side][where]))
            out.append(sides)
        return out


class Sweep:
    """Reads end events of documents in order of position and tells groups and links.

    Positions run on from document to document, and a document's end ends a token on
    either side, so many are swept at once. What is kept between calls is the open group
    (tokens after the last common end) and the document that goes on.
    """

    def __init__(self, names: list[bytes]):
        self.names = names
        self.open = [(np.empty(0, "i8"), np.empty(0, "i8")) for _ in range(2)]
        self.docs: list[dict] = []  # the documents that are not handed out, by start
        self.at = 0

    def begin(self, id_, length: int) -> None:
        self.docs.append({"id": id_, "end": self.at + length, "from": self.at, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": None, "keys": [], "held": 0})
        self.at += length

    def sweep(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Take the next ends and ids of A and of B; positions are absolute."""
        (ea, ia), (eb, ib) = ((np.concatenate([o[0], e]), np.concatenate([o[1], i])) for o, (e, i) in zip(self.open, sides))
        in_b = eb[np.minimum(np.searchsorted(eb, ea), len(eb) - 1)] == ea if len(eb) else np.zeros(len(ea), bool)
        common = ea[in_b]
        last = common[-1] if len(common) else -1
        na, nb = np.searchsorted(ea, last, "right"), np.searchsorted(eb, last, "right")
        self.open = [(ea[na:], ia[na:]), (eb[nb:], ib[nb:])]
        if not len(common):
            return
        ea, ia, eb, ib = ea[:na], ia[:na], eb[:nb], ib[:nb]
        # Each stretch between neighbouring ends lies in one token of either side: a link.
        # Two sorted runs, which a stable sort merges.
        bounds = np.sort(np.concatenate([ea[~in_b[:na]], eb]), kind="stable")
        keys = ia[np.searchsorted(ea, bounds)] * STEP + ib[np.searchsorted(eb, bounds)]
        ga, gb = np.searchsorted(common, ea), np.searchsorted(common, eb)
        # A's tokens of a group, then B's; what follows a token: "," "|" ";".
        out = np.empty(na + nb, "i8")
        at_a = np.arange(na) + np.searchsorted(gb, ga)
        out[at_a] = ia + STEP * np.append(ga[1:] != ga[:-1], True)
        at_b = np.arange(nb) + np.searchsorted(ga, gb, "right")
        out[at_b] = ib + 2 * STEP * np.append(gb[1:] != gb[:-1], True)
        text = list(map(self.names.__getitem__, out.tolist()))
        place = np.empty(na + nb, "i8")
        place[at_b], place[at_a] = common[gb], common[ga]
        ends = np.array([d["end"] for d in self.docs])
        cuts = [np.searchsorted(x, ends, "right") for x in (ea, eb, common, bounds, place)]
        before = [0] * 5
        for i, d in enumerate(self.docs):
            now = [int(c[i]) for c in cuts]
            if now[3] > before[3]:
                for name, x, y in zip(("n_a", "n_b", "n_groups", "n_links"), before, now):
                    d[name] += y - x
                own = b"".join(text[before[4] : now[4]])[:-1]
                if d["sha"] is None:
                    d["sha"] = hashlib.sha256(own)
                else:
                    d["sha"].update(b";" + own)
                self._hold(d, *np.unique(keys[before[3] : now[3]], return_counts=True))
            before = now

    @staticmethod
    def _hold(d: dict, keys: np.ndarray, n: np.ndarray) -> None:
        """Keep a document's pairs with their numbers; together once they are many."""
        d["keys"].append((keys, n))
        d["held"] += len(keys)
        if len(d["keys"]) > 1 and d["held"] > 4 * len(d["keys"][0][0]):
            d["keys"] = [merged(d["keys"])]
            d["held"] = len(d["keys"][0][0])

    def done(self, more: bool) -> list[dict]:
        """The documents that are complete; if `more` is to come, all but the last."""
        out = self.docs[: len(self.docs) - more]
        self.docs = self.docs[len(self.docs) - more :]
        return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of several lists of them as one."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([np.empty(0, "i8"), *(k for k, _ in parts)]), return_inverse=True)
    n = np.zeros(len(keys), "i8")
    np.add.at(n, at, np.concatenate([np.empty(0, "i8"), *(n for _, n in parts)]))
    return keys, n


_EVENTS = ("row", "side", "window", "id", "length", "ends", "ids")


def _events(a_path: str, b_path: str, kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, id, text) -> a first row of each document, then its end events of A and of B, window by window."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # A worker process has one copy of the broadcast dictionary, so its next tasks find the pieces it knows.
        pair = kept.value.get("pair") or Pair(a_path, b_path)
        kept.value["pair"] = pair
        for b in batches:
            for i in range(0, b.num_rows, 1500):
                rows, ids = b.column(0).slice(i, 1500), b.column(1).slice(i, 1500)
                texts = b.column(2).slice(i, 1500).to_pylist()
                doc, cols = [], {c: [] for c in ("side", "window", "length", "ends", "ids")}

                def put(k: int, *values) -> None:
                    doc.append(k)
                    for c, v in zip(cols.values(), values):
                        c.append(v)

                for k, sides in enumerate(pair.encode([t or "" for t in texts])):
                    put(k, 0, -1, int(sides[0][0][-1]) if sides else 0, None, None)
                    for side, (ends, own) in enumerate(sides or ()):
                        cuts = np.searchsorted(ends, np.arange(WINDOW, ends[-1] + WINDOW, WINDOW), "right")
                        start = 0
                        for w, stop in enumerate(cuts):
                            if stop > start:
                                put(k, side, w, 0, _planes(np.diff(ends[start:stop], prepend=w * WINDOW)), _planes(own[start:stop]))
                            start = stop
                at = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.take(at), pa.array(cols["side"], pa.int32()), pa.array(cols["window"], pa.int32()), ids.take(at), pa.array(cols["length"], pa.int64()), pa.array(cols["ends"], pa.binary()), pa.array(cols["ids"], pa.binary())],
                    list(_EVENTS),
                )

    return run


_DOC = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(id_type):
    def block(docs: list[dict]) -> pa.RecordBatch:
        pairs = [merged(d["keys"]) if d["keys"] else (np.empty(0, "i8"), np.empty(0, "i8")) for d in docs]
        sizes = np.array([len(k) for k, _ in pairs], "i8")
        keys, at = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
        n = np.concatenate([n for _, n in pairs])
        total = np.zeros(len(keys), "i8")
        np.add.at(total, at, n)
        # Frequent pairs get small numbers; within a document they rise.
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(keys), "i8")
        rank[order] = np.arange(len(keys))
        whole = np.repeat(np.arange(len(docs)), sizes) << 32 | rank[at]
        by = np.argsort(whole)
        codes = whole[by] & 0xFFFFFFFF
        first = np.zeros(len(codes), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        steps = np.where(first, codes, np.diff(codes, prepend=0))
        cols = {"ids": pa.array([[d["id"] for d in docs]], pa.list_(id_type))}
        cols |= {c: pa.array([[d[c] for d in docs]], pa.list_(pa.int64())) for c in _DOC}
        cols["sha"] = pa.array([[d["sha"].hexdigest() if d["sha"] else "" for d in docs]], pa.list_(pa.string()))
        cols["sizes"] = pa.array([sizes.tolist()], pa.list_(pa.int64()))
        cols |= {c: pa.array([x], pa.binary()) for c, x in (("a", _planes(keys[order] >> 17)), ("b", _planes(keys[order] & (STEP - 1))), ("total", _planes(total[order])), ("steps", _planes(steps)), ("n", _planes(n[by])))}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Events by document and window -> blocks of documents with their pairs of ids."""
        names = [b"%d" % i + sep for sep in (b",", b"|", b";") for i in range(STEP)]
        sweep, held, links = Sweep(names), [], 0
        sides: list[list] = [[[], []], [[], []]]
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            sweep.sweep([tuple(np.concatenate([np.empty(0, "i8"), *x]) for x in side) for side in sides])
            for side in sides:
                side[0].clear(), side[1].clear()
            waiting = 0

        def ready(more: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, links
            for d in sweep.done(more):
                held.append(d)
                links += 1 + sum(len(k) for k, _ in d["keys"])
                if links >= BLOCK:
                    yield block(held)
                    held, links = [], 0

        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("side", "window", "id", "length", "ends", "ids"))):
                side, window, id_, length, ends, ids = row
                if window < 0:
                    if waiting >= SWEEP or len(sweep.docs) > 10_000:
                        flush()
                        yield from ready(False)
                    sweep.begin(id_, length)
                    continue
                if waiting >= 4 * SWEEP and side == 0:  # a very long document
                    flush()
                own = _plain(ids)
                sides[side][0].append(np.cumsum(_plain(ends)) + sweep.docs[-1]["from"] + window * WINDOW)
                sides[side][1].append(own)
                waiting += len(own)
        flush()
        yield from ready(False)
        if held:
            yield block(held)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> (a, b, n), pairs that blocks of a batch share added up."""
    for b in batches:
        keys, n = merged([((_plain(x) * STEP) + _plain(y), _plain(t)) for x, y, t in zip(*(b.column(i).to_pylist() for i in range(3)))])
        for i in range(0, len(keys), 1 << 18):
            k = keys[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(k >> 17), pa.array(k & (STEP - 1)), pa.array(n[i : i + (1 << 18)])], ["a", "b", "n"])


def _sums(block: dict, count: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n_best and count_sum of each document of a block, from counts of its pairs in their order."""
    sizes, steps, n = np.array(block["sizes"], "i8"), _plain(block["steps"]), _plain(block["n"])
    starts = np.cumsum(sizes) - sizes
    run = np.concatenate([[0], np.cumsum(steps)])
    codes = run[1:] - np.repeat(run[starts], sizes)
    out = []
    for value in (best.astype("i8"), count):
        total = np.concatenate([[0], np.cumsum(n * value[codes])])
        out.append(total[starts + sizes] - total[starts])
    return out[0], out[1]


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", pairs_limit: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs`.

    A (a byte-level BPE file) encodes " " + text, B (a sentencepiece model that adds the
    space itself) encodes text, both without special tokens, whose strings are plain text.
    Positions in bytes where tokens of both end cut them into groups; a link is a pair of
    an A and a B token that share a byte. A pair of ids counts as many links as all rows
    have of it; n_best is how many of a document's links have the highest count of their
    B id, count_sum the sum of the counts of all its links.

    The end events of both sides are rows of up to WINDOW bytes of text, dealt by document
    and sorted by position; the sweep keeps the open group and the document's distinct
    pairs, so a text of any length goes through it. Its results are written in blocks
    of documents that share a list of pairs. Counts are summed over all blocks; if there
    are at most `pairs_limit` pairs of ids they are sent to all executors, otherwise each
    block is joined with the counts of its pairs.

    Null or empty texts, and texts that a side does not give back byte for byte, have no
    tokens: zeros and an empty digest. Repeated rows count as rows; null ids stay null;
    an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    events = texts.mapInArrow(_events(a_path, b_path, spark.sparkContext.broadcast({})), f"row long, side int, window int, id {kind.simpleString()}, length long, ends binary, ids binary")
    swept = events.repartition("row").sortWithinPartitions("row", "window", "side")
    ids = f"ids array<{kind.simpleString()}>, " + ", ".join(f"{c} array<long>" for c in _DOC) + ", sha array<string>, sizes array<long>, a binary, b binary, total binary, steps binary, n binary"
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = materialise(swept.mapInArrow(_blocks(to_arrow_type(kind)), ids).withColumn("block", F.monotonically_increasing_id()))
    pairs = blocks.select("a", "b", "total").mapInArrow(_pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = materialise(pairs)
    top = pairs.groupBy("b").agg(F.max("count").alias("most")).withColumnRenamed("b", "top_b")
    counted = pairs.join(top, F.col("b") == F.col("top_b")).select((F.col("a") * STEP + F.col("b")).alias("key"), "count", (F.col("count") == F.col("most")).alias("best"))
    out = f"id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, sha string"

    def told(block: dict, count: np.ndarray, best: np.ndarray, id_type) -> pa.RecordBatch:
        n_best, count_sum = _sums(block, count, best)
        cols = [pa.array(block["ids"], id_type), *(pa.array(block[c], pa.int64()) for c in _DOC), pa.array(n_best), pa.array(count_sum), pa.array(block["sha"], pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["id", *_DOC, "n_best", "count_sum", "sha"])

    if pairs.count() <= pairs_limit:
        known = counted.toArrow().sort_by("key")
        shared = share(spark, tuple(known.column(c).to_numpy() for c in ("key", "count", "best")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, count, best = value_of(shared)
            for b in batches:
                id_type = b.schema.field("ids").type.value_type
                for block in b.to_pylist():
                    at = np.searchsorted(keys, _plain(block["a"]) * STEP + _plain(block["b"]))
                    yield told(block, count[at], best[at], id_type)

        scored = blocks.mapInArrow(run, out)
    else:

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number, x, y in zip(*(c.to_pylist() for c in b.columns)):
                    keys = _plain(x) * STEP + _plain(y)
                    for i in range(0, len(keys), 1 << 18):
                        own = keys[i : i + (1 << 18)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(np.arange(i, i + len(own))), pa.array(own)], ["block", "code", "pair"])

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            known = right.sort_by("code")
            count, best = (known.column(c).to_numpy(zero_copy_only=False) for c in ("count", "best"))
            return pa.Table.from_batches([told(b, count, best, left.schema.field("ids").type.value_type) for b in left.to_pylist()])

        asks = blocks.select("block", "a", "b").mapInArrow(asked, "block long, code long, pair long")
        answers = asks.join(counted, F.col("pair") == F.col("key")).select("block", "code", "count", "best")
        scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(met, out)
    return scored.select(F.col("id").alias(id_col), *_DOC, "n_best", "count_sum", F.col("sha").alias("groups_sha256"))
