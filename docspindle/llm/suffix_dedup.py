"""Removal of byte strings that occur elsewhere, by suffix arrays of the ambiguous regions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, small

#: Bytes that are scanned at once for selected positions.
CHUNK = 1 << 18
#: Contexts of a group at most; larger groups are refined, and what stays larger is
#: dealt in blocks of about so many, whose windows then meet in an aggregation.
GROUP = 128
#: Groups are gathered up to so many contexts before they are sorted.
GATHER = 1024
#: How often a larger group is refined before that.
LEVELS = 3
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


class Selector:
    """Chooses positions such that equal windows of `window` bytes choose alike.

    Each window chooses the string of `k` bytes in it that has the least hash, the
    leftmost among equals. A string of `window` bytes that occurs twice so has its
    chosen string at the same place both times: equal windows meet under it.
    """

    def __init__(self, window: int, k: int):
        self.window, self.k, self.w = window, k, window - k + 1
        n = CHUNK + window + 1
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, _BASE, "u8")]), dtype="u8")
            self.inverse = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, pow(_BASE, -1, 1 << 64), "u8")]), dtype="u8")

    def hashes(self, buf: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            s = np.concatenate([np.zeros(1, "u8"), np.cumsum((buf.astype("u8") + np.uint64(1)) * self.power[: len(buf)], dtype="u8")])
            v = (s[self.k :] - s[: -self.k]) * self.inverse[: len(s) - self.k]
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xD6E8FEB86659FD93)
            v ^= v >> np.uint64(29)
        return v

    def least(self, v: np.ndarray) -> np.ndarray:
        """The chosen position of each run of `w` hashes."""
        w, n = self.w, len(v)
        key = (v & np.uint64(_MASK ^ 0xFFFFF)) | np.arange(n, dtype="u8")
        full = np.concatenate([key, np.full((-n) % w, _MASK, "u8")]).reshape(-1, w)
        left = np.minimum.accumulate(full, 1).ravel()
        right = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
        return (np.minimum(right[: n - w + 1], left[w - 1 : n]) & np.uint64(0xFFFFF)).astype("i8")

    def choose(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """text, first, last, position, hash: runs of window starts that choose one position."""
        units, out = [], []
        for i, t in enumerate(texts):
            last = len(t) - self.window
            for a in range(0, last + 1, CHUNK // 2):
                units.append((i, a, min(last, a + CHUNK // 2 - 1)))
        at = 0
        while at < len(units):
            size, to = 0, at
            while to < len(units) and (to == at or size + units[to][2] - units[to][1] + self.window <= CHUNK):
                size += units[to][2] - units[to][1] + self.window
                to += 1
            some, at = units[at:to], to
            buf = np.frombuffer(b"".join(texts[i][a : b + self.window] for i, a, b in some), "u1")
            v = self.hashes(buf)
            lens = np.array([b - a + self.window for _, a, b in some])
            starts = np.cumsum(lens) - lens
            owner = np.repeat(np.arange(len(some)), lens)
            left = (starts + lens)[owner] - np.arange(len(buf))
            n = len(v) - self.w + 1
            begin = np.flatnonzero(left[:n] >= self.window)  # windows within one text
            chosen, who = self.least(v)[begin], owner[begin]
            new = np.ones(len(begin), bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | (who[1:] != who[:-1])
            first = np.flatnonzero(new)
            final = np.concatenate([first[1:], [len(begin)]]) - 1
            shift = (np.array([u[1] for u in some]) - starts)[who[first]]
            text = np.array([u[0] for u in some])[who[first]]
            out.append((text, begin[first] + shift, begin[final] + shift, chosen[first] + shift, v[chosen[first]]))
        if not out:
            return (*[np.empty(0, "i8")] * 4, np.empty(0, "u8"))
        return tuple(np.concatenate(x) for x in zip(*out))


def repeated_starts(contexts: list[bytes], window: int) -> list[np.ndarray]:
    """For each context, the starts of windows that occur more than once among all contexts.

    A suffix array by two-stage sorting: suffixes smaller than their successors
    are sorted directly; the larger ones follow from one scan of the buckets by
    first byte, each placed when the scan meets its successor. Then neighbours'
    common prefixes tell what repeats. Only suffixes long enough to hold a window
    take part, and those that the scan needs to reach them.
    """
    n, most = len(contexts), max(map(len, contexts))
    lens = np.array([len(c) for c in contexts])
    wide = most + 1
    flat = np.zeros(n * wide + most + 1, "u1")
    grid = flat[: n * wide].reshape(n, wide)
    for i, c in enumerate(contexts):
        grid[i, : len(c)] = np.frombuffer(c, "u1")
    # Smaller than the successor? The next differing byte decides; the end is least.
    here, col = grid[:, :-1].astype("i2"), np.arange(wide - 1)
    after = grid[:, 1:].astype("i2")
    after[col[None, :] + 1 >= lens[:, None]] = -1
    differs = np.where(here != after, col[None, :], wide)
    at = np.minimum.accumulate(differs[:, ::-1], 1)[:, ::-1]
    at = np.minimum(at, wide - 2)
    smaller = np.take_along_axis(here, at, 1) < np.take_along_axis(after, at, 1)
    inside = col[None, :] < lens[:, None]
    last = lens - window  # the last start of a window
    reach = np.where(smaller & inside & (col[None, :] >= last[:, None]), col[None, :], wide).min(1)
    reach = np.minimum(reach, lens - 1)
    used = col[None, :] <= reach[:, None]
    direct, induced = np.zeros(n * wide, bool), np.zeros(n * wide, bool)
    direct.reshape(n, wide)[:, :-1] = used & smaller
    induced.reshape(n, wide)[:, :-1] = used & ~smaller
    suffixes = np.lib.stride_tricks.sliding_window_view(flat, most)
    s = np.flatnonzero(direct)
    s = s[np.argsort(np.ascontiguousarray(suffixes[s]).view(f"S{most}").ravel(), kind="stable")]
    buckets = np.searchsorted(flat[s], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]

    def larger(p: np.ndarray) -> np.ndarray:
        p = p[p > 0] - 1
        return p[induced[p]]

    def deal(p: np.ndarray) -> None:
        order = np.argsort(flat[p], kind="stable")
        p = p[order]
        bytes_, first = np.unique(flat[p], return_index=True)
        for b, part in zip(bytes_.tolist(), np.split(p, first[1:])):
            queue[b].append(part)

    ends = np.arange(n) * wide + lens - 1
    deal(ends[induced[ends]])
    out = []
    for c in range(256):
        part = np.concatenate([*queue[c], np.empty(0, "i8")]).astype("i8")
        parts, front = [part], part
        while len(front):
            front = larger(front)
            front = front[flat[front] == c]
            parts.append(front)
        whole = np.concatenate([*parts, s[buckets[c] : buckets[c + 1]]])
        out.append(whole)
        rest = larger(whole)
        deal(rest[flat[rest] > c])
    array = np.concatenate(out)
    row, start = array // wide, array % wide
    array = array[start <= last[row]]
    same = common_prefixes(suffixes, array) >= window
    hit = np.zeros(len(array), bool)
    hit[1:] |= same
    hit[:-1] |= same
    array = np.sort(array[hit])
    cut = np.searchsorted(array // wide, np.arange(n + 1))
    return [array[cut[i] : cut[i + 1]] - i * wide for i in range(n)]


def common_prefixes(suffixes: np.ndarray, array: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each suffix in `array` and the next one.
    Suffixes are padded to one length; what lies behind an end is never read, as
    each suffix that takes part is at least a window long."""
    out = np.empty(max(0, len(array) - 1), "i8")
    step = max(1, (1 << 24) // suffixes.shape[1])
    for at in range(0, len(out), step):
        rows = suffixes[array[at : at + step + 1]]
        differs = rows[1:] != rows[:-1]
        out[at : at + len(differs)] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return out


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Unions of [start, start + length) of sorted starts."""
    out: list[tuple[int, int]] = []
    for a in starts.tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + length))
        else:
            out.append((a, a + length))
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _refined(cut: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(few, hot): contexts with the `group` of at most GROUP contexts that they are
    sorted in, and those left whose groups stay larger, each once, with a block of
    its largest group instead and the `pieces` around the chosen string that it
    shares there: only windows that hold a piece can repeat beyond `few`.

    A window holds its chosen string and window - k bytes more, so half of these
    stand on its left or half on its right. A large group so falls into groups of
    the contexts that also agree on that half, on one side or the other: two that
    share a window meet in one of them. Halves are halved again, LEVELS times; a
    context goes to no more than two groups a level.
    """
    now = cut.select("key", "ctx", "left", "bytes", F.col("key").alias("group"), F.lit(0).alias("l"), F.lit(0).alias("r"), "d")
    few = now.filter(F.col("d") <= GROUP)
    rest = window - k
    for _ in range(LEVELS):
        step, rest = -(-rest // 2), rest // 2
        sides = F.explode(F.array(F.struct((F.col("l") + step).alias("l"), F.col("r").alias("r")), F.struct(F.col("l").alias("l"), (F.col("r") + step).alias("r"))))
        more = now.filter(F.col("d") > GROUP).select("key", "ctx", "left", "bytes", sides.alias("x")).select("key", "ctx", "left", "bytes", "x.*")
        more = more.filter((F.col("l") <= F.col("left")) & (F.col("left") + k + F.col("r") <= F.octet_length("bytes")))
        same = F.xxhash64("l", "r", F.expr(f"substring(bytes, left - l + 1, l + {k} + r)"))
        more = materialise(more.withColumn("group", same).distinct())
        sizes = more.groupBy("group").agg(F.count("*").alias("d")).filter("d > 1").withColumnRenamed("group", "group2")
        now = more.join(sizes, F.col("group") == F.col("group2")).select("key", "ctx", "left", "bytes", "group", "l", "r", "d")
        few = few.unionByName(now.filter(F.col("d") <= GROUP))
    pieces = F.collect_set(F.array("l", "r")).alias("pieces")  # 2 ** LEVELS at most
    hot = now.filter(F.col("d") > GROUP).groupBy("key", "ctx", "left", "bytes").agg(F.max(F.struct("d", "group")).alias("x"), pieces)
    block = F.xxhash64("x.group", F.pmod(F.xxhash64("ctx"), F.ceil(F.col("x.d") / GROUP)))
    return few, hot.select(block.alias("group"), "key", "ctx", "left", "bytes", "pieces")


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Whole groups of rows (group, key, ctx, ...), together until they are `most`
    contexts; a context stands once, though it may be in several groups."""
    held: dict[tuple, tuple] = {}
    group = None
    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns)):
            if len(held) >= most and x[0] != group:
                yield list(held.values())
                held.clear()
            group = x[0]
            held[x[1], x[2]] = x
    if held:
        yield list(held.values())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 200, k: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 for every row of `docs`.

    Each byte covered by a `window`-byte string that starts at two places or more,
    in one document or several, goes; texts are UTF-8 bytes (null: empty), matches
    never cross documents. Rows are places of their own, so a repeated row repeats
    its text; ids may repeat or be null.

    1. A narrow pass chooses positions such that equal windows choose alike, and
       gives each position's string and context (the windows that choose it) a
       hash. What repeats within a row is found there and stands once.
    2. Aggregation and a join drop strings that occur once, most of all.
    3. A context that occurs twice repeats whole. Strings with several contexts
       are looked at byte by byte: one example of each context goes to its
       string's group, whose suffix array shows which windows repeat. Groups of
       more than GROUP contexts are refined, and at last sorted in blocks; the
       different windows of each block meet the others' in an aggregation, so that
       no task gathers such a group, and no pair is lost.
    4. Spans go back to all places of a context and to their texts.

    Strings and contexts are told apart by 64-bit hashes of 100 bytes and more.
    Rows have 64-bit names; a second hash finds different rows of one name, which
    are named anew. Empty tables give empty results; other columns are not read.
    """
    # Rows need a name of their own: the id may repeat. Equal rows share one, with a count.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    own = F.coalesce(F.col("id").cast("string"), F.lit(""))
    other = F.xxhash64("text", F.lit(1), own)
    named = texts.withColumn("row", F.xxhash64(own, "text"))
    # Equal rows: all their windows repeat. Different rows of one name get another.
    again = named.withColumn("other", other).groupBy("row").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    again = materialise(again.filter("n > 1"))
    clash = again.filter("lo <> hi").select(F.col("row").alias("clash"))
    n_clash = clash.count()
    if n_clash:
        named = named.join(small(clash, n_clash), F.col("row") == F.col("clash"), "left")
        named = named.withColumn("row", F.when(F.col("clash").isNotNull(), F.xxhash64("row", other)).otherwise(F.col("row"))).drop("clash")
        again = materialise(named.groupBy("row").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).filter("n > 1"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        chooser = Selector(window, k)
        for b in batches:
            rows, data = b.column(0).to_numpy(), b.column(1)
            for start in range(0, len(rows), 512):
                part = data.slice(start, 512).to_pylist()
                who, lo, hi, pos, key = (x.view("i8") for x in chooser.choose(part))
                spots = zip(who.tolist(), lo.tolist(), (hi + window).tolist(), (pos - lo).tolist())
                ctx = np.fromiter((xxh3_64_intdigest(part[i][a:e], left) for i, a, e, left in spots), "u8", len(who)).view("i8")
                # One text's equal contexts: the first stands for them, their spans are known.
                order = np.lexsort((pos, ctx, key, who))
                same = np.zeros(len(order), bool)
                same[1:] = (who[order][1:] == who[order][:-1]) & (key[order][1:] == key[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])
                again = np.zeros(len(order), bool)
                again[order] = same
                both = same.copy()
                both[:-1] |= same[1:]
                covers: dict[int, list] = {}
                for j in order[both].tolist():
                    covers.setdefault(int(who[j]), []).append((int(lo[j]), int(hi[j]) + window))
                known = [(rows[start + i], a, e - a) for i, spans in covers.items() for a, e in _merge(spans)]
                one, n = ~again, len(known)
                zero = np.zeros(n, "i8")
                cols = (
                    np.concatenate([rows[start + who[one]], np.array([x[0] for x in known], "i8")]),
                    np.concatenate([key[one], zero]),
                    np.concatenate([ctx[one], zero]),
                    np.concatenate([pos[one], np.array([x[1] for x in known], "i8")]),
                    np.concatenate([(pos - lo)[one], zero - 1]),  # -1: no string, only a span
                    np.concatenate([(hi + window - pos - k)[one], np.array([x[2] for x in known], "i8")]),
                )
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, kinds)], ["row", "key", "ctx", "pos", "left", "right"])

    found = named.filter(F.octet_length("text") >= window).select("row", "text").mapInArrow(places, "row long, key long, ctx long, pos int, left short, right int")
    twice = again.filter(f"size >= {window}").select("row", F.lit(0).alias("a"), F.col("size").alias("e"))
    often = found.filter("left >= 0").groupBy("key").count().filter("count > 1").select(F.col("key").alias("often"))
    kept = materialise(found.join(often, F.col("key") == F.col("often"), "left").filter("often is not null or left < 0").drop("often"))
    known = kept.filter("left < 0").select("row", F.col("pos").alias("a"), (F.col("pos") + F.col("right")).alias("e"))
    m = kept.filter("left >= 0")
    example = F.min(F.struct("row", "pos", "left", "right")).alias("x")
    g = materialise(m.groupBy("key", "ctx").agg(F.count("*").alias("n"), example).select("key", "ctx", "n", "x.*"))
    several = g.groupBy("key").agg(F.count("*").alias("d")).filter("d > 1").withColumnRenamed("key", "k2")
    asked = g.join(several, F.col("key") == F.col("k2")).select("row", F.struct("key", "ctx", "pos", "left", "right", "d").alias("ask"))
    asked = asked.groupBy("row").agg(F.collect_list("ask").alias("asks")).withColumnRenamed("row", "row2")
    once = named.select("row", "text").join(asked, F.col("row") == F.col("row2"))
    # Equal rows give the same contexts again; one of each will do.
    cut = once.select("text", F.explode("asks").alias("ask")).select("ask.*", F.expr(f"substring(text, ask.pos - ask.left + 1, ask.left + ask.right + {k})").alias("bytes"))
    cut = materialise(cut.dropDuplicates(["key", "ctx"]).select("key", "ctx", "left", "d", "bytes"))

    most = GATHER
    span = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("a", pa.int32()), ("e", pa.int32())])
    seen = span.append(pa.field("part", pa.binary())).append(pa.field("single", pa.bool_()))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, most):
            starts = repeated_starts([x[4] for x in held], window)
            yield _batch([(x[1], x[2], a - x[3], e - x[3]) for x, s in zip(held, starts) for a, e in _runs(s, window)], span)

    def sort_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of what repeats here (no part), and one row of each different window that another block may hold."""
        for held in _gathered(batches, most):
            starts = repeated_starts([x[4] for x in held], window)
            out, met = [], set()
            for (_, key, ctx, left, text, pieces), s in zip(held, starts):
                out += [(key, ctx, a - left, e - left, None, None) for a, e in _runs(s, window)]
                here = set(s.tolist())
                # The window at i has left - i bytes before the chosen string, i + window - left - k after it.
                shared = {i for l, r in pieces for i in range(max(0, left + k + r - window), min(left - l, len(text) - window) + 1)}
                for i in sorted(shared):
                    part = hashlib.sha256(text[i : i + window]).digest()
                    if part not in met:
                        met.add(part)
                        out.append((key, ctx, i - left, i - left + window, part, i not in here))
            yield _batch(out, seen)

    few, hot = _refined(cut, window, k)
    few = few.repartition("group").sortWithinPartitions("group").select("group", "key", "ctx", "left", "bytes")
    sorted_ = few.mapInArrow(sort, "key long, ctx long, a int, e int")
    blocks = hot.repartition("group").sortWithinPartitions("group").mapInArrow(sort_block, "key long, ctx long, a int, e int, part binary, single boolean")
    blocks = materialise(blocks)
    # A window that two blocks hold is told by its two ends; of more, those alone in their block ask.
    place = F.struct("ctx", "a", "e")
    across = blocks.filter("part is not null").groupBy("key", "part").agg(F.count("*").alias("n"), F.min(place).alias("x"), F.max(place).alias("y")).filter("n > 1")
    across = materialise(across)
    compared = across.filter("n = 2").select("key", F.explode(F.array("x", "y")).alias("p")).select("key", "p.*")
    wide = across.filter("n > 2").select(F.col("key").alias("key2"), F.col("part").alias("part2"))
    alone = blocks.filter("single").join(wide, (F.col("key") == F.col("key2")) & (F.col("part") == F.col("part2")))
    compared = compared.unionByName(blocks.filter("part is null").select("key", "ctx", "a", "e")).unionByName(alone.select("key", "ctx", "a", "e"))
    whole = g.filter("n > 1").select("key", "ctx", (-F.col("left")).cast("int").alias("a"), (F.col("right") + k).cast("int").alias("e"))
    spans = sorted_.unionByName(compared).unionByName(whole).groupBy("key", "ctx").agg(F.collect_set(F.struct("a", "e")).alias("spans"))
    spans = spans.select(F.col("key").alias("key2"), F.col("ctx").alias("ctx2"), "spans")
    hits = m.join(spans, (F.col("key") == F.col("key2")) & (F.col("ctx") == F.col("ctx2"))).select("row", "pos", F.explode("spans").alias("s"))
    hits = hits.select("row", (F.col("pos") + F.col("s.a")).alias("a"), (F.col("pos") + F.col("s.e")).alias("e"))
    per_row = hits.unionByName(known).unionByName(twice).groupBy("row").agg(F.collect_list(F.struct("a", "e")).alias("spans")).withColumnRenamed("row", "row2")
    per_row = materialise(per_row)
    n_rows = per_row.count()
    spans = "array<struct<a: int, e: int>>"
    if n_rows <= BROADCAST_ROWS:
        # Few rows have spans: their names are sent out, and the other texts don't shuffle.
        names = F.broadcast(per_row.select("row2"))
        done = named.join(names, F.col("row") == F.col("row2"), "left_semi").join(per_row.hint("merge"), F.col("row") == F.col("row2")).select("id", "text", "spans")
        rest = named.join(names, F.col("row") == F.col("row2"), "left_anti").select("id", "text", F.lit(None).cast(spans).alias("spans"))
        done = done.unionByName(rest)
    else:
        done = named.join(per_row, F.col("row") == F.col("row2"), "left").select("id", "text", "spans")
    kind = done.schema["id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column(1), b.column(2)):
                text, merged = t.as_py(), _merge([(x["a"], x["e"]) for x in spans.as_py() or ()])
                at, kept = 0, []
                for a, e in merged:
                    kept.append(text[at:a])
                    at = e
                whole = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(whole), len(merged), whole, hashlib.sha256(whole).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = done.mapInArrow(remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
