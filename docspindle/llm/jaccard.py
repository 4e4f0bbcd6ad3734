"""Exact Jaccard join of shingle sets that skips by positions and by known answers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, share, small, value_of
from .simhash import components

#: Counters of hashed shingles, and how many of them travel in one row.
COUNTERS, SLICE = 1 << 21, 1 << 15
#: Counter tables that are added up in one group.
FAN_IN = 1000
#: Remembered hashes of words, and sets that a task knows to have met.
MEMO = 1 << 20
#: Sets, and shingles of sets, that one block of a leader's group holds.
STAR, STAR_SHINGLES = 2048, 4_000_000
#: Entries of a list whose partners are looked for one by one.
LIST = 512
#: Counters above MANY and four times the mean are those of frequent shingles.
MANY = 1000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], "u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _ODD[6]
    x = (x ^ (x >> _U(27))) * _ODD[7]
    return x ^ (x >> _U(31))


class _Words(dict):
    """Word -> 64-bit hash."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxh64_intdigest(word, self.seed)
        return h


def shingle_set(text: str | None, width: int, words: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `width` words of `text`.

    A-Z are lower-cased, words are runs other than ASCII white space; a text of fewer
    words is one shingle, a text without words has none.
    """
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.empty(0, "u8")
    h = np.fromiter(map(words.__getitem__, parts), "u8", len(parts))
    k = min(width, len(h))
    own = np.full(len(h) - k + 1, _U(k) * _U(0xA0761D6478BD642F))
    for i in range(k):
        own += h[i : len(h) - k + 1 + i] * _U((int(_ODD[i % 6]) + 2 * i) & (2**64 - 1) | 1)
    return np.unique(_mix(own))


def _name(own: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    a, b = (int(_mix(own + _U(seed) * _ODD[2] + _ODD[i]).sum(dtype="u8")) for i in (0, 1))
    return tuple((x + (1 << 63)) % (1 << 64) - (1 << 63) for x in (a, b))


def _sets(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    words = _Words(seed)
    with np.errstate(over="ignore"):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield part, [shingle_set(t.as_py(), width, words) for t in part.column(1)]


def _counted(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) -> a row (id, n, node, other) of each document; at the end how often each counter was met."""
        from pyspark import TaskContext

        names = ["id", "n", "node", "other", "part", "slice", "counts"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        counts, met = np.zeros(COUNTERS, "i8"), set()
        for part, sets in _sets(batches, width, seed):
            named, new = [_name(s, seed) for s in sets], []
            for (node, _), s in zip(named, sets):
                if node not in met:
                    met.add(node)
                    new.append(s)
            if len(met) > MEMO:
                met.clear()
            if new:
                counts += np.bincount((np.concatenate(new) & _U(COUNTERS - 1)).astype("i8"), minlength=COUNTERS)
            n = part.num_rows
            cols = [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([a for a, _ in named]), pa.array([b for _, b in named])]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(n, k) for k in kinds[4:])], names)
        if counts.any():
            cut = [counts[i : i + SLICE] for i in range(0, COUNTERS, SLICE)]
            cols = [pa.nulls(len(cut), k) for k in kinds[:4]]
            cols += [pa.array([TaskContext.get().partitionId()] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([_packed(c) for c in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<i8").view("u1").reshape(-1, 8).T).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), "u1").reshape(8, -1).T).view("<i8").ravel()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, slice, counts) -> the sum of each (part, slice)."""
    sums = {}
    for b in batches:
        for part, at, counts in zip(*(c.to_pylist() for c in b.columns)):
            sums[part, at] = sums.get((part, at), 0) + _unpacked(counts)
    keys = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([_packed(sums[k]) for k in keys], pa.binary())], ["part", "slice", "counts"])


def least_overlap(a, b, percent: int):
    """How many shingles sets of a and b must share for 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _prefixes(shared, width: int, seed: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) -> (h, node, size, often): the shingles of a set, rare counters first, of which a
        similar set must hold one; size has the set's size and the shingle's place."""
        (counts, many), met = value_of(shared), set()
        for _, sets in _sets(batches, width, seed):
            cols = []
            for s in sets:
                node = _name(s, seed)[0]
                if not len(s) or node in met:
                    continue
                met.add(node)
                k = len(s) - -(-percent * len(s) // 100) + 1
                seen = counts[(s & _U(COUNTERS - 1)).astype("i8")]
                first = np.lexsort((s, seen))[:k]
                cols.append((s[first].view("i8"), np.full(k, node), len(s) << 32 | np.arange(k), seen[first] > many))
            if len(met) > MEMO:
                met.clear()
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols)], ["h", "node", "size", "often"])

    return run


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, node, size, often) by h -> those of lists of several nodes, and all of frequent shingles."""

    def kept(b: pa.RecordBatch) -> pa.RecordBatch:
        h, node = (b.column(i).to_numpy() for i in (0, 1))
        alike = h[1:] == h[:-1]
        starts = np.flatnonzero(np.append(True, ~alike))
        several = np.logical_or.reduceat(np.append(False, alike & (node[1:] != node[:-1])), starts)
        keep = np.repeat(several, np.diff(np.append(starts, len(h)))) | b.column(3).to_numpy(zero_copy_only=False)
        return b.filter(pa.array(keep))

    held = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        h = b.column(0).to_numpy()
        whole = int(np.searchsorted(h == h[-1], True)) if len(h) and not b.column(3)[-1].as_py() else len(h)
        if whole:
            yield kept(b.slice(0, whole))
        held = b.slice(whole) if whole < len(h) else None
    if held is not None:
        yield kept(held)


def _whole(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text, a, i, j, b, node) -> (a, i, j, b, own), where the text's set is the node asked for."""
        for part, sets in _sets(batches, width, seed):
            keep = np.array([_name(s, seed)[0] for s in sets], "i8") == part.column(6).to_numpy()
            cols = [part.column(k).filter(pa.array(keep)) for k in (2, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([s.tobytes() for s, k in zip(sets, keep) if k], pa.binary())], ["a", "i", "j", "b", "own"])

    return run


def _stars(percent: int):
    def kept(n: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Which entries of a list have a partner in it whose size and place allow them to be similar."""
        need = least_overlap(n[:, None], n[None], percent)
        fine = (np.minimum(left[:, None], left[None]) >= need) & (100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None]))
        np.fill_diagonal(fine, False)
        return fine.any(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, low, node, n, band, pos) by list (h, low) and node -> (lead, node, n): the list's entries
        that may have a partner, under the first of them. Lists of over LIST entries pass as they come."""
        held: dict[str, np.ndarray] = {}
        names = ("h", "low", "node", "n", "band", "pos")
        passing, leader = None, 0

        def out(x: dict[str, np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, passing, leader
            if not len(x["h"]):
                held = x
                return
            new = np.append(True, (x["h"][1:] != x["h"][:-1]) | (x["low"][1:] != x["low"][:-1]))
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], len(new))
            lead, keep = np.zeros(len(new), "i8"), np.zeros(len(new), bool)
            held = {c: x[c][:0] for c in names}
            for s, e in zip(starts, stops):
                key = (x["h"][s], x["low"][s])
                if key == passing:
                    keep[s:e], lead[s:e] = True, leader
                elif e == len(new) and not last and e - s <= LIST:  # the list may go on
                    held = {c: x[c][s:e] for c in names}
                elif e - s > LIST:
                    passing, leader = key, x["node"][s]
                    keep[s:e], lead[s:e] = True, leader
                elif e - s > 1 and (x["band"][s:e] == x["low"][s]).any():
                    # Where none is of the lower band, the next list has all pairs.
                    own = kept(x["n"][s:e], x["n"][s:e] - x["pos"][s:e])
                    if own.any():
                        keep[s:e], lead[s:e] = own, x["node"][s:e][own][0]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (lead, x["node"], x["n"])], ["lead", "node", "n"])

        for b in batches:
            now = {c: b.column(k).to_numpy().astype("i8") for k, c in enumerate(names)}
            yield from out({c: np.concatenate([held[c], now[c]]) if held else now[c] for c in names}, False)
        if held:
            yield from out(held, True)

    return run


def _forest(leader: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in `sets`) that join what is linked among `sets`, at most one per member.

    A set's answers come from the leader's: two sets share what both keep of the leader, told by
    bits, and what both have beside it, told by lists of the few shingles that several of them have.
    """
    m, size = len(sets), np.array([len(s) for s in sets], "i8")
    of, flat = np.repeat(np.arange(m), size), np.concatenate(sets)
    at = np.minimum(np.searchsorted(leader, flat), len(leader) - 1)
    inside = leader[at] == flat
    bits = np.zeros((m, -(-len(leader) // 64) * 8), "u1")
    np.bitwise_or.at(bits, (of[inside], at[inside] >> 3), (1 << (at[inside] & 7)).astype("u1"))
    bits = bits.view("u8")
    _, where, n = np.unique(flat[~inside], return_inverse=True, return_counts=True)
    several = n[where] > 1
    beside_of, beside = of[~inside][several], where[several]
    by_shingle, by_member = np.argsort(beside, kind="stable"), np.argsort(beside_of, kind="stable")
    shingle_from = np.searchsorted(beside[by_shingle], np.arange(len(n) + 1))
    member_from = np.searchsorted(beside_of[by_member], np.arange(m + 1))
    # By rising size, so that those of a fitting size are a stretch.
    order = np.argsort(size, kind="stable")
    sizes = size[order]
    unseen, a, b = np.ones(m, bool), [], []
    for start in range(m):
        if not unseen[start]:
            continue
        unseen[start] = False
        front = [start]
        while front:
            x = front.pop()
            fit = order[np.searchsorted(sizes, -(-percent * size[x] // 100)) : np.searchsorted(sizes, 100 * size[x] // percent, "right")]
            rest = fit[unseen[fit]]
            if not len(rest):
                continue
            shared = np.bitwise_count(bits[rest] & bits[x]).sum(1, dtype="i8")
            own = beside[by_member[member_from[x] : member_from[x + 1]]]
            if len(own):
                more = np.concatenate([beside_of[by_shingle[shingle_from[e] : shingle_from[e + 1]]] for e in own])
                shared += np.bincount(more, minlength=m)[rest]
            near = rest[shared >= least_overlap(size[x], size[rest], percent)]
            unseen[near] = False
            a += [x] * len(near)
            b += near.tolist()
            front += near.tolist()
    return np.array(a, int), np.array(b, int)


def _group_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, i, j, b, own) by group (a, i, j), the leader first (b null) -> links (a, b)."""
        key, leader, nodes, sets = None, None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                a, b = _forest(leader, sets, percent)
                names = np.array(nodes, "i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(names[a], names[b])), pa.array(np.maximum(names[a], names[b]))], ["a", "b"])

        for batch in batches:
            for a, i, j, b, own in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(own, "u8")
                if b is None:
                    if key != (a, i, j):
                        yield from out()
                        key, leader, nodes, sets = (a, i, j), own, [], []
                    continue
                if key != (a, i, j):
                    raise RuntimeError("a set has come without its leader")
                nodes.append(b)
                sets.append(own)
        yield from out()

    return run


def group_links(groups: DataFrame, texts: DataFrame, width: int, seed: int, percent: int) -> DataFrame:
    """a, b: links between the members of each group (lead, node, n, rep) that connect what is linked
    in it. Large groups are dealt in blocks, and each pair of blocks is one task's, with the leader's
    set; so none is held whole. `texts` (id, text) meet what is asked of them, and only their sets travel."""
    full = groups.groupBy("lead").agg((1 + F.floor(F.greatest(F.count("*") / STAR, F.sum("n") / STAR_SHINGLES))).cast("int").alias("blocks")).withColumnRenamed("lead", "l")
    dealt = groups.join(full, F.col("lead") == F.col("l")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.col("lead").alias("a"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("node").alias("b"), "node", "rep")
    leaders = groups.filter("lead = node").select(F.col("node").alias("l"), F.col("rep").alias("l_rep"))
    first = dealt.select("a", "i", "j").distinct().join(leaders, F.col("a") == F.col("l")).select("a", "i", "j", F.lit(None).cast("long").alias("b"), F.col("a").alias("node"), F.col("l_rep").alias("rep"))
    asked = materialise(first.unionByName(dealt))
    met = texts.join(small(asked), F.col("id") == F.col("rep")).select("id", "text", "a", "i", "j", "b", "node")
    rows = met.mapInArrow(_whole(width, seed), "a long, i int, j int, b long, own binary")
    rows = rows.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_group_links(percent), "a long, b long").distinct()


def _band(n: Column, percent: int) -> Column:
    """Similar sets have sizes of one band or of neighbours."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def similar_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, seed: int = 42) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Two documents are linked when 100 * intersection >= percent * union of their sets of
    distinct `width`-word shingles; component_id is the smallest id reachable. Texts that
    are null or without words have no shingles and are linked with nothing. Repeated ids
    keep all rows and count as one document; rows with a null id get a null component. An empty table
    gives an empty result; other columns are not read.

    Shingles are 64-bit hashes. Equal sets are one node (two digests tell them apart; should
    one be shared by different sets, hashing starts again with another seed).
    Nodes are listed under the first shingles of their set, those with rare
    counters first: two similar sets share one of these. Then

    * lists are cut by size, in bands that hold all similar sizes with the next. How far back a
      shingle stands in a set bounds the size of partners there: entries skip the groups
      of bands that hold none;
    * entries without a partner of fitting size and place in their list are left out;
    * a group's first node is its leader, and groups of one leader are one. The sets of
      a group are compared with it; answers between two of them are derived from what each
      keeps of the leader and has beside it, so near copies cost a few words of bits a
      pair, and only links of a spanning forest are told.

    Large groups are dealt in blocks, so no task holds a whole one. The
    counters have a fixed size; every shingle of every distinct set is counted.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = materialise(narrow.mapInArrow(_counted(width, seed), "id long, n int, node long, other long, part long, slice int, counts binary"))
    rows = first.filter("slice is null").select("id", "n", "node", "other")
    nodes = materialise(rows.filter("id is not null and n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.min("other").alias("low"), F.max("other").alias("high")))
    if nodes.filter("low <> high").limit(1).count():
        discard(nodes)
        discard(first)
        return similar_sets(docs, id_col=id_col, text_col=text_col, width=width, percent=percent, seed=seed + 1)

    slices = first.filter("slice is not null").select("part", "slice", "counts")
    for _ in range(2):
        slices = slices.withColumn("part", F.expr(f"part div {FAN_IN}")).repartition("part", "slice").mapInArrow(_added, "part long, slice int, counts binary")
    counts = np.zeros(COUNTERS, "i8")
    for r in slices.select(F.lit(0), "slice", "counts").collect():  # COUNTERS numbers, whatever the input
        counts[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] += _unpacked(r["counts"])
    counts = np.minimum(counts, 2**31 - 1).astype("i4")
    shared = share(spark, (counts, max(MANY, 4 * int(counts.mean()))))

    known = narrow.filter("id is not null")
    prefix = known.mapInArrow(_prefixes(shared, width, seed, percent), "h long, node long, size long, often boolean")
    # Lists of frequent shingles may be long: their rows are dealt by node, and kept unlooked at.
    prefix = prefix.repartition(F.when(F.col("often"), F.xxhash64("node", "h")).otherwise(F.col("h"))).sortWithinPartitions("often", "h")
    entries = prefix.mapInArrow(_shared_lists, "h long, node long, size long, often boolean")
    entries = entries.select("h", "node", F.shiftright("size", 32).cast("int").alias("n"), F.expr("size & 4294967295").alias("pos"))
    # Partners have at most `top` shingles: else too few are left after this place.
    entries = entries.withColumn("top", ((100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n")).withColumn("band", _band(F.col("n"), percent))
    up = F.col("top") >= F.pow(F.lit(100 / percent), F.col("band")) - 1e-6 * F.col("n") - 1
    low = F.explode(F.when(up, F.array("band", F.col("band") - 1)).otherwise(F.array(F.col("band") - 1)))
    lists = entries.select("h", low.alias("low"), "node", "n", "band", F.col("pos").cast("int").alias("pos")).distinct()
    stars = lists.repartition("h", "low").sortWithinPartitions("h", "low", "node").mapInArrow(_stars(percent), "lead long, node long, n long").distinct()
    stars = materialise(stars.join(nodes.select(F.col("node").alias("r_node"), "rep"), F.col("node") == F.col("r_node")).select("lead", "node", "n", "rep"))
    links = materialise(group_links(stars, known, width, seed, percent))
    discard(stars)
    for c in "ab":
        links = links.join(nodes.select(F.col("node").alias(f"node_{c}"), F.col("rep").alias(f"rep_{c}")), F.col(c) == F.col(f"node_{c}"))
    # A repeated id joins the sets of its rows.
    same = rows.filter("id is not null and n > 0").join(nodes.select(F.col("node").alias("k"), "rep"), F.col("node") == F.col("k")).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = links.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    doubled = rows.filter("id is not null").groupBy(F.col("id").alias("twice")).agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    links = links.unionByName(same.join(doubled, F.col("b") == F.col("twice"), "left_semi").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    named = components(links)
    classes = nodes.join(named.select(F.col("node").alias("c_node"), "component"), F.col("rep") == F.col("c_node"), "left").select(F.col("node").alias("class"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(classes, (F.col("node") == F.col("class")) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
