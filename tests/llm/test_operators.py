"""Operators of the llm subpackage against brute-force versions, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from functools import partial

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from docspindle.llm import decontam, lang_id, lm_score, mixing, pii, simhash, suffix_dedup, token_count, topk, toxicity
from docspindle.llm.common import crc_mod

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
#: Names that operators use inside.
CLASHES = "id fp row key ctx size n target rate part words word norm kind label score mark a b t_id item_id start window embedding n_entities surrogate x".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def awkward(spark):
    """Nulls, blanks, repeats, ties, a very long text, and clashing columns."""
    long = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60_000))
    base = [(1, "the same text here for all", "en", "s1"), (1, "the same text here for all", "en", "s1"), (2, None, "en", None), (3, "", None, "s1"), (4, " \t\n ", "fr", "s2"), (None, "no id at all here", "en", "s2"), (5, long, "en", "s2"), (6, "x" * 3000, "fr", None), (7, "🙂 Ünïcode ﷽ \u0000 ok", "fr", "s2")]
    df = spark.createDataFrame(base, "doc_id long, text string, lang string, source string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    return df


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "tokens": lambda s, d: token_count.count_tokens(d, BPE),
    "mixing": lambda s, d: mixing.mix_sources(d),
    "leaks": lambda s, d: decontam.benchmark_leaks(d, benchmark_of(s, [(1, "the same text here for all"), (2, None), (None, "x"), (3, "")])),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "lm": lambda s, d: lm_score.cross_entropy_difference(d, labels_of(s, [(1, 1, 0), (1, 1, 0), (None, 1, 1)])),
    "language": lambda s, d: lang_id.identify_language(d, PIECES),
    "pii": lambda s, d: pii.replace_pii(d, key="k"),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels_of(s, [(1, 1, 0), (2, 1, 1), (5, None, None)])),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    d = awkward(spark)
    got = OPERATORS[name](spark, d).collect()
    if name == "leaks":
        assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)]
    else:
        assert len(got) == d.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, awkward(spark).limit(0)).collect() == []


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    for chunk, overlap in ((32_768, 512), (300, 130)):
        got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(docs, BPE, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: len(tok.encode(t, add_special_tokens=False)) for i, t in rows.items()}


def test_token_counts_widen_overlaps():
    from tokenizers import Tokenizer

    tok, c, rng = Tokenizer.from_file(BPE), token_count.Counter(BPE, 200, 128), random.Random(2)
    texts = ["a" * 5000, " " * 3000 + "x", "<|endoftext|>" * 200, "ab <|endoftext|> c  d\n\n e" * 90]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "é", "1", "'s", "<|endoftext|>", "x" * 90]) for _ in range(800)) for _ in range(40)]
    assert c.counts(texts) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    assert c.widened > 0


def test_top_products(spark):
    rng = np.random.default_rng(5)
    v = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).tolist()) for i in range(700)] + [(700 + i, [0.5] * 8) for i in range(40)] + [(800, [0.0] * 8), (801, None), (802, [None] * 8), (803, [float("nan")] * 8), (804, [1.0, 2.0]), (0, None)]
    df = spark.createDataFrame(v + v[:9], "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("block", F.lit(1))
    got = {}
    for r in topk.top_products(df, block=64, query_block=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: np.floor(256 * np.array(x)).astype(int) for i, x in v if x is not None and all(y is not None and np.isfinite(y) for y in x)}
    for q in (i for i in ints if i % 50 == 0):
        best = sorted(((-int(ints[q] @ x), i) for i, x in ints.items() if i != q and len(x) == len(ints[q])))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_products(df.limit(0)).collect() == []


def test_mixing(spark, docs, rows):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(got) == sorted(again)
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows.items()}
    totals = Counter()
    for i, n in size.items():
        totals[sources[i]] += n
    names = sorted(totals, key=lambda x: x.encode())
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    left, share, open_ = 1.5 * sum(totals.values()), {}, set(names)
    while True:  # the excess of those above goes to the others by weight
        unit = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if unit * weight[n] > 2 * totals[n]}
        if not over:
            break
        for n in over:
            share[n] = 2.0 * totals[n]
            left -= share[n]
        open_ -= over
    share |= {n: unit * weight[n] for n in open_}
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == totals[sources[r["doc_id"]]] and r["target"] == pytest.approx(share[sources[r["doc_id"]]])
        taken[sources[r["doc_id"]]] += r["taken"]
    for n in names:
        assert abs(taken[n] - share[n]) <= max(size[i] for i in size if sources[i] == n)


def shares(totals, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by a loop: the excess of sources above their cap goes to the others by weight."""
    names = sorted(totals, key=lambda x: (x is None, (x or "").encode()))
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    left, out, open_ = Fraction(share) * sum(totals.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if unit * weight[n] > most * totals[n]}
        if not over:
            break
        for n in over:
            out[n] = most * totals[n]
            left -= out[n]
        open_ -= over
    return out | {n: unit * weight[n] for n in open_}


def test_targets_with_ties(spark):
    """Equal sizes over weights, null and empty sources among them."""
    rng = random.Random(8)
    cases = [{"a": 30, "b": 10, "c": 20}, {"x": 3, "y": 1}, {"a": 6, "b": 2, None: 4}, {"a": 0, "b": 0}, {"a": 0, None: 5}, {"a": 1}]
    cases += [dict(zip(rng.sample(["a", "b", "c", "d", "e", "f", None], k := rng.randint(2, 7)), rng.choices([0, 3, 6, 9, 10, 12, 20, 30], k=k))) for _ in range(25)]
    for totals in cases:
        hist = spark.createDataFrame([(s, n, 1) for s, n in totals.items()], "source string, size long, n long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(hist, (3, 1, 2), 1.5, 2).collect()}
        assert got == {n: pytest.approx(float(x)) for n, x in shares(totals).items()}


def test_mixing_with_ties(spark):
    """Three sources whose sizes go like their weights."""
    rows = [(i, " ".join(["w"] * k), s) for i, (s, k) in enumerate([("a", 3)] * 100 + [("b", 1)] * 100 + [("c", 2)] * 100)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = Counter()
    for r in got:
        taken[r["size"]] += r["taken"]
        assert r["target"] == 1.5 * r["source_size"]
    assert taken == {3: 450, 1: 150, 2: 300}


def test_rates_are_tilted(spark):
    """min(most, exp(lam * size)) meets the target, for targets below and above the size."""
    rng = random.Random(6)
    hist = [(s, n, rng.randint(1, 9)) for s in ("up", "down", None) for n in rng.sample(range(1, 400), 60)]
    sizes = Counter()
    for s, n, k in hist:
        sizes[s] += n * k
    share = {"up": 1.7, "down": 0.4, None: 1.02}
    targets = spark.createDataFrame([(s, x, x * share[s]) for s, x in sizes.items()], "source string, source_size long, target double")
    duals = {r["source"]: r for r in mixing.balance(spark.createDataFrame(hist, "source string, size long, n long"), targets, 2.0).collect()}
    for s, x in sizes.items():
        d = duals[s]
        got = sum(k * n * min(2.0, np.exp(d["lam"] * n / d["scale"])) for t, n, k in hist if t == s)
        assert got == pytest.approx(x * share[s], rel=1e-5)


def _components(fps, radius):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash(spark, docs, rows):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fp(t) for i, t in rows.items()}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == _components(fps, 4)


def test_covering_masks_cover():
    masks, rng = simhash.covering_masks(4), random.Random(7)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(bits & (m & (2**64 - 1)) == 0 for m in masks)


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(3)
    centre = rng.getrandbits(62)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 6))) for _ in range(120)}
    table = spark.createDataFrame([(x, k) for k, x in enumerate(sorted(fps))], "fp long, node long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(table, 4)).collect()}
    want = _components(dict(enumerate(sorted(fps))), 4)
    assert {k: found.get(k, k) for k in want} == want


def test_leaks(spark, rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(12, 60))] for i in range(12)} | {90: ["alone", "three", "words"], 91: ["rep"] * 20}
    texts = {}
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 2:
            x = list(items[rng.choice(list(items))])
            if i % 4 == 1:
                x[-1] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = x
        texts[i] = " ".join(w).upper() if i % 3 else ", ".join(w)

    def shingles(w, k):
        return Counter(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))

    want = set()
    for i, t in texts.items():
        w = re.findall(r"\w+", t.lower())
        for j, x in items.items():
            k, n = min(5, len(x)), min(len(x), len(w))
            y = shingles(x, k)
            best = max((sum((z & y).values()) / sum((z | y).values()) for z in (shingles(w[s : s + n], k) for s in range(len(w) - n + 1))), default=0)
            if n and best >= 0.8:
                want.add((i, j, round(best, 9)))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    b = benchmark_of(spark, [(j, " ".join(x)) for j, x in items.items()])
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontam.benchmark_leaks(d, b).collect()}
    assert len(want) > 20 and got == want


def test_leaks_with_insertions(spark):
    """Edits near the threshold against all windows: shifted parts lose no leak."""
    rng = random.Random(11)
    word = iter(f"u{i}" for i in range(10_000))
    fresh = lambda n: [next(word) for _ in range(n)]
    a, b, c = fresh(32), fresh(25), fresh(32)
    items = {1: a + b + c, 2: a + fresh(10) + c, 3: c + fresh(7) + a} | {i: fresh(rng.randint(46, 100)) for i in range(4, 14)}
    texts = {1: " ".join(a + ["x"] + b + c[1:])}
    for i in range(2, 62):
        x = list(items[rng.choice(list(items))])
        for _ in range(rng.randint(1, 2)):
            at, kind = rng.randrange(len(x)), rng.randrange(3)
            x[at : at + (kind > 0)] = fresh(1) if kind < 2 else []
        texts[i] = " ".join(fresh(rng.randint(0, 20)) + x + fresh(rng.randint(0, 20)))

    def shingles(w):
        return Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4))

    want = {}
    for i, t in texts.items():
        w = t.split()
        for j, x in items.items():
            y, n = shingles(x), min(len(x), len(w))
            best = max(sum((z & y).values()) / sum((z | y).values()) for z in (shingles(w[s : s + n]) for s in range(len(w) - n + 1)))
            if best >= 0.8:
                want[i, j] = round(best, 9)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.benchmark_leaks(d, benchmark_of(spark, [(j, " ".join(x)) for j, x in items.items()])).collect()}
    assert want[1, 1] == 0.808510638 and len(want) > 15 and got == want


def test_leaks_without_broadcast(spark, monkeypatch, docs):
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(decontam.benchmark_leaks(docs, b).collect())
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(decontam.benchmark_leaks(docs, b).collect()) == want and want


def brute_losses(words, of):
    """Mean loss of each list of words by pair counts over the lists that `of` chooses, with edges."""
    chains = [["", *x, ""] for x in words if x]
    v = len({w for x in chains for w in x})
    pairs = Counter(p for i, x in enumerate(words) if x and of(i) for p in zip(["", *x], [*x, ""]))
    before, single = Counter(), Counter()
    for (a, b), n in pairs.items():
        before[a] += n
        single[b] += n
    total = sum(single.values())

    def p(a, b):
        one = single[b] / total if total else 1 / v
        return 0.7 * (pairs[a, b] / before[a] if before[a] else one) + 0.29 * one + 0.01 / v

    return [-np.mean([np.log(p(a, b)) for a, b in zip(["", *x], [*x, ""])]) if x else None for x in words]


def test_lm_scores(spark, docs, rows):
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    chosen = {r["doc_id"] for r in good.collect()}
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, good).collect()}
    words = [(t or "").lower().split() for t in rows.values()]
    ids = list(rows)
    back, target = brute_losses(words, lambda i: True), brute_losses(words, lambda i: ids[i] in chosen)
    for i, x, b, t in zip(ids, words, back, target):
        r = got[i]
        assert (r["n_words"], r["background_loss"], r["target_loss"]) == (len(x), *(y and pytest.approx(y, rel=1e-9) for y in (b, t)))
        assert r["score"] == pytest.approx(b - t if x else 0, abs=1e-9)


def test_segmentations_are_summed(monkeypatch):
    """Whole words and all pieces, against sums over every segmentation; short and long words alike."""
    words = ["abab", "b", "zz", "abababab" * 9, "", "ababzabba" * 3]
    p = np.abs(np.random.default_rng(1).normal(size=(8, 2))) / 3
    pieces = lang_id.Pieces(["▁", "a", "b", "ab", "▁a", "ababababab", "babzab"])
    last = len(pieces.pieces)

    def paths(text):
        """Every segmentation with its probability."""
        if not text:
            yield (), np.ones(2)
        for n in range(1, len(text) + 1):
            k = pieces.pieces.index(text[:n]) if text[:n] in pieces.pieces else last if n == 1 else None
            if k is not None:
                for rest, x in paths(text[n:]):
                    yield (k, *rest), p[k] * x

    def total(text):
        alpha = np.zeros((len(text) + 1, 2))
        alpha[0] = 1
        for j in range(1, len(text) + 1):
            for i in range(j):
                x = text[i:j]
                if x in pieces.pieces or j - i == 1:
                    alpha[j] += alpha[i] * p[pieces.pieces.index(x) if x in pieces.pieces else last]
        return alpha[-1]

    counts = np.array([2.0, 1, 1, 0, 3, 0])
    want = np.zeros_like(p)
    for w, n in zip(words, counts):
        every = list(paths("▁" + w)) if n else []
        whole = sum(x for _, x in every)
        for path, x in every:
            for k in path:
                want[k] += n * x / whole
    for most in (64, 0):
        monkeypatch.setattr(lang_id, "WORD", most)
        got = lang_id.log_likelihoods(words, pieces, p)
        for i, w in enumerate(words):
            assert got[i] == pytest.approx(np.log(total("▁" + w)))
        assert lang_id.expected_counts(words, counts, pieces, p) == pytest.approx(want)


def test_languages_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify_language(d, PIECES, per_language=60).join(d.select("doc_id", "lang"), "doc_id").filter(crc_mod("doc_id", 5) == 0)
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("s")).first()
    assert r["a"] > 0.98 and 0 <= r["s"] <= 1


def test_surrogates(spark):
    texts = [
        (1, "Write to Ana.Gil@mail.example.com or ANA.GIL@MAIL.EXAMPLE.COM, call +1 (414) 555-1791."),
        (2, "ana.gil@mail.example.com pays with 4111 1111 1111 1111 and 4111111111111111 from 10.1.2.3"),
        (3, 'Mrs Anna Smith met Mr. Smith and Herr Иван Петров; token = "7c72db563d7f6e50cec00950f7bab1f2223b6afd"'),
        (4, "nothing here 12 or 2024"),
    ]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.replace_pii(d, key="k").collect()}
    assert {i: r["n_entities"] for i, r in out.items()} == {1: 3, 2: 4, 3: 4, 4: 0} and out[4]["text"] == texts[3][1]
    mail = re.search(r"\S+@\S+(?=[ ,])", out[1]["text"])[0]
    assert mail.lower() in out[2]["text"] and mail != "Ana.Gil@mail.example.com"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.", out[1]["text"]) and "555-1791" not in out[1]["text"]
    spaced, plain = re.search(r"(?:\d{4} ){3}\d{4}", out[2]["text"])[0], re.search(r"\d{16}", out[2]["text"])[0]
    digits = [int(c) for c in plain]
    assert spaced.replace(" ", "") == plain != "4111111111111111"
    assert sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(digits))) % 10 == 0
    _, first, last = re.match(r"(Mrs) (\S+) (\S+) met", out[3]["text"]).groups()
    assert f"Mr. {last} and" in out[3]["text"] and first[-1] in "aeiou" and last != "Smith"
    assert re.search(r"Herr [А-Яа-я]+ [А-Яа-я]+;", out[3]["text"])
    assert len(re.search(r'"([0-9a-f]{40})"', out[3]["text"])[1]) == 40
    other = {r["doc_id"]: r["text"] for r in pii.replace_pii(d, key="another").collect()}
    assert other[1] != out[1]["text"]


def test_surrogates_stay_distinct(spark):
    e = spark.range(3000).select(F.lit("last").alias("kind"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("norm"))
    short = spark.createDataFrame([("first_f", a + b + c) for a in "abcdef" for b in "xyzuvw" for c in "mnopqr"], "kind string, norm string")
    for table in (e, short):
        got = pii.surrogates(table, "k").collect()
        sur = {(r["kind"], r["surrogate"].lower()) for r in got}
        assert len(sur) == len(got) and not sur & {(r["kind"], r["norm"]) for r in got}


def test_crowded_surrogates_grow(spark):
    """All numbers of two digits are taken, so surrogates get longer; none fails."""
    every = spark.range(100).select(F.explode(F.array(F.lit("phone"), F.lit("ssn"), F.lit("secret"))).alias("kind"), F.lpad(F.col("id").cast("string"), 2, "0").alias("norm"))
    got = pii.surrogates(every, "k").collect()
    assert len(got) == 300 == len({(r["kind"], r["surrogate"]) for r in got})
    assert all(len(r["surrogate"]) > 2 for r in got if r["kind"] != "secret")


def test_formats_hold(spark, capsys):
    texts = [
        "call +1 (414) 555-1791 or (414) 555-1791 or 414-555-1791, +49 (0)30 1234567 is 030 1234567",
        "pay DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819",
        "from 2001:db8::8a2e:370:7334 and fe80:0:0:0:1:2:3:4 at 12:30:45, std::vec",
        "My name is Anna Lena Berg. Berg said so. Contact: Öz Demir; Ich heiße Jürgen",
    ]
    d = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_entities int")
    frame = pii.replace_pii(d, key="secret'key\\\\")
    frame.explain("extended")
    plan = capsys.readouterr().out
    own = pii._keys(spark, "secret'key\\\\").first()
    assert "secret'key" not in plan and own["inner"].hex().upper() not in plan.upper()
    rows = sorted(frame.collect())
    assert [r["n_entities"] for r in rows] == [-1] * 4
    out = [r["text"] for r in rows]
    a = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4})", out[0]).groups()[::2]
    assert len(set(a)) == 1 and len(set(re.findall(r"\d{3}-\d{4}", out[0]))) == 1 and "555-1791" not in out[0]
    one, two = re.search(r"\+49 \(0\)(\d\d) (\d{7})", out[0]).groups()
    assert out[0].endswith(f"0{one} {two}") and two != "1234567"
    for x in (re.search(r"DE[\d ]+", out[1])[0], re.search(r"GB\w+", out[1])[0]):
        x = x.replace(" ", "")
        assert int("".join(str(int(ch, 36)) for ch in x[4:] + x[:4])) % 97 == 1 and x not in texts[1].replace(" ", "")
    assert re.fullmatch(r"from [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4} and [0-9a-f:]+ at 12:30:45, std::vec", out[2]) and "7334" not in out[2]
    assert not set(re.findall(r"\w+", out[3])) & {"Anna", "Lena", "Berg", "Öz", "Demir", "Jürgen"} and out[3].startswith("My name is ")
    last = re.match(r"My name is \w+ \w+ (\w+)\. (\w+) said", out[3])
    assert last[1] == last[2]


def test_nearest_examples_are_exact():
    rng, n, v = np.random.default_rng(2), 500, 40
    vectors = [(np.sort(rng.choice(v, rng.integers(0, 6), replace=False)), None) for _ in range(n)]
    vectors = [(t, rng.integers(1, 4, len(t))) for t, _ in vectors]
    idf = rng.uniform(0.5, 3, v)
    index = toxicity.Index(list(range(n)), list(rng.integers(0, 2, n)), [1.0] * n, vectors, idf)
    dense = np.zeros((len(index.rows), v))
    for i, (t, w) in enumerate(index.rows):
        dense[i, t] = w
    for t, c in vectors[:80]:
        at, cos = index.nearest(*index.unit(t, c))
        q = np.zeros(v)
        q[index.unit(t, c)[0]] = index.unit(t, c)[1]
        score = dense @ q
        order = np.lexsort((index.ids, -np.round(score, 9)))
        want = [i for i in order if score[i] > 1e-12][: toxicity.NEIGHBOURS]
        assert at.tolist() == want and np.allclose(cos, score[want])


def test_toxicity_held_out(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(d, l).join(l.select("doc_id", "toxic"), "doc_id").filter(crc_mod("doc_id", 3) == 1)
    c = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) > 0.8 and c.get((0, 1), 0) / c[0, 0] < 0.02


def _brute_removed(texts, window):
    seen = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group, levels, gather", [(128, 3, 1024), (2, 3, 1), (1, 1, 4), (1, 0, 1), (2, 0, 1024)])
def test_repeats(spark, monkeypatch, group, levels, gather):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "GATHER", gather)
    monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
    rng = random.Random(group)
    passages = ["".join(rng.choice("abc ") for _ in range(rng.randint(10, 80))) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(passages), rng.choice("abcé\0") * rng.randint(1, 5)]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts += ["aaaa" * 30, "ab" * 70, None, "", texts[0], texts[0], "a" * 19, "a" * 20]
    d = spark.createDataFrame([(i if i != 3 else 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(d, window=20, k=8).collect()
    want = _brute_removed([(t or "").encode() for t in texts], 20)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)


def test_suffix_array():
    rng = random.Random(9)
    for _ in range(60):
        base = bytes(rng.choice(b"ab\0\xff") for _ in range(60))
        some = [base[rng.randint(0, 10) : rng.randint(30, 60)] for _ in range(rng.randint(1, 6))]
        count = Counter(c[i : i + 15] for c in some for i in range(len(c) - 14))
        assert [g.tolist() for g in suffix_dedup.repeated_starts(some, 15)] == [[i for i in range(len(c) - 14) if count[c[i : i + 15]] > 1] for c in some]


@pytest.mark.parametrize("block, part, cut", [(500_000, 1_000_000, 1 << 22), (50, 10, 30)])
def test_lm_scores_over_all_words(spark, monkeypatch, block, part, cut):
    """Rare words count by themselves; documents in pieces, blocks and parts change nothing."""
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score, "PART", part)
    monkeypatch.setattr(lm_score, "SLICE", cut)
    rng = random.Random(8)
    frequent = [f"w{i}" for i in range(1500)]
    texts = {i: " ".join(rng.sample(frequent, 400) + ["the\u00a0end"] * 30) for i in range(30)}
    texts |= {100: "rare kestrel Feather", 101: "other granite pebble", 102: "rare kestrel feather", 103: "", 104: None}
    texts |= {2**60 + 1: " ".join(str(i) for i in range(50))}
    d = spark.createDataFrame([*texts.items(), (102, texts[102]), (102, "the end"), (None, "pebble")], "doc_id long, text string")
    got = Counter()
    for r in lm_score.cross_entropy_difference(d, labels_of(spark, [(100, 1, 0), (3, 1, 0), (None, 1, 1)])).collect():
        got[r["doc_id"], r["n_words"], *(x and round(x, 9) for x in (r["background_loss"], r["target_loss"]))] += 1
    ids, words = zip(*[(r["doc_id"], (r["text"] or "").lower().split()) for r in d.collect()])
    back, target = brute_losses(words, lambda i: True), brute_losses(words, lambda i: ids[i] in (100, 3))
    assert got == Counter((i, len(x), *(y and round(y, 9) for y in (b, t))) for i, x, b, t in zip(ids, words, back, target))


NAMES = {
    "Mr John Michael Smith came. Smith said that John Smith's car was SMITH'S.": "john michael smith",
    "Mrs Maria Garcia Lopez and Ms Garcia; Lopez": "maria garcia lopez",
    "Frau Dr. Schmidt und Herr von Braun, Braun-Werke": "schmidt braun",
    "Senor de la Cruz, Señora De La Vega. La casa": "cruz vega",
    "Herr Prof. Dr. Karl-Heinz Müller, Dr. Weber": "karl heinz müller weber",
    "Mr J. F. McDonald met Miss O'Brien": "mcdonald brien",
}
PHONES = ["1-800-555-1234", "Tel.414-555-1791", "x-414-555-1791", "06 12 34 56 78", "0612345678", "612 345 678", "030 1234567", "0171/1234567", "020 7946 0958", "(030) 1234567", "+49 (0)30 1234567"]


def test_names_and_phones_leave_nothing(spark):
    texts = [*NAMES, *PHONES, "in 2024 12 345 678 901 of 1.414-2 and 01-02-2024, Smith and Braun"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r["text"] for r in pii.replace_pii(d, key="k").orderBy("doc_id").collect()]
    for new, (old, names) in zip(out, NAMES.items()):
        assert not set(re.findall(r"\w+", new.lower())) & set(names.split()), new
        assert re.sub(r"[^\W]+", "", new) == re.sub(r"[^\W]+", "", old) or "-" in old or "'" in old
    for new, old in zip(out[len(NAMES) :], PHONES):
        assert new != old and re.sub("[0-9]", "#", new) == re.sub("[0-9]", "#", old), new
    assert out[-1] == texts[-1]
    first, last, alone = re.match(r"Mr (\w+) \w+ (\w+) came\. (\w+) said", out[0]).groups()
    assert alone == last and f"{first} {last}'s" in out[0] and f"{last.upper()}'S" in out[0]
    _, second, third = re.match(r"Mrs (\w+) (\w+) (\w+) and", out[1]).groups()
    assert out[1].endswith(f"Ms {second}; {third}")
    assert out[2].startswith("Frau Dr. ") and "Herr von " in out[2] and out[2].endswith("-Werke")
    assert "Senor de la " in out[3] and out[3].endswith(". La casa")


def test_secrets_and_other_scripts(spark):
    """Planted secrets, addresses and names are gone, formats and the rest stay, and equal ones stay equal."""
    rng = random.Random(9)
    some = lambda n, of="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(of) for _ in range(n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    secrets = ["hunter2", "p@ss-w0rd", some(12) + "7", "AKIA" + some(16, upper), "ghp_" + some(36), "sk-" + some(40), "xoxb-" + some(20), "eyJ" + some(20) + "." + some(30) + "." + some(20)]
    given = [f"password: {x}" for x in secrets[:3]] + [f'API_KEY="{secrets[2]}", next', f"contraseña = {secrets[0]}."]
    others = {"мария@почта.рф": 1, "müller@bücher.example": 1, "王小明": 1, "Иванов": 1, "Παπαδόπουλος": 1}
    texts = given + [f"see {x} there" for x in secrets[3:]] + ["mail мария@почта.рф or müller@bücher.example", "Name: 王小明", "Г-н Иванов and Κύριος Παπαδόπουλος"]
    clean = ["the secret: never tell anyone", "a token: of thanks", "password policy is strict", "sk-ill and AKIA", "clave: de sol", "王小明在这里"]
    rows = list(enumerate(texts + clean))
    got = [r["text"] for r in sorted(pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect())]
    for secret in [*secrets, *others]:
        assert not any(secret in g for g in got[: len(texts)]), secret
    assert got[len(texts) :] == clean
    assert [re.sub(r"[^\W_]", "x", g) for g in got[: len(texts)]] == [re.sub(r"[^\W_]", "x", t) for t in texts]
    for g, t in zip(got, texts):
        assert [c.isdigit() for c in g] == [c.isdigit() for c in t] or "eyJ" in t or "AKIA" in t
    # One secret in two texts, and a name's script.
    assert got[2].split(": ")[1] == got[3].split('"')[1] and got[0].split(": ")[1] == got[4].split("= ")[1].rstrip(".")
    assert got[5].startswith("see AKIA") and got[6].startswith("see ghp_")
    assert re.fullmatch(r"Name: [\u4e00-\u9fff]{3}", got[-len(clean) - 2]) and re.match(r"Г-н [А-Яа-я]+ and Κύριος [Α-Ωα-ω]+$", got[-len(clean) - 1])
    with pytest.raises(ValueError):
        pii.replace_pii(spark.createDataFrame(rows[:1], "doc_id long, text string"), key="")
