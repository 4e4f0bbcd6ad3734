"""Alignment, whitening and the Jaccard join against brute-force versions, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docspindle.llm import alignment, jaccard, queries, whitening

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
CLASHES = "id row side window ends ids block key count best a b n node h pos lead part shared component deviation whitened v dim own rep slice other".split()


def with_clashes(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    return df


def brute_alignment(texts):
    """A walk over the tokens of both sides, one after another."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_tok.encode_special_tokens = True
    alphabet, names = alignment.byte_alphabet(), {i: t for t, i in a_tok.get_vocab().items()}
    found, count = [], Counter()
    for t in texts:
        found.append(None)
        if not t:
            continue
        a, b, whole = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t), (" " + t).encode()
        a_bytes = [bytes(alphabet[c] for c in names[i]) if all(c in alphabet for c in names[i]) else names[i].encode() for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b_tok.id_to_piece, b)]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        i = j = 0
        links, groups, own = [], [], ([a[0]], [b[0]])
        while True:
            links.append((a[i], b[j]))
            if a_end[i] == b_end[j]:
                groups.append(own)
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                own = ([a[i]], [b[j]])
            elif a_end[i] < b_end[j]:
                i += 1
                own[0].append(a[i])
            else:
                j += 1
                own[1].append(b[j])
        count.update(links)
        found[-1] = (len(a), len(b), groups, links)
    best = defaultdict(int)
    for (_, y), c in count.items():
        best[y] = max(best[y], c)
    for r in found:
        if r is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in r[2])
        yield (r[0], r[1], len(r[2]), len(r[3]), sum(count[p] == best[p[1]] for p in r[3]), sum(count[p] for p in r[3]), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("window, sweep, block, limit", [(1 << 16, 1 << 20, 2_000_000, 2_000_000), (50, 200, 3000, 0)])
def test_alignment(spark, monkeypatch, window, sweep, block, limit):
    for k, v in (("WINDOW", window), ("SWEEP", sweep), ("BLOCK", block)):
        monkeypatch.setattr(alignment, k, v)
    rng = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += [None, "", " ", "a▁b", "<s> hello <|endoftext|> x</s>", "日本語 🙂🙂", "  two  spaces \n\n x ", "x" * 20_000, " ".join(f"w{i}" for i in range(6000)), "<0x41> A", "ﬁ \u0000 z"]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "é", "1", "'s", "<|endoftext|>", "漢", "▁x", "zq"]) for _ in range(300)) for _ in range(20)]
    texts += texts[:5]
    df = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {r[0]: tuple(r)[1:] for r in alignment.align_tokenizers(df, BPE, PIECES, pairs_limit=limit).collect()}
    assert got == dict(enumerate(brute_alignment(texts)))


def test_alignment_of_awkward_tables(spark):
    df = with_clashes(spark.createDataFrame([(None, "no id"), (1, "twice"), (1, "twice"), (None, None)], "doc_id long, text string"))
    got = alignment.align_tokenizers(df, BPE, PIECES).collect()
    assert len(got) == 4 and len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    assert alignment.align_tokenizers(df.limit(0), BPE, PIECES).collect() == []


@pytest.mark.parametrize("fan_in", [2, 64])
def test_whitening(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    v = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    more = [(-1, None), (-2, [None] * len(v[0][1])), (-3, [float("nan")] * len(v[0][1])), (-4, [float("inf")] * len(v[0][1])), (10**9, v[0][1])]
    df = with_clashes(df.unionByName(spark.createDataFrame(more, df.schema))).repartition(5)
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    v = sorted([*v, (10**9, v[0][1])])
    x = np.floor(64 * np.array([y for _, y in v], "f8")) + 1_000_000
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    want, had = c @ u / np.sqrt(e), got["whitened"].to_numpy().reshape(-1, 32)
    assert got["vec_id"].tolist() == [i for i, _ in v for _ in range(32)]
    assert np.abs(had * np.sign((had * want).sum(0)) - want).max() < 1e-8
    assert np.allclose(got["explained"][:32], e / np.trace(c.T @ c / len(x)), rtol=1e-9)
    assert 0 < got["identity_error"].iloc[0] < 1e-9 and got["identity_error"].nunique() == 1 and set(got["n"]) == {len(v)}
    total = x.astype(int).sum(0)
    assert got["deviation"].to_numpy()[::32].astype(int).tolist() == ((len(v) * x.astype(int) - total) ** 2).sum(1).tolist()


def test_whitening_of_awkward_tables(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [5.0, 1e300]), (6, []), (7, [1.0] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 4, None: 2, 7: 32}
    assert all(r["whitened"] == 0 and r["identity_error"] == 1 for r in got if r["vec_id"] == 7)
    assert all(np.isfinite(r["whitened"]) for r in got)
    assert whitening.whiten(df.limit(0)).collect() == []


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    by, shared, up = defaultdict(list), Counter(), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    for places in by.values():
        shared.update((a, b) for i, a in enumerate(places) for b in places[i + 1 :])
    for (a, b), k in shared.items():
        if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
            up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least[top(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("star, shingles, many", [(2048, 4_000_000, 1000), (7, 2000, 3)])
def test_jaccard_join(spark, monkeypatch, star, shingles, many):
    for k, v in (("STAR", star), ("STAR_SHINGLES", shingles), ("MANY", many), ("LIST", many)):
        monkeypatch.setattr(jaccard, k, v)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base, chain, passage = some(120), some(100), some(80)
    for _ in range(120):  # a loose group
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    for k in range(40):  # each like the one before, not like the first
        texts.append(" ".join(chain))
        chain[k] = rng.choice(words)
    texts += [" ".join(some(rng.randint(0, 60)) + passage + some(rng.randint(0, 10))) for _ in range(150)]
    texts += [" ".join(rng.choice(["a", "B", "c"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [None, "", " \t", None, "One", "one", "one two", "x" * 50_000]
    rows = list(enumerate(texts))
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(tuple(r) for r in jaccard.similar_sets(df).collect()) == brute_components(rows)


def test_jaccard_join_of_awkward_tables(spark):
    rows = [(5, "a b c d e"), (None, "a b c d e"), (3, "x y z u v"), (5, "x y z u v"), (4, None), (4, "a b c d e"), (9, "")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in jaccard.similar_sets(df).collect()), key=str)
    # Ids 3, 4 and 5 are joined by the two texts of 5; the row without an id joins nothing.
    assert got == sorted([(5, 2, 3), (None, 2, None), (3, 2, 3), (5, 2, 3), (4, 0, 4), (4, 2, 3), (9, 0, 9)], key=str)
    assert jaccard.similar_sets(df.limit(0)).collect() == []


def test_jaccard_join_like_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(tuple(r) for r in queries.op11_jaccard_join(spark, SF).collect()) == sorted(c.sql(queries.OP11_SQL).fetchall())
