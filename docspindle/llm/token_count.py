"""Exact token counts of whole texts, huge ones included, by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that the pre-tokeniser may look at past the end of a piece: the
#: longest special string, and the white space that a following word would claim.
GUARD = 64
#: Remembered counts of pieces per worker; the memo is emptied when it is full.
MEMO = 400_000


class Counter:
    """Counts the tokens of texts with one tokenizer file.

    A text up to `chunk` characters is cut at single spaces between two visible
    characters. There the pre-tokeniser always starts a new word, so the pieces
    encode alike alone and in place, and a piece's count is remembered.

    A longer text is encoded in overlapping chunks with offsets. Chunk k+1 is
    spliced to chunk k at the first position that starts a word in both and lies
    a guard away from chunk k's end: words are found from left to right without
    memory, so from there on both must agree. If the overlap has no such position
    (one endless word), it is doubled until it has one or the text ends.
    """

    def __init__(self, path: str, chunk: int, overlap: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.overlap = chunk, max(overlap, 2 * GUARD)
        self.memo: dict[str, int] = {}
        self.widened = 0

    def encode(self, texts: list[str]) -> list:
        return self.tok.encode_batch(texts, add_special_tokens=False)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """`text` cut before each single space that has visible neighbours."""
        parts = text.split(" ")
        first, rest = parts[0], parts[1:]
        if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
            return [first, *[" " + p for p in rest]]
        out, open_ = [first], bool(first) and not first[-1].isspace()
        for p in rest:
            if open_ and p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
            open_ = bool(p) and not p[-1].isspace()
        return out

    def counts(self, texts: Iterable[str]) -> list[int]:
        texts = list(texts)
        cut = [None if len(t) > self.chunk else self.pieces(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = list({p for ps in cut if ps for p in ps if p not in memo})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            memo.update(zip(part, map(len, self.encode(part))))
        get = memo.__getitem__
        return [self.long(t) if ps is None else sum(map(get, ps)) for t, ps in zip(texts, cut)]

    @staticmethod
    def starts(enc, base: int) -> dict[int, int]:
        """Where words start -> index of their first token."""
        out, last = {}, None
        for i, (word, (a, _)) in enumerate(zip(enc.word_ids, enc.offsets)):
            if word != last:
                out[base + a] = i
                last = word
        return out

    def long(self, text: str) -> int:
        total, at, n = 0, 0, len(text)
        end = min(n, self.chunk)
        enc = self.encode([text[at:end]])[0]
        first = 0
        while end < n:
            overlap = self.overlap
            while True:
                begin, known = max(end - overlap, at), self.starts(enc, at)
                stop = min(n, max(end + self.chunk - overlap, end + 1))
                nxt = self.encode([text[begin:stop]])[0]
                ahead = self.starts(nxt, begin)
                meet = next((p for p in sorted(known) if begin < p <= end - GUARD and known[p] >= first and p in ahead), None)
                if meet is not None:
                    break
                # No word starts in both: encode further from the same start.
                self.widened += 1
                overlap = 2 * overlap
                end = min(n, end + overlap)
                enc = self.encode([text[at:end]])[0]
                if end == n:
                    return total + len(enc) - first
            total += known[meet] - first
            enc, at, end, first = nxt, begin, stop, ahead[meet]
        return total + len(enc) - first


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    chunk: int = 32_768,
    overlap: int = 512,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`.

    One narrow pass without a shuffle; memory is bounded by a batch of texts.
    A null text counts as empty; repeated rows give repeated rows; a null id
    stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(tokenizer_path, chunk, overlap)
        for b in batches:
            counts, texts = [], b.column(1)
            for i in range(0, len(texts), 1000):
                counts += counter.counts(t or "" for t in texts.slice(i, 1000).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
