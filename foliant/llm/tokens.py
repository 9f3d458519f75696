"""Token counts by prefix dynamic programming.

For byte-pair encoding, exactly one token can end the encoding of a prefix so that it stays
the encoding that the merges give: the one that neither changes alone nor with the token before it. So
the count at a prefix is the count where that token begins, plus one. The table over all
prefixes of a text answers how many tokens any cut keeps, and where to cut for a budget,
without encoding again. Pieces (what the vocabulary's pattern separates) are encoded apart, so a text's
table is the running sum over its pieces' tables; pieces recur and are memoised, and so are
prefixes, which pieces share.

Everything is within a row: no shuffle, whole texts.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BYTES, LIMIT, NEIGHBOURS, UNUSUAL, Vocabulary, mapped
from .common import Memo, map_batches

SPACE = BYTES[32]


class PrefixCounter:
    """Counts for a byte-level vocabulary whose pieces the public pattern `PATTERN` separates."""

    def __init__(self, path: str, limit: int = 288 << 20):
        """limit: about how many bytes the memos take."""
        import public_tokenizers
        import regex

        self.v, self.most = Vocabulary(path), max(100, limit // 2 // 260)
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.ids, self.longest = self.v.ids, self.v.longest
        #: What tokens end with, and the token itself where it is one.
        self.ends = {t[i:]: "" for t in self.ids for i in range(1, len(t))} | {t: t for t in self.ids}
        self.pairs: Memo = Memo(lambda p: self.v.tokens(p[0] + p[1]) == [t for t in p if t], limit // 3, 330)
        self.prefixes: dict[str, tuple[int, str]] = {"": (0, "")}
        self.spaced: Memo = Memo(lambda c: self.count_piece(SPACE + mapped(c)) if c.isalpha() else self.count_chunk(" " + c), limit * 7 // 16)
        self.first: Memo = Memo(self.count_chunk, limit // 16)

    def grow(self, piece: str, known: dict[str, tuple[int, str]]) -> tuple[int, str]:
        """Fill in known[prefix] = (count, last token) for each prefix of a piece that lacks it; the piece's own is returned."""
        if len(known) > self.most:
            known.clear()
            known[""] = (0, "")
        k, ends, pairs = len(piece) - 1, self.ends, self.pairs
        while piece[:k] not in known:
            k -= 1
        for j in range(k + 1, len(piece) + 1):
            prefix = piece[:j]
            found, i = [], j - 1
            while i >= 0 and (token := ends.get(prefix[i:])) is not None:
                if token:
                    found.append(token)
                i -= 1
            while True:  # exactly one of the tokens that end here is right
                token = found.pop()
                count, last = known[prefix[: j - len(token)]]
                if pairs[last, token]:
                    break
            known[prefix] = (count + 1, token)
        return known[piece]

    def table(self, piece: str) -> list[int]:
        """Token counts at each prefix of a piece (written as the vocabulary writes bytes), from none to all."""
        if len(piece) <= LIMIT:
            self.grow(piece, self.prefixes)
            return [self.prefixes[piece[:j]][0] for j in range(len(piece) + 1)]
        # a window of prefixes is enough, and prefixes of a long piece are not kept
        counts, lasts, ids, pairs = [0], [""], self.ids, self.pairs
        for j in range(1, len(piece) + 1):
            for i in range(max(0, j - self.longest), j):
                if (token := piece[i:j]) in ids and pairs[lasts[i], token]:
                    counts.append(counts[i] + 1)
                    lasts.append(token)
                    break
        return counts

    def count_piece(self, piece: str) -> int:
        node = self.prefixes.get(piece)
        if node:
            return node[0]
        return self.grow(piece, self.prefixes)[0] if len(piece) <= LIMIT else self.table(piece)[-1]

    def count_chunk(self, chunk: str) -> int:
        return sum(self.count_piece(mapped(p)) for p in self.pieces.findall(chunk))

    def split(self, text: str) -> list[str | None]:
        """A text's pieces as the vocabulary writes them; None stands for a special token."""
        out: list[str | None] = []
        at = 0
        for m in [*self.v.special.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                if UNUSUAL.search(part):
                    out += [p for p, _ in self.v.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
                else:
                    out += map(mapped, self.pieces.findall(part))
            if m:
                out.append(None)
                at = m.end()
        return out

    def count(self, text: str) -> int:
        """All tokens of a text."""
        if not text:
            return 0
        if "<|" in text or UNUSUAL.search(text) or NEIGHBOURS.search(text):
            total = sum(1 if p is None else self.count_piece(p) for p in self.split(text))
        else:
            chunks = text.split(" ")
            total = self.first[chunks[0]] + sum(map(self.spaced.__getitem__, chunks[1:]))
        return total


class Prefixes:
    """The counts of one text at the byte offset of each prefix of its encoding.

    at(n): tokens of the encoding that lie within the first n bytes, plus those that the cut piece's part takes.
    fits(budget): the most bytes whose tokens stay within a budget.
    Both take the pieces as the whole text has them, so what they say holds for a truncation of the encoded text.
    """

    def __init__(self, counter: PrefixCounter, text: str):
        pieces = counter.split(text)
        special = iter(m[0] for m in counter.v.special.finditer(text))
        self.tables = [[0] * len(next(special).encode()) + [1] if p is None else counter.table(p) for p in pieces]
        self.starts = [0, *accumulate(len(t) - 1 for t in self.tables)]
        self.counts = [0, *accumulate(t[-1] for t in self.tables)]

    def at(self, n: int) -> int:
        n = max(0, min(n, self.starts[-1]))
        i = min(bisect_right(self.starts, n) - 1, len(self.tables) - 1)
        return self.counts[i] + self.tables[i][n - self.starts[i]] if self.tables else 0

    def fits(self, budget: int) -> int:
        i = bisect_right(self.counts, max(0, budget)) - 1
        if i >= len(self.tables):
            return self.starts[-1]
        left = budget - self.counts[i]
        return self.starts[i] + max(j for j, n in enumerate(self.tables[i]) if n <= left)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each row's whole text.

    A null text counts as empty: no bytes, no tokens. Repeated rows are each counted; no rows give none; other columns are not read.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def setup():
        counter = PrefixCounter(path)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [x.as_py() or "" for x in batch["__text"]]
            counts = [counter.count(t) for t in texts]
            return {c: batch[c] for c in keep} | {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return step

    return map_batches(docs.select(*keep, F.col("text").cast("string").alias("__text")), f"{ddl}, n_bytes long, n_tokens long, over_limit boolean", setup)


def prefix_counts(docs: DataFrame, path: str, budgets: list[int], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, and cuts: for each budget of tokens, how many bytes of the text fit in. Null texts as empty."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def setup():
        counter = PrefixCounter(path)

        def step(batch: pa.RecordBatch) -> dict:
            tables = [Prefixes(counter, x.as_py() or "") for x in batch["__text"]]
            return {c: batch[c] for c in keep} | {"cuts": [[{"budget": b, "n_bytes": t.fits(b)} for b in budgets] for t in tables]}

        return step

    return map_batches(docs.select(*keep, F.col("text").cast("string").alias("__text")), f"{ddl}, cuts array<struct<budget:int,n_bytes:long>>", setup)
