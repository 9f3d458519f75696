"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum, over all ways to cut it into pieces, of the
product of the pieces' probabilities; the forward algorithm gives it in one
pass over the word. Words are independent, so a text's log likelihood is the
sum over its words, and one pass over whole texts suffices: no shuffle.

Fitting reads at most about `per_lang` documents of each language (a documented
bound, drawn by a hash of the id), segments their words with the vocabulary's own
tokenizer and counts pieces. The table that reaches the driver has at most
languages x vocabulary rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, with_text

WORDS = re.compile(r"[^\W\d_]+")
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
MARK = "▁"
SPLIT = 30  # longer words are scored in log space, one by one
TOGETHER = 2_000  # words that are scored together
LONG = 96  # bytes of a chunk that is remembered: texts in scripts without spaces are one chunk
PART = 20_000  # chunks that are looked up between two looks at the memory


@dataclass
class LangModel:
    """Piece probabilities: langs in alphabetical order, pieces -> a tuple with one value a language."""

    langs: list[str]
    pieces: dict[str, tuple[float, ...]]
    floor: tuple[float, ...]


def fit(labelled: DataFrame, vocabulary: str, per_lang: int = 1500, alpha: float = 0.1) -> LangModel:
    """Learn piece probabilities from rows (doc_id, text, lang); null texts or langs are left out.

    vocabulary: path of a sentencepiece model. per_lang bounds the sample of each language.
    An empty table gives a model without languages, which predicts `und` throughout.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return LangModel([], {}, ())
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(1e6 * min(1.0, per_lang / n)) + 1)])
    draw = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)), F.lit(0))
    sample = known.where(draw < share[F.col("lang")]).select("lang", "text")

    def setup():
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)

        def step(batch: pa.RecordBatch) -> dict:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
            out = {"lang": [], "piece": [], "n": []}
            for lang, count in words.items():
                total: Counter = Counter()
                for n, ids in zip(count.values(), sp.encode(list(count), num_threads=1), strict=True):
                    for i in ids:
                        total[i] += n
                out["lang"] += [lang] * len(total)
                out["piece"] += list(total)
                out["n"] += list(total.values())
            return out

        return step

    counts = map_batches(sample, "lang string, piece int, n long", setup).groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    langs, size = sorted(sizes), sp.get_piece_size()
    table = np.full((size, len(langs)), alpha)
    for lang, piece, n in counts:
        table[piece, langs.index(lang)] += n
    table /= table.sum(axis=0)
    floor = tuple(alpha / (sum(r[2] for r in counts if r[0] == lang) + alpha * size) for lang in langs)
    seen = {r[1] for r in counts}
    pieces = {sp.id_to_piece(i): tuple(table[i].tolist()) for i in range(size) if i in seen and not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_byte(i)}
    return LangModel(langs, pieces, floor)


class Scorer:
    """Log likelihoods of words and texts under a LangModel, with at most about `limit` bytes of memos.

    Words that recur are looked up. The others of many texts are scored together: the pieces in them are found one by one, and
    the forward algorithm then takes one step for all words that have a piece which ends at a place.
    """

    def __init__(self, model: LangModel, limit: int = 96 << 20):
        self.m, self.n, self.limit = model, len(model.langs), limit
        #: Number of each piece, from 1; 0 for what pieces begin with. An unknown character has the probabilities of number 0.
        self.begins = {p[:i]: 0 for p in model.pieces for i in range(1, len(p))} | {p: k for k, p in enumerate(model.pieces, 1)}
        self.probs = np.array([model.floor, *model.pieces.values()]).reshape(1 + len(model.pieces), self.n)
        self.size = len(self.probs)
        self.reset()

    def reset(self) -> None:
        self.table, self.used = np.zeros((1024, self.n + 1)), 0
        self.chunks: dict[bytes, int] = {}
        self.held = 0

    def cuts(self, text: str, base: int, stride: int, out: list[int]) -> None:
        """Append a number for each piece within a text: base + stride x its end + size x its beginning + its own number.

        A character that is no piece is unknown, and a piece of its own.
        """
        get, size, n = self.begins.get, self.size, len(text)
        for i in range(n):
            j = i + 1
            piece = get(text[i])
            out.append(base + j * stride + (piece or 0))
            while piece is not None and j < n:
                j += 1
                piece = get(text[i:j])
                if piece:
                    out.append(base + j * stride + piece)
            base += size

    def words(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of lower-cased words, a row each: the summed probability of all segmentations."""
        out = np.empty((len(words), self.n))
        short = [k for k, w in enumerate(words) if len(w) < SPLIT]
        for a in range(0, len(short), TOGETHER):
            part = short[a : a + TOGETHER]
            out[part] = self.forward([MARK + words[k] for k in part])
        for k, w in enumerate(words):
            if len(w) >= SPLIT:
                out[k] = self.forward_log(MARK + w)
        return out

    def forward(self, texts: list[str]) -> np.ndarray:
        """The forward algorithm for texts of at most SPLIT characters, in step: by place, a sum for each text with a piece that ends there."""
        width, numbers = SPLIT + 1, []
        stride = len(texts) * width * self.size
        for k, text in enumerate(texts):
            self.cuts(text, k * width * self.size, stride, numbers)
        end, rest = np.divmod(np.sort(np.array(numbers, np.int64)), stride)
        begin, piece = np.divmod(rest, self.size)
        of = begin // width
        sums = np.zeros((len(texts) * width, self.n))
        sums[::width] = 1
        edges = np.searchsorted(end, np.arange(1, SPLIT + 2))
        for j, (a, b) in enumerate(pairwise(edges.tolist()), 1):
            if a < b:
                first = np.flatnonzero(np.diff(of[a:b], prepend=-1))
                sums[of[a:b][first] * width + j] = np.add.reduceat(sums[begin[a:b]] * self.probs[piece[a:b]], first, axis=0)
        return np.log(sums[np.arange(len(texts)) * width + np.fromiter(map(len, texts), np.int64, len(texts))])

    def forward_log(self, text: str) -> np.ndarray:
        """The forward algorithm for one text of any length, in log space."""
        numbers: list[int] = []
        stride = len(text) * self.size
        self.cuts(text, 0, stride, numbers)
        logs, known = np.full((len(text) + 1, self.n), -np.inf), np.log(self.probs)
        logs[0] = 0
        for number in sorted(numbers):
            j, rest = divmod(number, stride)
            i, piece = divmod(rest, self.size)
            logs[j] = np.logaddexp(logs[j], logs[i] + known[piece])
        return logs[-1]

    def rows(self, chunks: list[bytes]) -> np.ndarray:
        """Where the table has the chunks' log likelihoods and letters; a long chunk's row is not found again."""
        rows = np.fromiter(map(self.chunks.get, chunks, repeat(-1)), np.int64, len(chunks))
        lack = np.flatnonzero(rows < 0)
        if not len(lack):
            return rows
        new: dict[bytes, int] = {}
        rows[lack] = [self.used + new.setdefault(chunks[k], len(new)) for k in lack.tolist()]
        words, of = [], []
        for k, chunk in enumerate(new):
            text = chunk.decode("utf-8", "surrogatepass")
            found = (text,) if text.isalpha() else WORDS.findall(text)
            words += found
            of += [k] * len(found)
        block = np.zeros((len(new), self.n + 1))
        if words:
            np.add.at(block, of, np.column_stack([self.words(words), np.fromiter(map(len, words), np.int64, len(words))]))
        if self.used + len(new) > len(self.table):
            self.table = np.concatenate([self.table[: self.used], np.zeros((self.used + 2 * len(new), self.n + 1))])
        self.table[self.used : self.used + len(new)] = block
        short = {c: self.used + k for c, k in new.items() if len(c) <= LONG}
        self.chunks |= short
        self.held += sum(map(len, short)) + len(short) * (140 + 8 * (self.n + 1))
        self.used += len(new)
        return rows

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Each text's predicted language and its posterior under equal priors; `und` and 0 without letters.

        Texts are looked up together, about PART chunks at a time; a text's sum has the same parts whatever its neighbours.
        """
        totals = np.zeros((len(texts), self.n + 1))
        part, of, first = [], [], []

        def look_up() -> None:
            if part:
                rows = self.rows(part)
                totals[of] += np.add.reduceat(self.table[rows], first, axis=0)
            part.clear(), of.clear(), first.clear()
            if self.held > self.limit * 5 // 8 or self.used > self.limit // 6 // (8 * (self.n + 1)):
                self.reset()

        for k, text in enumerate(texts if self.n else ()):
            # ASCII other than letters separates words; what else does is left to WORDS
            chunks = text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []
            for a in range(0, len(chunks), PART):
                of.append(k)
                first.append(len(part))
                part += chunks[a : a + PART]
                if len(part) >= PART:
                    look_up()
        look_up()
        return [self.decide(total) for total in totals]

    def decide(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-1]:
            return "und", 0.0
        logs = total[:-1]
        best = int(np.argmax(logs))
        return self.m.langs[best], float(round(1 / math.fsum(np.exp(logs - logs[best])), 6))


def identify(docs: DataFrame, model: LangModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add lang_pred and score to the columns `keep` of docs, from `text` alone.

    Null, empty and letterless texts give `und` with score 0; ties go to the first language
    in alphabetical order; repeated rows are each judged; an empty table gives none.
    Other columns of docs are not carried, so that their names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, text = with_text(docs, keep)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def setup():
        scorer = Scorer(shared.value)

        def step(batch: pa.RecordBatch) -> dict:
            found = scorer.texts(batch[text].to_pylist())
            return {c: batch[c] for c in keep} | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return step

    return map_batches(kept, f"{ddl}, lang_pred string, score double", setup)


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4))
