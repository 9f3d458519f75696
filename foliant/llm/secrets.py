"""Secret scans by a battery of randomness tests, with DataFrame functions alone.

Fixed-format patterns find the known kinds. For the rest, each run of key-like characters
is a candidate; the narrowest alphabet that holds it (hex, base32 or base64) is its encoding.
Tests ask whether its characters look drawn evenly and independently from that
alphabet: chi-squared for uniformity, over single characters and over the alphabet's classes (capitals, small letters, the rest), a runs test around the
alphabet's middle, and the serial correlation of neighbours. The chi-squared tests ask for unevenness alone, as characters that are too even are no sign of prose.
Fisher's method makes one p-value under randomness of the four, and minus its logarithm is the candidate's structure.

Prose has much structure once it is long enough; short strings can't have. So false discoveries are controlled by length, with the corpus's own
prose as the null: for each candidate, strings of its length are cut from its document's prose without the white space, folded to its alphabet, and tested
alike. The logarithm of their structure has a mean and a spread in each stratum (encoding and length class), beside a stated prior that counts like PRIOR
strings, and so a candidate has a p-value under the null that it is prose. Within each stratum of the whole table, Benjamini-Hochberg
at level `q` decides which candidates are not: at most a part q of what is reported should be prose. The p-values of a stratum are kept as a histogram of fixed
bins, so the threshold needs one small aggregation whatever the number of candidates.

One pass reads the texts and writes the candidates' spans and p-values; texts are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The known kinds. Letters of a key name in either case (A-Z and a-z only).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
LEAST = 12
#: A candidate of the battery; what can be told at a length is left to the control by length.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
#: P-values below it count as this one.
LEAST_P = 1e-30
BINS = 200  # of -10 log10 p, so down to p = 1e-20
#: Where an alphabet's first and second class of characters end.
CLASSES = {"hex": (10, 16), "base32": (26, 32), "base64": (26, 52)}
#: The prior of prose: structure a character, and how many strings the prior counts for.
STRUCTURE = {"hex": 0.3, "base32": 0.06, "base64": 0.3}
PRIOR = 20
BASE, SPREAD = 0.3, 0.4
#: Strings of prose cut for a candidate. Where strings are asked for of some candidates alone, of a document with more than DRAWN for about that many, chosen by a hash of their places.
DRAWS, DRAWN = 4, 50
PART = 256


def marked(text: Column, pattern: str) -> Column:
    """The text with a mark before and after each match, leftmost and non-overlapping."""
    plain = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, OTHER + OTHER)).otherwise(text)
    return F.regexp_replace(plain, F.lit(f"({pattern})"), F.lit(f"{OPEN}$1{CLOSE}"))


def spans_of(marks: Column) -> Column:
    """array<struct<start,end,value>>: the marked matches, in code points.

    Spark has no function for the offsets of all matches; a split at the marks gives the lengths between matches, which are added up
    in parts of PART, so that the work stays in proportion to the matches of a text.
    Marks that the text itself has were replaced by another character of the same length; no pattern matches any of the three.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pieces = F.transform(F.slice(F.split(marks, OPEN), 2, 2_000_000_000), lambda p: F.struct(F.substring_index(p, CLOSE, 1).alias("value"), (F.length(p) - 1).alias("length")))

    def added(pieces: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / PART).cast("int")), lambda i: F.slice(pieces, i * PART + 1, PART))
        return let(parts, placed)

    def placed(parts: Column) -> Column:
        first = F.struct(F.length(F.substring_index(marks, OPEN, 1)).alias("at"), F.array().cast("array<int>").alias("out"))
        total = lambda part: F.aggregate(part, F.lit(0), lambda n, p: n + p["length"])
        begins = F.aggregate(parts, first, lambda a, part: F.struct((a["at"] + total(part)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(parts, begins, spans))

    def spans(part: Column, at: Column) -> Column:
        one = lambda a, p: F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(p["value"])).alias("end"), p["value"].alias("value")))
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), lambda a, p: F.struct((a["at"] + p["length"]).alias("at"), F.concat(a["out"], one(a, p)).alias("out")), lambda a: a["out"])

    return F.when(marks.contains(OPEN), let(pieces, added)).otherwise(none)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * tail)


def encoding_of(value: Column) -> Column:
    return F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(value.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")


def alphabet(encoding: Column) -> Column:
    """struct<table, k, t1, t2>: an encoding's characters, their number, and where its first and second class end."""
    tables = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    one = {e: F.struct(F.lit(x).alias("table"), F.lit(float(len(x))).alias("k"), F.lit(float(CLASSES[e][0])).alias("t1"), F.lit(float(CLASSES[e][1])).alias("t2")) for e, x in tables.items()}
    return F.when(encoding == "hex", one["hex"]).when(encoding == "base32", one["base32"]).otherwise(one["base64"])


def digits_of(value: Column, encoding: Column, table: Column) -> Column:
    """array<int>: each character's place in its alphabet; padding is left out."""
    bare = F.regexp_replace(value, "=+$", "")
    text = F.when(encoding == "hex", F.lower(bare)).when(encoding == "base64", F.translate(bare, "-_=", "+//")).otherwise(bare)
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(table, c) - 1)


def battery(value: Column) -> Column:
    """struct<encoding, n, p>: the inferred encoding, length without padding, and combined p-value under randomness of a candidate."""
    return let(F.struct(value.alias("v"), encoding_of(value).alias("e")), lambda s: tested_as(s["v"], s["e"]))


def tested_as(value: Column, encoding: Column) -> Column:
    """The battery for a value of a given encoding: each step has what the steps before have made."""
    read = lambda s: F.struct(s["e"].alias("e"), s["a"]["k"].alias("k"), s["a"]["t1"].alias("t1"), s["a"]["t2"].alias("t2"), digits_of(s["v"], s["e"], s["a"]["table"]).alias("d"))
    made = let(F.struct(value.alias("v"), encoding.alias("e"), alphabet(encoding).alias("a")), read)
    return let(let(let(made, sums), scores), decision)


def sums(s: Column) -> Column:
    """What the tests add up over the characters of s (e, k, t1, t2, d)."""
    d, k = s["d"], s["k"]
    sum_of = lambda array, term: F.aggregate(array, F.lit(0.0), lambda a, x: a + term(x))
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    counts = F.transform(F.array_distinct(d), lambda c: F.size(F.filter(d, lambda x: x == c)).cast("double"))
    mid = (k - 1) / 2
    pairs = F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d)), lambda x, y: F.struct(((x >= k / 2) != (y >= k / 2)).alias("turn"), ((x - mid) * (y - mid)).alias("product")))
    both = F.aggregate(pairs, F.struct(F.lit(1.0).alias("runs"), F.lit(0.0).alias("serial")), lambda a, p: F.struct((a["runs"] + one(p["turn"])).alias("runs"), (a["serial"] + p["product"]).alias("serial")))
    named = {"squares": sum_of(counts, lambda c: c * c), "high": sum_of(d, lambda x: one(x >= k / 2)), "c1": sum_of(d, lambda x: one(x < s["t1"])), "c2": sum_of(d, lambda x: one(x < s["t2"])), "both": both}
    return F.struct(s["e"].alias("e"), k.alias("k"), s["t1"].alias("t1"), s["t2"].alias("t2"), F.size(d).cast("double").alias("n"), *[v.alias(c) for c, v in named.items()])


def scores(s: Column) -> Column:
    """The tests' statistics, each nearly normal for random characters, the two of unevenness first; null where one has no spread."""
    n, k, t1, t2, c1, c2, high, low = s["n"], s["k"], s["t1"], s["t2"], s["c1"], s["c2"], s["high"], s["n"] - s["high"]
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
    normal = lambda chi, f: (F.pow(F.greatest(chi, F.lit(0.0)) / f, F.lit(1 / 3)) - (1 - 2 / (9 * f))) / F.sqrt(2 / (9 * f))
    third = F.when(t2 < k, (n - c2) * (n - c2) / (k - t2)).otherwise(0.0)
    cells = k / n * (c1 * c1 / t1 + (c2 - c1) * (c2 - c1) / (t2 - t1) + third) - n
    mean = 2 * high * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = F.when(spread > 0, (s["both"]["runs"] - mean) / F.sqrt(spread))
    serial = s["both"]["serial"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
    return F.struct(s["e"].alias("e"), n.alias("n"), F.array(normal(s["squares"] * k / n - n, k - 1), normal(cells, F.when(t2 < k, 2.0).otherwise(1.0)), runs, serial).alias("z"))


def decision(s: Column) -> Column:
    """Fisher's method: of minus the sum of the logarithms of four p-values."""

    def less_log(z: Column, i: Column) -> Column:
        p = normal_p(z)
        p = F.when(i > 1, p).when(z > 0, p / 2).otherwise(1 - p / 2)
        return -F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(LEAST_P)))

    total = F.aggregate(F.transform(s["z"], less_log), F.lit(0.0), lambda a, x: a + x)
    p = let(total, lambda x: F.exp(-x) * (1 + x * (1 + x / 2 * (1 + x / 3))))
    return F.struct(s["e"].alias("encoding"), s["n"].cast("int").alias("n"), F.coalesce(p, F.lit(0.0)).alias("p"))


def bin_of(p: Column) -> Column:
    """0 for p = 1 up to BINS - 1 for p at and below 1e-20."""
    return F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(BINS - 1)).cast("int")


def of_kind(spans: Column, kind: str) -> Column:
    """array<struct<start,kind,end>>, which sorts by start, then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def outside(run: Column, base: Column) -> Column:
    """The parts of a run that base spans, sorted by start, leave over; none for a run that they don't touch."""
    part = lambda at, end: F.filter(F.array(F.struct(at.alias("start"), end.alias("end"), F.substring(run["value"], at - run["start"] + 1, F.greatest(end - at, F.lit(0))).alias("value"))), lambda x: x["start"] < x["end"])
    zero = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    left = F.aggregate(base, zero, lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), F.concat(a["out"], part(a["at"], b["start"])).alias("out")), lambda a: F.concat(a["out"], part(a["at"], run["end"])))
    return F.when(F.size(base) > 0, left).otherwise(zero["out"])


def left_over(run: Column, base: Column) -> Column:
    """Whether base spans, sorted by start, leave any of a run."""
    return F.aggregate(base, run["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at)) < run["end"]


def testable(value: Column) -> Column:
    """Whether 16 characters or more are left without padding; letters with digits are enough in a run of 24."""
    return value.rlike("^.{16,}?(?<!=)=*$") | (F.length(value) >= 24) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def structure(b: Column) -> Column:
    """Logarithm of BASE plus minus the decimal logarithm of the p-value under randomness, which is 30 at most: of prose it is nearly normal."""
    return F.log(BASE - F.log10(F.greatest(b["p"], F.lit(LEAST_P))))


def folded(prose: Column, encoding: Column) -> Column:
    """Prose without what is not of an alphabet."""
    return F.when(encoding == "hex", F.regexp_replace(F.lower(prose), "[^0-9a-f]", "")).when(encoding == "base32", F.regexp_replace(F.upper(prose), "[^A-Z2-7]", "")).otherwise(prose)


def draws(text: Column, tested: Column, drawn: int | None = DRAWN) -> Column:
    """array<struct<encoding,n,p>>: the battery's results for strings of prose as long as the tested candidates.

    For each of DRAWS strings a candidate, a stretch of the text is cut, at a place that follows from where the candidate begins; its runs of candidate length go, then
    what is not of the alphabet. A stretch with less prose left than the candidate is long gives none. drawn: about how many candidates of a document have strings; None for all.
    """

    def cut(t: Column, r: Column) -> Column:
        n, e = t["end"] - t["start"], t["b"]["encoding"]
        width = F.when(e == "hex", 8 * n).otherwise(2 * n + 32)
        at = (t["start"] * F.lit(7919).cast("long") + r * 104_729) % F.greatest(F.length(text) - width + 1, F.lit(1))
        prose = F.regexp_replace(F.regexp_replace(F.substring(text, (at + 1).cast("int"), width), CANDIDATE, " "), "[^A-Za-z0-9+/_-]+", "")
        return F.substring(folded(prose, e), F.lit(1), n)

    def of_candidate(t: Column) -> Column:
        strings = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda r: cut(t, r))
        whole = F.filter(strings, lambda v: F.length(v) == t["end"] - t["start"])
        return F.transform(whole, lambda v: tested_as(v, t["b"]["encoding"]))

    chosen = tested if drawn is None else F.filter(tested, lambda t: F.pmod(F.xxhash64(t["start"]), F.size(tested)) < drawn)
    return F.flatten(F.transform(chosen, of_candidate))


def candidates(docs: DataFrame, keep: tuple[str, ...], drawn: int | None = DRAWN) -> DataFrame:
    """keep, base spans, tested spans, and what the battery says of strings of prose (see draws), for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    patterns = {"assign": ASSIGN.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+"), "access": ACCESS, "hex": HEX, "random": CANDIDATE}
    # one marked copy of a text at a time
    spans = docs.select(*keep, text.alias("__whole"), *[let(marked(text, p), spans_of).alias(f"__{k}") for k, p in patterns.items()])
    value = lambda s: F.regexp_extract(s["value"], f"^{ASSIGN}", 1)
    named = {"assign": F.filter("__assign", lambda s: F.length(value(s)) >= LEAST), "access": F.col("__access"), "hex": F.col("__hex")}
    base = F.array_sort(F.concat(*[of_kind(a, k) for k, a in named.items()]))
    runs = F.filter(F.flatten(F.transform("__random", lambda s: F.concat(F.array(s), outside(s, F.filter("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))))), lambda s: testable(s["value"]) & left_over(s, F.col("__base")))
    tested = F.transform(runs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["value"]).alias("b")))
    found = spans.select(*keep, "__whole", base.alias("__base"), "__random").select(*keep, "__whole", F.col("__base").alias("base"), tested.alias("tested"))
    return found.select(*keep, "base", "tested", draws(F.col("__whole"), F.col("tested"), drawn).alias("prose"))


def stratum(b: Column) -> Column:
    """Encoding and length class (powers of two by halves)."""
    return F.concat_ws(":", b["encoding"], F.floor(2 * F.log2(b["n"].cast("double"))).cast("string"))


def null_of_prose(found: DataFrame) -> dict[str, tuple[float, float]]:
    """stratum -> mean and spread of the structure of prose, of at most 3 encodings x 60 length classes."""
    each = found.select(F.explode("tested").alias("t")).groupBy(stratum(F.col("t.b")).alias("stratum")).agg(F.max("t.b.encoding").alias("encoding"), F.avg("t.b.n").alias("n"))
    prose = found.select(F.explode("prose").alias("b")).groupBy(stratum(F.col("b")).alias("stratum")).agg(F.count("*").alias("m"), F.sum(structure(F.col("b"))).alias("s"), F.sum(structure(F.col("b")) * structure(F.col("b"))).alias("ss"))
    out = {}
    for r in each.join(prose, "stratum", "left").collect():
        prior = math.log(BASE + min(30.0, STRUCTURE[r.encoding] * r.n))
        m, s, ss = PRIOR + (r.m or 0), PRIOR * prior + (r.s or 0.0), PRIOR * (prior * prior + SPREAD * SPREAD) + (r.ss or 0.0)
        mean = s / m
        out[r.stratum] = mean, max(0.1, ss / m - mean * mean) ** 0.5
    return out


def prose_p(b: Column, null: dict[str, tuple[float, float]]) -> Column:
    """The p-value of a candidate under the null that it is prose: how seldom prose has as little structure."""
    if not null:
        return F.lit(1.0)
    at = lambda i: F.create_map(*[F.lit(x) for k, v in null.items() for x in (k, v[i])])[stratum(b)]
    z = (structure(b) - at(0)) / at(1)
    return F.when(z < 0, normal_p(z) / 2).otherwise(1.0)


def thresholds(found: DataFrame, null: dict[str, tuple[float, float]], q: float) -> DataFrame:
    """(stratum, cut): by Benjamini-Hochberg over each stratum's histogram, candidates in bin `cut` and beyond are not prose.

    At most strata x BINS rows after an aggregation that combines before it shuffles.
    """
    from pyspark.sql import Window

    bins = found.select(F.explode("tested").alias("t")).groupBy(stratum(F.col("t.b")).alias("stratum"), bin_of(prose_p(F.col("t.b"), null)).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum")
    ranked = bins.withColumn("upto", F.sum("n").over(w.orderBy(F.desc("bin")))).withColumn("m", F.sum("n").over(w))
    # the largest p in a bin is 10^(-bin / 10), so the decision for a bin is on the safe side
    passed = F.pow(F.lit(10.0), -F.col("bin") / 10) <= q * F.col("upto") / F.col("m")
    return ranked.groupBy("stratum").agg(F.coalesce(F.min(F.when(passed, F.col("bin"))), F.lit(BINS)).alias("cut"))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), q: float = 0.05) -> DataFrame:
    """Columns `keep`, and spans: array<struct<start,kind,end>> sorted by start, then kind (its index in KINDS).

    Null text counts as empty and has no spans; whole texts are read; repeated rows are each scanned; an empty table
    gives none. Offsets are code points, ends exclusive. Only `keep` and `text` of docs are read, so other
    columns may have any name. A candidate that base spans cover is not tested, as they stand for it; of one that they cover in part,
    the whole and the parts that they leave over are tested. The null has strings of prose for every candidate. q is the part of the added spans that may be prose.
    """
    found = materialise(candidates(docs, keep, None), "secrets")
    null = null_of_prose(found)
    cuts = {r.stratum: r.cut for r in thresholds(found, null, q).collect()}
    table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if cuts else F.create_map().cast("map<string,int>")
    random = of_kind(F.filter("tested", lambda t: (bin_of(prose_p(t["b"], null)) >= F.coalesce(table[stratum(t["b"])], F.lit(BINS)))), "random")
    within = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (x != y)
    more = F.filter("__more", lambda x: ~F.exists("__more", lambda y: within(x, y)))
    return found.select(*keep, "base", random.alias("__more")).select(*keep, "base", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones merged, replaced by mark."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(a: Column, s: Column) -> Column:
        before = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        fresh = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], before, F.lit(mark))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, zero, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
