"""URL filter by a weighted vocabulary.

An Aho-Corasick automaton finds every term of the vocabulary in an URL in one
pass. A hit counts when it is bounded (not inside a longer run of letters).
One strict term rejects; so do two or more different soft ones whose weights add up to `soft_limit`: common words weigh
less than telling ones. Host rules stand above the vocabulary: the longest rule that fits decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: The default vocabulary. Strict terms reject alone, soft ones only together, by weight.
STRICT = ["porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "camgirl", "camgirls", "escort", "escorts", "milf", "casino", "casinos", "warez", "keygen", "cracked", "malware", "phishing"]
SOFT = {
    "sex": 1.0, "sexy": 1.0, "adult": 1.0, "nude": 1.0, "erotic": 1.0, "fetish": 1.0, "webcam": 1.0, "hookup": 1.0, "dating": 1.0,
    "bet": 1.0, "betting": 1.0, "poker": 1.0, "slots": 1.0, "jackpot": 1.0, "roulette": 1.0, "gambling": 1.0,
    "loan": 1.0, "loans": 1.0, "payday": 1.0, "pills": 1.0, "viagra": 1.0, "crack": 1.0, "torrent": 1.0, "torrents": 1.0, "serial": 1.0,
    "free": 0.5, "win": 0.5, "bonus": 0.5, "cheap": 0.5, "deal": 0.5, "hot": 0.5, "girls": 0.5, "download": 0.5, "credit": 0.5,
}
SOFT_LIMIT = 1.5

URL = re.compile(r"://([^/?#]*)([^?#]*)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    m = URL.search(url) if url else None
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


class UrlFilter:
    def __init__(self, strict: Iterable[str] = STRICT, soft: Mapping[str, float] = SOFT, soft_limit: float = SOFT_LIMIT, rules: Iterable[tuple[str, str]] = ()):
        import ahocorasick

        self.limit, self.weights = soft_limit, dict(soft)
        self.automaton = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):
            for t in terms:
                self.automaton.add_word(t, (kind, t))
        if len(self.automaton):
            self.automaton.make_automaton()
        #: (host, path) -> (rule, verdict)
        self.rules = {tuple(r.split("/", 1)[i] if i == 0 else "/" + r.split("/", 1)[1] for i in (0, 1)): (r, v) for r, v in rules}
        self.paths: dict[str, list[str]] = {}
        for host, path in self.rules:
            self.paths.setdefault(host, []).append(path)
        for paths in self.paths.values():
            paths.sort(key=len, reverse=True)

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule, host and path together, that fits a host or one of its parents."""
        best, name = None, host
        while name:
            for p in self.paths.get(name, ()):
                if path.startswith(p) and (best is None or len(name + p) > len("".join(best))):
                    best = (name, p)
                    break
            name = name.partition(".")[2]
        return best and self.rules[best]

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """The bounded strict terms and soft terms of an URL."""
        text = url.translate(LOWER)
        found: dict[str, set[str]] = {"strict": set(), "soft": set()}
        if len(self.automaton):
            for end, (kind, term) in self.automaton.iter(text):
                start = end - len(term) + 1
                if not (start and text[start - 1].isalpha()) and not text[end + 1 : end + 2].isalpha():
                    found[kind].add(term)
        return found["strict"], found["soft"]

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, list[str], list[str]]:
        host, path = split_url(url)
        strict, soft = self.hits(url or "")
        verdict = "block" if strict or (len(soft) > 1 and sum(map(self.weights.__getitem__, soft)) >= self.limit) else "allow"
        rule = self.rule(host, path)
        return host, path, rule and rule[0], rule[1] if rule else verdict, sorted(strict), sorted(soft)


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = (), strict: Iterable[str] = STRICT, soft: Mapping[str, float] = SOFT, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """One row per row of pages (page_id, url): host, path, rule, verdict, strict_hits, soft_hits.

    A null or empty url has no host, no hits and the verdict `allow`; repeated rows are each
    judged; other columns are not carried; an empty table gives none. Only `url` is read, and
    the automaton is built once a task from the vocabulary, which is a parameter and not data.
    """
    given = (list(strict), dict(soft), soft_limit, list(rules))

    def setup():
        f = UrlFilter(*given)

        def step(batch: pa.RecordBatch) -> dict:
            found = [f.judge(x.as_py()) for x in batch["url"]]
            names = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")
            return {"page_id": batch["page_id"]} | {n: [x[i] for x in found] for i, n in enumerate(names)}

        return step

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", F.col("url").cast("string")), f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits array<string>, soft_hits array<string>", setup)
