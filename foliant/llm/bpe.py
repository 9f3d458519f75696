"""Public byte-pair vocabularies, read with the tokenizers library, and what they need at corpus speed.

A text is cut at spaces, and most chunks recur, so chunks are memoised. Texts with a character outside the
Latin range for which Python's and the library's character classes were compared, or with
a special token's string, or with neighbouring white space, take a slower way through the library's own normaliser and pre-tokenizer.
"""

from __future__ import annotations

import os
import re
from functools import cached_property

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: How byte-level vocabularies write the 256 bytes as characters.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
UNUSUAL = re.compile(r"[^\t\n\r -~¡-¬®-ÿ‐-‧]")
NEIGHBOURS = re.compile(r"\s\s")
LIMIT = 64  # longer pieces are not memoised by prefix


def mapped(text: str) -> str:
    """A text's UTF-8 bytes as the vocabulary writes them."""
    if text.isascii():
        return text if text.isprintable() and " " not in text else text.translate(BYTES)
    return text.encode().decode("latin1").translate(BYTES)


class Vocabulary:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # asked for once: each access makes a new object
        self.specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else re.compile(r"(?!)")

    @cached_property
    def ids(self) -> dict[str, int]:
        return self.tokenizer.get_vocab(with_added_tokens=False)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    def tokens(self, piece: str) -> list[str]:
        """The model's own encoding of a piece."""
        return [t.value for t in self.model.tokenize(piece)]
