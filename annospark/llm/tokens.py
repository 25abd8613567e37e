"""Token ids of public vocabularies inside Spark tasks, one word at a time.

The byte-level pre-tokenizer always cuts before a single space that stands
between two other characters, so a text's ids are those of its space-separated
parts, each with its space.  Parts recur, so each worker keeps a bounded table
from part to ids.  Texts with two spaces in a row, where this does not hold,
and texts beyond the Latin letters go through the tokenizer whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

#: Parts kept by a worker; beyond it the table starts anew (about 30 MB).
PARTS = 120_000

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_UNUSUAL = re.compile("  |[^\x00-ɏ‐-‧€]")


class Ids(dict):
    """part (without its space) -> bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part):
        if len(self) >= PARTS:
            self.clear()
        ids = self[part] = array("I", self.encode(" " + part)).tobytes()
        return ids


@lru_cache(maxsize=1)
def whole_tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@lru_cache(maxsize=1)
def parts_table(ranks_path: str) -> Ids:
    """The table of a worker, shared by the tasks and operators that it runs."""
    return Ids(rank_encoder(ranks_path))


@lru_cache(maxsize=1)
def rank_encoder(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})._core_bpe.encode_ordinary


class TextIds:
    """Ids of whole texts as bytes; the same ids as the tokenizer file's."""

    def __init__(self, tokenizer_path: str, ranks_path: str):
        self.path = tokenizer_path
        self.encode = rank_encoder(ranks_path)
        self.parts = parts_table(ranks_path)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNUSUAL.search(text):
            return array("I", whole_tokenizer(self.path).encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.encode(first)).tobytes() if first else b""
        return head + b"".join(map(self.parts.__getitem__, rest))
