"""Token ids of the public vocabulary with word ends inside Spark tasks.

The tokenizer drops white space and never joins over it, so a text's ids are
those of its parts between ASCII white space.  Parts recur, so each worker
keeps the parts of its last texts.  A part of Latin letters, digits and signs is
merged by rank, the word end being one more byte that joins its last byte before
all else; any other part goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import regex

VOCABULARY = "word_bpe_49k.json"
#: Parts in a generation of the table; two are kept (about 30 MB).
PARTS = 120_000

_USUAL = regex.compile("[\x21-\x7e\xa1-ɏ]+")
_END = b"\xff"   # no UTF-8 text holds it
#: Signs that are a piece of their own after a word.
_SIGNS = frozenset(b"%c" % c for c in b".,;:!?)")


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=1)
def load(path: str):
    """(tokenizer, encoder of one piece with its end, ids by rank, piece pattern) of a vocabulary file."""
    import tiktoken
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True  # their strings in a text are ordinary text
    with open(path, encoding="utf-8") as lines:
        spec = json.load(lines)
    model, letters = spec["model"], byte_letters()
    end = model["end_of_word_suffix"]
    vocabulary = model["vocab"]

    def raw(token: str) -> bytes:
        ended = token.endswith(end)
        return bytes(letters[c] for c in (token[:-len(end)] if ended else token)) + _END * ended
    special = {t["content"] for t in spec["added_tokens"]}
    single = {raw(t): i for t, i in vocabulary.items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [bytes([b]) + _END for b in range(256)] + [bytes([b]) for b in range(256)]
    order += [raw(a) + raw(b) for a, b in merges]
    ranks: dict[bytes, int] = {}
    for token in order:
        ranks.setdefault(token, len(ranks))
    ids = [single.get(token, 0) for token in ranks]
    if max(vocabulary.values()) > 0xFFFF:
        raise ValueError("ids over 65535")
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    core = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
    return whole, core.encode_single_piece, ids, regex.compile(pattern).findall


class Kept(dict):
    """A table that makes missing values and keeps those of its last two generations."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = found
        return found


class Parts(Kept):
    """part (bytes without ASCII white space) -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, limit: int = PARTS):
        super().__init__(self.made, limit)
        self.whole, self.encode, self.ids, self.pieces = load(path)
        #: A piece recurs with other signs around it and in other cases.
        self.known = Kept(self.piece, limit)

    def piece(self, piece: str) -> bytes:
        ids = self.ids
        return array("I", [ids[r] for r in self.encode(piece.encode() + _END)]).tobytes()

    def made(self, part: bytes) -> bytes:
        if part.isalpha():   # of bytes: A-Z and a-z only
            return self.known[part.lower().decode()]
        if part[-1:] in _SIGNS and part[:-1].isalpha():
            return self.known[part[:-1].lower().decode()] + self.known[part[-1:].decode()]
        text = part.decode()
        if not _USUAL.fullmatch(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.known.__getitem__, self.pieces(text.lower())))


@lru_cache(maxsize=1)
def parts_of_worker(path: str) -> Parts:
    return Parts(path)


def text_ids(parts: Parts, text: bytes) -> bytes:
    """Ids of a whole text as bytes."""
    return b"".join(map(parts.__getitem__, text.split()))
