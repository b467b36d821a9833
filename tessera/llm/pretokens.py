"""Byte-level BPE by pre-tokens: splitting, encoding with bounded caches, decoding.

The vocabulary file is read on the driver, by a path the caller names, and travels to the executors as text.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from pathlib import Path

import regex
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import common

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers before it starts afresh.
CACHE_PIECES = 150_000
#: Characters by which a longer text can change a match that ended before: "'l" may go on to "'ll".
LOOKAHEAD = 3


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def vocabulary(path: str | None = None) -> str:
    return Path(path or default_path()).read_text(encoding="utf-8")


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def unsettled() -> regex.Pattern:
    """Characters that only some Unicode versions call letters or digits: texts with one are split by the library itself."""
    word = regex.compile(r"[\p{L}\p{N}\s]")
    found = [c for c in map(chr, range(0x100, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and word.match(c)]
    return regex.compile("[" + "".join(found) + "]") if found else regex.compile(r"(?!)")


class Codec:
    """Encodes and decodes as the library does, one pre-token at a time."""

    def __init__(self, vocabulary_json: str):
        self.source, spec = vocabulary_json, json.loads(vocabulary_json)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pattern = regex.compile(PATTERN)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.merge = self.fast_merge(vocab, spec["model"]["merges"])
        self.seen: dict[str, tuple[int, ...]] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, for texts that the pattern can't be trusted with."""
        out = Tokenizer.from_str(self.source)
        out.no_truncation()
        out.no_padding()
        return out

    def fast_merge(self, vocab: dict[str, int], merges: list) -> Callable[[str], list[int]]:
        """Encodes one pre-token; by ranks if the ids follow the order of the merges, as then both rules choose alike."""
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != sorted(set(made)):
            return lambda piece: self.library.encode(piece, add_special_tokens=False).ids
        ranks = {self.bytes_of[i]: i for i in vocab.values()}
        core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda piece: core.encode_single_piece(piece.encode())

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        if (ids := self.seen.get(piece)) is None:
            if len(self.seen) >= CACHE_PIECES:
                self.seen.clear()
            ids = self.seen[piece] = tuple(self.merge(piece))
        return ids

    def regular(self, text: str) -> bool:
        """Whether the pattern splits this text as the library does."""
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return unsettled().search(text) is None

    def specials_in(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, id) of the special tokens in a text, in order."""
        if not self.special or not any(s in text for s in self.specials):
            return []
        return [(m.start(), m.end(), self.specials[m[0]]) for m in self.special.finditer(text)]

    def split(self, text: str, at: int, stop: int, regular: bool) -> Iterator[str]:
        """The pre-tokens of text[at:stop], a part without special tokens, one after the other."""
        if regular:
            while at < stop:
                m = self.pattern.match(text, at, stop)
                yield m[0]
                at = m.end()
            return
        size = 4096  # the library splits pieces of the text, whose last pre-tokens a longer piece could change
        while at < stop:
            upto = min(stop, at + size)
            ends = [b for _, (_, b) in self.library.pre_tokenizer.pre_tokenize_str(text[at:upto])]
            if upto < stop:
                ends = [b for b in ends if b <= upto - at - LOOKAHEAD]
                size *= 1 if ends else 2
            for a, b in zip([0, *ends], ends):
                yield text[at + a : at + b]
            at += ends[-1] if ends else 0

    def walk(self, text: str, at: int, specials: list[tuple[int, int, int]], regular: bool) -> Iterator[tuple[str, int | None]]:
        """The pre-tokens of a text from the boundary ``at`` on, and its special tokens with their ids."""
        for start, end, special in specials[bisect_left(specials, (at, 0, 0)) :]:
            for piece in self.split(text, at, start, regular):
                yield piece, None
            yield text[start:end], special
            at = end
        for piece in self.split(text, at, len(text), regular):
            yield piece, None

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """Plain parts and special tokens (with their id), in order."""
        out, at = [], 0
        for start, end, special in self.specials_in(text):
            if start > at:
                out.append((text[at:start], None))
            out.append((text[start:end], special))
            at = end
        return [*out, (text[at:], None)] if at < len(text) else out

    def encode(self, text: str) -> list[int]:
        """The whole text, pre-token by pre-token."""
        out: list[int] = []
        for piece, special in self.walk(text, 0, self.specials_in(text), self.regular(text)):
            if special is not None:
                out.append(special)
            else:
                out.extend(self.piece(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included, broken UTF-8 replaced."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(vocabulary_json: str) -> Codec:
    """The worker's codec, built once; holds caches only."""
    state = common.worker_state()
    key = ("codec", hash(vocabulary_json))
    if key not in state:
        state[key] = Codec(vocabulary_json)
    return state[key]
