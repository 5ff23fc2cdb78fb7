"""Token ids of whole texts by a tokenizer that drops white space.

Such a tokenizer gives each run of other characters the same ids wherever it
stands, so a text's ids are those of its words in order, and words that recur
are looked up. Words of Latin letters alone (with one closing mark perhaps) are
merged from the file's own vocabulary by a byte-pair encoder that starts faster;
all others go to the tokenizer itself. ``tests/llm`` holds both against the
tokenizer's encoding of whole texts.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

WORD_END = b"\xff"  # stands for the vocabulary's end-of-word suffix; no UTF-8 text has this byte
LATIN_END = "ɐ"  # letters below have no combining forms to compose
CLOSING = ".,;:!?"


def default_path() -> str:
    """Where the installed package of public tokenizers keeps the word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _pieces(path: str):
    """An encoder of single pieces (bytes that end in WORD_END) with the ids of the file's vocabulary."""
    import tiktoken

    with open(path) as file:
        model = json.load(file)["model"]
    suffix, byte_of = model["end_of_word_suffix"], _byte_of()
    ranks = {}
    for token, number in model["vocab"].items():
        ends = token.endswith(suffix)
        chars = token[: -len(suffix)] if ends else token
        if chars and all(c in byte_of for c in chars) and not token.startswith("<|"):
            ranks[bytes(byte_of[c] for c in chars) + WORD_END * ends] = number
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class WordTokens(dict):
    """Words (bytes) to their little-endian unsigned 32-bit ids (bytes); emptied when full."""

    def __init__(self, path: str, most: int = 1 << 20):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.piece = _pieces(path)
        self.marks = {c: self.whole(c) for c in CLOSING}
        self.most = most

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = word.decode()
        core, mark = (text[:-1], self.marks[text[-1]]) if text[-1] in CLOSING else (text, b"")
        if core.isalpha() and max(core) < LATIN_END and "İ" not in core:
            found = np.array(self.piece(core.lower().encode() + WORD_END), "<u4").tobytes() + mark
        else:
            found = self.whole(text)
        self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split())) if text else b""


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each worker process, so words stay known from task to task."""
    return WordTokens(path)
