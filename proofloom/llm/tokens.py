"""Texts to token ids by a public tokenizer, with a memo of words."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CUT = re.compile(r"(?<=\S)(?= \S)")  # no token of a byte-level vocabulary crosses such a place
MEMO = 700_000
# Byte-level vocabularies write visible bytes as themselves and the others as characters from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SIGNS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


class _Words(dict):
    """Ids, as bytes, of a blank and the word behind it.  Holds ``MEMO`` words; later ones are encoded each time."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.marks = {m: self._encode(m) for m in ".,"}

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise ValueError("several blanks in a row")
        if word[-1] in self.marks and word[:-1].isalpha():  # letters and a mark behind them are tokens apart
            ids = self[word[:-1]] + self.marks[word[-1]]
        elif word.isalpha():  # with its blank, one token of the pre-tokenizer
            signs = "Ġ" + word if word.isascii() else "".join(map(SIGNS.__getitem__, b" " + word.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        else:
            ids = self._encode(" " + word)
        if len(self) < MEMO:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A special token's string in a text is that token, as the library has it.

    The pre-tokenizer starts a token at every single blank between two visible characters, so a
    text may be cut there.  Words recur, so the ids of a blank and a word are remembered.  Texts with
    other runs of white space are cut by a pattern instead and encoded without the memo.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.words = _Words(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        head, *rest = text.split(" ")
        if not rest or (head and not head[-1].isspace()):
            try:
                return self.words._encode(head) + b"".join(map(self.words.__getitem__, rest))
            except ValueError:
                pass
        parts = CUT.split(text)
        return b"".join([self.words._encode("".join(parts[i:i + 4096])) for i in range(0, len(parts), 4096)])


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids with the end id) of batches of (doc_id, text)."""
    own, end = encoder(path), array("I", [end_id]).tobytes()
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            yield i.as_py(), np.frombuffer(own.encode(t.as_py() or "") + end, "<u4")
