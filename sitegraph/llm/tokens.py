"""Encoding with a public tokenizer file, fast on texts whose words repeat.

The tokenizers library encodes every piece; a piece is a run between blanks and
line ends, which no token of such a file spans. Ids of pieces are kept in a
bounded table per process. Plain Latin words reach the library's model without
its normaliser, which for them only lowers the case.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

BLANKS = re.compile("[ \\n]+")
WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|*%$#&]*)")  # letters, then signs that the pre-tokenizer cuts off
MAX_PIECES = 600_000  # pieces remembered per process; beyond it the table starts anew


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_table() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(others)}


class Pieces(dict):
    """Piece -> ids as little-endian unsigned 32-bit bytes; unknown pieces are encoded by the library.

    A lower-case word and a run of signs are pieces too: what longer pieces are made of stands in the same table.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: the word route holds for files that lower the case, cut letters from signs and drop white space
        self.by_piece = norm == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"]
        self.table = _byte_table()
        self.bytes_of = [k.to_bytes(4, "little") for k in range(self.tok.get_vocab_size())]

    def _word(self, w: str) -> bytes:
        got = self.get(w)
        if got is None:
            plain = w if w.isascii() else w.encode().decode("latin1").translate(self.table)  # printable ASCII stands for itself
            of = self.bytes_of
            got = self[w] = b"".join([of[t.id] for t in self.tok.model.tokenize(plain)])
        return got

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MAX_PIECES:
            self.clear()
        m = WORD.fullmatch(piece) if len(piece) < 100 else None
        if m:
            ids = self._word(m[1].lower())
            if m[2]:
                ids += self[m[2]]
        else:
            ids = self._library(piece)
        if len(piece) < 100:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, as the library's ``encode`` without special tokens gives them."""
        if not self.by_piece:
            return self._library(text)
        return b"".join(map(self.__getitem__, BLANKS.split(text)))

    def decode(self, ids: bytes) -> str:
        return self.tok.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """The process's table for a tokenizer file."""
    return Pieces(path)
