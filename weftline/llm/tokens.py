"""Ids of whole texts by the tokenizers library, with the ids of space-delimited pieces kept in the worker.

Both vocabularies cut a text at a space that stands between two non-space characters, so a text's ids are those of its
pieces in order. A text with any other white space around a space goes to the library whole when that matters. A piece of
plain Latin words, punctuation and single line feeds is cut by hand, where the vocabularies' patterns leave no doubt, and
its words go to the library's model; every other piece goes through the whole library.
"""

from __future__ import annotations

import os
import re

import numpy as np

from weftline.llm.common import worker_cache

#: Pieces, and words in pieces, whose ids a worker keeps; further ones are encoded again each time.
KEPT_PIECES = 400_000

#: Words, numbers, punctuation without apostrophe and "<" (contractions, special tokens), line feeds.
_PLAIN = {
    True: re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:;=-@\[-`{-~]+|\n"),
    False: re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+|\n"),
}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable in Latin-1, else the next from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    ``spaces`` says whether the vocabulary encodes white space and keeps capitals (byte-level); if not, it drops white
    space and lower-cases, so that a piece's ids are the same wherever it stands.
    """

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spaces = spaces
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.letters = dict(enumerate(byte_letters()))
        self.plain = _PLAIN[spaces]
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        spelt = word if self.spaces else word.lower()
        if spelt[0] <= " " or not spelt.isascii():
            spelt = spelt.encode().decode("latin-1").translate(self.letters)
        ids = b"".join([self.bytes_of[t.id] for t in self.model.tokenize(spelt)])
        if len(self.words) < KEPT_PIECES:
            self.words[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        lead = " " if self.spaces else ""
        words = [piece] if piece.isascii() and piece.isalpha() else self.plain.findall(piece)
        if not piece or sum(map(len, words)) < len(piece) or "\n\n" in piece:
            ids = self._whole(lead + piece)
        else:
            if self.spaces:
                words[0] = lead + words[0]
            else:
                words = [w for w in words if w != "\n"]
            known = self.words
            ids = b"".join([known.get(w) or self._word(w) for w in words])
        if len(self.pieces) < KEPT_PIECES:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        pieces, head = text.split(" "), b""
        if self.spaces:
            if not pieces[0] or pieces[0][-1].isspace():
                return self._whole(text)
            head, pieces = self._whole(pieces[0]), pieces[1:]
        found = [*map(self.pieces.get, pieces)]
        if None in found:
            for i, f in enumerate(found):
                if f is None:
                    p = pieces[i]
                    if self.spaces and (not p or p[0].isspace() or p[-1].isspace()):
                        return self._whole(text)
                    found[i] = self._piece(p)
        return head + b"".join(found)


def encoder(path: str, spaces: bool) -> Encoder:
    cache = worker_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path, spaces)
    return cache[path]
