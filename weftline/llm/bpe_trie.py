"""Byte-pair encoding by a trie of distinct words, and decoding from the ids alone.

Theory. The encoding of a byte string by merges in order of rank has two properties. Cutting off its last token leaves the
encoding of the shorter string, and a row of tokens is an encoding if each two neighbours are. So one token a prefix is a
whole state: the last token of the prefix's encoding. The state of a longer prefix is the one token that ends there and whose
boundary with the state before it survives all merges. An encoding is read backwards from the states.

Practice. A text is cut into words by the vocabulary's pattern, and words repeat. The distinct new words of an Arrow batch go
into a trie, kept as the words in order with the length of the prefix that each shares with the one before it. The walk over
them is depth first: it holds the states of the open path, drops those below the shared prefix and adds one for each new
node. A prefix that many words share is encoded once. The path is as long as the longest word; nothing grows with the corpus.
Ids of pieces (what stands between single spaces) are kept in the worker, up to a bound; further ones are encoded again.

Texts are read whole, where they lie, without an exchange. Null texts count as empty: no tokens, hashes of nothing. Rows that
repeat, or whose id is null, have a row each. An empty table gives an empty one. Columns but the id and the text are not
read, so that none can clash. The marks of added tokens (such as an end-of-text mark) in a text become their ids, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import only, steps, worker_cache
from weftline.llm.tokens import byte_letters

#: Code points of text that one trie takes at a time; a longer text makes a trie of its own.
STEP = 1 << 24
#: Pieces whose ids a worker keeps between steps, and pairs of tokens whose boundary it has judged.
KEPT = 500_000
KEPT_PAIRS = 1_000_000

#: Code points for which Python's classes of letters, numbers and white space are those of the library; a test goes through them.
PLAIN = re.compile("[\x00-՗‐-‧€]*").fullmatch
_LETTER, _NUMBER = r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]", r"[0-9\xb2\xb3\xb9\xbc-\xbe]"
_SPACE = r"[\t-\r \x85\xa0]"
#: The pattern that byte-level vocabularies share: contractions, letters, numbers, other marks, white space.
WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?(?:(?!{_SPACE}|{_LETTER}|{_NUMBER}).)+|{_SPACE}+(?!(?!{_SPACE}).)|{_SPACE}+",
    re.S,
).findall
#: Where pieces cannot be encoded one by one: white space that a space neither starts nor ends, or that ends the text.
BLANKS = ("  ", " \n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")
RUNS = re.compile(rf"{_SPACE} (?:{_SPACE}|\Z)").search


class Trie:
    """A byte-level vocabulary with its merges, and the encodings of words and texts by it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-pair merges are encoded by states")
        if told["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or told["decoder"]["type"] != "ByteLevel":
            raise ValueError("only byte-level vocabularies with the shared pattern are covered")
        letters = {letter: b for b, letter in enumerate(byte_letters())}
        spelt = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        number = {token: i for token, i in model["vocab"].items()}
        self.spelling = {number[t]: s for t, s in spelt.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made = {i: -1 for i in self.spelling}  # when a token comes into being; single bytes are there from the start
        self.halves: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, both = number[left], number[right], number[left + right]
            if both in self.halves:
                raise ValueError("two merges with one product are not covered")
            self.rank[a, b], self.made[both], self.halves[both] = r, r, (a, b)
        self.pairs: dict[tuple[int, int], bool] = {}
        # A token takes part if its own bytes encode to it: if its halves' boundary survives until their merge.
        whole = [i for i, s in self.spelling.items() if len(s) == 1 or i in self.halves and self.apart(*self.halves[i], self.made[i])]
        self.ids = {self.spelling[i]: i for i in whole}
        # An automaton over the starts of tokens finds the tokens that end at a byte; its edges are added as they are met.
        self.strings = [b"", *sorted({s[:k] for s in self.ids for k in range(1, len(s) + 1)})]
        self.nodes = {s: k for k, s in enumerate(self.strings)}
        self.next: list[dict[int, int]] = [{} for _ in self.strings]
        self.tokens: list[list[tuple[int, int]] | None] = [None] * len(self.strings)
        self.size = {i: len(s) for i, s in self.spelling.items()}
        self.states = 0  # computed so far
        self.added = {a["content"]: a["id"] for a in told["added_tokens"]}
        if any(a[k] for a in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip or normalise are not covered")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        for mark, i in self.added.items():
            self.spelling[i] = bytes(letters[c] for c in mark) if all(c in letters for c in mark) else mark.encode()
        self.decimal = {i: str(i) for i in self.spelling}
        self.pieces: dict[str, bytes] = {}
        self.known: dict[bytes, bytes] = {}
        self.library = None
        self.path = path

    def apart(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether no merge of a rank below ``until`` crosses the boundary between tokens a and b.

        Goes back in time: of the tokens at the boundary, the one made later is replaced by its half at the boundary. Two
        tokens merge if their rank comes before the merge that ends either. Equal ranks merge from left to right.
        """
        end_a = end_b = until
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < until and r < end_a and r <= end_b:
                return False
            if self.made[a] > self.made[b]:
                end_a, a = self.made[a], self.halves[a][1]
            elif self.made[b] >= 0:
                end_b, b = self.made[b], self.halves[b][0]
            else:
                return True

    def _judge(self, pair: tuple[int, int]) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        fits = self.pairs[pair] = self.apart(*pair)
        return fits

    def _follow(self, at: int, byte: int) -> int:
        """The node of the longest end of (node's string + byte) that starts a token."""
        longer = self.strings[at] + bytes([byte])
        while longer not in self.nodes:
            longer = longer[1:]
        self.next[at][byte] = found = self.nodes[longer]
        return found

    def _ending(self, at: int) -> list[tuple[int, int]]:
        """Tokens that end at a node, the longest first, with their lengths."""
        string = self.strings[at]
        self.tokens[at] = found = [(len(string) - k, self.ids[string[k:]]) for k in range(len(string)) if string[k:] in self.ids]
        return found

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words as unsigned 32-bit integers, by a depth-first walk over their trie."""
        out, states, path, before = {}, [], [0], b""
        follow, tokens, judged, size = self.next, self.tokens, self.pairs.get, self.size
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared:], path[shared + 1 :]
            at, end = path[-1], shared
            self.states += len(word) - shared
            for byte in word[shared:]:
                end += 1
                found = follow[at].get(byte)
                at = self._follow(at, byte) if found is None else found
                path.append(at)
                for length, token in tokens[at] or self._ending(at):
                    if length == end:
                        break
                    pair = states[end - length - 1], token
                    fits = judged(pair)
                    if self._judge(pair) if fits is None else fits:
                        break
                else:
                    raise ValueError("a byte has no token")
                states.append(token)
            ids, end = [], len(word)
            while end:
                token = states[end - 1]
                ids.append(token)
                end -= size[token]
            ids.reverse()
            out[word] = array("I", ids).tobytes()
            before = word
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text by the vocabulary's pattern; texts beyond the plain code points are cut by the library."""
        if PLAIN(text):
            return WORDS(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _cut(self, part: str) -> tuple[str, list[str]]:
        """A text without marks as what is looked up: its start, and the pieces that follow a space each. A text whose pieces
        cannot be encoded one by one is a start without pieces."""
        if not (part.isascii() or PLAIN(part)) or any(x in part for x in BLANKS) and RUNS(part) or part.endswith(" "):
            return part, []
        start, *pieces = part.split(" ")
        return start, pieces

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        for a, b in steps(texts, STEP):
            yield from self._encode_step(texts[a:b])

    def _parts(self, text: str) -> list[str]:
        return self.marks.split(text) if self.marks else [text]  # marks stand at odd places

    def _encode_step(self, texts: list[str]) -> Iterator[np.ndarray]:
        starts, new, marked = set(), set(), {m: array("I", [i]).tobytes() for m, i in self.added.items()}
        for text in texts:
            for part in self._parts(text)[::2]:
                start, pieces = self._cut(part)
                starts.add(start)
                new.update(pieces)
        new.difference_update(self.pieces)
        cut = {p: [b" " + p.encode()] if p.isalpha() else [w.encode() for w in WORDS(" " + p)] for p in new}
        start_words = {t: [w.encode() for w in self.words(t)] for t in starts}
        met = {w for words in start_words.values() for w in words}
        met.update(*cut.values())
        known = self.known
        known |= self.encode_words(met.difference(known))
        start_ids = {t: b"".join([known[w] for w in words]) for t, words in start_words.items()}
        spelt = self.pieces
        spelt.update([(p, known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])) for p, words in cut.items()])
        del cut
        for text in texts:
            found = []
            for k, part in enumerate(self._parts(text)):
                if k % 2:
                    found.append(marked[part])
                else:
                    start, pieces = self._cut(part)
                    found.append(start_ids[start])
                    found.extend(map(spelt.__getitem__, pieces))
            yield np.frombuffer(b"".join(found), np.uint32)
        for kept in (self.pieces, self.known):  # the first ones stay: frequent ones are met early
            for key in [*islice(reversed(kept), max(0, len(kept) - KEPT))]:
                del kept[key]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the bytes they spell, with the replacement mark for bytes that are no text; unknown ids spell nothing."""
        try:
            spelt = b"".join([*map(self.spelling.__getitem__, ids)])
        except KeyError:
            spelt = b"".join([self.spelling.get(i, b"") for i in ids])
        return spelt.decode("utf-8", "replace")


def trie(path: str) -> Trie:
    cache = worker_cache("tries")
    if path not in cache:
        cache[path] = Trie(path)
    return cache[path]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = list(trie(path).encode_texts(_texts(part.column(1))))
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.uint32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _slim(docs, id_column, text_column).mapInArrow(encode, f"`{id_column}` {kind}, ids array<int>")


def decode_ids(rows: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text): the text that each row's ids spell; null ids spell an empty one."""

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [trie(path).decode(ids or ()) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = rows.schema[id_column].dataType.simpleString()
    return only(rows, id_column, ids_column).mapInArrow(decode, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded in one pass."""

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, ids_hash, text_hash = [], [], []
            own = trie(path)
            for found in own.encode_texts(_texts(part.column(1))):
                ids = found.tolist()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join([*map(own.decimal.__getitem__, ids)]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _slim(docs, id_column, text_column).mapInArrow(digests, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slim(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column], docs[text_column].cast("string").alias("_text"))
