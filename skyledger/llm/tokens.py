"""Token ids of whole texts by the tokenizers library, with a per-worker memo.

Both vocabularies split a text at white space before any merge, so the ids of
a text are the concatenated ids of its chunks (a run of white space with the
run of other characters behind it).  Each distinct chunk is given to the
library once per worker and looked up afterwards; tests hold the result
against the library on whole texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from skyledger.llm.common import Growing, Numbered, ragged

#: Characters with the Unicode property White_Space.
_WIDE = "\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
SPACES = "\t-\r " + _WIDE
_CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_WORD = re.compile(f"[^{SPACES}]+")
#: A text with none of these has only single spaces and single line feeds between words.
_IRREGULAR = ("  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Marks a chunk at the start of a text; no valid text holds it.
_FIRST = "\ud800"


class _Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._reset()

    def _reset(self) -> None:
        self.memo = Numbered()
        self.flat, self.start, self.length = Growing(np.uint16), Growing(np.int64), Growing(np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Ids of the pending chunks."""
        pending, self.memo.pending = self.memo.pending, []
        if pending:
            starts, lengths, ids = self._encode_new(pending)
            self.start.extend(self.flat.size + starts)
            self.length.extend(lengths)
            self.flat.extend(ids)

    @staticmethod
    def _placed(simple, simple_lengths, odd_lengths, ids):
        """Starts and lengths in pending order; ``ids`` has the simple chunks first."""
        ends = np.cumsum(np.concatenate([simple_lengths, odd_lengths]))
        lengths, starts = np.empty(len(simple), np.int64), np.empty(len(simple), np.int64)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        lengths[order] = np.diff(ends, prepend=0)
        starts[order] = ends - lengths[order]
        return starts, lengths, ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint16 ids of each text."""
        if len(self.memo) >= self.memo.limit:
            self._reset()
        rows = [self._chunks(t) for t in texts]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        index = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(rows)), np.int64, int(counts.sum()))
        self._learn()
        lengths = self.length.values[index]
        ids = ragged(self.flat.values, self.start.values[index], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return np.split(ids, ends[:-1]) if texts else []

class ByteBpe(_Encoder):
    """byte_bpe_50k.json.  A memo key without leading white space stands for
    the chunk with one space before it."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.spaced[number] = token.startswith("Ġ")  # a space in the byte alphabet

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if not (any(x in text for x in _IRREGULAR) or text[0] in " \n" or text[-1] in " \n"
                or not text.isascii() and any(x in text for x in _WIDE)):
            chunks = text.replace("\n", " \n").split(" ")
            chunks[0] = _FIRST + chunks[0]
            return chunks
        chunks = [c[1:] if c[0] == " " and _WORD.match(c, 1) else c for c in _CHUNK.findall(text)]
        if _WORD.match(text):
            chunks[0] = _FIRST + chunks[0]
        return chunks

    @staticmethod
    def _plain(key: str) -> str:
        if key[0] == _FIRST:
            return key[1:]
        return " " + key if _WORD.match(key) else key

    def _encode_new(self, pending):
        simple = np.fromiter((k[0] != _FIRST and _WORD.match(k) is not None for k in pending), bool, len(pending))
        first = [k for k, s in zip(pending, simple) if s]
        odd = [k for k, s in zip(pending, simple) if not s]
        # One call for all simple chunks: each begins with the only one of its tokens that begins with a space.
        ids = np.array(self._library([" " + " ".join(first)])[0] if first else [], np.uint16)
        cuts = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
        each = self._library([self._plain(k) for k in odd])
        flat = np.concatenate([ids, *(np.array(x, np.uint16) for x in each)])
        return self._placed(simple, np.diff(cuts), np.fromiter(map(len, each), np.int64, len(odd)), flat)


class WordBpe(_Encoder):
    """word_bpe_49k.json: white space is dropped, words stand alone.

    The library lowers a text and cuts it into pieces (letters, one digit, signs,
    some endings behind an apostrophe) that it merges one by one.  Texts of
    Latin-1 characters are cut here by the same rule, so the memo holds a piece
    once, whatever its case and the signs around it; other texts are cut at
    white space only.  The last token of a piece, and no other, ends a word: new
    pieces go to the library in one text and are told apart by that."""

    _MARK = "\x01"
    _NOT_LATIN = re.compile("[^\t\n\r -~\xa1-\xac\xae-\xff]")
    _PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                         "|[^\\s0-9a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")
    #: Pieces that stay one piece in any text.
    _PIECE = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[!-&(-/:-@\\[-`{-~]+")

    def __init__(self, path: str):
        super().__init__(path)
        self.mark, = self._library([self._MARK])[0]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")

    def _chunks(self, text: str) -> list[str]:
        if not self._NOT_LATIN.search(text):
            return self._PIECES.findall(text.lower())
        return text.split() if not _SEPARATORS.search(text) else _WORD.findall(text)

    def _encode_new(self, pending):
        simple = np.fromiter((self._PIECE.fullmatch(k) is not None for k in pending), bool, len(pending))
        ids = np.array(self._library([" ".join(k for k, s in zip(pending, simple) if s)])[0], np.uint16)
        ends = np.flatnonzero(self.ends[ids]) + 1
        odd_ids, odd_lengths = self._marked([k for k, s in zip(pending, simple) if not s])
        return self._placed(simple, np.diff(ends, prepend=0), odd_lengths, np.concatenate([ids, odd_ids]))

    def _marked(self, chunks):
        """Ids and lengths of any chunks: those without a mark in one text, with marks between them."""
        plain = np.fromiter((self._MARK not in k for k in chunks), bool, len(chunks))
        ids = np.array(self._library([f" {self._MARK} ".join(k for k, s in zip(chunks, plain) if s)])[0], np.uint16)
        marks = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
        each = self._library([k for k, s in zip(chunks, plain) if not s])
        flat = np.concatenate([ids[ids != self.mark], *(np.array(x, np.uint16) for x in each)])
        lengths = np.diff(marks)[:int(plain.sum())] - 1
        starts, lengths, flat = self._placed(plain, lengths, np.fromiter(map(len, each), np.int64, len(each)), flat)
        return ragged(flat, starts, lengths), lengths


@lru_cache(maxsize=None)
def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder; it lives as long as the worker."""
    return ByteBpe(path)


@lru_cache(maxsize=None)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
