"""Whole-text token ids by a public tokenizer file, at the price of its distinct words.

The tokenizer library does the encoding.  It sees each distinct white-space-free chunk once for as long as a worker
remembers it: in this tokenizer no match of the pre-tokenizer holds white space, its normalisers act on single characters and their
combining marks, and its special tokens are cut out of the raw text wherever they stand, so the ids of a text are those of its chunks, end to
end.  A text in which a special token occurs, in either case, is not lower-cased ahead: in capitals it is no special token.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np

#: A worker forgets its words once it knows so many; they are encoded anew when they come again.
CACHE_WORDS = 1_200_000
#: Marks that compose with a Latin letter, and letters whose lower case is longer or depends on what follows; such texts are not
#: lower-cased ahead of the normaliser.
_MARKS = re.compile("[\u0300-\u036f\u0130\u03a3]")
#: Letters, then ASCII punctuation other than the apostrophe: the pre-tokenizer always cuts between the two.
_TAILED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip(sorted(set(range(256)) - set(plain)), range(256, 512), strict=False))


class BatchEncoder:
    """encode(texts) gives the ids of all texts in one array, and each text's number of ids."""

    def __init__(self, file: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        special = sorted(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(special) or "(?!)", re.IGNORECASE)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cache_words = cache_words
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _letters_only(self, word: str) -> list[int]:
        """Ids of a word that is one match of the pre-tokenizer: the model alone is asked."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return [x.id for x in self.model.tokenize(word)]

    def _encode_word(self, word: str, tails: dict[str, list[int]]) -> list[int] | None:
        if word.isalpha():
            core, tail = word, ""
        elif (m := _TAILED.fullmatch(word)) and m[1].isalpha():
            core, tail = m[1], m[2]
        else:
            return None
        if core != core.lower() or not (core.isascii() or is_normalized("NFC", core)):
            return None
        ids = self._letters_only(core)
        if tail:
            if tail not in tails:
                tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
            ids = ids + tails[tail]
        return ids

    def _learn(self, words: list[str]) -> None:
        tails: dict[str, list[int]] = {}
        ids = [self._encode_word(x, tails) for x in words]
        odd = [i for i, x in enumerate(ids) if x is None]
        if odd:
            for i, x in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
                ids[i] = x.ids
        n, flat = len(self.known), np.fromiter(chain.from_iterable(ids), np.uint32)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.counts[n : n + len(words)] = counts
        self.used += len(flat)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if (text.isascii() or is_normalized("NFC", text) and not _MARKS.search(text)) and not ("<" in text and self.special.search(text)):
                text = text.lower()
            own = _SPACE.split(text) if _SEPARATORS.search(text) else text.split()
            words += own
            per_text[i] = len(own)
        if len(self.known) > self.cache_words:
            self.forget()
        if new := [x for x in dict.fromkeys(words) if x not in self.known]:
            self._learn(new)
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        take = np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - counts), counts)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.ids[take], np.diff(bounds)


#: str.split() also cuts at these; the tokenizer's \s may not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


@cache
def encoder(file: str) -> BatchEncoder:
    """One encoder for each worker process and file."""
    return BatchEncoder(file)


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
