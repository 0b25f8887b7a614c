"""Ids of whole texts from a tokenizer that drops white space, by a cache of words.

Such a tokenizer never merges across white space, so a text's ids are those of
its words in a row. A batch's words are numbered by Arrow; each Python worker
keeps the ids of the words it has seen in one flat array, and a batch's new words
are encoded together. Plain words are cut into pieces by the tokenizer's own
pattern first, so that only new pieces go to the library, past its normalizer.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

from kestrel.llm.token_counts import tokenizer

#: Words in a worker's cache at most, and their characters.
CACHE, CHARACTERS = 400_000, 1 << 24

#: Python splits at these, the tokenizer does not; such texts go to the library whole.
ODD = re.compile("[\x00\x1c-\x1f]")

#: The tokenizer's own pattern of what it never merges across (fixed, must match its file).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Words that are encoded as one text, with a NUL between each two.
JOINED = 4096

_made: dict = {}


def plain_lower(text: str) -> str:
    """Lower case, where it surely is what the tokenizer makes of the text; fewer words to know."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


class WordIds:
    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        #: The same model without normalizer and pattern, for pieces that need neither.
        self.lean = Tokenizer(self.tok.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tok.get_vocab_size()
        #: Whether a token closes a sentence.
        self.ends = np.zeros(size, bool)
        for token, i in self.tok.get_vocab().items():
            bare = token.removesuffix("</w>")
            self.ends[i] = bool(re.fullmatch(r"\W+", bare) and re.search(r"[.!?]", bare)) and token != bare
        [self.nul] = self.tok.encode("\0", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.words, self.pieces, self.characters = Table(), Table(), 0
        self.pieces.add(["\0"], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _encoded(self, tok: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has.

        Many words go to the library as one text, which costs less than one by
        one; no text with a NUL of its own comes here.
        """
        texts = [" \0 ".join(words[i:i + JOINED]) + " \0" for i in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.nul)
        sizes = np.diff(marks, prepend=-1) - 1
        if len(sizes) != len(words):
            raise AssertionError("a word gave the separator's id")
        return np.delete(ids, marks), sizes

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if is_plain(w)]
        if plain:
            cut = PIECES.findall(" \0 ".join(plain) + " \0")
            new = list(set(cut).difference(self.pieces.index))
            if new:
                self.pieces.add(new, *self._encoded(self.lean, new))
            at = np.fromiter(map(self.pieces.index.__getitem__, cut), np.int64, len(cut))
            breaks = np.flatnonzero(at == 0)
            self.words.add(plain, self.pieces.gather(at), np.add.reduceat(self.pieces.sizes[at], np.concatenate([[0], breaks[:-1]])))
        if len(plain) < len(words):
            other = [w for w in words if not is_plain(w)]
            self.words.add(other, *self._encoded(self.tok, other))
        self.characters += sum(map(len, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.words.index) > CACHE or self.characters > CHARACTERS:
            self.clear()
        odd = [i for i, t in enumerate(texts) if ODD.search(t)]
        plain = texts if not odd else ["" if ODD.search(t) else t for t in texts]
        split = pc.utf8_split_whitespace(pa.array(map(plain_lower, plain), pa.large_string()))
        numbered = pc.dictionary_encode(split.flatten())
        words = numbered.dictionary.to_pylist()
        new = [w for w in words if w not in self.words.index]
        if new:
            self._learn(new)
        known = np.fromiter(map(self.words.index.__getitem__, words), np.int64, len(words))
        at = known[numbered.indices.to_numpy()]
        ids = self.words.gather(at)
        ends = np.concatenate([[0], np.cumsum(self.words.sizes[at])])[split.offsets.to_numpy()]
        out = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for i in odd:
            out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def is_plain(word: str) -> bool:
    """Whether the normalizer leaves the word as it is, and no special token is in it."""
    return "<|" not in word and (word.isascii() or max(word) < "\u0100") and word == word.lower()


class Table:
    """Ids of numbered strings, in one flat array."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.index), len(words)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        if n + m > len(self.begins):
            self.begins, self.sizes = (np.concatenate([x, np.zeros(max(len(x), m), np.int64)]) for x in (self.begins, self.sizes))
        self.flat[self.used:self.used + len(ids)] = ids
        self.sizes[n:n + m] = sizes
        self.begins[n:n + m] = self.used + np.cumsum(sizes) - sizes
        self.index.update(zip(words, range(n, n + m), strict=True))
        self.used += len(ids)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the strings numbered ``at``, in a row."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.uint32)
        return self.flat[np.repeat(self.begins[at] - ends + sizes, sizes) + np.arange(ends[-1])]
