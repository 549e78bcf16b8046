"""Token ids of whole texts by a public tokenizer, through a cache of words.

The tokenizer turns white space into word breaks before anything else, so the
ids of a text are those of its white-space-separated words in turn. A word of
letters with plain marks at its end is split there first, which the tokenizer's
own pattern does as well; so a word is two parts, of which the second may be empty.
Letters of ASCII texts are lower-cased beforehand, as the tokenizer would.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import kept, Words

END_ID = 1
CACHED_WORDS, CACHED_PARTS = 450_000, 320_000
#: Bytes of text that are encoded together.
ENCODED_BYTES = 1 << 20
#: Parts that are encoded as one text.
_JOINED = 256
#: ASCII and Latin-1 letters, which lower-case alike everywhere, then plain marks.
_MARKS = b".,!?;:#*$%&|"
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "TextEncoder":
    """The worker's encoder, kept with its words from one encoding task to the next."""
    return kept(f"encoder {path}", lambda: TextEncoder(path))


class _Parts(dict):
    """Parts of words to running numbers; new ones are gathered."""

    def __init__(self):
        super().__init__({b"": 0})
        self.new: list[bytes] = []

    def __missing__(self, part: bytes) -> int:
        at = self[part] = len(self)
        self.new.append(part)
        return at


class TextEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: ids that end a run of letters or marks, if the tokenizer marks ends
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[v for k, v in vocabulary.items() if k.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.parts = Words(self._learn, 1 << 62), _Parts()
        self.first, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def _learn(self, words: list[bytes]) -> dict[str, np.ndarray]:
        """The two parts of new words; ids of new parts go into self.ids."""
        at_letters, n = _LETTERS.fullmatch, len(words)
        head = [w.rstrip(_MARKS) for w in words]
        for k, (w, x) in enumerate(zip(words, head, strict=True)):
            if x.isalpha():
                head[k] = x.lower()
            elif x and at_letters(x):
                head[k] = x.decode().lower().encode()
            else:
                head[k] = w
        size = np.fromiter(map(len, words), np.int64, n) - np.fromiter(map(len, head), np.int64, n)
        parts, number = np.zeros((n, 2), np.int32), self.parts.__getitem__
        parts[:, 0] = np.fromiter(map(number, head), np.int32, n)
        marked = np.flatnonzero(size)
        parts[marked, 1] = np.fromiter((number(words[k][-c:]) for k, c in zip(marked.tolist(), size[marked].tolist(), strict=True)), np.int32, len(marked))
        self._encode_parts()
        return {"parts": parts}

    def _encode_parts(self) -> None:
        new, self.parts.new = self.parts.new, []
        # letters or marks alone, letters that are not ASCII, and others, which go one by one
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, x in enumerate(new):
            kinds[0 if x.isalpha() or not x.rstrip(_MARKS) else 1 if _LETTERS.fullmatch(x) else 2].append(k)
        base, alone = len(self.parts) - len(new), kinds[2]
        for at in kinds[:2]:
            if not at:
                continue
            texts = [b" ".join([new[k] for k in at[a : a + _JOINED]]).decode() for a in range(0, len(at), _JOINED)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(got), "<u4", sum(map(len, got)))
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(at) and ends[-1] == len(ids):
                self._keep(base + np.array(at), ids, np.diff(ends, prepend=0))
            else:  # ends are not marked as expected: one by one
                alone = [*alone, *at]
        if alone:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([new[k].decode("utf-8", "replace") for k in alone], add_special_tokens=False)]
            count = np.fromiter(map(len, got), np.int64, len(got))
            self._keep(base + np.array(alone), np.fromiter(chain.from_iterable(got), "<u4", int(count.sum())), count)

    def _keep(self, at: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        if len(self.parts) > len(self.first):
            more = np.zeros(2 * len(self.parts) - len(self.first), np.int64)
            self.first, self.count = np.concatenate([self.first, more]), np.concatenate([self.count, more])
        self.first[at], self.count[at] = self.used + np.cumsum(count) - count, count
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(2 * (self.used + len(ids)), "<u4")
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, without an end id, as bytes of little-endian uint32."""
        if len(self.words) > CACHED_WORDS or len(self.parts) > CACHED_PARTS:
            self._forget()
        # names of special tokens, which begin with <, are matched before letters are lower-cased
        at, ends = self.words.indices([(x.lower() if x.isascii() and b"<" not in x else x).split() for x in texts])
        if not len(at):
            return [b""] * len(texts)
        parts = self.words.columns["parts"][at].ravel()
        first, count = self.first[parts], self.count[parts]
        stop = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        raw = memoryview(self.ids[np.repeat(first - stop[:-1], count) + np.arange(stop[-1])].tobytes())
        cuts = (4 * stop[2 * ends]).tolist()
        return [bytes(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
