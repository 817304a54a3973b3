"""Subword ids of words, looked up where a word was seen before.

The public word-level BPE drops white space and never joins across it, so the ids of a text are those of its
white-space words in order. Words repeat, so a task keeps the ids of those it has met and tokenises only new ones, many
at a time. Case is dropped by the tokenizer; ASCII letters are lowered first so that more words are the same.
"""

import base64
import functools
import os
import re

import numpy as np

FILE = "word_bpe_49k.json"
#: A worker forgets its words when it has kept so many.
KEPT_WORDS = 1_500_000
#: White space to the tokenizer, beyond what bytes.split() knows; a text that holds any is tokenised whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -​    　﻿]")
_PLAIN = re.compile(rb"[a-z]+\Z")
_LETTERS = re.compile(r"[^\W\d_]+\Z")
#: Letters with marks behind; no apostrophe, which may begin a piece of its own.
_MARKED = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)\Z")


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(FILE)


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> "WordIds":
    """A worker's word ids; later tasks of the same worker go on with them."""
    return WordIds(path)


class WordIds:
    """encode(text) gives the ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normalizer = self.tokenizer.normalizer
        #: A letter may become letter and mark, which the tokenizer joins with the marks behind: such words are no run of letters.
        self.normal = normalizer.normalize_str if normalizer else str
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.kept, self.known = kept, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        known, normal = self.known, self.normal
        if len(known) + len(words) > self.kept:
            known.clear()
        plain, other, marked = [], [], []
        letters = lambda w: _PLAIN.match(w) or (_LETTERS.match(t := w.decode()) and _LETTERS.match(normal(t)))
        for w in words:
            if letters(w):
                plain.append(w)
            elif (m := _MARKED.match(w)) and letters(m[1]):
                marked.append((w, m[1], m[2]))
            else:
                other.append(w)
        plain += list({w for _, w, _ in marked if w not in known}.difference(plain))
        other += list({w for _, _, w in marked if w not in known}.difference(other))
        if plain:
            # a run of letters is one piece to the tokenizer, and its last id marks the end
            for at in range(0, len(plain), 64):
                some = plain[at : at + 64]
                ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(some):  # a letter that the tokenizer splits
                    other += some
                    continue
                raw, start = ids.tobytes(), 0
                for w, stop in zip(some, stops.tolist(), strict=True):
                    known[w] = raw[4 * start : 4 * stop]
                    start = stop
        for w in other:
            known[w] = self._whole(w.decode())
        for w, a, b in marked:
            known[w] = known[a] + known[b]

    @staticmethod
    def by_words(text: str) -> bool:
        """Whether the tokenizer sees the same words as bytes.split()."""
        if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return False
        return text.isascii() or not _OTHER_SPACE.search(text)

    def words(self, text: str) -> list[bytes] | None:
        """The words of a text, all learned; None if it must be tokenised whole."""
        if not self.by_words(text):
            return None
        words = text.encode("utf-8", "replace").lower().split()
        if new := list({w for w in words if w not in self.known}):
            self._learn(new)
            if any(w not in self.known for w in words):  # more words than are kept at once
                self._learn(list(set(words)))
        return words

    def encode(self, text: str) -> bytes:
        words = self.words(text)
        if words is None:
            return self._whole(text)
        return b"".join([self.known[w] for w in words])


SPACED_FILE = "byte_bpe_50k.tiktoken"
#: Ids of that vocabulary.
SPACED = 50_256


def spaced_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(SPACED_FILE)


@functools.lru_cache(maxsize=1)
def spaced_words(path: str) -> "SpacedWords":
    return SpacedWords(path)


class SpacedWords:
    """Byte-level ids of words that each have a space in front: no id spans two words, and the first id of each begins with the space."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("spaced", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(SPACED, bool)
        self.begins[[i for w, i in ranks.items() if w[:1] == b" "]] = True

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words, one after the other, and how many each has."""
        pools, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.encoding.encode_ordinary(" " + b" ".join(some).decode("utf-8", "replace")), np.int32)
            n = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
            if len(n) != len(some):  # a word with white space of other kinds
                each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in some]
                ids, n = np.array([i for e in each for i in e], np.int32), np.array([len(e) for e in each])
            pools.append(ids)
            sizes.append(n)
        return np.concatenate(pools), np.concatenate(sizes)
