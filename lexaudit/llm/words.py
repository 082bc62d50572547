"""Encoding of single words with the tokenizers library."""

from __future__ import annotations

import os
import re

import numpy as np


class WordEncoder:
    """Encodes words, each as a text of its own, without truncation and padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        found = self.tokenizer.encode_batch([x.decode("utf-8") for x in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]


class SpacedEncoder(WordEncoder):
    """The same for tokenizers that drop white space and mark the last id of every piece by ``</w>``.

    Words of plain letters, with a run of marks behind or not, are one piece
    or two; such words go to the library many at a time, with spaces between,
    and their ids are cut behind the marked ones.
    """

    PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([,.;:!?*#%$&|)\]]*)")
    TOGETHER = 64

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        texts = [x.decode("utf-8") for x in words]
        plain = [self.PLAIN.fullmatch(x) for x in texts]
        few = [i for i, m in enumerate(plain) if m]
        rest = [i for i, m in enumerate(plain) if not m]
        out: list[bytes] = [b""] * len(words)
        if few:
            joined = [" ".join(texts[i] for i in few[a : a + self.TOGETHER]) for a in range(0, len(few), self.TOGETHER)]
            found = np.concatenate([np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch(joined, add_special_tokens=False)])
            pieces = np.cumsum([2 if plain[i][1] else 1 for i in few])
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == pieces[-1]:
                cuts, flat, start = (4 * ends[pieces - 1]).tolist(), found.tobytes(), 0
                for i, end in zip(few, cuts, strict=True):
                    out[i], start = flat[start:end], end
            else:
                rest += few
        for i, x in zip(rest, super().ids([words[i] for i in rest]), strict=True):
            out[i] = x
        return out
