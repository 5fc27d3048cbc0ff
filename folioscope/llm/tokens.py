"""Token ids of public tokenizers, with the pieces of each distinct pre-token kept per Python worker.

Both tokenizers here cut a text into pre-tokens and encode each alone, so the ids of a text are those of its pre-tokens
in a row.  Texts of plain Latin characters are cut by ``re`` with the letters and numbers written out, which gives what
the tokenizers' own patterns give; any other text goes to the library whole.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

#: Distinct pre-tokens kept per worker before the memory is emptied.
MEMORY = 500_000

# fixed values: letters, numbers and white space of the code points below U+0250
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\\t-\\r \u0085 "

_ODD = re.compile("[^\\t\\n\\r -~¡-įı-ɏ]|<\\|")
_WORD_PATTERN = re.compile(f"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+")
_BYTE_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

#: The printable characters that stand for bytes in byte-level vocabularies: their own where printable, then those from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}

_loaded: dict = {}


class _Stretches(dict):
    """The ids, as bytes of int32, of stretches of text without white space; those not met before are cut into pre-tokens."""

    def __init__(self, of_word: Callable[[str], bytes]) -> None:
        self.of_word = of_word

    def __missing__(self, stretch: str) -> bytes:
        found = self[stretch] = b"".join(map(self.of_word, _WORD_PATTERN.findall(stretch)))
        return found


class WordBpe:
    """Ids by the lower-casing BPE with word ends; ``ends`` says which pre-tokens end a sentence."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.ids = _Stretches(self._of_word)
        vocabulary = self.library.get_vocab()
        self.stops = {i for w, i in vocabulary.items() if w.removesuffix("</w>")[-1:] in (".", "!", "?")}

    def _of_word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            ids = (t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(_BYTES)))
            found = self.words[word] = np.fromiter(ids, dtype=np.int32).tobytes()
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as int32, without special tokens.

        No pre-token holds white space, so those of a text are those of its stretches between white space, which are looked up whole.
        """
        for known in (self.ids, self.words):
            if len(known) > MEMORY:
                known.clear()
        of = self.ids.__getitem__
        one = lambda t: np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.int32)
        odd = lambda t: bool(_ODD.search(t)) or not unicodedata.is_normalized("NFC", t)
        return [one(t) if odd(t) else np.frombuffer(b"".join(map(of, t.lower().split())), dtype=np.int32) for t in texts]


class ByteBpe:
    """Counts by the byte-level BPE; a special token's string in a text is ordinary text."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        import regex

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.counts: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        return (self.pattern if _ODD.search(text) else _BYTE_PATTERN).findall(text)

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        known = self.counts
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = len(self.library.encode_ordinary(p))
            return list(map(known.__getitem__, pieces))


def loaded(kind: type, path: str):
    """One tokenizer of a kind and path per worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
