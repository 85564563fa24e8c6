"""Token ids of whole texts, word by word.

Both vocabularies cut a text at white space before they merge anything, so the
ids of a text are those of its words one after another. Each worker keeps the
ids of the words it has met, which is several times faster than encoding running text.
A text with white space beyond ASCII is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import regex

#: Words that one worker remembers; past that it forgets all and starts again.
MEMORY = 1_000_000

#: White space that Python or Unicode knows besides ASCII's.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: A word with the space before it, or white space that no word takes along.
_SPACED = re.compile(rb" ?[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+")

# How both vocabularies cut a text before merging.
_WITH_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WITHOUT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Letters for which normalising is lower case alone.
_LATIN = re.compile("[\x20-\x7e\xa1-\u024f]+").fullmatch
#: Bytes as the vocabularies write them: printable ones as they are, others moved past 255.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_VISIBLE = {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}

_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts to little-endian uint32 ids with a tokenizer file.

    ``spaces``: white space is part of the vocabulary and a space goes with the
    word after it; otherwise white space only separates.
    """

    def __init__(self, path: str, spaces: bool) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._split: Callable[[bytes], list[bytes]] = _SPACED.findall if spaces else bytes.split
        self._lower = not spaces
        self._cut = regex.compile(_WITH_SPACES if spaces else _WITHOUT_SPACES).findall
        self._known = _Words(self._learn)
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self._tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(_VISIBLE))
        ids = self._pieces[piece] = np.array([t.id for t in found], dtype="<u4").tobytes()
        return ids

    def _learn(self, word: bytes) -> bytes:
        """Ids of a new word. A Latin one is cut as the tokenizer would, and each piece is merged once."""
        text, pieces = word.decode(), self._pieces
        if not _LATIN(text):
            return self._encode([text])[0]
        cut = self._cut(text.lower() if self._lower else text)
        return b"".join([pieces.get(p) or self._piece(p) for p in cut])

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def ids(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for an empty or missing one."""
        known, split = self._known, self._split
        for memory in (known, self._pieces):
            if len(memory) > MEMORY:
                memory.clear()
        get, out = known.__getitem__, []
        for text in texts:
            if text and _ODD_SPACE.search(text):
                found = self._encode([text])[0]
            else:
                found = b"".join(map(get, split((text or "").encode("utf-8", "replace"))))
            out.append(np.frombuffer(found, dtype="<u4"))
        return out


class _Words(dict):
    """Ids by word; a new one is learnt when it is asked for."""

    def __init__(self, learn: Callable[[bytes], bytes]) -> None:
        super().__init__()
        self._learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self._learn(word)
        return ids


def encoder(path: str, spaces: bool) -> WordEncoder:
    """One encoder per worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        _loaded[path] = WordEncoder(path, spaces)
    return _loaded[path]
