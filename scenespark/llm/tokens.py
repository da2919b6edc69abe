"""Fast exact use of the public tokenizers inside tasks: a text is cut as the vocabulary cuts it, and each cut is encoded once."""

from __future__ import annotations

import os
import re
from array import array

#: Cuts an encoder remembers (about 200 bytes each) and the longest one it keeps.
REMEMBERED, LONGEST = 250_000, 48
#: Texts taken from a batch at once.
TEXTS = 512
_SPACE_AFTER_SPACE, _WORD_THEN_SPACE = re.compile(r"\s "), re.compile(r"(?<=\S) ")
# Letters, numbers and white space of Latin-1, as the vocabularies' patterns (\p{L}, \p{N}, \s) have them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_WITH_SPACE = re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WITHOUT_SPACE = re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_encoders: dict = {}


def _byte_letters() -> dict[int, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Known(dict):
    """Ids of cuts, found when they are first asked for.

    The first cuts are kept, which are the frequent ones and some rare ones; after four times as many misses they
    are all forgotten, so that the memory follows a change of language.
    """

    def __init__(self, find):
        self.find, self.missed = find, 0

    def __missing__(self, cut: str) -> bytes:
        ids = self.find(cut)
        self.missed += 1
        if self.missed > 4 * REMEMBERED:
            self.clear()
            self.missed = 0
        if len(self) < REMEMBERED and len(cut) <= LONGEST:
            self[cut] = ids
        return ids


class Encoder:
    """Encodes texts as the tokenizers library does with add_special_tokens=False.

    ``keep_space``: a space belongs to what follows it (byte-level vocabularies); else white space is dropped
    and letters are lowered.  Texts of Latin-1 are cut by the vocabulary's own pattern and the cuts go straight
    to the library's model.  Other texts are split before every space that follows a character other than
    white space, where both vocabularies cut too; those pieces that are not Latin-1, and whole texts that
    spell a special token, go to the library as they are.
    """

    def __init__(self, path: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.keep_space = self.tokenizer.model, keep_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts, self.pieces = _Known(self._cut), _Known(self._piece)
        self.get = self.cuts.__getitem__

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _cut(self, cut: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(cut.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._latin(piece) if _is_latin(piece) else self._library(piece)

    def _latin(self, text: str) -> bytes:
        cuts = _WITH_SPACE.findall(text) if self.keep_space else _WITHOUT_SPACE.findall(text.lower())
        return b"".join(map(self.get, cuts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        return list(map(self.ids, texts))

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._library(text)
        if _is_latin(text):
            return self._latin(text)
        first, *rest = _WORD_THEN_SPACE.split(text) if self.keep_space and _SPACE_AFTER_SPACE.search(text) else text.split(" ")
        if self.keep_space:
            rest = [" " + p for p in rest]
        return b"".join(map(self.pieces.__getitem__, [first, *rest]))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str, keep_space: bool) -> Encoder:
    """The worker's encoder for a vocabulary file; one at a time, so that a worker of several jobs keeps one memory."""
    if (path, keep_space) not in _encoders:
        _encoders.clear()
        _encoders[path, keep_space] = Encoder(path, keep_space)
    return _encoders[path, keep_space]


def slices(batch, rows: int = TEXTS):
    """Arrow batches of at most so many rows."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)
