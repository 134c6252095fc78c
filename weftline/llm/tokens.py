"""Whole-text encoding with a public tokenizer, one worker-wide memo of encoded words.

Both tokenizers split a text into words before they merge anything, so a text's ids are the ids of
its pieces in a row, wherever the text is cut at a place that the split also cuts. A memo of such
pieces gives exactly the library's ids, at a fraction of its cost, since most words come again.
Texts that hold an added token, like ``<|endoftext|>``, are encoded by the library as they are.
"""

from __future__ import annotations

import os
import re
from array import array

#: Entries a worker keeps; later new words are encoded each time. Bounds memory, not results.
MEMO_WORDS = 500_000

# A space before a character that is surely no white space: every split of this kind of tokenizer
# starts a new word there.
_ODD_SPACE = re.compile(r" (?![!-~¡-ɏ])")
_PLAIN_SPACE = re.compile(r"(?!\A)(?= [!-~¡-ɏ])")

#: Marks that both kinds of split part from the letter or digit before them.
_TAIL = ".,;:!?*$%&#|)"
#: Composed letters that lower-casing maps one to one.
_SIMPLE_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """Piece to packed ids; the pieces of one memo all follow the same ``lead`` (none, or a space)."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> bytes:
        body = piece.rstrip(_TAIL)
        room = MEMO_WORDS
        last = body[-1:].lower()  # what lower-casing takes apart may end in a mark that joins the tail
        if len(body) < len(piece) and len(last) == 1 and last.isalnum():
            found, room = self[body] + self.encoder.bare[piece[len(body) :]], MEMO_WORDS // 2
        else:
            found = self.encoder.fresh(self.lead, piece)
        if len(self) < room and len(piece) < 64:
            self[piece] = found
        return found


class Encoder:
    """Encodes texts as little-endian unsigned ids of 16 bits, or 32 for large vocabularies.

    ``spaces``: the vocabulary holds words with their leading space (else spaces are dropped).
    ``added``: added tokens in a text get their own id, the library's default, which ``encoder``
    takes; else they are split like other text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        known = self.tokenizer.get_added_tokens_decoder().values() if added else []
        # One that is sought in normalised text may be any text.
        self._added = tuple("" if t.normalized else t.content for t in known)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self.spaces = self.encode(" a") != self.encode("a")
        self.bare, self.led = _Memo(self, ""), _Memo(self, " ")
        self._word = self.tokenizer.model.tokenize
        self._letters = byte_alphabet()

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def fresh(self, lead: str, piece: str) -> bytes:
        word = self._as_word(lead, piece)
        return array(self.code, self.encode(lead + piece) if word is None else [t.id for t in self._word(word)]).tobytes()

    def _as_word(self, lead: str, piece: str) -> str | None:
        """The piece as the merges take it, if it is one word of plain letters."""
        if not piece.isalpha():
            return None
        if not self.spaces:
            if not piece.isascii() and _SIMPLE_LETTERS.fullmatch(piece) is None:
                return None
            piece = piece.lower()
        if not piece.isascii():
            return "".join(map(self._letters.__getitem__, (lead + piece).encode()))
        return "Ġ" + piece if lead else piece

    def ids(self, text: str) -> bytes:
        """The text's ids, packed."""
        if any(t in text for t in self._added):
            return array(self.code, self.encode(text)).tobytes()
        if not self.spaces:
            return b"".join(map(self.bare.__getitem__, text.replace("\n", " ").split(" ")))
        if _ODD_SPACE.search(text) is None:
            first, *rest = text.split(" ")
            return self.bare[first] + b"".join(map(self.led.__getitem__, rest))
        first, *rest = _PLAIN_SPACE.split(text)
        return self.bare[first] + b"".join([self.led[x[1:]] for x in rest])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]
