"""Cutting text into short pieces that byte-level BPE encodes independently, so each distinct piece is encoded once."""

from __future__ import annotations

from collections.abc import Callable

#: Texts with any of these, or with a character that isn't printable, are encoded whole: white space other than single spaces
#: and up to two line ends in a row, and what a tokenizer may treat as special. All others split before any space or line end.
UNUSUAL = ("  ", "\n ", " \n", "\n\n\n", "<|")


def pieces(text: str) -> list[str] | None:
    """Chunks whose encodings, joined, are the text's encoding; None if the text has to be encoded whole.

    The pre-tokenizing pattern always breaks before a single space that stands between two other characters, and
    before and after a line end between two such characters, so no token crosses these places.
    """
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in UNUSUAL) or not text.replace("\n", "").isprintable():
        return None
    # A chunk is " word" (its space is put back by the caller's key) or "\nword"; the first has neither.
    first, *rest = text.replace("\n", " \n").split(" ")
    return ["\0" + first, *rest]


def source_text(piece: str) -> str:
    """The characters of the text that a chunk stands for."""
    if piece[0] == "\0":
        return piece[1:]
    return piece if piece[0] == "\n" else " " + piece


class PieceCache(dict):
    """Chunk -> encoding, filled in batches and emptied when it holds ``limit`` chunks (a bound on memory only).

    A full stop or comma after a Latin letter is a piece of its own, so a word and the word with such a mark are encoded
    once; encodings are joined by +.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.marks = dict(zip(".,", encode([".", ","]), strict=True))

    def _marked(self, chunk: str) -> bool:
        return chunk[-1] in self.marks and len(chunk) > 1 and chunk[-2] < "\u0250" and chunk[-2].isalpha()

    def parts(self, chunks: list[str]) -> list:
        """The encodings of chunks in order."""
        out = list(map(self.get, chunks))
        holes = [i for i, x in enumerate(out) if x is None]
        if not holes:
            return out
        missing = {chunks[i] for i in holes}
        if len(self) + 2 * len(missing) > self.limit:
            self.clear()
            holes, missing = range(len(chunks)), set(chunks)
        marked = {c for c in missing if self._marked(c)}
        new = [c for c in (missing - marked) | {c[:-1] for c in marked} if c not in self]
        self.update(zip(new, self.encode([source_text(x) for x in new]), strict=True))
        for c in marked:
            self[c] = self[c[:-1]] + self.marks[c[-1]]
        for i in holes:
            out[i] = self[chunks[i]]
        return out
