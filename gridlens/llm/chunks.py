"""Split a text where every byte-level BPE pre-token boundary is certain.

No alternative of the public pattern runs from a non-space character into
white space, so each unit "white space run + non-space run" tokenises alone.
``ChunkEncoder`` encodes a unit once per worker and reuses the bytes; the cache is a
bounded speed-up and never changes a result.
"""

from __future__ import annotations

import regex

_UNITS = regex.compile(r"\s*\S+|\s+")


class _Ragged(Exception):
    pass


class ChunkEncoder(dict):
    """word (without its leading space) -> packed ids of " word".

    ``encode_units(list[str]) -> list[bytes]`` does the real work.  When ``limit`` words
    are held they become the older generation, which replaces the one before; words met
    again move back from there.
    """

    def __init__(self, encode_units, limit: int = 150_000, longest: int = 64):
        super().__init__()
        self.encode_units, self.limit, self.longest = encode_units, limit, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            if not word or word[-1].isspace():
                raise _Ragged
            out = self.encode_units([" " + word])[0]
        self._keep(word, out)
        return out

    def _keep(self, word: str, out: bytes) -> None:
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = out

    def warm(self, texts: list[str]) -> None:
        """Encode all unseen words of some texts in one call."""
        new: set[str] = set()
        for t in texts:
            new.update(t.split(" ")[1:-1])
        new = [w for w in new.difference(self, self.older) if w and len(w) <= self.longest and not w[-1].isspace()]
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            for w, out in zip(part, self.encode_units([" " + w for w in part])):
                self._keep(w, out)

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; null and empty texts give none."""
        if not text:
            return b""
        words = text.split(" ")
        if len(words) < 3 or (words[0] and words[0][-1].isspace()):
            return self._slow(text)
        try:
            mid = b"".join(map(self.__getitem__, words[1:-1]))
        except _Ragged:
            return self._slow(text)
        ends = self.encode_units([u for u in (words[0], " " + words[-1]) if u])
        return (ends[0] if words[0] else b"") + mid + ends[-1]

    def _slow(self, text: str) -> bytes:
        return b"".join(self.encode_units(_UNITS.findall(text)))
