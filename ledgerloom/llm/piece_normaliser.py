"""The normaliser of a piece model as a transducer: longest matches of its
compiled character map are rewritten, spaces become the space mark."""

from __future__ import annotations

import struct

MARK = "▁"


class CharacterMap:
    """Longest-match rewriting by a compiled map: a double-array trie over
    UTF-8 bytes, and the texts that its leaves point to."""

    def __init__(self, blob: bytes):
        size, = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size:]
        self.memo: dict[int, str] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _text(self, at: int) -> str:
        if at not in self.memo:
            self.memo[at] = self.texts[at:self.texts.index(b"\0", at)].decode()
        return self.memo[at]

    def longest(self, raw: bytes, at: int) -> tuple[str, int] | None:
        """What the longest key that begins at ``at`` becomes, and its length."""
        units, found = self.units, None
        node = self._offset(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            unit = units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, k - at + 1)
        return found and (self._text(found[0]), found[1])


class Normaliser:
    def __init__(self, spec):
        if not spec.escape_whitespaces:
            raise ValueError("spaces must become marks")
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        #: nothing but marks for spaces and one in front
        self.plain = self.map is None and not self.squeeze

    def _rewritten(self, text: str) -> list[str]:
        if self.map is None:
            return list(text)
        raw, at, out = text.encode("utf-8", "replace"), 0, []
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit is None:  # one character as it is
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                hit = (raw[at:at + n].decode(), n)
            out.append(hit[0])
            at += hit[1]
        return out

    def __call__(self, text: str) -> str:
        if self.plain:
            return (MARK + text if self.prefix and text else text).replace(" ", MARK)
        steps = self._rewritten(text)
        if self.squeeze:
            first = next((i for i, s in enumerate(steps) if s != " "), len(steps))
            steps = steps[first:]
        if not steps:
            return ""
        out, after_space = [MARK] if self.prefix else [], self.squeeze
        for s in steps:
            if after_space:
                s = s.lstrip(" ")
            if s:
                out.append(s.replace(" ", MARK))
                after_space = s.endswith(" ")
            after_space = after_space and self.squeeze
        done = "".join(out)
        return done.rstrip(MARK) if self.squeeze else done
