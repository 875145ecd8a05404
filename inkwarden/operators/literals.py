"""Which of many literals occur in which of many texts, in one vectorised pass over all bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are looked through at once.
CHUNK = 2 << 20


class Literals:
    """A fixed list of byte strings, told apart by their first three bytes.

    Two tables of byte pairs, eight bits wide, leave a few positions in a hundred; these are compared
    in full. The cost hangs on the bytes read, hardly on how many literals there are.
    """

    def __init__(self, literals: list[bytes]) -> None:
        self.literals = list(literals)
        self._short = [(i, x) for i, x in enumerate(literals) if len(x) < 3]
        heads: dict[int, list[int]] = {}
        for i, x in enumerate(literals):
            if len(x) >= 3:
                heads.setdefault(int.from_bytes(x[:3], "little"), []).append(i)
        self._keys = np.array(sorted(heads), np.uint32)
        self._of = [heads[k] for k in self._keys.tolist()]
        self._first, self._second = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        for n, key in enumerate(self._keys.tolist()):
            self._first[key & 0xFFFF] |= 1 << n % 8
            self._second[key >> 8] |= 1 << n % 8

    def among(self, texts: list[bytes]) -> np.ndarray:
        """(text, literal) truth values."""
        out = np.zeros((len(texts), len(self.literals)), bool)
        for i, x in self._short:
            out[:, i] = [x in t for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) < 3 or not len(self._keys):
            return out
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        pairs = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << np.uint16(8)
        at = np.flatnonzero(self._first[pairs[:-1]] & self._second[pairs[1:]])
        key = pairs[at].astype(np.uint32) | data[at + 2].astype(np.uint32) << np.uint32(16)
        which = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        true = self._keys[which] == key
        at, which = at[true], which[true]
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(len(self._keys) + 1))
        for n in np.flatnonzero(np.diff(edges)).tolist():
            own = at[order[edges[n] : edges[n + 1]]]
            for i in self._of[n]:
                literal = self.literals[i]
                left = own[own + len(literal) <= len(data)]
                for k in range(3, len(literal)):
                    left = left[data[left + k] == literal[k]]
                    if not len(left):
                        break
                text = np.searchsorted(bounds, left, side="right") - 1
                out[text[left + len(literal) <= bounds[text + 1]], i] = True
        return out


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring rows with at most limit bytes together, or of one row."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)
