"""Byte-level BPE by distinct pieces: texts are cut in numpy, the tokenizers library encodes each piece once.

A byte-level BPE never merges across the pieces of its pre-tokenizer, so the ids of a text are those
of its pieces in order. Pieces are found for a block of texts at once, from the classes of their
characters; equal pieces are one by a 64-bit hash (long ones by a stronger hash of their content).
Pieces not met before go to the library's model. What is known is kept in flat arrays, at most
``CACHE_PIECES`` pieces, and lives as long as the Python worker, across its tasks.

Texts with characters on which Unicode versions may disagree, with a special token's string or a NUL,
and tokenizers of another build go through the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from dapple.llm.neardup import mix, powers

CACHE_PIECES = 1_000_000
RECENT_PIECES = 50_000
BLOCK_CHARS = 1 << 18
LONG_PIECE = 64

OTHER, LETTER, NUMBER, SPACE, MARK, NUL = range(6)
#: Characters whose class is the same in every version of Unicode.
AGREED = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))
_U = np.uint64


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    kinds = [(LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s"))]
    out = np.full(0x110000, OTHER, np.uint8)
    for first, last in AGREED:
        for c in range(first, last + 1):
            out[c] = next((k for k, p in kinds if p.match(chr(c))), MARK)
    out[0] = NUL
    return out


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary; NUL, a separator here, stays."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden) if b}


def cuts(c: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where a piece begins, in code points that start with one NUL and end with two; a NUL is a piece.

    Pieces are contractions, runs of letters, of numbers or of marks, each with a space before it,
    and white space: all of a run but what goes with the next piece.
    """
    begin = np.ones(len(c), bool)
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin[kind == NUL] = True
    after = np.flatnonzero(begin[1:] & (kind[:-1] == SPACE) & (kind[1:] != NUL)) + 1
    begin[after - 1] = True
    begin[after[c[after - 1] == 32]] = False
    at = np.flatnonzero(c == 39)
    at = at[begin[at] & (kind[at + 1] == LETTER)]
    x, y = c[at + 1], c[at + 2]
    one = np.isin(x, [ord("s"), ord("t"), ord("m"), ord("d")])
    two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    begin[at[one | two] + 1] = False
    begin[at[one] + 2] = True
    begin[at[two] + 3] = True
    return begin


class Known:
    """Ids by the hash of a piece: a large sorted part and a small recent one."""

    def __init__(self):
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.parts = [(np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(2)]

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of the ids of sorted keys; begin is -1 where a key is not known."""
        begin, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for have, b, m in self.parts:
            if len(have):
                i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[i] == keys
                begin[hit], n[hit] = b[i[hit]], m[i[hit]]
        return begin, n

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(ids), self.used), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        new = (keys, self.used + np.cumsum(n) - n, n)
        self.used += len(ids)
        self.parts[1] = self.merged(self.parts[1], new)
        if len(self.parts[1][0]) > RECENT_PIECES:
            self.parts = [self.merged(*self.parts), (np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64))]

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)


class Encoder:
    """Texts to the bytes of their ids, each with ``end_id`` after it.

    With ``special_as_text`` the strings of special tokens are ordinary text; the library's default,
    kept here, turns them into their ids.
    """

    def __init__(self, path: str, end_id: int, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.end_id = end_id
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens") or []]
        self.by_piece = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True)
            and spec.get("normalizer") is None
            and spec["model"].get("type") == "BPE"
            and spec["model"].get("dropout") is None
        )
        self.known = Known()

    def library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and the number of each one's."""
        mapped = "\0".join(pieces).encode().decode("latin-1").translate(byte_letters()).split("\0") if pieces else []
        tokenize, ids, n = self.tok.model.tokenize, [], []
        for p in mapped:
            got = tokenize(p)
            n.append(len(got))
            ids += [t.id for t in got]
        return np.array(ids, np.uint32), np.array(n, np.int64)

    def whole(self, text: str) -> bytes:
        return np.asarray([*self.tok.encode(text, add_special_tokens=False).ids, self.end_id], "<u4").tobytes()

    def apart(self, text: str) -> bool:
        """Whether the library must see the text whole."""
        return not self.by_piece or "\0" in text or any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text in order, in blocks of about ``BLOCK_CHARS`` characters."""
        held, size = [], 0
        for t in texts:
            if held and size + len(t) > BLOCK_CHARS:
                yield from self.block(held)
                held, size = [], 0
            held.append(t)
            size += len(t) + 1
        if held:
            yield from self.block(held)

    def block(self, texts: list[str]) -> list[bytes]:
        alone = [self.apart(t) for t in texts]
        raw = "\0" + "".join(["\0" if a else t + "\0" for t, a in zip(texts, alone, strict=True)])
        c = np.frombuffer(raw.encode("utf-32-le"), "<u4")
        kind = classes()[c]
        if not kind.all():
            ends = np.flatnonzero(kind == NUL)
            for d in np.unique(np.searchsorted(ends, np.flatnonzero(kind == OTHER)) - 1).tolist():
                alone[d] = True
            raw = "\0" + "".join(["\0" if a else t + "\0" for t, a in zip(texts, alone, strict=True)])
            c = np.frombuffer(raw.encode("utf-32-le"), "<u4")
            kind = classes()[c]
        ids, ends = self.ids_of(raw, c, kind)
        cut = np.concatenate([[0], ends]).tolist()
        return [self.whole(t) if a else ids[x:y].tobytes() for t, a, x, y in zip(texts, alone, cut, cut[1:], strict=False)]

    def ids_of(self, raw: str, c: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's end."""
        nul = np.zeros(3, c.dtype)
        begin = np.flatnonzero(cuts(np.concatenate([c, nul]), np.concatenate([kind, np.full(3, NUL, np.uint8)]))[: len(c)])[1:]
        end = np.append(begin[1:], len(c))
        up, down = powers(max(20, int(len(c)).bit_length()))
        run = np.concatenate([np.zeros(1, _U), np.cumsum((c.astype(_U) + _U(1)) * up[: len(c)], dtype=_U)])
        h = mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(_U))
        long_ = np.flatnonzero(end - begin > LONG_PIECE)
        if len(long_):
            import xxhash

            h[long_] = [xxhash.xxh3_64_intdigest(c[a:b].tobytes()) for a, b in zip(begin[long_].tolist(), end[long_].tolist(), strict=True)]
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        at, n = self.known.look(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.known) > CACHE_PIECES:
                self.known = Known()
                new = np.arange(len(keys))
            ends = c[begin[first[new]]] == 0
            places = first[new[~ends]]
            got, m = self.library([raw[a:b] for a, b in zip(begin[places].tolist(), end[places].tolist(), strict=True)])
            own = np.full(ends.sum(), self.end_id, np.uint32)
            self.known.add(np.append(keys[new[~ends]], keys[new[ends]]), np.append(got, own), np.append(m, np.ones(len(own), np.int64)))
            at, n = self.known.look(keys)
        at, n = at[back], n[back]
        total = np.cumsum(n)
        ids = self.known.flat[np.repeat(at - (total - n), n) + np.arange(total[-1])].astype("<u4")
        return ids, total[c[begin] == 0]


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int, special_as_text: bool = False) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path, end_id, special_as_text)
