"""Token ids of whole texts, by a tokenizer of the ``tokenizers`` library.

Byte-level BPE with its usual rule for words never joins a visible ASCII character with a space or a line break after it,
nor an ASCII letter with a mark after it, so a text is encoded in pieces that begin at such places. Pieces repeat: each distinct one that a process meets is encoded once and remembered with its
bytes. A piece of up to 16 bytes is two words and a length, which are compared in full wherever its hash is found;
longer pieces, and short ones whose hash another piece has, are looked up by their bytes. So the ids are those of the
whole text whatever the text is (tests compare them).
"""

from __future__ import annotations

import json
import os
import sys
from types import ModuleType

import numpy as np
import public_tokenizers
import tokenizers

from .shingles import mix

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pieces that a process remembers; beyond these it keeps those that came again.
REMEMBERED = 1_000_000
#: Longer pieces are encoded each time.
LONGEST = 256
BATCH = 1 << 20
_JOINED = 200
_BREAKS = np.zeros(256, bool)
_BREAKS[[0x20, 0x0A]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Marks that begin a piece after a letter; an apostrophe may belong to the letters behind it.
_MARKS = np.zeros(256, bool)
_MARKS[list(b',.;:!?)"')] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        words = rules["pre_tokenizer"] or {}
        if words.get("type") != "ByteLevel" or words.get("add_prefix_space") or rules["normalizer"]:
            raise ValueError("pieces are known to be safe for byte-level BPE alone")
        #: Whether letters and marks are words of their own; a whole token of both may not be cut.
        whole = [np.frombuffer(t["content"].encode(), np.uint8) for t in rules["added_tokens"]]
        self.marks = words["use_regex"] and not any((_LETTERS[t[:-1]] & _MARKS[t[1:]]).any() for t in whole)
        if any((_VISIBLE[t[:-1]] & _BREAKS[t[1:]]).any() for t in whole):
            raise ValueError("a token of several pieces")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level token has one character for each byte
            self.bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        #: Hashes of the short pieces in order, and the slot of each; by slot the piece and its ids.
        self.names, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.piece = np.zeros((0, 3), np.uint64)
        self.hits, self.start, self.size = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.uint32)
        self.others: dict[bytes, int] = {}

    def _shrink(self) -> None:
        """Forget the pieces that are not among the half that came again most often, and all that are looked up by bytes."""
        kept = np.sort(self.slots[self.hits[self.slots] > 1])
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argsort(-self.hits[kept], kind="stable")[: REMEMBERED // 2]])
        slot_names = np.zeros(len(self.hits), np.uint64)
        slot_names[self.slots] = self.names
        size = self.size[kept]
        upto = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[kept] - (upto - size), size) + np.arange(upto[-1] if len(kept) else 0)]
        self.start, self.size, self.piece, self.hits = upto - size, size, self.piece[kept], self.hits[kept] // 2 + 1
        self.slots = np.argsort(slot_names[kept])
        self.names = slot_names[kept][self.slots]
        self.others = {}

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, as uint32, and the number of each text's ids."""
        if len(self.hits) > REMEMBERED:
            self._shrink()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = b"".join([*texts, b"\0" * 16])
        n = len(raw) - 16
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        buf = np.frombuffer(raw, np.uint8)
        begins = np.zeros(n, bool)
        begins[1:] = _VISIBLE[buf[: n - 1]] & _BREAKS[buf[1:n]]
        heads = np.cumsum(lengths) - lengths
        if self.marks:
            begins[1:] |= _LETTERS[buf[: n - 1]] & _MARKS[buf[1:n]]
        begins[heads[lengths > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        which = self._slots_of(raw, buf, starts, ends)
        self.hits += np.bincount(which, minlength=len(self.hits))
        size = self.size[which]
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[which] - (upto - size), size) + np.arange(upto[-1])]
        piece_ends = np.concatenate(([0], upto))
        return ids, piece_ends[np.searchsorted(starts, heads + lengths)] - piece_ends[np.searchsorted(starts, heads)]

    def _slots_of(self, raw: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        at_byte = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
        head = at_byte[starts] & _MASKS[np.minimum(size, 8)]
        tail = at_byte[np.minimum(starts + 8, len(raw) - 8)] & _MASKS[np.clip(size - 8, 0, 8)]
        piece = np.stack((head, tail, size.astype(np.uint64)), axis=1)
        names = mix(head + mix(tail + piece[:, 2] * np.uint64(0x9E3779B97F4A7C15)))
        unique, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        place = np.searchsorted(self.names, unique)
        there = np.append(self.names, np.uint64(0))[place] == unique if len(self.names) else np.zeros(len(unique), bool)
        slot = np.full(len(unique), -1, np.int64)
        slot[there] = self.slots[place[there]]
        new = np.flatnonzero(~there & (size[first] <= 16))
        if len(new):
            at = first[new]
            slot[new] = self._learn(raw, buf, starts[at], ends[at], piece[at])
            self.names = np.insert(self.names, place[new], unique[new])
            self.slots = np.insert(self.slots, place[new], slot[new])
        which = slot[inverse]
        # What is not the piece it was taken for, or too long to be one of these, goes by its bytes.
        odd = np.flatnonzero((size > 16) | (self.piece[which] != piece).any(axis=1))
        if len(odd):
            which[odd] = self._by_bytes(raw, buf, starts[odd], ends[odd])
        return which

    def _by_bytes(self, raw: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        held = self.others
        new = {p: i for i, p in enumerate(pieces) if p not in held}
        if new:
            at = np.fromiter(new.values(), np.int64, len(new))
            slots = self._learn(raw, buf, starts[at], ends[at], np.zeros((len(at), 3), np.uint64))
            new = dict(zip(new, slots.tolist(), strict=True))
            held.update((p, s) for p, s in new.items() if len(p) <= LONGEST)
        return np.fromiter((held[p] if p in held else new[p] for p in pieces), np.int64, len(pieces))

    def _learn(self, raw: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Encode pieces and return their slots. Those that begin with a break and end visibly are joined to longer
        texts for that: they are cut from each other as in their own text."""
        joins = _BREAKS[buf[starts]] & _VISIBLE[buf[ends - 1]]
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        n_joined = int(joins.sum())
        bounds = [*range(0, n_joined, _JOINED), *range(n_joined, len(starts) + 1)]
        starts, ends = starts[order], ends[order]
        cuts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        texts = [b"".join(cuts[a:b]).decode() for a, b in zip(bounds, bounds[1:])]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        upto, cut = np.cumsum(self.bytes[flat]), np.cumsum(ends - starts)
        last = np.searchsorted(upto, cut)
        assert (upto[last] == cut).all(), "a token spans two pieces"
        begin = np.concatenate(([0], last[:-1] + 1))
        known = len(self.hits)
        self.start = np.append(self.start, len(self.flat) + begin)
        self.size = np.append(self.size, last + 1 - begin)
        self.flat = np.concatenate((self.flat, flat))
        self.piece = np.concatenate((self.piece, piece[order]))
        self.hits = np.append(self.hits, np.zeros(len(order), np.int64))
        slots = np.empty(len(order), np.int64)
        slots[order] = known + np.arange(len(order))
        return slots


def encoder(path: str) -> Encoder:
    """The encoder of this process for a file; it outlives a task where Spark reuses its workers."""
    # Functions come to the workers by value, with globals of their own; what is to stay has a module of its own.
    held = vars(sys.modules.setdefault("sitewright_encoders", ModuleType("sitewright_encoders"))).setdefault("by_path", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
