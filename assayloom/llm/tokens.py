"""Token ids of texts under a public tokenizer, each distinct word piece encoded once.

``word_bpe_49k.json`` drops white space, so a text's ids are the ids of its chunks between ASCII white space.
A chunk that is letters (ASCII or Latin-1) and then ASCII punctuation other than ' is two pieces to the
tokenizer's own pattern; every other chunk is given to the tokenizer whole. Chunks are told apart by their
64-bit hash. A worker keeps the ids of chunks met before in a table of 2^``SLOT_BITS`` places (place: leading bits of the hash; the newer
of two chunks stays), so that only chunks it doesn't hold leave numpy; the pool of their ids starts anew beyond ``POOL`` ids.
"""

from __future__ import annotations

import re

import numpy as np

from assayloom.llm.common import mix, word_places

END_ID, MEMO, SLOT_BITS, POOL, BATCH_BYTES = 2, 200_000, 20, 6_000_000, 3_000_000
_SPLIT = re.compile("^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)|([^\\n]*))$", re.M)


class Ids:
    """The tokenizer of a file, and what it gave for pieces met before."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype(np.uint16 if size <= 65_536 else np.uint32)
        ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.is_end = ends
        self.pieces: dict[str, bytes] = {"": b""}
        self._clear()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks."""
        split = _SPLIT.findall(b"\n".join(chunks).decode())
        pieces = self.pieces
        simple = [(a.lower(), b) if a and "<|" not in b else None for a, b, _ in split]
        new = {p for pair in simple if pair for p in pair}.difference(pieces)
        if len(pieces) + len(new) > MEMO:
            pieces.clear()
            pieces[""] = b""
            new = {p for pair in simple if pair for p in pair} - {""}
        listed = list(new)
        for k in range(0, len(listed), 2000):
            part = listed[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part):
                flat, size, at = ids.tobytes(), self.kind.itemsize, 0
                for p, e in zip(part, (ends * size).tolist()):
                    pieces[p] = flat[at:e]
                    at = e
            else:
                pieces.update(zip(part, self._whole(part)))
        odd = [k for k, pair in enumerate(simple) if pair is None]
        out = [pieces[pair[0]] + pieces[pair[1]] if pair else b"" for pair in simple]
        for k, ids in zip(odd, self._whole([chunks[k].decode() for k in odd])):
            out[k] = ids
        return out

    def _clear(self) -> None:
        """An empty table; entry 0 of the pool is the end id."""
        self.held = np.zeros(1 << SLOT_BITS, np.uint64)  # hash in each place
        self.begin = np.full(1 << SLOT_BITS, -1, np.int32)
        self.length = np.zeros(1 << SLOT_BITS, np.int32)
        self.pool, self.used = np.empty(1 << 20, self.kind), 1
        self.pool[0] = END_ID

    def _add(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of each in the pool, appended."""
        flat = np.frombuffer(b"".join(ids), self.kind)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        begin = self.used + np.cumsum(length) - length
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(len(self.pool) + len(flat), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return begin, length

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows' texts one after another, each with the end id appended, and the rows' bounds in them."""
        if self.used > POOL:
            self._clear()
        rows = len(offsets) - 1
        blob = data.tobytes()
        lower = b"<|" not in blob
        hashed, starts, sizes = word_places(data, offsets, lower=lower)
        if not lower:  # hashes of unfolded and folded words must not meet
            hashed = mix(hashed ^ np.uint64(1))
        place = (hashed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        begin, length = self.begin[place].astype(np.int64), self.length[place].astype(np.int64)
        missing = np.flatnonzero((self.held[place] != hashed) | (begin < 0))
        if len(missing):
            _, first, which = np.unique(hashed[missing], return_index=True, return_inverse=True)
            first = missing[first]
            new_begin, new_length = self._add(self._ids([blob[s : s + n] for s, n in zip(starts[first].tolist(), sizes[first].tolist())]))
            begin[missing], length[missing] = new_begin[which], new_length[which]
            at = place[first]
            self.held[at], self.begin[at], self.length[at] = hashed[first], new_begin, new_length
        of_row = np.searchsorted(starts, offsets[1:])
        begin, n = np.insert(begin, of_row, 0), np.insert(length, of_row, 1)
        total = np.cumsum(n)
        size = int(total[-1]) if len(total) else 0
        flat = self.pool[np.repeat(begin - (total - n), n) + np.arange(size)]
        return flat, np.concatenate([[0], total[of_row + np.arange(rows)]]).astype(np.int64)


_LOADED: dict[str, Ids] = {}


def ids_for(path: str) -> Ids:
    """One tokenizer and memo for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
