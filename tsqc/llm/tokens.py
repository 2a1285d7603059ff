"""Byte-level BPE ids of whole texts, the same as the tokenizers library gives for byte_bpe_50k.json.

Texts of code points below FAST_BELOW and without an apostrophe are cut into pieces in numpy and each different piece is encoded once
per worker; all other texts go through the tokenizers library as they are. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np

from tsqc.llm.common import powers, splitmix

FAST_BELOW = 0x100
#: Different pieces that a worker remembers; then it starts anew.
REMEMBER = 1 << 20
_BASE = 0xD6E8FEB86659FD93
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0)

_WORKER: dict[tuple[str, str], "Encoder"] = {}


def encoder(json_path: str, rank_path: str) -> "Encoder":
    """The encoder of this process."""
    key = (json_path, rank_path)
    if key not in _WORKER:
        _WORKER[key] = Encoder(*key)
    return _WORKER[key]


class Encoder:
    def __init__(self, json_path: str, rank_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.encode_special_tokens = True
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        kind = np.zeros(FAST_BELOW, np.uint8)  # 0 other, 1 letter, 2 number, 3 space
        for i in range(FAST_BELOW):
            c = chr(i)
            kind[i] = 1 if c.isalpha() else 2 if c.isnumeric() else 3 if i in SPACES else 0
        self.kind = kind
        self.code = splitmix(np.arange(1, FAST_BELOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.forget()

    def forget(self):
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]):
        encoded = [self.bpe.encode_single_piece(p.encode()) for p in pieces]
        count = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(count.sum()))
        at = len(self.ids) + np.cumsum(count) - count
        where = np.searchsorted(self.known, hashes)
        self.known, self.at, self.count = (np.insert(a, where, b) for a, b in ((self.known, hashes), (self.at, at), (self.count, count)))
        self.ids = np.concatenate((self.ids, flat))

    def _fast(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given in Latin-1, in a row, and how many each text has. No text is empty."""
        whole = b"".join(texts)
        code = np.frombuffer(whole, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        kind = self.kind[code]
        new = np.ones(len(code), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[starts] = True
        last = np.zeros(len(code) + 1, bool)  # the next character begins another text
        last[starts] = True
        last[-1] = True
        before_word = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~last[1:-1])
        new[before_word] = True
        new[before_word[code[before_word] == 0x20] + 1] = False
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(code))
        power, inverse = powers(_BASE, len(code) + 1)
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(self.code[code] * power[: len(code)], out=sums[1:])
        h = splitmix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self.forget()
        where = np.searchsorted(self.known, unique)
        fresh = np.ones(len(unique), bool)
        inside = where < len(self.known)
        fresh[inside] = self.known[where[inside]] != unique[inside]
        if fresh.any():
            at = first[fresh]
            self._learn(unique[fresh], [whole[a:b].decode("latin-1") for a, b in zip(start[at].tolist(), end[at].tolist())])
            where = np.searchsorted(self.known, unique)
        at, count = self.at[where][which], self.count[where][which]
        total = np.cumsum(count)
        flat = self.ids[np.repeat(at - (total - count), count) + np.arange(total[-1])]
        each = np.add.reduceat(count, np.searchsorted(start, starts))
        return flat, each

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        fast: list[int] = []
        slow: list[int] = []
        plain: list[bytes] = []
        size = 0

        def flush():
            nonlocal size
            if fast:
                flat, each = self._fast(plain)
                for i, ids in zip(fast, np.split(flat, np.cumsum(each)[:-1])):
                    out[i] = ids
            fast.clear()
            plain.clear()
            size = 0

        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
                continue
            try:
                b = t.encode("latin-1")
            except UnicodeEncodeError:
                b = b"'"
            if b"'" in b:
                slow.append(i)
            else:
                fast.append(i)
                plain.append(b)
                size += len(t)
                if size > 1 << 20:
                    flush()
        flush()
        for k in range(0, len(slow), 64):
            part = slow[k : k + 64]
            for i, e in zip(part, self.slow.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
        return out
