"""Token ids of whole texts, from a public tokenizer file, in numpy batches.

The tokenizer of ``word_bpe_49k.json`` drops white space and never looks across
it, so a text's ids are the ids of its space-separated words, one after another.
``WordIds`` keeps the ids of words it has met (a bounded table) and asks the
tokenizers library only for new ones.  Any other file (``is_plain`` reads its
normalizer, pattern and model) has whole texts encoded by the library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from . import hashing

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: str.split() without arguments also cuts at these, the tokenizer doesn't.
ODD_LATIN = "\x1c\x1d\x1e\x1f\x85\xa0"
ODD = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words(text: str | None) -> list[str]:
    """The maximal runs of anything but the six ASCII white spaces; null: none."""
    if not text:
        return []
    odd = any(c in text for c in ODD_LATIN) or not text.isascii() and ODD.search(text)
    return WORD.findall(text) if odd else text.split()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a file must say for its texts to be encoded by words (fixed values).
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def is_plain(path: str) -> bool:
    """Whether the tokenizer folds case, drops white space, never looks across it, and shows bytes in the usual way."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    steps = (held.get("normalizer") or {}).get("normalizers", [])
    cuts = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return False
    split, shown = cuts
    drops = split["pattern"] == {"Regex": PLAIN_PATTERN} and split["behavior"] == "Removed" and split["invert"]
    marks = all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] for x in held.get("added_tokens", []))
    return bool(held["model"]["type"] == "BPE" and drops and marks and not shown["add_prefix_space"] and not shown["use_regex"])


class WordIds:
    """Ids by word, through a table of at most ``limit`` words by 64-bit hash and as many pieces.

    A word that is new is cut where the tokenizer's own pattern cuts it, and its
    pieces go to the merge model alone.  Words with letters beyond Latin, or that
    may hold a special token, go through the whole library.
    """

    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    SIMPLE = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0139-\u0148\u014a-\u017e]+")

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok, self.limit, self.plain = Tokenizer.from_file(path), limit, is_plain(path)
        self.model = self.tok.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as they are
        hidden = [b for b in range(256) if b not in set(shown)]
        self.bytes = {b: 256 + i for i, b in enumerate(hidden)}
        self.clear()

    def clear(self) -> None:
        self.mask = (1 << (2 * self.limit).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.place = np.zeros(self.mask + 1, np.int32)
        self.n = self.used = 0
        self.flat = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(1 << 18, np.int64)  # where a word's ids begin; one more entry than words
        self.pieces: dict[str, list[int]] = {}

    def piece(self, p: str) -> list[int]:
        got = self.pieces.get(p)
        if got is None:
            shown = p if p.isascii() else p.encode().decode("latin-1").translate(self.bytes)
            got = [x.id for x in self.model.tokenize(shown)]
            if len(self.pieces) < self.limit:
                self.pieces[p] = got
        return got

    def ids_of(self, word: str) -> list[int]:
        if self.SIMPLE.fullmatch(word) and "<|" not in word:
            return [x for p in self.PIECE.findall(word.lower()) for x in self.piece(p)]
        return self.tok.encode(word, add_special_tokens=False).ids

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words of these hashes, -1 for new ones."""
        at = (h & np.uint64(self.mask)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.place[at], -1)
        far = np.flatnonzero((key != h) & (key != 0))
        while len(far):
            at[far] = (at[far] + 1) & self.mask
            key = self.keys[at[far]]
            hit = key == h[far]
            out[far[hit]] = self.place[at[far[hit]]]
            far = far[~hit & (key != 0)]
        return out

    def learn(self, h: np.ndarray, new: list[str]) -> int:
        """Puts the ids of new words (distinct hashes h) into the flat table and returns the first one's number.
        A full table keeps its words (frequent ones come early) and has new ones for this call only."""
        ids = list(map(self.ids_of, new))
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        n, more = self.n, int(lens.sum())
        while n + len(new) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.at[n + 1 : n + 1 + len(new)] = self.used + np.cumsum(lens)
        self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(ids), np.uint32, more)
        if n + len(new) <= self.limit:
            self.used, self.n = self.used + more, n + len(new)
            at, number, left = (h & np.uint64(self.mask)).astype(np.int64), np.arange(n, self.n, dtype=np.int32), np.arange(len(h))
            while len(left):
                own = at[left]
                free = np.flatnonzero(self.keys[own] == 0)
                _, first = np.unique(own[free], return_index=True)
                put = left[free[first]]
                self.keys[at[put]], self.place[at[put]] = h[put], number[put]
                left = np.setdiff1d(left, put, assume_unique=True)
                at[left] = (at[left] + 1) & self.mask
        return n

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of texts between offsets of UTF-8 bytes, with ``end_id`` after each."""
        raw = data.tobytes()
        if not self.plain:
            got = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])], add_special_tokens=False)]
            end = [] if end_id is None else [np.array([end_id], np.uint32)]
            parts = [x for one in got for x in (one, *end)]
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array([len(x) + len(end) for x in got], np.int64)
        if b"<|" not in raw:  # else case may tell a special token
            data = hashing.FOLD[data]
            raw = data.tobytes()
        begin, stop, edges = hashing.word_spans(data, offsets)
        h = hashing.span_hashes(data, begin, stop) | np.uint64(1)  # 0 marks an empty place
        idx = self.find(h)
        miss = np.flatnonzero(idx < 0)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            full = self.n + len(new) > self.limit
            if full and self.n and len(miss) > 0.5 * len(h):
                self.clear()  # another kind of text: begin anew
                return self.encode_bytes(data, offsets, end_id)
            w = [raw[begin[i] : stop[i]].decode() for i in miss[first]]
            idx[miss] = self.learn(new, w) + back.reshape(-1)
        start, lens = self.at[idx], self.at[idx + 1] - self.at[idx]
        ends = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=ends[1:])
        per = np.diff(ends[edges])
        if end_id is None:
            return self.flat[np.repeat(start - ends[:-1], lens) + np.arange(ends[-1])], per
        # Words move on by one place for each text before theirs.
        shift = np.repeat(np.arange(len(per)), np.diff(edges))
        ids = np.full(ends[-1] + len(per), end_id, np.uint32)
        source = np.repeat(start - ends[:-1], lens) + np.arange(ends[-1])
        ids[np.arange(ends[-1]) + np.repeat(shift, lens)] = self.flat[source]
        return ids, per + 1

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.encode_bytes(data, offsets, end_id) for _, data, offsets in hashing.texts_of(pa.array([t or "" for t in texts], pa.string()))]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table per Python worker."""
    return WordIds(path)
