"""Token ids by the tokenizers library, each distinct pre-token encoded once per worker.

A tokenizer of the library never merges across pre-tokens, so a text's ids are the ids of its
pre-tokens in order. ``PieceEncoder`` finds the pre-tokens of many texts at once with numpy (by the
class of each code point, which it asks of the tokenizer itself), gives each distinct one to the
library, and looks the rest up. Texts for which that isn't proven the same (special tokens inside
the text, text that NFC changes, code points whose normal form is several) go to the library whole,
as do all texts of a tokenizer with another pre-tokenizer.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE, ODD, UNKNOWN = 0, 1, 2, 3, 4, 255
#: Code points that are cut at once, and distinct pre-tokens and ids that a worker remembers.
CHUNK_CHARS, MEMO_PIECES, MEMO_IDS = 1_000_000, 250_000, 3_000_000
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of all these spans, one after another."""
    stop = np.cumsum(length)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin - (stop - length), length)


class PieceEncoder:
    """Encodes texts as ``Tokenizer.from_file(path)`` does with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        self.special = [x["content"] for x in conf["added_tokens"]]
        self.scheme = self._scheme(conf)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._forget()
        self.old = self.slots, self.begin, self.length, self.flat

    @staticmethod
    def _scheme(conf: dict) -> str:
        """'spaced' (a space joins the word after it), 'words' (white space is dropped), or 'whole' (any other)."""
        pre, norm = conf["pre_tokenizer"] or {}, conf["normalizer"]
        byte = {"type": "ByteLevel", "add_prefix_space": False}
        if conf.get("post_processor") or any(x.get(k) for x in conf["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            return "whole"
        if norm is None and byte.items() <= pre.items() and pre.get("use_regex"):
            return "spaced"
        steps, norms = pre.get("pretokenizers") or [], (norm or {}).get("normalizers") or []
        if (
            len(steps) == 2
            and steps[0].get("type") == "Split"
            and steps[0].get("pattern") == {"Regex": SPLIT}
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert")
            and byte.items() <= steps[1].items()
            and not steps[1].get("use_regex")
            and [x["type"] for x in norms] == ["NFC", "Replace", "Lowercase"]
            and norms[1]["pattern"] == {"Regex": r"\s+"}
            and norms[1]["content"] == " "
        ):
            return "words"
        return "whole"

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.begin = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.n_flat = 0

    def _add(self, new: list[str], lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
        first, total = len(self.slots), len(flat)
        while first + len(new) > len(self.begin):
            self.begin, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.length))
        while self.n_flat + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.n_flat : self.n_flat + total] = flat
        self.begin[first : first + len(new)] = self.n_flat + np.cumsum(lens) - lens
        self.length[first : first + len(new)] = lens
        self.n_flat += total
        self.slots.update(zip(new, range(first, first + len(new))))
        return np.arange(first, first + len(new))

    def _class_of(self, c: str) -> int:
        cut = self.tok.pre_tokenizer.pre_tokenize_str
        if self.scheme == "spaced":
            return LETTER if len(cut("a" + c)) == 1 else NUMBER if len(cut("1" + c)) == 1 else OTHER if len(cut("!" + c)) == 1 else SPACE
        n = self.tok.normalizer.normalize_str(c)
        if len(n) != 1:
            return ODD
        return SPACE if not cut(n) else LETTER if len(cut("a" + n)) == 1 else NUMBER if len(cut(n + n)) == 2 else OTHER

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All pieces, how many each text has, and which texts must be encoded whole."""
        joined = "".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        cls = self.classes[cps]
        if (cls == UNKNOWN).any():
            for c in np.unique(cps[cls == UNKNOWN]):
                self.classes[c] = self._class_of(chr(c))
            cls = self.classes[cps]
        whole = np.zeros(len(texts), bool)
        if any(s in joined for s in self.special):
            whole |= [any(s in t for s in self.special) for t in texts]
        if self.scheme == "words":
            if not unicodedata.is_normalized("NFC", joined):
                whole |= [not unicodedata.is_normalized("NFC", t) for t in texts]
            if (odd := cls == ODD).any():
                whole[np.searchsorted(ends, np.flatnonzero(odd), "right")] = True
        n = len(cps)
        space = cls == SPACE
        at = np.zeros(n + 1, bool)  # True where a piece begins
        at[1:n] = cls[1:] != cls[:-1]
        at[starts[starts < n]] = True
        fresh = np.zeros(n + 1, bool)
        fresh[starts[starts < n]] = True
        if self.scheme == "spaced":
            turn = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:n]) + 1  # the first code point after white space
            at[turn - 1] = True
            at[turn[cps[turn - 1] == 32]] = False
        else:
            at[:n] |= cls == NUMBER
        quotes = np.flatnonzero((cps == 39) & at[:n])
        if len(quotes):
            if self.scheme == "words":
                low = np.where((cps >= 65) & (cps <= 90), cps + 32, cps)
            else:
                low = cps
            last = np.repeat(ends, [len(t) for t in texts])[quotes]  # the end of the text that holds the quote
            for c in CONTRACTIONS:
                ok = quotes + len(c) < last
                for k, x in enumerate(c, 1):
                    ok[ok] = low[quotes[ok] + k] == ord(x)
                hit = quotes[ok]
                at[hit + 1] = False
                at[hit + 1 + len(c)] = True
        at[n] = False
        begin = np.flatnonzero(at)
        counts = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
        wide = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
        data = joined.encode()
        if len(data) == n:
            offsets = np.append(begin, n)
        else:
            where = np.concatenate(([0], np.cumsum(wide, dtype=np.int64)))
            offsets = np.append(where[begin], len(data))
        pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        if self.scheme == "words":
            keep = ~space[begin]
            sums = np.concatenate(([0], np.cumsum(keep)))
            bounds = np.concatenate(([0], np.cumsum(counts)))
            counts = sums[bounds[1:]] - sums[bounds[:-1]]
            pieces = pieces.filter(pa.array(keep))
        return pieces, counts, whole

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """The slot of each of these distinct pieces. The memo has two generations; what is used again moves to the new one."""
        if self.slots and (len(self.slots) + len(pieces) > MEMO_PIECES or self.n_flat > MEMO_IDS):
            self.old = self.slots, self.begin, self.length, self.flat
            self._forget()
        slots = np.array([self.slots.get(p, -1) for p in pieces], np.int64)
        miss = np.flatnonzero(slots < 0)
        if len(miss):
            known, begin, length, flat = self.old
            were = np.array([known.get(pieces[i], -1) for i in miss], np.int64)
            if len(again := miss[were >= 0]):
                at = were[were >= 0]
                slots[again] = self._add([pieces[i] for i in again], length[at], flat[spans(begin[at], length[at])])
            if len(miss := miss[were < 0]):
                new = [pieces[i] for i in miss]
                ids = [e.ids for part in range(0, len(new), 4096) for e in self.tok.encode_batch_fast(new[part : part + 4096], add_special_tokens=False)]
                lens = np.fromiter(map(len, ids), np.int64, len(ids))
                slots[miss] = self._add(new, lens, np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())))
        return slots

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _chunks(self, texts: Iterable[str | None]) -> Iterator[list[str]]:
        part, size = [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= CHUNK_CHARS:
                yield part
                part, size = [], 0
        if part:
            yield part

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Part by part: texts, number of ids of each, and the ids of all as one int32 array. Null counts as empty."""
        for part in self._chunks(texts):
            if self.scheme == "whole":
                ids = [self._whole(t) for t in part]
                yield part, np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.int32)
                continue
            pieces, counts, whole = self._cut(part)
            coded = pieces.dictionary_encode()
            slots = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
            lens = self.length[slots]
            flat = self.flat[spans(self.begin[slots], lens)]
            bounds = np.concatenate(([0], np.cumsum(lens)))[np.concatenate(([0], np.cumsum(counts)))]
            sizes = np.diff(bounds)
            if whole.any():
                each = np.split(flat, bounds[1:-1])
                for i in np.flatnonzero(whole):
                    each[i] = np.array(self._whole(part[i]), np.int32)
                    sizes[i] = len(each[i])
                flat = np.concatenate(each)
            yield part, sizes, flat

    def count(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Part by part: texts and the number of ids of each; no ids are made for whole texts.

        Each distinct pre-token is counted once, and a text's count is the sum over its
        (pre-token, frequency) rows of frequency times count."""
        for part in self._chunks(texts):
            if self.scheme == "whole":
                yield part, np.array([len(self._whole(t)) for t in part], np.int64)
                continue
            pieces, counts, whole = self._cut(part)
            coded = pieces.dictionary_encode()
            slots = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            per_piece = self.length[slots]
            sizes = np.zeros(len(part), np.int64)
            if len(coded):
                doc = np.repeat(np.arange(len(part)), counts)
                code = coded.indices.to_numpy().astype(np.int64)
                rows, times = np.unique(doc * len(per_piece) + code, return_counts=True)  # the texts' pre-token frequencies
                sizes = np.bincount(rows // len(per_piece), times * per_piece[rows % len(per_piece)], len(part)).astype(np.int64)
            for i in np.flatnonzero(whole):
                sizes[i] = len(self._whole(part[i]))
            yield part, sizes


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are; the operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)
