"""Token ids by the tokenizers library, with each distinct piece of text encoded once.

A byte-pair tokenizer works inside the pieces its pre-tokenizer cuts, so the ids
of a text are those of its pieces in a row. Pieces repeat: a block of texts is
cut by array operations, the library encodes the pieces not yet known in one
call, and a bounded table of piece hashes (64 bits) supplies the rest.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from loamlake.llm.blocks import prefix_hash, ramp, range_hash, shared

SPACE, LETTER, DIGIT, OTHER, END = 0, 1, 2, 3, 4
# Texts of these characters alone are cut here: ASCII and the letters of the second Latin block.
PLAIN = re.compile(r"[\t\n\r -~¡«»¿À-ÖØ-öø-ÿ]*")
# The contractions both kinds of vocabulary files split off.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def classes() -> np.ndarray:
    chars = map(chr, range(256))
    kinds = [SPACE if c.isspace() else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER for c in chars]
    kinds[0] = END
    return np.array(kinds, np.uint8)


def cut(data: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of Latin-1 texts that each end in a zero byte.

    ``spaced``: a blank goes with what follows it, digits stay together and white space is kept; else white space is
    dropped and every digit is a piece.
    """
    kind = shared(("classes",), classes)[data]
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    before[0] = END
    first = kind != before
    if spaced:
        word = (kind >= LETTER) & (kind <= OTHER)
        last = (kind == SPACE) & (after >= LETTER) & (after <= OTHER)
        first |= last  # the last of several white-space characters stands apart
        first &= ~(word & np.roll(last & (data == 0x20), 1))
    else:
        first |= kind == DIGIT
    quote = np.flatnonzero((data == 0x27) & (before != OTHER) & (after == LETTER))
    if spaced:
        quote = quote[np.roll(data, 1)[quote] != 0x20]
    if len(quote):
        one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        length = np.isin(one, np.frombuffer(SHORT.encode(), np.uint8)).astype(np.int64) * 2
        for pair in LONG:
            length[(one == ord(pair[0])) & (two == ord(pair[1]))] = 3
        quote, length = quote[length > 0], length[length > 0]
        first[quote + 1] = False
        first[(quote + 2)[length == 3]] = False
        ends = quote + length
        first[ends] |= kind[ends] == LETTER
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != END
    if not spaced:
        keep &= kind[starts] != SPACE
    return starts[keep], ends[keep]


class PieceEncoder:
    """``ids(texts)``: the library's ids of each text.

    Texts with characters beyond PLAIN or with the string of an added token, and
    files whose pre-tokenizer is not one of the two known kinds, go to the library whole.
    """

    def __init__(self, path: str, keep: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self.whole = re.compile("|".join(map(re.escape, added))) if added else None
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.lower = kind == "Sequence" and steps == ["NFC", "Replace", "Lowercase"]
        self.spaced = kind == "ByteLevel" and spec.get("normalizer") is None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known pieces
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuttable(self, text: str) -> bool:
        known = self.lower or self.spaced
        return known and PLAIN.fullmatch(text) is not None and not (self.whole and self.whole.search(text))

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids = self._library(pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        data = np.frombuffer(("\0".join(texts) + "\0").encode("latin-1"), np.uint8)
        starts, ends = cut(data, self.spaced)
        hashes, first, back = np.unique(range_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > self.keep:
            self._forget()
        place = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != hashes[inside]
        if new.any():
            raw = data.tobytes()
            found = [raw[s:e].decode("latin-1") for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            self._learn(hashes[new], found)
            place = np.searchsorted(self.keys, hashes)
        size = self.size[place][back]
        ids = self.flat[np.repeat(self.at[place][back], size) + ramp(size)]
        before = np.concatenate([[0], np.cumsum(size)])
        stops = np.searchsorted(starts, np.flatnonzero(data == 0))
        return np.split(ids, before[stops][:-1])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cuttable = [self._cuttable(t) for t in texts]
        out: list = [None] * len(texts)
        plain = [i for i, ok in enumerate(cuttable) if ok]
        if plain:
            made = self._by_pieces([texts[i].lower() if self.lower else texts[i] for i in plain])
            for i, x in zip(plain, made):
                out[i] = x
        rest = [i for i, ok in enumerate(cuttable) if not ok]
        for i, x in zip(rest, self._library([texts[i] for i in rest]) if rest else ()):
            out[i] = np.array(x, np.uint32)
        return out


def encoder(path: str) -> PieceEncoder:
    return shared(("encoder", path), lambda: PieceEncoder(path))
