"""Token ids of whole texts by a public tokenizer, each distinct stretch encoded once.

A text is cut only where the tokenizer's own splitting must cut too: before a
single space, between a letter and a sign, and after a single line break. What
lies between two cuts has the same ids in every text, so a worker keeps the ids
of the stretches it has seen and asks the library only for new ones. A text that
holds one of the tokenizer's added tokens goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Stretches remembered per worker, and their ids; beyond that the memory starts anew.
REMEMBERED = 1_000_000
REMEMBERED_IDS = 8_000_000
# Stretches that are tokenised as one text.
JOINED = 100
# Every character that Unicode calls white space, and the four information separators.
_BLANK = r"\t\n\x0B\x0C\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# A space next to white space, the cutting sign itself, or the one letter whose lower case ends
# in a sign (U+0130): such texts are cut by the careful rule alone.
_CAREFUL = rf" [{_BLANK}]|[{_BLANK}] |\x00|\x{{130}}"
_SIGN = rf"(\pL)([^\pL\pN\pM'{_BLANK}])"
_BREAK = rf"([^{_BLANK}]\n)(\pL)"
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Tokens:
    """Ids of texts by the tokenizer file at ``path``, as the library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = "|".join(re.escape(token.content) for token in added.values())
        # What stands on either side of such a token is tokenised by itself, and no stretch holds one.
        self.between = next(
            ((token.content, i) for i, token in added.items() if not (token.lstrip or token.rstrip or token.single_word or token.normalized)),
            None,
        )
        capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str(capitals) == capitals.lower()
        # Texts come with A to Z lower-cased, and printable ASCII is left alone by all else that these do.
        self.bare = None
        if self.lowers and _harmless(json.loads(self.tokenizer.to_str())["normalizer"]):
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted hashes of the stretches
        self.checks = np.empty(0, np.uint64)  # a second hash of each
        self.place = np.empty(0, np.int64)
        self.length = np.empty(0, np.int32)
        self.ids = np.empty(0, self.kind)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts, which must not be null, one after the other, and their number per text."""
        stretches, codes, per_text = _stretches(self._lowered(texts), self.added)
        place, length = self._known(stretches)
        size = length[codes].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(place[codes] - (ends - size), size) + np.arange(total)
        whole = np.concatenate(([0], ends))
        stops = np.cumsum(per_text)
        return self.ids[at].astype(np.uint32), whole[stops] - whole[stops - per_text]

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """Texts in which A to Z are lower-cased, where the tokenizer does that itself; not those with marks, which
        may join a small letter but not its capital, nor those that hold an added token."""
        if not self.lowers:
            return texts
        kept = pc.match_substring_regex(texts, rf"\pM|(?i:{self.added})" if self.added else r"\pM")
        return pc.if_else(kept, texts, pc.ascii_lower(texts))

    def _known(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self._forget()
        values = stretches.to_numpy(zero_copy_only=False)
        if not len(values):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        keys = pd.util.hash_array(values, categorize=False)
        checks = pd.util.hash_array(values, categorize=False, hash_key="fedcba9876543210")
        at, found = self._found(keys, checks)
        new = np.flatnonzero(~found)
        if not len(new):
            return self.place[at], self.length[at]
        place, length = np.empty(len(values), np.int64), np.empty(len(values), np.int32)
        place[found], length[found] = self.place[at[found]], self.length[at[found]]
        if (self.keys[at[new]] == keys[new]).any() if len(self.keys) else False:
            raise RuntimeError("two stretches share a hash")
        place[new], length[new] = self._learn(values[new], keys[new], checks[new])
        return place, length

    def _found(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.checks[at] == checks)

    def _learn(self, values: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take stretches in and give the place and number of their ids."""
        ids, length = [self.ids], []
        for start in range(0, len(values), 10_000):
            found, sizes = self._encoded(values[start : start + 10_000].tolist())
            ids.append(found)
            length.append(sizes)
        sizes = np.concatenate(length)
        places = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
        self.ids = np.concatenate(ids)
        # The few new ones are sorted and put between those known, which are in order.
        order = np.argsort(keys, kind="stable")
        if (np.diff(keys[order].view(np.int64)) == 0).any():
            raise RuntimeError("two stretches share a hash")
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.checks = np.insert(self.checks, at, checks[order])
        self.place = np.insert(self.place, at, places[order])
        self.length = np.insert(self.length, at, sizes[order])
        return places, sizes

    def _encoded(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the stretches, and their number per stretch; many stretches go to the library as one text."""
        if self.between is None or (self.added and any(map(re.compile(self.added).search, values))):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(values, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int32, len(lists))
            return np.fromiter(chain.from_iterable(lists), self.kind, int(sizes.sum())), sizes
        if self.bare is None:
            return self._joined(self.tokenizer, values)
        # What is normal already needs no normaliser.
        plain = np.fromiter((v.isascii() and v.isprintable() and v == v.lower() for v in values), bool, len(values))
        if plain.all() or not plain.any():
            return self._joined(self.bare if plain.all() else self.tokenizer, values)
        parts = [
            self._joined(tokenizer, [v for v, p in zip(values, plain.tolist()) if p == kind])
            for tokenizer, kind in ((self.bare, True), (self.tokenizer, False))
        ]
        sizes = np.empty(len(values), np.int32)
        sizes[plain], sizes[~plain] = parts[0][1], parts[1][1]
        of_plain = np.repeat(plain, sizes)
        found = np.empty(len(of_plain), self.kind)
        found[of_plain], found[~of_plain] = parts[0][0], parts[1][0]
        return found, sizes

    def _joined(self, tokenizer, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sign, number = self.between
        joined = [sign.join(values[i : i + JOINED]) + sign for i in range(0, len(values), JOINED)]
        lists = [np.array(e.ids, self.kind) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        found = np.concatenate(lists) if lists else np.empty(0, self.kind)
        ends = np.flatnonzero(found == number)
        return np.delete(found, ends), np.diff(ends, prepend=-1).astype(np.int32) - 1


def _stretches(texts: pa.Array, added: str = "") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct stretches, the number of each stretch of each text among them, and the stretches per text.

    A text that the pattern ``added`` matches is one stretch.
    """
    careful = pc.match_substring_regex(texts, _CAREFUL)
    whole = pc.match_substring_regex(texts, added) if added else pa.array(np.zeros(len(texts), bool))
    careful = pc.or_(careful, whole)
    plain = pc.if_else(careful, "", texts)
    cut = pc.replace_substring_regex(plain, _SIGN, "\\1\x00\\2")
    cut = pc.replace_substring_regex(cut, _BREAK, "\\1\x00\\2")
    lists = pc.split_pattern(pc.replace_substring(cut, " ", "\x00 "), "\x00")
    rows = np.flatnonzero(careful.to_numpy(zero_copy_only=False))
    if len(rows):
        split = [
            [texts[int(i)].as_py()] if whole[int(i)].as_py() else _careful_cuts(texts[int(i)].as_py()) for i in rows
        ]
        where = np.arange(len(texts))
        where[rows] = len(texts) + np.arange(len(rows))
        lists = pa.concat_arrays([lists, pa.array(split, pa.list_(pa.string()))]).take(pa.array(where))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts


def _careful_cuts(text: str) -> list[str]:
    """Cut before each space that stands between two characters which are not white space."""
    first, *rest = _SINGLE_SPACE.split(text)
    return [first, *(" " + part for part in rest)]


def _harmless(normalizer: dict) -> bool:
    """Only steps that leave a stretch of small printable ASCII letters with at most one blank as it is."""
    if normalizer["type"] == "Sequence":
        return all(map(_harmless, normalizer["normalizers"]))
    if normalizer["type"] == "Replace":
        return normalizer["pattern"] == {"Regex": "\\s+"} and normalizer["content"] == " "
    return normalizer["type"] in ("NFC", "NFKC", "Lowercase")


@lru_cache(maxsize=2)
def shared_tokens(path: str) -> Tokens:
    """One tokenizer and memory per worker process."""
    return Tokens(path)
