"""Token ids of whole texts by a public tokenizer file, many texts at once, with a table of words.

The tokenizer splits a text into letters, single digits and other signs before it merges anything, and white space
ends every piece. So ids of a text are the ids of its words between white space in turn, and a word's ids those of its pieces. The distinct words of
some texts are looked up together; the pieces of new ones go through the file's merges, many in one call: the last id of a piece carries the end-of-word
mark. Texts with characters where lower-casing or composition depends on neighbours take the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import batched, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: the split pattern of the tokenizer file (a fixed value of that file)
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: outside of this: control and format characters, odd spaces, final sigma, scripts above U+052F, special tokens
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-įı-˿Ͱ-΢Τ-ԯ‐-‧‰-⁞₠-₿]*")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: the same over ASCII letters, lower case
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: the ASCII characters of ``_PLAIN``
_PLAIN_ASCII = bytes([9, 10, 13, *range(32, 127)])
#: words a worker keeps; longer ones are encoded each time
CACHE, LONGEST = 400_000, 64
#: bytes of ids that it keeps, so that long words go at once
BYTES = 1 << 26
#: pieces that go through the merges in one call
STEP = 5_000

_STATE: dict = {}


def _plain(text: str) -> bool:
    """Whether the words of a text have the ids that they have alone."""
    if any(x in text for x in _SPECIAL):
        return False
    if text.isascii():
        return not text.encode().translate(None, _PLAIN_ASCII)
    return bool(_PLAIN.fullmatch(text)) and unicodedata.is_normalized("NFC", text)


def _split(word: str) -> list[str]:
    """The pieces of a word in lower case."""
    if word.isalpha():
        return [word]
    if word[-1:] in ".,;:!?" and word[:-1].isalpha():
        return [word[:-1], word[-1]]
    return (_ASCII_PIECE if word.isascii() else _PIECE).findall(word)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.uint32()))


class _Merges:
    """Ids of pieces by the merges of a tokenizer file alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        given = json.loads(Path(path).read_text("utf-8"))["model"]
        merges = [tuple(x.split(" ") if isinstance(x, str) else x) for x in given["merges"]]
        # the file's own model with an empty cache: pieces come once, so it would only cost time
        self.model = models.BPE(given["vocab"], merges, cache_capacity=0, end_of_word_suffix=given["end_of_word_suffix"])
        self.by_space = Tokenizer(self.model)
        self.by_space.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(max(given["vocab"].values()) + 1, bool)
        self.last[[i for t, i in given["vocab"].items() if t.endswith(given["end_of_word_suffix"])]] = True
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on
        shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
        self.shown = {x: chr(256 + i) for i, x in enumerate(x for x in range(256) if x not in shown) if x != 32}  # the space parts pieces

    def ids(self, pieces: list[str]) -> pa.ListArray:
        """The ids of each piece; a piece has a character or more and no white space."""
        values, sizes = [], []
        for some in batched(pieces, STEP):
            line = " ".join(some)
            if not line.isascii():
                line = line.encode().decode("latin-1").translate(self.shown)
            found = np.array(self.by_space.encode(line, add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(some) or ends[-1] != len(found):  # a mark in the middle: piece by piece
                each = [[t.id for t in self.model.tokenize(p)] for p in line.split(" ")]
                found, ends = np.array(list(chain.from_iterable(each)), np.uint32), np.cumsum([len(x) for x in each])
            values.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return _lists(np.concatenate(values), np.concatenate(sizes)) if values else _lists(np.zeros(0, np.uint32), np.zeros(0, np.int64))


class _Words:
    """The ids of words in lower case, with a table of at most about ``CACHE`` of those met before."""

    def __init__(self, merges: _Merges):
        self.merges, self.words, self.ids, self.uses = merges, pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32())), np.zeros(0, np.int64)

    def spelled(self, words: list[str]) -> pa.ListArray:
        split = [_split(w) for w in words]
        flat = list(chain.from_iterable(split))
        place = {p: i for i, p in enumerate(sorted(dict.fromkeys(flat), key=str.isascii))}  # ASCII pieces are their own byte-level form
        ids = self.merges.ids(list(place)).take(pa.array(np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))))
        stops = np.append(0, np.cumsum(ids.value_lengths().to_numpy()))[np.append(0, np.cumsum([len(x) for x in split])).astype(np.int64)]
        return _lists(ids.flatten().to_numpy(), np.diff(stops))

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word)"""
        coded = words.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.words)
        new = coded.dictionary.filter(place.is_null())
        at = place.fill_null(0).to_numpy().astype(np.int64)
        at[place.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        if len(new):
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self.spelled(new.to_pylist())])
            self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        at = at[coded.indices.to_numpy()]
        found = self.ids.take(pa.array(at))
        self.uses += np.bincount(at, minlength=len(self.uses))
        if len(self.words) > CACHE or self.ids.nbytes > BYTES:
            # the more used half stays, without long words
            short = pc.binary_length(self.words).to_numpy() <= LONGEST
            order = np.argsort(-self.uses, kind="stable")[:CACHE // 2]
            kept = order[short[order]]
            self.words, self.ids, self.uses = self.words.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.uses[kept] // 2
        return found.flatten().to_numpy(), found.value_lengths().to_numpy().astype(np.int64)


class TokenCoder:
    """Ids of texts; a worker keeps its tables."""

    def __init__(self, path: str):
        if _STATE.get("path") != path:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _STATE.update(path=path, tokenizer=tokenizer, words=_Words(_Merges(path)))
        self.tokenizer, self.words = _STATE["tokenizer"], _STATE["words"]

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as unsigned 32-bit numbers, number of ids of each text); a null text has none."""
        texts = texts.fill_null("")
        plain = np.array([_plain(t) for t in texts.to_pylist()], bool)
        some = texts if plain.all() else texts.filter(pa.array(plain))
        words = pc.ascii_split_whitespace(pc.utf8_lower(some))
        ids, sizes = self.words.look_up(words.flatten())
        stops = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(words.value_lengths().to_numpy())).astype(np.int64)]
        if plain.all():
            return ids, np.diff(stops)
        whole = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.filter(pa.array(~plain)).to_pylist()]
        counts = np.zeros(len(texts), np.int64)
        counts[plain], counts[~plain] = np.diff(stops), [len(x) for x in whole]
        out = np.empty(counts.sum(), np.uint32)
        inside = np.repeat(plain, counts)
        out[inside], out[~inside] = ids, np.concatenate(whole)
        return out, counts

    def ids(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit bytes."""
        return self.many(pa.array([text], pa.string()))[0].astype("<u4").tobytes()
