"""Token ids and token counts of whole texts with the public tokenizers, unit by unit.

Between a character that is no white space and a single space before another such character, none of the tokenizers here
forms a token across the border: byte-level BPE starts a new word at that space, the word BPE drops white space, and a
special token holds none. So a text is cut there into units, each distinct unit is encoded once per worker process by the
library's own steps, and ids are looked up. Results equal those of the library on the whole text.
"""
from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Distinct units that a worker keeps: half of them as the newer ones, which replace the older half when they are so many.
CACHED_UNITS = 600_000
# Characters of text that are cut and looked up at once.
PORTION = 1 << 22
_BORDER = re.compile(r"(?<=\S) (?=\S)")
# White space other than the plain space.
_OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B))
# Signs that form a word of their own after letters, whatever stands next; an apostrophe may not.
_SIGNS = ".,;:!?&%$*#|()[]{}\"-_/+=<>@~^"
# Signs after letters that an encoder remembers; words of letters are remembered as units only, being mostly new.
_PIECES = 20_000


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {**{b: b for b in printable}, **{b: 256 + k for k, b in enumerate(others)}}


BYTE_LETTERS = _byte_letters()
_SPACE, _BREAK = chr(BYTE_LETTERS[32]), chr(BYTE_LETTERS[10])


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def every_space(text: str) -> bool:
    """Whether every space is a border, none being at an end or beside other white space."""
    beside = any(c in text and (f"{c} " in text or f" {c}" in text) for c in _OTHER_SPACE)
    return not (beside or "  " in text or text[:1] == " " or text[-1:] == " ")


def units(text: str) -> list[str]:
    """The text cut at single spaces; joined with spaces they give the text again."""
    return text.split(" ") if every_space(text) else _BORDER.split(text)


class UnitEncoder:
    """Ids of one unit with ``leading`` in front of it: normaliser, pre-tokenizer and model, step by step."""

    def __init__(self, path: str, leading: str) -> None:
        self.whole, self.leading = tokenizer(path), leading
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.normalizer, self.cutter, self.model = self.whole.normalizer, self.whole.pre_tokenizer, self.whole.model
        self.signs: dict[str, list[int]] = {"": []}

    def _piece(self, piece: str) -> list[int]:
        """Ids of one word of the pre-tokenizer, in its byte letters."""
        return [t.id for t in self.model.tokenize(piece)]

    def _signs(self, signs: str) -> list[int]:
        found = self.signs.get(signs)
        if found is None:
            if len(self.signs) > _PIECES:
                self.signs = {"": []}
            found = self.signs[signs] = self._piece(signs)
        return found

    def _letters(self, letters: str, signs: str) -> list[int]:
        """Ids of letters, which are one word, and of signs after them, which are another."""
        if letters.isascii():  # nothing but the space in front is written otherwise
            return self._piece(letters.replace(" ", _SPACE)) + self._signs(signs)
        return self._piece(letters.encode().decode("latin-1").translate(BYTE_LETTERS)) + self._signs(signs)

    def __call__(self, unit: str) -> list[int]:
        text = self.leading + unit
        if "<" in text and any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        if self.normalizer is not None:
            # Latin letters are composed already, and lower case is all that is left to do.
            text = text.lower() if unit and max(unit) < "\u0250" and unit.rstrip(_SIGNS).isalpha() else (
                self.normalizer.normalize_str(text))
        letters = text.rstrip(_SIGNS)
        if letters[len(self.leading):].isalpha():
            return self._letters(letters, text[len(letters):])
        head, line_break, tail = text.partition("\n")
        if line_break and self.normalizer is None:  # one line break between letters is a word of its own
            own, last = head.rstrip(_SIGNS), tail.rstrip(_SIGNS)
            if own[len(self.leading):].isalpha() and last.isalpha():
                return [*self._letters(own, head[len(own):]), *self._signs(_BREAK), *self._letters(last, tail[len(last):])]
        return list(chain.from_iterable(self._piece(p) for p, _ in self.cutter.pre_tokenize_str(text)))


class Units:
    """A cache from unit to what ``make`` says of it."""

    def __init__(self, make: Callable[[str], object]) -> None:
        self.make = make
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def look_up(self, wanted: list[str]) -> list:
        if len(self.known) > CACHED_UNITS // 2:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, wanted))
        if None in found:
            for k, (unit, value) in enumerate(zip(wanted, found)):
                if value is None:
                    value = self.known.get(unit)
                    if value is None:
                        value = self.older.get(unit)
                        if value is None:
                            value = self.make(unit)
                        self.known[unit] = value
                    found[k] = value
        return found


@lru_cache(maxsize=4)
def id_units(path: str, leading: str) -> Units:
    """Little-endian 32-bit ids of units with ``leading`` put in front."""
    import sys

    encode = UnitEncoder(path, leading)

    def packed(unit: str) -> bytes:
        ids = array("I", encode(unit))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    return Units(packed)


@lru_cache(maxsize=4)
def count_units(path: str) -> Units:
    encode = UnitEncoder(path, "")
    return Units(lambda unit: len(encode(unit)))


def portions(texts: list[str | None]) -> Iterator[slice]:
    """Consecutive texts of about PORTION characters together, at least one."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= PORTION or k + 1 == len(texts):
            yield slice(first, k + 1)
            first, held = k + 1, 0


def encode_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """The ids of each text as little-endian 32-bit words, no special tokens added; null counts as empty.

    Each distinct unit of a portion is looked up once, and its ids are copied to its places by their numbers.
    """
    firsts, rest = id_units(path, ""), id_units(path, " ")
    out: list[bytes] = [b""] * len(texts)
    plain = []
    for k, text in enumerate(texts):
        if text and every_space(text):
            plain.append(k)
        elif text:
            head, *tail = _BORDER.split(text)
            out[k] = firsts.look_up([head])[0] + b"".join(rest.look_up(tail))
    for part in portions([texts[k] for k in plain]):
        rows = plain[part]
        cut = pc.split_pattern(pa.array([texts[k] for k in rows], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        borders, code = cut.offsets.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        names = coded.dictionary.to_numpy(False).tolist()  # objects at once, several times as fast as to_pylist
        heads, which = np.unique(code[borders[:-1]], return_inverse=True)
        code[borders[:-1]] = len(names) + which
        found = rest.look_up(names) + firsts.look_up([names[k] for k in heads])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ends = np.concatenate(([0], np.cumsum(sizes[code])))
        at = np.repeat((np.cumsum(sizes) - sizes)[code] - ends[:-1], sizes[code]) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        edges = (4 * ends[borders]).tolist()
        for k, a, b in zip(rows, edges[:-1], edges[1:]):
            out[k] = ids[a:b]
    return out


def count_tokens(path: str, texts: list[str | None]) -> list[int]:
    """How many ids each text has, for a tokenizer that drops white space; null counts as empty."""
    cache = count_units(path)
    return [sum(cache.look_up((t or "").split(" "))) for t in texts]
