"""Token ids of many texts by a word tokenizer, each distinct part of a block encoded once.

The tokenizer lowers case and splits at white space, between letters and signs, and around every digit before
it looks at a vocabulary, so the ids of a text are those of its parts in order.  A block of text is cut into
parts with array operations, its distinct parts are found by dictionary encoding, and their ids are laid out
for all places at once.  What a worker remembers between blocks is a cache only: every block has all its own
parts at hand, so that what was forgotten is encoded again and no text has too many words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes a worker remembers between blocks, with what an entry takes beside its part and ids; bounds memory, not the result.
REMEMBERED_BYTES, ENTRY_BYTES = 32 << 20, 200
#: Bytes of text that are cut into parts at once; a longer text is cut at white space.
BLOCK_BYTES = 4 << 20

_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _kind(byte: int) -> int:
    c = bytes([byte])
    if c.isspace():
        return _SPACE
    if c.isalpha():
        return _LETTER
    if c.isdigit():
        return _DIGIT
    return _SIGN if 32 < byte < 127 and c != b"'" else _OTHER


#: The kind of each byte.  An apostrophe may begin a contraction and bytes beyond ASCII may be anything (letters,
#: signs, marks that join the letter before them): no cut is made beside either.
_KINDS = bytes(map(_kind, range(256)))
#: Parts that the tokenizer leaves whole: letters (ASCII and Latin-1, which have nothing to be composed), a digit, signs.
_WHOLE = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")
# How the tokenizer that these cuts are made for prepares a text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_WORD_END = "</w>"


def cut_parts(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All parts of all texts in order, in lower-case ASCII, and the number of parts of each text."""
    joined = b"\n".join(texts).lower()
    data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8).copy()
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] >= 0x80) & (data[at + 1] <= 0xBF) & (data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kind[at] = kind[at + 1] = _LETTER
    begins, plain = kind != _SPACE, (kind != _SPACE) & (kind != _OTHER)
    begins[1:] &= (kind[:-1] == _SPACE) | plain[1:] & plain[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    text_ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
    counts = np.bincount(np.searchsorted(text_ends, np.flatnonzero(begins), side="right"), minlength=len(texts))
    inked = kind != _SPACE
    ink = data[inked]
    offsets = np.append(np.flatnonzero(begins[inked]), len(ink)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(ink)]), counts


def _blocks(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes that end at white space; a longer run of anything else stays whole."""
    at = 0
    while len(text) - at > limit:
        end = at + limit
        space = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if space <= at:
            space = min((x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, end)) >= 0), default=len(text))
        yield text[at:space]
        at = space
    yield text[at:]


def _cost(parts: dict[bytes, bytes]) -> int:
    return sum(len(p) + len(i) + ENTRY_BYTES for p, i in parts.items())


class WordEncoder:
    """``ids_of(texts)`` gives the token ids of all texts in one array, and how many each text has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.by_parts = made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and made["model"]["end_of_word_suffix"] == _WORD_END
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for k, i in vocabulary.items() if k.endswith(_WORD_END)]] = True
        self.whole = Tokenizer(self.tokenizer.model)  # for parts that need no preparing
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.remembered: dict[bytes, bytes] = {}
        self.held = 0

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def _encoded(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each part with its ids: those that stay whole in one call, where a token that ends a word ends a part."""
        whole, other = [], []
        for p in parts:
            (whole if p.isalpha() or _WHOLE.fullmatch(p) else other).append(p)
        if whole:
            ids = np.array(self.whole.encode_batch_fast([b" ".join(whole).decode().lower()], add_special_tokens=False)[0].ids, np.uint32)
            data, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            yield from ((p, data[a:b]) for p, a, b in zip(whole, [0, *ends[:-1]], ends, strict=True))
        if other:
            yield from zip(other, self._plain(other), strict=True)

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = cut_parts(texts)
        coded = parts.dictionary_encode()
        own, known = coded.dictionary.to_pylist(), self.remembered
        new = [p for p in own if p not in known]
        encoded = dict(self._encoded(new))
        added = _cost(encoded)
        if self.held + added > REMEMBERED_BYTES:  # the parts of this block outlast the rest
            known = self.remembered = {p: known[p] for p in own if p in known}
            self.held = _cost(known)
        known.update(encoded)
        self.held += added
        ids = [known[p] for p in own]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
        place = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[place]
        ends = np.cumsum(lengths)
        of_part = np.repeat(begin[place] - (ends - lengths), lengths)
        of_part += np.arange(len(of_part))
        return pool[of_part], np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))])

    def ids_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts end to end, and each text's number of ids."""
        pieces, own, start, size = [], np.zeros(len(texts), np.int64), 0, 0

        def close(stop: int) -> None:
            if start < stop:
                ids, own[start:stop] = self._block(texts[start:stop])
                pieces.append(ids)

        for i, text in enumerate(texts):
            plain = not self.by_parts or any(s in text for s in self.special)
            if plain or len(text) > BLOCK_BYTES:
                close(i)
                parts = [np.frombuffer(self._plain([text])[0], np.uint32)] if plain else [self._block([b])[0] for b in _blocks(text, BLOCK_BYTES)]
                own[i] = sum(map(len, parts))
                pieces += parts
                start, size = i + 1, 0
            elif size + len(text) > BLOCK_BYTES:
                close(i)
                start, size = i, len(text)
            else:
                size += len(text)
        close(len(texts))
        return np.concatenate(pieces) if pieces else np.zeros(0, np.uint32), own


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker: what it remembers outlasts a task."""
    return WordEncoder(path)
