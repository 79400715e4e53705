"""Token ids of whole texts by a public tokenizer, remembered by what stands between blanks.

Byte-pair merges never cross the borders at which a tokenizer cuts a text into words.
Two known ways of cutting always have a border before a single blank between two
characters that are no white space, so a text's ids are those of its pieces in a row.
A piece of plain Latin letters, digits and marks is cut into words here at the same
borders, and each distinct word goes to the tokenizer's own model; any other piece goes
to the library as it is. Texts with other white space around a blank, and any other
tokenizer, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode

import numpy as np

#: Bytes (about) of each of two generations of pieces, and of words.
KEPT_BYTES = 40 << 20
#: What an entry takes beside its own characters.
_ENTRY = 150
#: Longer pieces are not remembered.
_LONGEST = 64
# Latin letters without U+0130, whose lower case is two characters
_LETTERS = "A-Za-zÀ-ÖØ-öø-įıĲ-ɏ"
_MARKS = re.escape(".,;:!?%&#*$|-+=/()[]{}<>@_~^\"\\") + "–—…“”„«»‘’"
#: The borders of the two known kinds, for these characters alone.
_CUT = {
    "byte": re.compile(rf" ?[{_LETTERS}]+| ?[{_MARKS}]+| ?[0-9]+|\n(?=\S)"),
    "lower": re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+|[0-9]"),
}
#: A word of letters (or a number, where its digits stay together) with or without marks behind it.
_SIMPLE = {
    "byte": re.compile(rf"([{_LETTERS}]+|[0-9]+)([{_MARKS}]*)").fullmatch,
    "lower": re.compile(rf"([{_LETTERS}]+)([{_MARKS}]*)").fullmatch,
}


def _byte_letters() -> str:
    """The letters that stand for the 256 bytes: visible ones for themselves, the others
    for the letters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    letters = {b: b for b in visible} | {b: 256 + k for k, b in enumerate(hidden)}
    return "".join([chr(letters[b]) for b in range(256)])


class _Remembered(dict):
    """Values by key, in two generations of bounded size; absent ones are made."""

    def __init__(self, make):
        self.make, self.old, self.size = make, {}, 0

    def __missing__(self, key):
        value = self.old.get(key, False)
        if value is False:
            value = self.make(key)
        length = len(key) if type(key) is str else len(key[0])
        if length <= _LONGEST:
            entry = _ENTRY + length + (len(value) if value else 0)
            if self.size + entry > KEPT_BYTES:
                self.old, self.size = dict(self), 0
                self.clear()
            self.size += entry
            self[key] = value
        return value


class WordEncoder:
    """``encode(texts)``: ids of each text as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        size = max(self.library.get_vocab_size(), *(1 + k for k in self.library.get_added_tokens_decoder()), 0)
        self.dtype = np.dtype(dtype or ("<u2" if size < 65_000 else "<u4"))
        if size > np.iinfo(self.dtype).max:
            raise ValueError(f"{dtype} can't hold the ids of {path}")
        self.kind = _kind(self.library)
        self.letters, self.tokenize = _byte_letters(), self.library.model.tokenize
        self.blank = self.letters[32]
        raw, width = np.arange(size).astype(self.dtype).tobytes(), self.dtype.itemsize
        self.table = [raw[k:k + width] for k in range(0, len(raw), width)]
        self.simple = _SIMPLE.get(self.kind)
        self.words = _Remembered(self._word)
        self.pieces = _Remembered(self._piece)

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """Ids of one word of known characters, from the tokenizer's model."""
        return self._tokens(charmap_decode(word.encode("utf-8"), "strict", self.letters)[0])

    def _tokens(self, letters: str) -> bytes:
        """Ids of one word, given by the letters that stand for its bytes."""
        table = self.table
        return b"".join([table[t.id] for t in self.tokenize(letters)])

    def _piece(self, piece: str | tuple[str]) -> bytes | None:
        """Ids of what stands between two blanks; a tuple opens its text. None: not sure."""
        if type(piece) is str and piece.isascii() and piece.isalpha():
            # the most common kind, one word whose letters stand for themselves
            return self._tokens(self.blank + piece if self.kind == "byte" else piece.lower())
        byte, opens = self.kind == "byte", type(piece) is tuple
        own = piece[0] if opens else piece
        simple = self.simple(own)
        if simple:
            word, marks = simple.groups()
            if marks and not opens:
                return self.pieces[word] + self.words[marks]
            word = word if opens else " " + word if byte else word.lower()
            return self._word(word) + (self.words[marks] if marks else b"")
        if byte:
            # white space beside a blank belongs to a run of white space
            if not own or own[0].isspace() or own[-1].isspace():
                return None
            text = own if opens else " " + own
        else:
            text = own.lower()
        words = _CUT[self.kind].findall(text)
        if sum(map(len, words)) + (0 if byte else text.count("\n")) != len(text):
            return self._whole(text if byte else own)
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind is None:
            return [self._whole(t) if t else b"" for t in texts]
        get, out = self.pieces.__getitem__, []
        for text in texts:
            pieces = text.split(" ") if text else []
            if pieces and self.kind == "byte":
                pieces[0] = (pieces[0],)
            try:
                out.append(b"".join(map(get, pieces)))
            except TypeError:  # a piece that is not sure
                out.append(self._whole(text))
        return out


def _kind(library) -> str | None:
    """Which of the two known ways the tokenizer cuts a text into words."""
    def told(part):
        return json.loads(part.__getstate__()) if part is not None else None

    cutter, shape, model = told(library.pre_tokenizer) or {}, told(library.normalizer), library.model
    if any(not a.content.startswith("<|") for a in library.get_added_tokens_decoder().values()) or type(model).__name__ != "BPE":
        return None
    if shape is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space"):
        return "byte"
    steps = [n.get("type") for n in (shape or {}).get("normalizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and cutter.get("type") == "Sequence":
        first, second = (cutter.get("pretokenizers") or [{}, {}])[:2]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if first.get("pattern") == {"Regex": pattern} and second.get("use_regex") is False:
            return "lower"
    return None


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this process for a tokenizer file; its words outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
