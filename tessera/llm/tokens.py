"""Token ids of whole texts by the tokenizers library."""

from __future__ import annotations

import codecs
import json
import re
from array import array

import numpy as np

#: A space followed by white space or the end: there a token may span the space.
_UNEVEN = re.compile(" (?:[\\s\u180e\u200b\ufeff]|$)")
_SPACE, _LETTER, _MARK = "\\t-\\r ", "A-Za-zÀ-ÖØ-öø-ſ", "!-/:-@\\[-`{-~‘’“”–—…"
#: Characters whose class is not spelled out above.
_OTHER = re.compile(f"[^{_SPACE}0-9{_LETTER}{_MARK}]")
#: Where the byte-level pre-tokeniser cuts a text without such characters.
_PIECES = re.compile(f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[{_MARK}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_KEPT = 500_000  # pieces whose ids a worker remembers; when as many are new, older ones not met since are forgotten


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> str:
    """The printable characters that stand for the bytes 0 to 255 in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


class _Known(dict):
    """piece of text -> ids (little-endian unsigned 32-bit), filled by `encode` as pieces turn up."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = array("I", self.encode(piece)).tobytes()
        if len(self) >= _KEPT:
            self.older = dict(self)
            self.clear()
        if len(piece) < 64:
            self[piece] = out
        return out


class Encoder:
    """Encodes texts as the tokenizer at `path` does, add_special_tokens=False.

    With a byte-level pre-tokeniser a text is cut into its pieces here, each piece
    is encoded by the tokenizer's model, and the ids of repeated pieces are
    remembered.  Texts with characters of other classes are cut before single
    spaces and words with such characters go through the whole tokenizer.  Texts
    with added tokens, or with both such characters and runs of spaces, and all
    texts under other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model, letters = self.tokenizer.model.tokenize, _byte_letters()
        self.pieces = _Known(lambda piece: [t.id for t in model(codecs.charmap_decode(piece.encode(), "strict", letters)[0])])
        self.words = _Known(self._encode)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        cut = made.get("pre_tokenizer") or {}
        self.by_piece = made.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _known(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if not self.by_piece or any(t in text for t in self.added):
            return np.array(self._encode(text), "<u4")
        if not _OTHER.search(text):
            return np.frombuffer(self._known(text), "<u4")
        if _UNEVEN.search(text):
            return np.array(self._encode(text), "<u4")
        head, *rest = text.split(" ")
        words = [head, *(" " + word for word in rest)]
        return np.frombuffer(b"".join([self.words[w] if _OTHER.search(w) else self._known(w) for w in words]), "<u4")

    def with_end(self, text: str | None, end: int = 0) -> np.ndarray:
        return np.append(self.ids(text), np.uint32(end)).astype("<u4")

    def ends_sentence(self) -> np.ndarray:
        """Whether each id's text ends a sentence or a line."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            out[i] = token.endswith((".", "!", "?", "Ċ"))  # U+010A stands for the line feed byte
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
