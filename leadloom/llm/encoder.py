"""Byte-level BPE ids of whole texts with the tokenizers library, with a bounded cache of pieces.

The pre-tokenizer never joins what stands on both sides of a single space or newline between two visible
characters, nor a letter or digit with a full stop or comma after it, so a text may be cut there and each
distinct piece encoded once. A piece of letters, or of a space and letters, is one pre-token and goes
straight to the library's BPE model; any other goes through the whole tokenizer. Texts in which a cut isn't
certain (control characters, other white space, runs of spaces) are cut only between visible ASCII
characters, and a text that holds a special token's string is encoded in one go.
"""

from __future__ import annotations

import functools
import os
import re
import struct

VOCABULARY = "byte_bpe_50k.json"
#: Pieces held by a worker in each of two generations; when the younger is full, the older goes.
CACHE_PIECES = 500_000
#: Longer pieces aren't held.
CACHED_BYTES = 48

#: Control characters but for the newline.
_CONTROL = bytes(b for b in [*range(32), 127] if b != 10)
#: White space outside ASCII (or what starts like it), and runs of white space.
_ODD = (b"  ", b" \n", b"\n ", b"\n\n", b"\xC2\xA0", b"\xC2\x85", b"\xE1\x9A\x80", b"\xE2\x80", b"\xE2\x81\x9F", b"\xE3\x80\x80")
_SURE_CUT = re.compile(rb"(?<=[!-~])(?= [!-~])")
#: Full stops and commas become q, other visible ASCII that isn't a letter or digit (and white space) p.
_MARKS = bytes(ord("q") if chr(b) in ".," else ord("a") if b >= 0x80 or chr(b).isalnum() else ord("p") for b in range(256))
#: A word and a run of marks after it (no apostrophe, which may open a contraction) are two pre-tokens.
_WORD_MARKS = re.compile(r"( ?[^\s!-@\[-`{-\x7F]+)([!#$%&()*+,./:;<=>?@\[\\\]^{|}~-]+)")
#: Bytes of ASCII and of U+00C0 to U+017F, which are letters but for two signs.
_LATIN = bytes([*range(0xC0), 0xC3, 0xC4, 0xC5])
_SIGNS = (b"\xC3\x97", b"\xC3\xB7")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 as it is, the rest from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(rest)) for b in range(256)]


class Encoder(dict):
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers. As a dict: the younger pieces."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encoded(piece)
        if len(piece) <= CACHED_BYTES:
            self[piece] = ids
        return ids

    def encoded(self, piece: bytes) -> bytes:
        """A piece's ids, not from the cache."""
        text = piece.decode()
        if (text[1:] if text[:1] == " " else text).isalpha():
            found = self._pre_token(piece)
        elif (cut := _WORD_MARKS.fullmatch(text)) and (cut[1][1:] if cut[1][:1] == " " else cut[1]).isalpha():
            found = self._pre_token(cut[1].encode()) + self._pre_token(cut[2].encode())
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def _pre_token(self, piece: bytes) -> list[int]:
        name = piece.decode().replace(" ", self.letters[32]) if piece.isascii() else "".join([self.letters[b] for b in piece])
        return [t.id for t in self.model.tokenize(name)]

    def _pieces(self, text: bytes) -> list[bytes]:
        if any(s in text for s in self.special):
            return [text]
        if text[:1] in b" \n" or text[-1:] in b" \n" or len(text.translate(None, _CONTROL)) < len(text) or any(x in text for x in _ODD):
            return _SURE_CUT.split(text)
        cut = text.replace(b"\n", b"\0\n\0").replace(b" ", b"\0 ")
        marks = text.translate(_MARKS)
        if marks[:1] != b"q" and b"pq" not in marks and b"qq" not in marks and not text.translate(None, _LATIN) and not any(s in text for s in _SIGNS):
            cut = cut.replace(b".", b"\0.").replace(b",", b"\0,")
        return cut.split(b"\0")

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        out, get = [], self.__getitem__
        for text in texts:
            out.append(b"".join(map(get, self._pieces(text))) if text else b"")
            if len(self) > CACHE_PIECES:
                self.older = dict(self)
                self.clear()
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
