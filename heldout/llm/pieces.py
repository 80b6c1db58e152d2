"""Pre-tokens of the public word-level BPE and the pieces the library makes of them.

The library normalises a text (NFC, white space, lower case), cuts it into
pre-tokens, and merges pieces inside each pre-token alone.  So a pre-token has
the same pieces wherever it stands, and each distinct one is encoded once.
"""

from __future__ import annotations

import json
import re

SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: The pre-token pattern of the vocabulary file for lower-case Latin text (U+0000 to U+017F).
LATIN = re.compile(r"[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa00-9a-zªµºß-öø-ſ²³¹¼-¾]+")
#: What the pattern, str.split() and str.lower() don't treat as the library's own steps do.
BEYOND = re.compile("[^\x00-\x1b\x20-įı-ſ]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    from tokenizers.pre_tokenizers import ByteLevel

    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    if set(letters.values()) != set(ByteLevel.alphabet()):
        raise ValueError("the library's byte letters are not the known ones")
    return letters


class _Chunks(dict):
    """Ids of what stands between white space, filled when asked for."""

    def __init__(self, pieces: Pieces, most: int):
        super().__init__()
        self.pieces, self.most = pieces, most

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        encode = self.pieces.encode
        value = self[chunk] = b"".join([encode(t) for t in LATIN.findall(chunk)])
        return value


class Pieces:
    """Ids of pre-tokens and texts, as little-endian unsigned 32-bit bytes.

    Pre-tokens, and chunks between white space, are remembered up to ``most``
    entries of each kind.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.most = most
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = _byte_letters()
        self.special = {x["content"]: x["id"].to_bytes(4, "little") for x in spec["added_tokens"]}
        self.known: dict[str, bytes] = {}
        self.tokenize = self.whole.model.tokenize
        self.chunks = _Chunks(self, most)

    def encode(self, pretoken: str) -> bytes:
        """Ids of one pre-token."""
        found = self.known.get(pretoken)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.special.get(pretoken)
            if found is None:
                text = pretoken.encode().decode("latin-1").translate(self.letters)
                found = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(text)])
            self.known[pretoken] = found
        return found

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text in order; a special string is one of its own."""
        if "<|" in text and SPECIAL.search(text):
            parts = SPECIAL.split(text)
            return [t for part in parts for t in ([part] if part in self.special else self.pretokens(part))]
        if not BEYOND.search(text):
            return LATIN.findall(text.lower())
        normal = self.whole.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(normal)]

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, without added special tokens."""
        if ("<|" in text and SPECIAL.search(text)) or BEYOND.search(text):
            return b"".join([self.encode(t) for t in self.pretokens(text)])
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))
