"""Token ids of whole texts by a public tokenizer file, with the ids of words remembered."""

from __future__ import annotations

import os
import re
from array import array

from attestary.llm.common import worker_state

REMEMBERED = 600_000  # words a worker process remembers; further ones are encoded each time they occur
CLOSERS = ".,;:!?%$&*#|"
# a blank before a word belongs to it, the last of several as well
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD_BLANKS = re.compile("[\x1c-\x1f]")  # blanks to Python, not to the tokenizers


# byte-level models write each byte as one printable character: its own where it has one
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in PLAIN)}


class WordIds(dict):
    """Ids of a unit of text as little-endian unsigned 32-bit bytes, encoded when first asked for."""

    def __init__(self, path: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self.model, self.bytes = self.tokenizer.model, BYTE_CHARS
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        stem = unit.rstrip(CLOSERS)
        letters = stem[1:] if stem[:1] == " " else stem
        # below U+0100 letters and closing signs never join, and case changes letter by letter
        if not letters.isalpha() or not (letters.isascii() or max(letters) < "\u0100"):
            ids = self.encode(unit)
        elif len(stem) < len(unit):
            ids = self[stem] + self[unit[len(stem):]]
        elif self.lower and not unit.islower():
            small = unit.lower()
            ids = self[small] if small.islower() and small != unit else self.encode(unit)
        else:
            # letters alone are one unit to the model, which needs no other step of the tokenizer
            ids = array("I", [t.id for t in self.model.tokenize(
                unit.encode().decode("latin-1").translate(self.bytes))]).tobytes()
        if len(self) < REMEMBERED:
            self[unit] = ids
        return ids


class Encoder:
    """Whole texts to ids. ``drops_blanks``: the tokenizer drops white space and case (word BPE);
    otherwise it keeps every blank (byte-level BPE)."""

    def __init__(self, path: str, drops_blanks: bool):
        self.path, self.drops_blanks = path, drops_blanks

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit bytes.

        Both kinds of tokenizer divide a text at white space before they merge, so units between
        blanks can be encoded one by one and remembered. Texts with a special token's string, which
        divides them first, are encoded whole.
        """
        words = worker_state(f"ids:{self.path}", lambda: WordIds(self.path, self.drops_blanks))
        if ODD_BLANKS.search(text) or any(s in text for s in words.special):
            return words.encode(text)
        units = text.split() if self.drops_blanks else SPACED.findall(text)
        return b"".join(map(words.__getitem__, units))
