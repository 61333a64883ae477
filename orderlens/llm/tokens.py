"""Token ids of whole texts by the tokenizers library, remembered by chunk."""

from __future__ import annotations

import os
import re
from array import array

from orderlens.llm.common import kept

#: Chunks that one Python worker remembers, and the length up to which it does.
MEMO_CHUNKS, MEMO_LENGTH = 600_000, 48

# Characters of which none is white space, combines with its neighbours or changes class between
# Unicode versions: printable ASCII and Latin up to U+024F, without U+0130, which lower case makes two
# characters.  LETTER holds the letters among them.
SOLID = "!-~¡-įı-ɏ"
LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"

#: A text with a match is encoded as a whole.  Otherwise each space, newline, comma and full stop
#: stands where the pre-tokenizers split anyway: single white space between solid characters, and
#: marks after a letter or digit.
#: The pattern begins with the characters it is about, so that a search passes over all others.
ODD = re.compile(f"[ \n.,\0](?:(?<=[ \n])(?:(?![{SOLID}])|(?<![{SOLID}].))|(?<=[.,])(?<![{LETTER}0-9].)|(?<=\0))", re.S)

# Classes of Latin-1 characters: a letter or digit, blank, point (full stop, comma), other solid, or 0.
_CLASSES = bytes(next((ord(c) for c, of in (("a", f"[{LETTER}0-9]"), (" ", "[ \n]"), (".", "[.,]"), ("!", f"[{SOLID}]")) if re.match(of, chr(i))), 0)
                 for i in range(256))


def odd(text: str) -> bool:
    """Whether ODD is in a text.  Texts of Latin-1 show it by pairs of neighbours' classes, in a quarter of the search's time."""
    try:
        of = text.encode("latin-1").translate(_CLASSES)
    except UnicodeEncodeError:
        return ODD.search(text) is not None
    if b"\0" in of:
        return ODD.search(text) is not None
    return of[:1] in (b" ", b".") or of[-1:] == b" " or any(pair in of for pair in (b"  ", b" .", b"..", b"!."))


#: Chunks that a worker encodes both ways before it trusts the model's own.
PROOF = 256

# A byte-level model reads bytes as characters: printable ones as themselves, the others, in turn, as those from U+0100 on.
_UNPRINTABLE = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_NAMES = {byte: 0x100 + i for i, byte in enumerate(_UNPRINTABLE)}
SPACE_NAME = chr(BYTE_NAMES[0x20])


class _Memo(dict):
    """Ids by chunk.  A chunk of letters is one pre-token, so the library's model takes it as it is, without the
    steps around it; a worker compares the first PROOF of them with the whole way, and keeps to that if one differs."""

    def __init__(self, tokenizer, spaces: str | None):
        super().__init__()
        self.tokenizer, self.tokenize, self.kept, self.proof = tokenizer, tokenizer.model.tokenize, spaces == "kept", PROOF

    def _whole(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _ids(self, chunk: str) -> list[int]:
        word = chunk[1:] if self.kept and chunk[:1] == " " else chunk
        if self.proof < 0 or not word.isalpha() or not (self.kept or word.isascii()):
            return self._whole(chunk)
        if not self.kept:
            named = chunk
        elif chunk.isascii():
            named = chunk if word is chunk else SPACE_NAME + word
        else:
            named = chunk.encode().decode("latin-1").translate(BYTE_NAMES)
        ids = [t.id for t in self.tokenize(named)]
        if self.proof:
            whole = self._whole(chunk)
            self.proof = self.proof - 1 if ids == whole else -1
            return whole
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self._ids(chunk)).tobytes()
        if len(self) < MEMO_CHUNKS and len(chunk) <= MEMO_LENGTH:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, equal to the library's ids of the whole text.

    Byte-pair merges never cross the pre-tokenizer's splits, so the ids of a text are those of its
    chunks in turn.  ``spaces`` says how the tokenizer takes white space: ``"kept"`` (a byte-level
    BPE, where a space belongs to the next word), ``"dropped"`` (white space and ASCII case don't
    count), or None: nothing is known, each text is encoded as a whole.  Strings of special tokens
    are ordinary text.
    """

    def __init__(self, path: str, spaces: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaces = spaces
        self._of = _Memo(self.tokenizer, spaces).__getitem__

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def ids(self, text: str) -> bytes:
        if self.spaces is None or odd(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.spaces == "kept":
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        else:
            cut = text.encode().lower().decode().replace(" ", "\0").replace("\n", "\0")
        return b"".join(map(self._of, cut.replace(",", "\0,").replace(".", "\0.").split("\0")))


def encoder(path: str, spaces: str | None) -> Encoder:
    """The worker's encoder of a file; tasks that run in one worker share what it remembers, until it runs another step."""
    return kept((path, spaces), lambda: Encoder(path, spaces))
