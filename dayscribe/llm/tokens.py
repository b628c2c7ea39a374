"""Encoding of whole texts with a public byte-level BPE vocabulary.

Byte-level BPE never merges across pre-tokens, so a text's ids are the ids of its pre-tokens in a row.
Pre-tokens repeat: a worker encodes each one once, by the BPE model of the tokenizers library, and looks it up
afterwards.
Texts with characters on whose class Unicode versions may differ go to the library as a whole.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k.json"
#: Letters and digits among the characters that ODD lets pass; their classes are old and settled.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
ODD = r"[^\t-\r\x20-\x7e\xa1-ɏ‐-‧]"
#: Pre-tokens that a worker remembers: 2,000,000 entries in all, some 200 MB.
REMEMBERED = 800_000
MARK = "\1"  # odd, so no text that is split holds it
WORD = rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    table, more = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD:
            table[b] = chr(b)
        else:
            table[b], more = chr(more), more + 1
    return table


class _Recent(dict):
    """A lookup that keeps the entries used since the last but one time it was full."""

    def __init__(self, find, size: int):
        self._find, self._size, self._old = find, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self._old.get(key)
        if found is None:
            found = self._find(key)
        if len(key) <= 64:
            if len(self) >= self._size:
                self._old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """text -> its ids as little-endian unsigned 32-bit integers in bytes; strings of special tokens are ordinary text.

    remembered bounds the entries of the lookups (2.5 times as many in all), so a worker's memory doesn't grow with its input.
    A file that normalises text, or splits it in another way than byte-level BPE does, is left to the library throughout.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, block: int = 1 << 21):
        import json
        import re
        from array import array

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        def plain(text: str) -> bytes:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        split_by = told.get("pre_tokenizer") or {}
        known = split_by.get("type") == "ByteLevel" and not split_by.get("add_prefix_space") and split_by.get("use_regex", True)
        dropped = (told.get("model") or {}).get("dropout")
        self._known = known and told.get("normalizer") is None and (told.get("model") or {}).get("type") == "BPE" and not dropped and not told["model"].get("ignore_merges")
        merge, letters = tokenizer.model.tokenize, _byte_letters()

        def token(x: str) -> bytes:
            """What stands for one pre-token: straight from the library's BPE model, which finds nothing left to split."""
            return array("I", [t.id for t in merge(x.encode().decode("latin-1").translate(letters))]).tobytes()

        split = re.compile(WORD).findall
        words = _Recent(token, remembered // 8)
        word = words.__getitem__
        line_feed = token("\n") if self._known else b""

        def piece(x: str) -> bytes:
            """What stands for: a word with the space before it, a mark set apart, or a line feed with the word after it."""
            if x[:1] == MARK:
                return word(x[1:])
            if x[:1] == "\n":
                return line_feed + b"".join(map(word, split(x[1:])))
            return token(" " + x) if x.isalpha() else b"".join(map(word, split(" " + x)))

        pieces = _Recent(piece, remembered).__getitem__
        apart = re.compile(rf"[.,](?<=[{LETTERS}][.,])(?=[ \n]|\Z)").sub

        def lines(text: str) -> bytes:
            # A comma or stop between a letter and white space is a pre-token: set apart, words with and without it are one.
            head, *rest = apart(rf" {MARK}\g<0>", text).replace("\n", " \n").split(" ")
            return b"".join(map(word, split(head))) + b"".join(map(pieces, rest))

        self._plain, self._lines, self._block = plain, lines, block
        self._loosely = lambda text: b"".join(map(word, split(text)))
        self._odd, self._tabs = re.compile(ODD).search, re.compile(r"[\t\r\x0b\x0c]").search
        # Between two letters a space starts a pre-token, so a text may be cut before it.
        self._cut = re.compile(r"(?<=[a-z]) (?=[a-z])").search

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._known or self._odd(text):
            return self._plain(text)
        n, at, out = len(text), 0, []
        while n - at > 2 * self._block and (m := self._cut(text, at + self._block)):
            out.append(self._loosely(text[at : m.start()]))
            at = m.start()
        rest = text[at:]
        # Single spaces and line feeds between words end pre-tokens; other white space needs the pattern.
        loose = out or "  " in rest or "\n\n" in rest or " \n" in rest or "\n " in rest or rest[0] in " \n" or rest[-1] in " \n"
        out.append(self._loosely(rest) if loose or self._tabs(rest) else self._lines(rest))
        return out[0] if len(out) == 1 else b"".join(out)


def worker_encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker process's own Encoder: what it remembers serves all tasks that the process runs."""
    import sys
    import types

    kept = sys.modules.setdefault("_dayscribe_worker", types.ModuleType("_dayscribe_worker"))
    if getattr(kept, "key", None) != (path, remembered):
        kept.value, kept.key = None, (path, remembered)  # one thing at a time: what served another operator goes
        kept.value = Encoder(path, remembered)
    return kept.value
