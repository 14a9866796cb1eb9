"""Encoding whole texts with a public tokenizer, fast enough for large corpora.

Both vocabularies split a text into pretokens that never span certain white
space, so a text can be cut there and each piece encoded on its own; pieces
repeat, so their ids are kept in a bounded two-generation cache for each
process.  Which cut is safe depends on the tokenizer's own pre-tokenizer, which
is read from its file; any other tokenizer gets whole texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
import string
from array import array
from collections.abc import Callable

import numpy as np

from .common import kept_between_tasks

#: Pieces of a generation, shared out among an executor's Python workers, and bytes of pieces of one.
CACHE = 2_000_000
CACHE_BYTES = 64 << 20
#: Hashes of the table of pieces seen before, less one.
DOOR = (1 << 22) - 1
#: A piece that ends in some of these after an ASCII letter or digit is its ids without them, then theirs.  Special tokens end in |>.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{}~"
MOST_ENDS = 10_000
#: White space beyond ASCII's six that a pattern's \s may match; such texts are encoded whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2060\u3000\ufeff]")
#: Two white-space characters in a row, or one at the end.
_RUN = re.compile("[\\x20\\x09-\\x0D](?:[\\x20\\x09-\\x0D]|\\Z)")
#: A run of white space and what follows it.
_PIECE = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")


class Encoder:
    """encode(text as bytes) gives ids as little-endian bytes of `width` bytes each."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.vocabulary <= 1 << 16 else 4
        self._code = {2: "H", 4: "I"}[self.width]
        self.most = CACHE // workers()
        self._young: dict = {}
        self._old: dict = {}
        self._held = self._passed = 0
        self._door = bytearray(DOOR + 1)
        self._pieces = _cut_for(described)
        self._ends: dict = {}
        if self._pieces is not None:
            letters = string.ascii_letters + string.digits
            self._solid = {*letters, *letters.encode()}
            self._bounds = np.zeros(self.vocabulary, bool)
            for token, number in self.tokenizer.get_vocab().items():
                self._bounds[number] = token.startswith("\u0120") if self._pieces is _spaced else token.endswith("</w>")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self._code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list) -> list[bytes] | None:
        """Ids of words of letters alone, encoded as one text and cut at the tokens that end (or start) a word; None if these are not as many."""
        text = "".join(words) if isinstance(words[0], str) else b" ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")
        cuts = np.flatnonzero(self._bounds[ids]) * self.width
        if len(cuts) != len(words):
            return None
        raw = ids.tobytes()
        if isinstance(words[0], str):
            return [raw[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(raw)])]
        ends = (cuts + self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: set) -> dict:
        """The ids of these pieces, none of which is in the young generation.

        Half of all pieces are seen once only; a piece is kept from its second time on, which a table of hashes tells.
        """
        young, old, ends, solid, door = self._young, self._old, self._ends, self._solid, self._door
        marks_of = {str: MARKS, bytes: MARKS.encode()}
        made, words, others, ended = {}, set(), [], []
        for p in pieces:
            if (held := old.get(p)) is not None:
                young[p] = made[p] = held
                continue
            body = p.rstrip(marks_of[type(p)])
            if len(body) < len(p) and len(body) > 1 and body[-1] in solid:
                # Letters and digits never share a pretoken with marks that follow, and these are one.
                end = p[len(body) :]
                if end not in ends:
                    if len(ends) > MOST_ENDS:
                        ends.clear()
                    ends[end] = self._ids([end.decode() if isinstance(end, bytes) else end])[0]
                ended.append((p, body, ends[end]))
                p = body
                if p in made:
                    continue
                held = young.get(p)
                if held is None:
                    held = old.get(p)
                if held is not None:
                    made[p] = held
                    continue
            if p.isalpha() or p.decode().isalpha() if isinstance(p, bytes) else p[:1] == " " and p[1:].isalpha():
                words.add(p)
            else:
                others.append(p)
        if words:
            order = list(words)
            found = self._joined(order)
            if found is None:
                others += order
            else:
                made.update(zip(order, found))
        if others:
            made.update(zip(others, self._ids([p.decode() if isinstance(p, bytes) else p for p in others])))
        for p, body, end in ended:
            made[p] = made[body] + end
        for p, ids in made.items():
            at = hash(p) & DOOR
            if door[at]:
                young[p] = ids
                self._held += len(p)
            else:
                door[at] = 1
        self._passed += len(made)
        if self._passed > DOOR // 2:
            self._door, self._passed = bytearray(DOOR + 1), 0
        return made

    def encode(self, text: bytes) -> bytes:
        pieces = self._pieces(text) if self._pieces else None
        if pieces is None:
            return self._ids([text.decode()])[0]
        found = list(map(self._young.get, pieces))
        if None in found:
            made = self._learn({p for p, ids in zip(pieces, found) if ids is None})
            at = -1
            try:
                while True:
                    at = found.index(None, at + 1)
                    found[at] = made[pieces[at]]
            except ValueError:
                pass  # no further piece was missing
            if len(self._young) > self.most or self._held > CACHE_BYTES:
                self._old, self._young, self._held = ({} if self._held > CACHE_BYTES else self._young), {}, 0
        return b"".join(found)


def _words(text: bytes) -> list[bytes]:
    return text.split()


def _lowered(text: bytes) -> list[bytes]:
    """For a tokenizer that lower-cases; special tokens' strings must keep their case."""
    return text.split() if b"<|" in text else text.lower().split()


def _spaced(text: bytes) -> list[str] | None:
    """Cut before each run of white space, and after a lone line feed; None where that isn't plainly safe."""
    whole = text.decode()
    if not whole.isascii() and _OTHER_SPACE.search(whole):
        return None
    if "\x1e" in whole or _RUN.search(whole):
        return _PIECE.findall(whole)
    return whole.replace(" ", "\x1e ").replace("\n", "\x1e\n\x1e").split("\x1e")


def _cut_for(described: dict) -> Callable[[bytes], list | None] | None:
    before = described.get("pre_tokenizer") or {}
    parts = before.get("pretokenizers", [before])
    if described.get("post_processor") or described.get("truncation") or described.get("padding"):
        return None
    if [p.get("type") for p in parts] == ["ByteLevel"] and parts[0].get("use_regex") and not parts[0].get("add_prefix_space") and not described.get("normalizer"):
        return _spaced
    if len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space"):
        # The pattern's matches hold no white space, and what is outside matches is dropped.
        if re.search(r"\\s(?![^\[]*\])", parts[0]["pattern"].get("Regex", r"\s")) is None:
            steps = (described.get("normalizer") or {}).get("normalizers", [])
            return _lowered if any(x.get("type") == "Lowercase" for x in steps) else _words
    return None


def workers() -> int:
    """Python workers of this executor, the siblings of this process; two where that can't be told."""
    parent = os.getppid()
    try:
        with open(f"/proc/{parent}/task/{parent}/children") as file:
            return max(2, len(file.read().split()))
    except OSError:
        return 2


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a file, kept from task to task until another operator's task runs here."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    made = _ENCODERS[path]
    made.most, made._old = CACHE // workers(), {}
    return made


def _release() -> None:
    if _ENCODERS:
        _ENCODERS.clear()
        with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
            ctypes.CDLL(None).malloc_trim(0)


kept_between_tasks(_release)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
