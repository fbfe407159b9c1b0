"""Token ids by the tokenizers library, with a memo of words."""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Where a text holds these characters only, NFC changes nothing and lower-casing goes character by character.
_SIMPLE, _LETTERS, _NUMBERS, _SPACES = "\x00-\xff\u2010-\u2027", "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: The pre-tokenizer's pattern of word vocabularies, and the same over simple characters.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# (the alternatives begin differently, so their order is free, but for the last two: the commonest comes first)
_PIECE = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile(f"[^{_SIMPLE}]")


def _simple(text: str) -> bool:
    """Whether the text has characters of _SIMPLE only."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _OTHER.search(text)


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones are their own, others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, rest = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in own else chr(rest)
        rest += b not in own
    return out


#: How many things of a kind a process holds on to.
LATEST = 2


class Encoder:
    """Encodes texts with a vocabulary file of the tokenizers library, without special tokens.

    If the vocabulary cuts a text by WORD_PATTERN, drops white space and marks word ends, the ids of a
    text are the ids of its pieces one after another, so each different piece is encoded once. The memo
    has two generations of ``limit`` pieces at most: a full one becomes the old one, from which pieces in
    use are taken over. This bounds memory and changes no result. Texts with other characters or with an
    added token's string, and texts under other vocabularies, are encoded whole.
    """

    def __init__(self, path: str, limit: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cuts, bytes_ = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_pieces = (
            (cuts.get("pattern") or {}).get("Regex") == WORD_PATTERN and cuts.get("behavior") == "Removed" and bool(cuts.get("invert"))
            and kinds == ["NFC", "Replace", "Lowercase"] and bytes_.get("type") == "ByteLevel" and not bytes_.get("add_prefix_space") and not bytes_.get("use_regex")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.memo: dict[str, bytes] = {}  # piece -> its ids
        self.old: dict[str, bytes] = {}
        self.letters = dict(enumerate(_byte_letters()))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: Iterable[str]) -> None:
        """Pieces are lower case and in NFC already, so the model alone gives their ids, from their bytes."""
        tokenize, letters, memo = self.tokenizer.model.tokenize, self.letters, self.memo
        for w in pieces:
            memo[w] = array("I", [t.id for t in tokenize(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters))]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; a null text is empty."""
        texts = [t or "" for t in texts]
        if not self.by_pieces:
            return self._whole(texts)
        plain = [_simple(t) and not any(x in t for x in self.added) for t in texts]
        cut = [_PIECE.findall(t.lower()) for t, p in zip(texts, plain) if p]
        new = set(filterfalse(self.memo.__contains__, chain.from_iterable(cut)))
        if len(self.memo) + len(new) > self.limit:
            self.old, self.memo = self.memo, {}
            new = set(chain.from_iterable(cut))
        if self.old:
            again = new & self.old.keys()
            self.memo.update((w, self.old[w]) for w in again)
            new -= again
        self._learn(new)
        get = self.memo.__getitem__
        done = iter([b"".join(map(get, w)) for w in cut])
        rest = iter(self._whole([t for t, p in zip(texts, plain) if not p]) if not all(plain) else ())
        return [next(done) if p else next(rest) for p in plain]


def per_process(kind: str, key, make: Callable):
    """What make() gives, made once per process for each key; only the last LATEST keys of a kind are held.

    Functions reach executors by value, so globals of this module don't outlive a task; a module of the process does.
    """
    held = sys.modules.setdefault("_flowloom_process", types.ModuleType("_flowloom_process")).__dict__.setdefault(kind, {})
    if key not in held:
        while len(held) >= LATEST:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


def shared_encoder(path: str) -> Encoder:
    """One encoder per process and vocabulary: its memo serves all tasks that the process runs."""
    return per_process("encoders", path, lambda: Encoder(path))


def runs(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """Cuts a text column into runs of about size bytes: (first, last + 1, texts). Only one run is held as Python strings."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    at = 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="left")) + 1
        stop = min(stop, len(ends), at + 4096)
        yield at, stop, column.slice(at, stop - at).to_pylist()
        at = stop
