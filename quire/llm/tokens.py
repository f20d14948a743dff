"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces.

Both vocabularies split a text into words and signs before they merge, so a text may be cut at certain
places and its pieces encoded on their own: the ids, joined, are those of the whole text. Most pieces recur; the cache holds
the ids of recent ones in two generations: when the young one is full it becomes the old one.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

from quire.llm.common import worker_cache

#: A word (with the space before it), or what else there is up to the next word. Between two such pieces the
#: vocabularies' own patterns have a border too. No border: beside an apostrophe (contractions), beside
#: other signs beyond ASCII (a combining mark may be composed with the letter before it), and between a run of white space and a
#: word (its last character is a token of its own there).
PIECES = re.compile(
    r" ?[^\W_]+(?![^\W_]|'|[^\x00-\x7f])"
    r"|(?: (?=[^\W_]))?.(?:(?! [^\W_]|(?<![^\W_])(?<!')(?<!\s\s)(?<![^\x00-\x7f])[^\W_]).)*",
    re.S,
)
_LONGEST_KEPT = 64
#: Pieces looked up together, about.
_AT_ONCE = 4_000


#: Letters up to here are composed, and have small forms of one letter (but for U+0130, see below).
_PLAIN = "\u017f"


def _byte_signs() -> dict[int, str]:
    """The signs by which byte-level vocabularies write bytes: printable ones themselves, the others from U+0100 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceEncoder:
    """encode(text) -> little-endian unsigned 32-bit ids as bytes, without special tokens added."""

    def __init__(self, path: str, kind: str, max_pieces: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._folds, self._max = kind == "word", max_pieces
        self._kept: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        if kind == "word":
            self._special.append("\u0130")  # its small form ends in a sign of its own
        self.vocab_size = self._tokenizer.get_vocab_size()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order. Some texts at a time share the look at what the cache lacks."""
        held: list = []
        size = 0
        for text in texts:
            # what NFC changes may join the sign after it; a composed text has borders where its pieces have them
            whole = any(s in text for s in self._special) or self._folds and not unicodedata.is_normalized("NFC", text)
            held.append(_little(self._tokenizer.encode(text, add_special_tokens=False).ids) if whole else PIECES.findall(text))
            size += len(held[-1])
            if size >= _AT_ONCE:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list) -> Iterator[bytes]:
        """Of lists of pieces their ids; what is bytes already passes."""
        kept, old = self._kept, self._old
        missing = set().union(*[x for x in held if type(x) is list]).difference(kept)
        long = [p for p in missing if len(p) > _LONGEST_KEPT]
        if old:
            found = [p for p in missing if p in old]
            kept.update((p, old[p]) for p in found)
            missing.difference_update(found)
        if self._folds:  # small and capital letters have the same ids
            missing = [p for p in missing if not self._folded(p)]
        self._add(missing)
        get = kept.__getitem__
        out = [b"".join(map(get, x)) if type(x) is list else x for x in held]
        for p in long:
            kept.pop(p, None)
        if len(kept) > self._max:
            self._old, self._kept = kept, {}
        yield from out

    def _add(self, missing) -> None:
        """Keeps the ids of pieces. A space and letters are one unit for the vocabularies: such pieces go to the model straight away."""
        kept, tokenize, folds = self._kept, self._tokenizer.model.tokenize, self._folds
        rest = []
        for p in missing:
            if p[0] != " " or not p[1:].isalpha() or folds and max(p) > _PLAIN:
                rest.append(p)
                continue
            unit = p[1:].lower() if folds else p
            kept[p] = _little([t.id for t in tokenize(unit.encode().decode("latin-1").translate(_BYTE_SIGNS))])
        if rest:
            for p, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                kept[p] = _little(e.ids)

    def _folded(self, piece: str) -> bool:
        """Takes the ids of an ASCII piece from the same one in small letters, if that is kept."""
        small = piece.lower() if piece.isascii() else piece
        ids = self._kept.get(small) if small != piece else None
        if ids is not None:
            self._kept[piece] = ids
        return ids is not None


def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder a Python worker; workers are reused, and so is the cache."""
    return worker_cache(f"{kind}:{path}", lambda: PieceEncoder(path, kind))


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
