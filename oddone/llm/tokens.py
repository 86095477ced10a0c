"""Token ids of whole texts, equal to those of ``tokenizers`` for a byte-level BPE file, found by ``tiktoken``.

``tiktoken``'s pattern engine backtracks over runs of white space and overflows its stack on runs of some
hundred thousand characters. Texts with a long run are therefore split by ``regex``, which does not, and
each pre-token is merged on its own; the merges run no pattern.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Runs of white space from this length on are kept from ``tiktoken``'s pattern.
LONG_RUN = 1 << 16
BLANKS = re.compile(r"\s+")


def byte_pairs(ranks_path: str, pattern: str, special: dict[str, int] | None = None):
    """The merges of the vocabulary by ``tiktoken``: the same ids as ``tokenizers``, found faster."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})


def long_run(text: str) -> bool:
    """Whether the text holds a run of white space that ``tiktoken``'s pattern may not survive."""
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in BLANKS.finditer(text))


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; special strings inside texts become their ids."""

    def __init__(self, ranks: str, special: tuple[tuple[str, int], ...]):
        import public_tokenizers
        import regex

        self.bpe = byte_pairs(public_tokenizers.path(ranks), public_tokenizers.PATTERN, dict(special))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.ids = dict(special)
        names = "|".join(map(regex.escape, sorted(self.ids, key=len, reverse=True)))
        self.cut = regex.compile(f"({names})").split if names else lambda t: [t]

    def encode(self, text: str) -> bytes:
        if long_run(text):
            return self._by_piece(text)
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def _by_piece(self, text: str) -> bytes:
        merge, out = self.bpe._encode_single_piece, []
        for part in self.cut(text):
            if part in self.ids:
                out.append(self.ids[part])
            else:
                for word in self.split(part):
                    out += merge(word)
        return np.array(out, "<u4").tobytes()


@lru_cache(maxsize=4)
def encoder(ranks: str, special: tuple[tuple[str, int], ...]) -> Encoder:
    return Encoder(ranks, special)
