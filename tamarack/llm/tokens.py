"""Token ids of texts by a byte-level BPE tokenizer file.

Ids are computed by tiktoken from the file's own vocabulary, which gives the same ids as the tokenizers library several
times faster. Texts that hold a special token's string, and texts that tiktoken's pattern gives up on (runs of hundreds
of thousands of blanks), go through the tokenizers library itself.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: how the byte-level pre-tokenizer splits. The contractions share one alternative, and the last one is a single character,
#: as white space of two characters or more is always matched by the one before it: the same pieces, found faster.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s"

_encoders: dict = {}


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """texts -> list of uint32 arrays, by the tokenizer file at `path`."""
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        fast, slow = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(path)

        def one(t: str) -> np.ndarray:
            if not any(s in t for s in special):
                try:
                    return fast.encode_to_numpy(t, disallowed_special=())
                except ValueError:  # the pattern's backtracking limit
                    pass
            return np.asarray(slow.encode(t, add_special_tokens=False).ids, np.uint32)

        _encoders[path] = lambda texts: [one(t) for t in texts]
    return _encoders[path]
