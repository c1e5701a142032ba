"""Byte-level BPE ids of whole texts.

The ids are those of the `tokenizers` library for the given vocabulary file. Texts are encoded whole by
`tiktoken` on the same vocabulary and splitting pattern, straight into a buffer of ids: over texts with many
rare words this takes less time than looking words up in a cache, and keeps no memory.
"""

from __future__ import annotations

import json

import numpy as np

_loaded: dict[str, "Bpe"] = {}


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take code points from 256 on in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep}
    rest = (b for b in range(256) if b not in set(keep))
    table.update({chr(256 + i): b for i, b in enumerate(rest)})
    return table


class Bpe:
    """ids(text) gives a uint16 array; the vocabulary must have no id above 65,535."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        alphabet = _byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        if max([*ranks.values(), *special.values()]) > 0xFFFF:
            raise ValueError("ids above 65,535 are not supported")
        self.size = 1 + max([*ranks.values(), *special.values()])
        self._core = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self._special = set(special)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self._core.encode_to_tiktoken_buffer(text, self._special), dtype=np.uint32).astype("<u2")


def load(path: str) -> Bpe:
    """One instance per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
