"""Reads a byte-pair vocabulary file once in each worker process."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

#: Room for ids in a packed pair; both vocabularies are smaller.
WIDTH = 17
ID_MASK = (1 << WIDTH) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in symbols)
    symbols.update((b, chr(256 + k)) for k, b in enumerate(hidden))
    return [symbols[b] for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """``pairs``: left << WIDTH | right -> rank << WIDTH | id of the merged symbol."""

    ids: dict[str, int]
    names: dict[int, str]
    pairs: dict[int, int]
    first: list[int]
    last: list[int]
    special: dict[str, int]
    word_end: str


def parse(raw: bytes) -> Vocabulary:
    spec = json.loads(raw)
    model = spec["model"]
    ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs: dict[int, int] = {}
    for rank, (left, right) in enumerate(model["merges"]):
        pairs.setdefault(ids[left] << WIDTH | ids[right], rank << WIDTH | ids[left + right])
    symbols = byte_symbols()
    names = {i: s for s, i in ids.items()} | {i: s for s, i in special.items()}
    return Vocabulary(ids, names, pairs, [ids[s] for s in symbols], [ids[s + end] for s in symbols], special, end)


def read(path: str) -> bytes:
    return Path(path).read_bytes()
