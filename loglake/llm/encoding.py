"""Byte-level BPE ids of many texts, fast enough for whole corpora.

The ids are those of the ``tokenizers`` library with the vocabulary file's JSON (``byte_bpe_50k.json``), without special
tokens added; the strings of its special tokens, such as ``<|endoftext|>``, are those tokens wherever a text holds them
(tests/llm/test_operators.py holds the ids against that library). The vocabulary's split pattern always starts a new
piece at a space that a non-space follows, so a text can be cut there and each chunk be encoded once per worker and
remembered. Texts where a space meets other white space are encoded whole, by a library that takes the same ranks.
"""

from __future__ import annotations

import json
import re

import numpy as np

from loglake.llm.common import tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: Chunks remembered by one worker, and the longest of them in characters.
MOST_CHUNKS = 500_000
LONGEST_CHUNK = 64

_SLOW = re.compile(r" (?=\s|$)")


class ChunkEncoder:
    def __init__(self, vocabulary: str = VOCABULARY, most: int = MOST_CHUNKS):
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = _byte_of()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(map(as_byte.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: the longest first, as one may begin with another
        self.special = {k: special[k] for k in sorted(special, key=len, reverse=True)}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if special else None
        size = max([*ranks.values(), *special.values()]) + 1
        #: bytes of each token, and whether it begins with a space
        self.length, self.spaced = np.zeros(size, np.int64), np.zeros(size, bool)
        for token, i in ranks.items():
            self.length[i], self.spaced[i] = len(token), token[:1] == b" "
        for token, i in special.items():
            self.length[i] = len(token.encode())
        self.cache: dict[str, bytes] = {"": b""}
        self.most = most

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(chunks)), "<u4")
        at = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * 4
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(chunks, at[:-1].tolist(), at[1:].tolist(), strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(x in t for x in self.special for t in texts):
            return self._plain(texts)
        parts = [self.cut.split(t) for t in texts]  # every second one is a special token
        plain = iter(self._plain([p for own in parts for p in own[::2]]))
        return [b"".join(next(plain) if k % 2 == 0 else self.special[p].to_bytes(4, "little") for k, p in enumerate(own)) for own in parts]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        out: list[bytes | None] = [None] * len(texts)
        cut, seen = [], set()
        for k, text in enumerate(texts):
            if _SLOW.search(text):
                out[k] = np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
                continue
            words = text.split(" ")
            head = words[0]
            words[0] = ""
            cut.append((k, head, words))
            seen.update(words)
        seen.discard("")
        known = self.cache
        if new := [w for w in seen if w not in known]:
            learnt = self._learn(new)
            kept = {w: ids for w, ids in learnt.items() if len(w) <= LONGEST_CHUNK}
            room = max(0, self.most - len(known))
            known.update(kept if len(kept) <= room else list(kept.items())[:room])
            if len(kept) < len(learnt) or len(kept) > room:
                known = {w: known[w] if w in known else learnt[w] for w in seen} | {"": b""}
        get = known.__getitem__
        for k, head, words in cut:
            first = np.array(self.bpe.encode_ordinary(head), "<u4").tobytes() if head else b""
            out[k] = first + b"".join(map(get, words))
        return out


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in order,
    for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ChunkEncoder(vocabulary)
    return _ENCODERS[vocabulary]
