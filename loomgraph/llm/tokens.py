"""Byte-level BPE from a tokenizers file, run by the faster of two installed encoders.

The file's vocabulary and merges are read; where its merge order equals its
id order, and it has the plain byte-level pre-tokenizer, encoding goes through
tiktoken over the same ranks, else through tokenizers. Both give the same ids.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

#: Fixed value: the pre-tokenizer pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, Codec] = {}


def default_path() -> str:
    """The tokenizer that the queries name; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """encode(text) -> uint32 array; decode(ids) -> text; both as the tokenizers library has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        vocab, added = spec["model"]["vocab"], spec.get("added_tokens") or []
        specials = {x["content"]: x["id"] for x in added}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in specials else bytes(to_byte[c] for c in token)
        for token, i in specials.items():
            self.bytes_of[i] = token.encode()
        self.specials = {k: np.array([v], np.uint32) for k, v in specials.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        plain = plain and all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word")) for x in added)
        if not plain or not self._ranked(vocab, spec["model"]["merges"], specials):
            raise ValueError(f"{path} is not a plain byte-level BPE in merge order")
        ranks = {self.bytes_of[i]: i for t, i in vocab.items() if t not in specials}
        self.fast = tiktoken.Encoding("loom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self._slow = path, None
        top = max(self.bytes_of) + 1
        self.table = [self.bytes_of.get(i, b"") for i in range(top)]

    @staticmethod
    def _ranked(vocab: dict[str, int], merges: list, specials: dict[str, int]) -> bool:
        ids = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
        return all(a < b for a, b in zip(ids, ids[1:])) and min(ids, default=256) >= 256

    def slow(self):
        """The tokenizers library itself, for texts that the fast encoder gives up on."""
        if self._slow is None:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            t.no_truncation()
            t.no_padding()
            self._slow = t
        return self._slow

    def _plain(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        except BaseException as e:  # the Rust side panics on some extreme runs of one character
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.slow().encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if self.split is None or not any(s in text for s in self.specials):
            return self._plain(text)
        found = [self.specials[x] if x in self.specials else self._plain(x) for x in self.split.split(text) if x]
        return np.concatenate(found) if found else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        t = self.table
        return b"".join([t[i] for i in ids.tolist()]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One Codec a worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]
