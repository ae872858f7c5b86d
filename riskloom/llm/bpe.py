"""Token ids of whole texts with a file of the tokenizers library.

Where the file is plain byte-level BPE whose ids are in the order of its merges,
the same vocabulary runs in tiktoken, several times faster; tests hold its ids
against the tokenizers library. Any other file is left to that library.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: The pattern of the ByteLevel pre-tokenizer (fixed value of the tokenizer format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Encoder:
    """encode(text) -> ids. size: bytes of each id, None unless the vocabulary is byte-level."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        self.special = {t["content"]: t["id"] for t in added}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.fast = self._tiktoken(spec) if plain else None
        self.size = self._sizes(spec) if plain else None
        self.n_ids = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1

    def _tiktoken(self, spec: dict):
        """None unless ids follow the merges."""
        letters, vocab = _letters(), spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in t): k for t, k in vocab.items() if t not in self.special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def _sizes(self, spec: dict) -> np.ndarray:
        """One character of a token stands for one byte; special tokens stand for their UTF-8 text."""
        vocab = spec["model"]["vocab"]
        out = np.zeros(max([*vocab.values(), *self.special.values()]) + 1, np.int64)
        for token, k in vocab.items():
            out[k] = len(token)
        for token, k in self.special.items():
            out[k] = len(token.encode())
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
