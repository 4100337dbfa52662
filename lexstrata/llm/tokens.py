"""Token ids of a public tokenizer, in batches inside tasks."""

from __future__ import annotations

import functools
import json
import os

import numpy as np

END_ID = 2

# Fixed value: the byte-level pre-tokenisation pattern that belongs to the vocabulary, written with
# possessive repeats: the same pieces, without the way back that `\s+(?!\S)|\s+` and the like keep open.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: a byte that prints as Latin-1 text stands for
    itself, the others take the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BatchTokenizer:
    """Ids as unsigned 32-bit arrays, none added around a text.

    Added tokens of the file that stand in a text, special ones too, get their own ids, as
    ``tokenizers`` does it. ``path`` is a file of that library. Where it is a plain byte-level BPE
    whose ids follow the order of its merges, encoding by merge list and encoding by rank
    give the same ids, and the rank encoder, built from the same file, does the work
    several times faster. Every other file is encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str, fast: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rank_encoder = self._by_rank(spec) if fast else None
        self.added = sorted(self.rank_encoder.special_tokens_set) if self.rank_encoder else []
        self.tokenizer = None
        if self.rank_encoder is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    @staticmethod
    def _by_rank(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        alphabet, vocab = _byte_alphabet(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab.get(a + b) for a, b in merges]
        if any(i is None for i in ids) or ids != sorted(set(ids)) or any(vocab.get(c, 1 << 30) >= ids[0] for c in alphabet):
            return None
        added = {t["content"]: t for t in spec.get("added_tokens") or []}
        if any(t.get(k) for t in added.values() for k in ("lstrip", "rstrip", "single_word")) or any(a != b and b.startswith(a) for a in added for b in added):
            return None
        known = {*map("".join, merges), *alphabet} - added.keys()
        import tiktoken

        ranks = {bytes(alphabet[c] for c in token): vocab[token] for token in known}
        return tiktoken.Encoding("by_rank", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={c: t["id"] for c, t in added.items()})

    def _ranked(self, text: str) -> list[int]:
        """Added tokens cost a slower scan, which texts without any are spared."""
        if any(t in text for t in self.added):
            return self.rank_encoder.encode(text, allowed_special="all")
        return self.rank_encoder.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.rank_encoder is not None:
            return [np.array(self._ranked(t), dtype="<u4") for t in texts]
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def tokenizer_at(path: str) -> BatchTokenizer:
    """One tokenizer a worker process, kept from task to task."""
    return BatchTokenizer(path)


def pieces_of(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids: whole when it fits,
    else pieces of ``limit`` ids behind a first piece that holds the remainder."""
    if length <= limit:
        return [(0, length)]
    first = length % limit or limit
    return [(0, first), *((at, limit) for at in range(first, length, limit))]
