"""Token ids of texts for byte-level BPE tokenizers, by a library that works by rank.

It gives the ids that the tokenizer file gives, several times as fast and in less memory.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The character that stands for each byte: printable ones of Latin-1 for themselves, the
#: others in order from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}


def _byte_of() -> dict[str, int]:
    others = iter(range(0x100, 0x200))
    return {chr(b if b in _PRINTED else next(others)): b for b in range(256)}


class ByteIds:
    """Ids equal to those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    A file is read by rank if it is a plain byte-level BPE whose merges have their ids in
    order.  Its special strings have their own ids wherever they stand in a text.  Any other
    kind of tokenizer is asked itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model, pre, added = found["model"], found.get("pre_tokenizer") or {}, found.get("added_tokens") or []
        vocabulary = model.get("vocab") or {}
        merges = ("".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges") or [])
        unusual = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        plain = (
            model.get("type") == "BPE"
            and (pre.get("type"), pre.get("use_regex", True), pre.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not found.get("normalizer")
            and not any(model.get(k) for k in unusual)
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
            and all(vocabulary.get(m) == 256 + i for i, m in enumerate(merges))
        )
        self.special = {t["content"]: t["id"] for t in added}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        if plain:
            import tiktoken

            byte_of = _byte_of()
            ranks = {bytes([byte_of[c] for c in t]): i for t, i in vocabulary.items() if t not in self.special}
            self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.ranked, self.tokenizer = None, Tokenizer.from_file(path)

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif not any(s in text for s in self.special):
            ids = self.ranked.encode_ordinary(text)
        else:
            ids = []
            for k, part in enumerate(self.parts.split(text)):
                ids += [self.special[part]] if k % 2 else self.ranked.encode_ordinary(part)
        return np.array(ids, dtype=np.uint32)
