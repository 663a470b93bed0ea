"""Token ids of whole texts by a ``tokenizers`` file.

The ids are those that ``tokenizers`` gives. Its encodings carry offsets, words and strings, which
costs five times what the ids cost (1.3 MB a second and core), so texts of Latin letters go through
``tiktoken`` with ranks made of the same file, if that is a byte-level BPE whose ids follow its
merges. The two cut such texts alike: their patterns are the same, and tests hold all characters
below ``COMMON``, in all places of a text, against each other. Any text with another character,
whose class may differ with the Unicode tables of the two, and any other kind of file goes through
``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Texts of characters below this one, and of general punctuation without its spaces, are cut alike by both libraries.
COMMON = 0x250
_UNCOMMON = re.compile(f"[^\x00-{chr(COMMON - 1)}‐-‧‰-⁞]")
#: Fixed: the pattern that a byte-level BPE cuts text by.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, others count from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def ranks(form: dict) -> dict[bytes, int] | None:
    """Bytes and rank of each token, if the file is a plain byte-level BPE whose ids follow the order of its merges."""
    model, cut = form["model"], form.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or form.get("normalizer") or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space"):
        return None
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    vocabulary, letters = model["vocab"], byte_letters()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    after = [vocabulary.get(a + b, -1) for a, b in merges]
    singles = [vocabulary.get(c, -1) for c in letters]
    if min(singles) < 0 or any(b <= a for a, b in zip([max(singles), *after], after)):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token in letters or i > max(singles) and i <= after[-1]}


class Encoder:
    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.fast = None
        if found := ranks(json.loads(source)):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=found, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as ``kind``."""
        if self.fast is None:
            return self.plainly(texts)
        own = [i for i, t in enumerate(texts) if _UNCOMMON.search(t)]
        given = dict(zip(own, self.plainly([texts[i] for i in own])))
        return [given[i] if i in given else self.fast.encode_to_numpy(t, disallowed_special=()).astype(self.kind) for i, t in enumerate(texts)]

    def plainly(self, texts: list[str]) -> list[np.ndarray]:
        """The same by ``tokenizers`` alone."""
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


_encoders: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The worker's encoder for a tokenizer file's content; it keeps the last one."""
    if source not in _encoders:
        _encoders.clear()
        _encoders[source] = Encoder(source)
    return _encoders[source]
