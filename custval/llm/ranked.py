"""BPE of tokenizer files by ranks.

A tokenizer file lists its merges; where the i-th merge makes the i-th token after the
single symbols, merging the neighbours that make the token of lowest id is the same as
replaying the list, and the rank-based library does that several times faster.  The
functions here read a file and refuse one for which this does not hold.
``tests/llm/test_curve.py`` and ``test_wavelet.py`` compare with the files' own library.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: The split of byte-level pre-tokenizers with ``use_regex``.  Fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte: visible Latin-1 characters for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(model: dict, end: str = "", mark: bytes = b"") -> dict[bytes, int]:
    """Tokens as bytes, the end-of-word suffix as ``mark``; checks that ids follow the merges."""
    vocabulary, symbols = model["vocab"], byte_symbols()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = 256 * (2 if end else 1)

    def joined(a: str, b: str) -> int:
        return vocabulary[a + b]

    if model["type"] != "BPE" or [joined(a, b) for a, b in merges] != list(range(first, first + len(merges))):
        raise ValueError("the ids of this tokenizer do not follow its merges")

    def spelled(token: str) -> bytes:
        body, tail = (token[: -len(end)], mark) if end and token.endswith(end) else (token, b"")
        return bytes(symbols[c] for c in body) + tail

    return {spelled(token): i for token, i in vocabulary.items() if i < first + len(merges)}


def byte_level(data: bytes) -> tiktoken.Encoding:
    """The encoding of a byte-level BPE file without normalizer; its special tokens are found in texts."""
    file = json.loads(data)
    if file["normalizer"] is not None or file["post_processor"] is not None:
        raise ValueError("normalizers and post-processors are not supported")
    split = file["pre_tokenizer"]
    if split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
        raise ValueError("only the byte-level split is supported")
    special = {}
    for token in file["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError("special tokens that take blanks along are not supported")
        special[token["content"]] = token["id"]
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=_ranks(file["model"]), special_tokens=special)


class WordRanks:
    """Encodes words of letters with a file whose last symbol of a word has a suffix: the suffix is a blank here."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        ranks = _ranks(model, model["end_of_word_suffix"], b" ")
        ranks[b" "] = max(ranks.values()) + 1  # never alone: it joins the byte before it first
        self.encoding = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(ranks[b" "] + 1, bool)
        self.ends[[i for token, i in ranks.items() if token.endswith(b" ")]] = True

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (of lower-case letters, not empty), one after another, and how many each has."""
        marked = pc.cast(pc.binary_join_element_wise(pc.cast(words, pa.large_string()), *pa.array(["", " "], pa.large_string())), pa.large_string())
        offsets = np.frombuffer(marked.buffers()[1], np.int64, len(marked) + 1, marked.offset * 8)
        text = memoryview(marked.buffers()[2] or b"")[offsets[0] : offsets[-1]]
        ids = self.encoding.encode_to_numpy(str(text, "utf-8"), disallowed_special=()).astype(np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
