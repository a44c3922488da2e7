"""Byte-level BPE: the ids that the tokenizers library gives for a JSON file.

The merge loop runs in tiktoken, built from the vocabulary of that file (a
byte-level BPE's ids are its merge ranks), at several times the speed; tests
compare the two libraries' ids.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: The pre-token pattern of byte-level BPE vocabularies of this family.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space after anything else always begins a pre-token, whatever stands farther left.
SURE = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable Latin-1, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _checked(path: str) -> dict:
    """The file's contents, if merging by id is what it describes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    if model["type"] != "BPE" or spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"{path}: other pre-tokens than byte-level ones")
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that take in their surroundings")
    ranks = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if ranks != sorted(set(ranks)) or len(ranks) != len(model["vocab"]) - 256 - sum(t["content"] in model["vocab"] for t in added):
        raise ValueError(f"{path}: ids don't follow the merges")
    return spec


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """tiktoken encoding of a byte-level BPE .json; raises if the file isn't one."""
    import tiktoken

    spec = _checked(path)
    byte, special = _byte_of(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    enc = tiktoken.Encoding("byte_bpe", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)
    enc.source = path
    return enc


@functools.lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(enc, text: str) -> np.ndarray:
    """Ids of the text; where a run of white space is too long for tiktoken's matcher, the slower library gives them."""
    try:
        return enc.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(library(enc.source).encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids, np.uint32)


def packed(enc, text: str) -> bytes:
    """Ids of the text as little-endian unsigned 32-bit numbers."""
    return ids_of(enc, text).astype("<u4", copy=False).tobytes()
