"""Byte-level BPE vocabularies, read from a public tokenizer's file that each executor has. The path is a parameter."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken


def json_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def rank_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the JSON form: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a rank file or of a ``tokenizers`` JSON file with byte-level BPE."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special, letters = {x["id"] for x in spec["added_tokens"]}, _byte_letters()
        return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(2)
def special_tokens(path: str) -> dict[str, int]:
    """Added tokens of a JSON file, which the ``tokenizers`` library finds in texts before anything else; a rank file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens=special_tokens(path))


def encode(path: str, text: str) -> np.ndarray:
    """Ids of a text, as the library that reads the file gives them: a JSON file's added tokens count wherever their text occurs."""
    return encoding(path).encode_to_numpy(text, allowed_special="all")


@lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    every = ranks(path) | {text.encode(): i for text, i in special_tokens(path).items()}
    out = [b""] * (max(every.values()) + 1)
    for token, i in every.items():
        out[i] = token
    return out


@lru_cache(2)
def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether a sentence or line ends with it."""
    return np.array([b"\n" in t or t.rstrip().endswith((b".", b"!", b"?")) for t in [*token_bytes(path), b""]])
