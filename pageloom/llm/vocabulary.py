"""Public byte-pair vocabularies, loaded once per Python worker from their files."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


@lru_cache(maxsize=4)
def tokenizer(name: str = VOCABULARY) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@lru_cache(maxsize=4)
def encoding(name: str = VOCABULARY) -> tiktoken.Encoding:
    """The same vocabulary as ranks, which encodes whole texts faster."""
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


@lru_cache(maxsize=1)
def pre_token_pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def encode(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text; the special string in it is one id, as the tokenizers library has it by default."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    return np.frombuffer(np.asarray(encoding(name).encode_to_numpy(text, allowed_special={SPECIAL})), dtype=np.uint32)
