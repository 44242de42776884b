"""Token ids of whole texts by a public byte-level BPE vocabulary, through an installed library."""

from __future__ import annotations

import numpy as np
import tiktoken

from aforo.llm.bpe import WORD_SPLIT, Vocabulary


class ByteEncoder:
    """Ids of a text. Strings of special tokens in it become these tokens, or stay text with ``special=False``."""

    def __init__(self, vocabulary: Vocabulary, special: bool = True):
        rising = all(later[2] > earlier[2] for earlier, later in zip(vocabulary.merges, vocabulary.merges[1:]))
        if not rising:
            raise ValueError("the ids of the vocabulary do not rise with its merges")
        ranks = {token: i for i, token in vocabulary.tokens.items()}
        self._special = vocabulary.special if special else {}
        self._encoding = tiktoken.Encoding("vocabulary", pat_str=WORD_SPLIT, mergeable_ranks=ranks, special_tokens=self._special)

    def ids(self, text: str) -> np.ndarray:
        """All ids of the whole text, as 32-bit numbers; none of an empty one."""
        return self._encoding.encode_to_numpy(text, allowed_special=set(self._special), disallowed_special=())
