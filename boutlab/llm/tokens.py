"""Token ids of texts.

The ids are those of the ``tokenizers`` file. For texts in Latin letters the same vocabulary as ranks
gives the same ids at a third of the CPU time (tests compare both); all others, where the libraries
could know different Unicode versions, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np

_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._model, self._fast = Tokenizer.from_file(path), None
        if ranks:
            import public_tokenizers
            import tiktoken

            lines = Path(ranks).read_bytes().splitlines()
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self._model.get_added_tokens_decoder().items()}
            self._fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special
            )

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        slow = [i for i, t in enumerate(texts) if self._fast is None or _BEYOND_LATIN.search(t)]
        other = set(slow)
        found = [
            None if i in other else self._fast.encode_to_numpy(t, allowed_special="all").astype("<u4")
            for i, t in enumerate(texts)
        ]
        encoded = self._model.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)
        for i, x in zip(slow, encoded, strict=True):
            found[i] = np.array(x.ids, "<u4")
        return found


def encoder(path: str, ranks: str | None) -> Encoder:
    """One per Python worker and vocabulary; workers are reused by later tasks."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = Encoder(path, ranks)
    return _ENCODERS[path, ranks]
