"""Token ids of a public vocabulary."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.json"
END = 1
#: The white space of the vocabulary's pattern (Unicode's White_Space): a fixed value.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Longer runs of white space go past the pattern, whose search gives up on runs of some 500,000.
LONG = 10_000


class Encoder:
    """Ids of texts as unsigned 32-bit numbers.

    vocabulary: a byte-level BPE vocabulary of public_tokenizers. Its rank file (the same vocabulary under the suffix
    .tiktoken) and its added tokens give the ids that tokenizers gives with add_special_tokens=False, at four times the speed.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        lines = Path(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken"))).read_bytes().split(b"\n")
        pairs = (line.split() for line in lines if line)
        added = json.loads(Path(public_tokenizers.path(vocabulary)).read_bytes())["added_tokens"]
        self.added = {x["content"]: x["id"] for x in added}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens=self.added)
        self._blanks = re.compile(f"[{WHITE}]{{{LONG},}}")
        self._added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text in parts. In a run of white space all but the last character (at a text's end, all) are one word of the pattern."""
        for piece in self._added.split(text) if self._added else [text]:
            if piece in self.added:
                yield np.array([self.added[piece]], np.uint32)
                continue
            at = 0
            for run in self._blanks.finditer(piece):
                cut = run.end() if run.end() == len(piece) else run.end() - 1
                yield self.bpe.encode_to_numpy(piece[at : run.start()], disallowed_special=())
                yield np.array(self.bpe._encode_single_piece(piece[run.start() : cut]), np.uint32)
                at = cut
            yield self.bpe.encode_to_numpy(piece[at:], disallowed_special=())

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text and END; null counts as empty."""
        if not text:
            return np.array([END], "<u4")
        if len(text) >= LONG and self._blanks.search(text):
            parts = list(self._parts(text))
        else:
            parts = [self.bpe.encode_to_numpy(text, allowed_special="all")]
        return np.concatenate([*parts, [END]]).astype("<u4")


@lru_cache(1)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for each worker process."""
    return Encoder(vocabulary)
