"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries: in front of an ASCII white space that follows other than white space. No pre-token
spans such a place and no added token holds white space, so the counts of the pieces add up to that of the text.
Pieces that a worker has not met are encoded in batches of about ``BATCH_BYTES``; their lengths are kept in a table of
bounded size. A long text is thus many small pieces, and only counts travel back.

The work is one pass without a shuffle. Null and empty texts have zero bytes and tokens. A text without a safe
boundary is one piece. Repeated rows and other columns do not matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import whole

BATCH_BYTES = 1 << 16
CACHE_PIECES = 400_000
#: Pieces above this length are encoded each time: remembering them would not pay.
CACHE_CHARS = 48
#: Rows of an Arrow batch are taken together up to so many characters.
GROUP_CHARS = 1 << 22

_BOUNDARY = re.compile(r"(?<=\S)(?=[ \t-\r])")
# Text without white space other than blanks and line feeds has the same boundaries here, and this form is faster.
_FAST = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries; joined they give the text again."""
    if not text:
        return []
    return _BOUNDARY.split(text) if _OTHER_SPACE.search(text) else _FAST.findall(text)


class Counter:
    """Counts tokens with one tokenizer file, remembering short pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self._piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(x) for x in self._piece.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
            self._encode = lambda texts: [len(x) for x in self._tokenizer.encode_batch(texts, add_special_tokens=False)]
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        """Token counts of texts, encoded in batches balanced by size."""
        out: list[int] = []
        batch: list[str] = []
        size = 0
        for t in texts:
            if batch and size + len(t) > BATCH_BYTES:
                out += self._encode(batch)
                batch, size = [], 0
            batch.append(t)
            size += len(t)
        return out + (self._encode(batch) if batch else [])

    def count(self, texts: list[str]) -> list[int]:
        # Word models see a whole text at once; byte-level pairs never cross a safe boundary.
        if not self.path.endswith("byte_bpe_50k.json"):
            return self.lengths(texts)
        cut = [pieces(t) for t in texts]
        seen = {p for c in cut for p in c}
        if len(self.known) + len(seen) > 2 * CACHE_PIECES:
            self.known = {}
        new = list(seen - self.known.keys())
        self.known.update(zip(new, self.lengths(new), strict=True))
        out = [sum(map(self.known.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > CACHE_CHARS:
                del self.known[p]
        return out


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for t in texts:
        if group and size + len(t) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` and ``n_tokens`` of every whole text, for a ``.json`` or ``.model`` tokenizer file."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in batches:
            yield pd.Series([n for g in _groups(texts.tolist()) for n in counter.count(g)], dtype="int64")

    counted = F.pandas_udf(run, "long")
    text = whole(text_col)
    return docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
