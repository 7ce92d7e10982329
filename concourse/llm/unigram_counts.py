"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

Sorted distinct pre-tokens are the depth-first walk of their trie: a pre-token shares the forward scores of the prefix
that it has in common with the one before, so each trie node is scored once. Its count is stored at its terminal node.
The model: pieces are a public byte-level vocabulary and their scores a Zipf law over ranks, in whole 2^-20 nats so
that sums are exact. A text's best segmentation has the highest total score and, of those, the fewest tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import tidy
from .byte_bpe import read_ranks
from .pretokens import looked_up, splitter

UNIT = 1 << 20


@lru_cache(2)
def scores(path: str) -> tuple[dict[bytes, int], int]:
    """Piece to score, and the longest piece."""
    tokens = read_ranks(path)
    total = math.log(sum(1 / (i + 1) for i in range(len(tokens))))
    return {t: round(UNIT * (-math.log(i + 1) - total)) for i, t in enumerate(tokens) if t}, max(map(len, tokens))


def trie_counts(words: list[bytes], model: dict[bytes, int], longest: int) -> Iterator[tuple[int, int]]:
    """(tokens, score) of the best segmentation of each of the sorted distinct words."""
    last, best = b"", [(0, 0)]  # best[i]: score and minus tokens of the first i bytes
    for word in words:
        shared = len(commonprefix((last, word)))
        del best[shared + 1 :]
        for stop in range(shared + 1, len(word) + 1):
            found = None
            for start in range(max(0, stop - longest), stop):
                piece = model.get(word[start:stop])
                if piece is not None:
                    score, minus = best[start]
                    way = (score + piece, minus - 1)
                    if found is None or way > found:
                        found = way
            best.append(found)
        last = word
        yield -best[-1][1], best[-1][0]


@lru_cache(2)
def _known(path: str) -> dict[str, int]:
    return {}


def _counter(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, longest), known, split = scores(path), _known(path), splitter(pattern)

        def learn(new: list[str]) -> list[tuple[int, int]]:
            words = sorted(w.encode("utf-8", "surrogatepass") for w in new)
            by = dict(zip(words, trie_counts(words, model, longest)))
            return [by[w.encode("utf-8", "surrogatepass")] for w in new]

        for batch in batches:
            rows = []
            for x in looked_up(batch.column(1).to_pylist(), split, known, learn):
                rows.append((len(x), sum(c for c, _ in x), sum(s for _, s in x)))
            n, tokens, score = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array([s / UNIT for s in score], pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "log_score"])
        tidy(known)

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_score) for every row of docs, over whole texts.

    Null or empty text: zeros. Repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_counter(path, pattern), "doc_id long, n_pretokens long, n_tokens long, log_score double")
