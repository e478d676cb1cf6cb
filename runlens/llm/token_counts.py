"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates every vocabulary piece in a chunk; dynamic
programming over the chunk carries the best score and its number of pieces.
Ties follow the tokenizer: of equal scores at one end the earliest start wins,
and a character without a piece of its own is unknown, at the least score less
ten, after every piece that ends there. Unknown characters count their UTF-8
bytes if the vocabulary falls back to bytes, else one per run. Chunks start at
each meta space (U+2581, which stands for U+0020 and is put in front of the
text); their counts are kept for the next chunk that is equal.

The vocabulary (pieces and scores) comes from a sentencepiece file whose path is
a parameter.

Defined results: null and empty texts have 0 tokens; null ids are kept;
repeated rows are counted each; an empty table gives no rows; texts are taken
whole; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

META = "▁"
#: What the tokenizer takes off the least score for an unknown character; fixed.
PENALTY = 10.0
#: Chunks kept at once by a worker.
KEPT = 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece, score in vocab:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - PENALTY
        self.byte_fallback = byte_fallback
        self.kept: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count, run = [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        done = 0  # ends up to here are final

        def settle(upto: int) -> None:
            """Unknown characters that end at positions up to ``upto``."""
            nonlocal done
            while done < upto:
                done += 1
                c = text[done - 1]
                if c not in self.single:
                    s = score[done - 1] + self.unknown
                    if score[done] is None or s > score[done]:
                        score[done], run[done] = s, True
                        cost = len(c.encode("utf-8", "replace")) if self.byte_fallback else int(not run[done - 1])
                        count[done] = count[done - 1] + cost

        for last, (size, s) in self.pieces.iter(text):
            end = last + 1
            settle(last)
            start = end - size
            s += score[start]
            if score[end] is None or s > score[end]:
                score[end], count[end], run[end] = s, count[start] + 1, False
        settle(n)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", META)
        total, kept = 0, self.kept
        for rest in (text[1:] if text[0] == META else text).split(META):
            n = kept.get(rest)
            if n is None:
                if len(kept) >= KEPT:
                    kept.clear()
                n = self.chunk(META + rest)
                if len(rest) <= 64:
                    kept[rest] = n
            total += n
        return total


@cache
def _counter(path: str, byte_fallback: bool) -> Counter:
    return Counter(vocabulary(path), byte_fallback)


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True) -> DataFrame:
    """One row per document: the id, n_tokens."""

    def run(batches):
        counter = _counter(vocabulary_path, byte_fallback)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)
