"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece inside a word; dynamic programming over the word's
characters carries only the best score and the number of pieces on the way to each place. Ties go to the
candidate met first, which begins earliest: the rule of unigram tokenizers, which replace only by a strictly
better score. A character that is no piece on its own costs the least piece score less UNKNOWN_PENALTY and counts
as its UTF-8 bytes if the vocabulary falls back to bytes, as one piece otherwise; neighbouring unknown characters
are one piece in that case.

Words are cut before every space, which becomes the mark; the text gets a mark in front. Distinct words are
counted once for each worker and remembered.

A null or empty text has no tokens and score 0. Texts are counted whole; repeated rows get equal counts; an empty
table gives an empty result. Extra columns are carried through, unless they bear a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import chunks, read_table, resident, session_defaults, tidy, utf8_parts

#: The mark for a space, and by how much an unknown character is worse than the worst piece.
MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words that a worker remembers; when full, it forgets all and goes on.
CACHE_WORDS = 300_000
_NONE = float("-inf")


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = True):
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(pieces):
            if piece and k != unknown:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """(pieces, score) of one word on its best path."""
        n = len(text)
        score, count, unknown_run = [0.0] + [_NONE] * n, [0] * (n + 1), [False] * (n + 1)
        done, single = 0, False  # places up to `done` are final; whether a piece of one character ends behind it
        for last, (size, gain) in self.automaton.iter(text):  # by end, and the longest piece first
            if last > done:
                self._close(text, done, last, single, score, count, unknown_run)
                done, single = last, False
            total = score[last + 1 - size] + gain
            if total > score[last + 1]:
                score[last + 1], count[last + 1] = total, count[last + 1 - size] + 1
            if size == 1:
                single = True
        self._close(text, done, n, single, score, count, unknown_run)
        return count[n], score[n]

    def _close(self, text: str, done: int, to: int, single: bool, score: list, count: list, unknown_run: list) -> None:
        """Make the places done + 1 to `to` final: where no piece of one character ends, it may be unknown."""
        for end in range(done + 1, to + 1):
            if single:
                single = False
                continue
            total = score[end - 1] + self.unknown_score
            if total > score[end]:
                score[end], unknown_run[end] = total, True
                count[end] = count[end - 1] + (len(text[end - 1].encode()) if self.byte_fallback else not unknown_run[end - 1])

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        known, pieces, score = self.known, 0, 0.0
        for word in (MARK + text.replace(" ", MARK)).split(MARK)[1:]:
            got = known.get(word)
            if got is None:
                if len(known) > CACHE_WORDS:
                    known.clear()
                got = known[word] = self.word(MARK + word)
            pieces += got[0]
            score += got[1]
        return pieces, score


def model(path: str) -> Unigram:
    """The pieces and scores of a sentencepiece file, read as a unigram vocabulary, once in each worker."""

    def read() -> Unigram:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = [own.is_control(k) or own.is_byte(k) for k in range(own.get_piece_size())]
        pieces = [(own.id_to_piece(k), own.get_score(k)) for k in range(own.get_piece_size())]
        return Unigram([("", s) if skip[k] else (p, s) for k, (p, s) in enumerate(pieces)], own.unk_id())

    return resident("token_count", (path,), read)


def count_tokens(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Replace the text by n_tokens and score."""
    session_defaults(df.sparkSession)
    kept = [c for c in df.columns if c not in ("n_tokens", "score", text_col)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            _, offsets = utf8_parts(column)
            for i, j in chunks(offsets):
                counts = [own.count(t) for t in column[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:-1]), pa.array(np.array([c for c, _ in counts], np.int64)), pa.array(np.array([s for _, s in counts], float))], names=[*kept, "n_tokens", "score"])

    return source.mapInArrow(tidy(run), ", ".join([*fields, "n_tokens bigint", "score double"]))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
