"""Token counts of a unigram tokenizer: Viterbi that carries counts only.

An Aho-Corasick automaton lists the vocabulary's pieces in a word; dynamic
programming over their ends carries the best score and its number of pieces, so
no path is kept or walked back. Ties go to the piece that starts first, and
neighbouring unknown characters are one token, as in the tokenizers library.

No public unigram vocabulary is at hand, so the pieces are those of the public
BPE model in their order, scored by Zipf's law on it: piece number r has the
log probability ``-ln((r + 1) * h)``. Words are what white space parts, each with
the word sign before it; words already met are looked up.

Rows: a null, empty or blank text has no tokens and the score 0; repeated rows
and null ids keep their rows; an empty table gives none; further columns are
ignored.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidetally.llm.batches import column, record, slices
from tidetally.llm.tokens import Recent

PIECES = "piece_bpe_32k.model"
WORD_SIGN = "▁"

#: Below the worst piece's score by this much lies an unknown character's (fixed value).
UNKNOWN_PENALTY = 10.0

KEPT_WORDS = 250_000


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) in the model's order, without control, byte and unknown pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    ]
    harmonic = sum(1 / (r + 1) for r in range(len(pieces)))
    return [(piece, -math.log((r + 1) * harmonic)) for r, piece in enumerate(pieces)]


class WordCounts(Recent):
    """Word to (pieces, score of the best path)."""

    def __init__(self, path: str | None):
        super().__init__(KEPT_WORDS)
        pieces = vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def work_out(self, word: str) -> tuple[int, float]:
        # The sign may be in the text too; it begins a word of its own there.
        count, score = 0, 0.0
        parts = word.split(WORD_SIGN)
        for part in parts if parts[0] else parts[1:]:
            n, s = self.best(WORD_SIGN + part)
            count, score = count + n, score + s
        return count, score

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path over all of ``text``.

        For an end, the automaton lists the longest piece first, that is, the
        one that starts first; only a better score takes its place.
        """
        size = len(text)
        score = [0.0] + [None] * size
        count = [0] * (size + 1)
        after_unknown = [False] * (size + 1)
        single = [False] * (size + 1)

        def close(end: int) -> None:
            """The unknown character that ends here, unless a piece is that character."""
            if not single[end]:
                candidate = score[end - 1] + self.unknown
                if score[end] is None or candidate > score[end]:
                    score[end] = candidate
                    count[end] = count[end - 1] + (not after_unknown[end - 1])
                    after_unknown[end] = True

        done = 0
        for last, (length, own) in self.automaton.iter(text):
            end = last + 1
            while done < end - 1:
                done += 1
                close(done)
            if length == 1:
                single[end] = True
            start = end - length
            candidate = own + score[start]
            if score[end] is None or candidate > score[end]:
                score[end], count[end], after_unknown[end] = candidate, count[start] + 1, False
        while done < size:
            done += 1
            close(done)
        return count[size], score[size]

    def of(self, text: str | None) -> tuple[int, float]:
        count, score = 0, 0.0
        for n, s in map(self.__getitem__, (text or "").split()):
            count += n
            score += s
        return count, score


@lru_cache(maxsize=2)
def word_counts(path: str | None = None) -> WordCounts:
    """This worker's table of words."""
    return WordCounts(path)


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, score (log probability of the best path)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_counts(model)
        for batch in slices(batches):
            found = [words.of(text) for text in column(batch, "text")]
            yield record(schema, column(batch, "doc_id"), *(list(zip(*found, strict=True)) or [[], []]))

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long, score double")
