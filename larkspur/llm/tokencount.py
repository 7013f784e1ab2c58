"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton lists every piece that ends at each place of a word; dynamic programming carries
the best score and its number of pieces. The rules are those of the tokenizers library's Unigram model with
byte fallback behind a Metaspace pre-tokenizer that always prepends: a character without a piece of its own
costs the lowest score less ten and becomes its bytes, and of equal scores the piece that begins first wins.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, resident, text_or_empty

SPACE, UNKNOWN_PENALTY = "\u2581", 10.0
CACHE = 100_000


class _Counts(dict):
    """Piece counts of words, remembered; begun anew when there are CACHE of them."""

    def __init__(self, count, lead: str):
        super().__init__()
        self.count, self.lead = count, lead

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = n = self.count(self.lead + word)
        return n


class PieceCounter:
    """Counts the pieces of texts under a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        # No piece spans a sign that no piece holds, so texts may be cut there.
        self.cuts_lines = not any("\n" in p for p, _ in pieces)
        self.led, self.bare = _Counts(self.count_word, SPACE), _Counts(self.count_word, "")

    def count_word(self, word: str) -> int:
        """Pieces on the best path through one pre-tokenized word."""
        n = len(word)
        score, pieces, start = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        at = 0  # all ends up to here are settled, for what ends at a place only needs earlier places
        for last, (length, own) in self.matches.iter(word):
            end = last + 1
            while at < end - 1:
                at += 1
                self._unknown(word, at, score, pieces, start)
            begin = end - length
            total = score[begin] + own
            if start[end] < 0 or total > score[end] or (total == score[end] and begin < start[end]):
                score[end], pieces[end], start[end] = total, pieces[begin] + 1, begin
        while at < n:
            at += 1
            self._unknown(word, at, score, pieces, start)
        return pieces[n]

    def _unknown(self, word: str, end: int, score: list[float], pieces: list[int], start: list[int]) -> None:
        """Let the character before `end` be unknown, if it has no piece; it begins last, so only a better score counts."""
        char = word[end - 1]
        if char not in self.single:
            total = score[end - 1] + self.unknown
            if start[end] < 0 or total > score[end]:
                score[end], pieces[end], start[end] = total, pieces[end - 1] + len(char.encode("utf-8", "surrogatepass")), end - 1

    def count(self, text: str) -> int:
        """Tokens of a whole text. Each blank becomes a mark that begins a word; a text not beginning with one gets one."""
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        if not text.startswith(" "):
            text = " " + text
        total = 0
        for k, line in enumerate(text.split("\n") if self.cuts_lines else [text]):
            first, *words = line.split(" ")
            total += sum(map(self.led.__getitem__, words)) + (1 if k else 0) + (self.bare[first] if first else 0)
        return total


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add `out`: the number of tokens of each whole text (long). Null and empty texts have none.

    Rows are independent: nothing is shuffled, repeated rows get equal counts, other columns pass through.
    """
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(read_pieces(path)))  # a fixed vocabulary of 32,000 pieces

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = hashlib.sha256(packed.value).hexdigest()
        counter = resident(key, lambda: PieceCounter(pickle.loads(packed.value)))
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, run(text_or_empty(text)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id and n_tokens."""
    return count_tokens(docs.select("doc_id", "text"), path).select("doc_id", "n_tokens")
