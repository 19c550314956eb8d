"""Token counts under a unigram vocabulary: Viterbi that carries scores and counts only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SPACE = "▁"
#: A word that no vocabulary match covers costs this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words remembered per Python worker; the memory is emptied when it is full.
REMEMBERED = 400_000


def read_pieces(model_path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) by id, and whether all 256 byte pieces are there, of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    held = {p for p, _ in pieces}
    return pieces, all(f"<0x{b:02X}>" in held for b in range(256))


class Counter:
    """Counts the pieces of the best path through a word.

    Matches of the vocabulary come from an Aho-Corasick automaton, in order of
    their ends. Of paths to one place the greater score wins and of equal ones
    that whose last piece begins first, which is how the tokenizers library
    decides: it goes from start to start and replaces a path only by a better
    one. Where no piece of one character begins at a place, that character is
    unknown; a run of unknown characters is one piece, or as many as it has
    UTF-8 bytes where the vocabulary holds all byte pieces.
    """

    def __init__(self, pieces: list[tuple[str, float]], bytes_: bool) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p, _ in pieces if len(p) == 1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = bytes_
        self.known: dict[str, int] = {}

    def best(self, word: str) -> int:
        n = len(word)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(word):
            at[last + 1].append((last + 1 - size, score))
        score, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            char = word[end - 1]
            found = at[end] if char in self.single else [*at[end], (end - 1, None)]
            best = None
            for start, gain in sorted(found):
                total = score[start] + (self.unknown if gain is None else gain)
                if best is None or total > best:
                    best, from_, lost = total, start, gain is None
            score[end] = best
            if lost:
                size = len(char.encode("utf-8", "surrogatepass")) if self.bytes else int(not open_[from_])
                count[end], open_[end] = count[from_] + size, True
            else:
                count[end] = count[from_] + 1
        return count[n]

    def of(self, text: str) -> int:
        """Pieces of a text: each space begins a word, as does the text itself."""
        if not text:
            return 0
        known, total = self.known, 0
        marked = text.replace(" ", SPACE)
        marked = marked if marked.startswith(SPACE) else SPACE + marked
        for word in marked.split(SPACE)[1:]:
            pieces = known.get(word)
            if pieces is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                pieces = known[word] = self.best(SPACE + word)
            total += pieces
        return total


def token_count(text: Column, model_path: str) -> Column:
    """Number of unigram pieces of a text, by the pieces and scores of a sentencepiece model.

    The text is prefixed by a space, unless it begins with one, and parted before
    each space; nothing else is changed. Zero for a null or empty text. Each word
    of a text is counted once per worker and remembered, up to REMEMBERED words. A
    text or word of any length is counted whole, in time that grows with it.
    """
    pieces, bytes_ = read_pieces(model_path)

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(pieces, bytes_)
        for texts in batches:
            yield pd.Series(np.fromiter((counter.of(t or "") for t in texts), np.int64, len(texts)))

    return F.pandas_udf(counted, LongType())(text)
