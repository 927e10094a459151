"""Token counts of whole texts under a unigram vocabulary, without making the tokens.

A text is cut before each blank; a part is a blank's sign and what follows it. In a part, an Aho-Corasick automaton enumerates every
vocabulary entry at every place, and dynamic programming carries the best score that ends at each place and the number of
tokens on that path. The rules are those of the unigram model in the `tokenizers` library with byte fallback: of paths with equal scores the one
whose last entry starts first stays; a character without an entry of its own costs the lowest score less ten, and a run of such
characters counts a token for each of its bytes. Counts of parts are kept, since parts repeat.

The vocabulary comes from a SentencePiece file, whose path is a parameter. Files of merges hold ranks, not probabilities: an
entry of rank r then has Zipf's probability, in proportion to 1 / (r + 2). Nothing is trained.

Defined cases: a null or empty text has 0 tokens; rows with equal identifiers are counted each; a null identifier stays null; other
columns are ignored; a part without blanks may be of any length and takes time in proportion to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import HashCache, small_batches, table, tidied
from .tokens import tokenizer_path

SIGN = "▁"
#: What a character without an entry costs beyond the lowest score.
PENALTY = 10.0


def zipf_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(entry, log probability) in the order of identifiers, and the identifier for unknown text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    mass = math.log(sum(1 / (r + 2) for r in range(size)))
    return [(model.id_to_piece(r), -math.log(r + 2) - mass) for r in range(size)], model.unk_id()


class PieceCounter:
    """Counts tokens under a unigram vocabulary with byte fallback."""

    _shared: dict[str, PieceCounter] = {}

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (entry, score) in enumerate(vocabulary):
            self.automaton.add_word(entry, (len(entry), score, i == unknown))
        self.automaton.make_automaton()
        self.cost = min(s for _, s in vocabulary) - PENALTY
        entries = {e for e, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in entries for b in range(256))
        self.single, self.name = {e for e in entries if len(e) == 1}, vocabulary[unknown][0]
        self.known = HashCache(500_000, self.part)

    @classmethod
    def shared(cls, path: str) -> PieceCounter:
        if path not in cls._shared:
            cls._shared[path] = cls(*zipf_vocabulary(path))
        return cls._shared[path]

    def part(self, part: str) -> int:
        """Tokens of one part. The automaton gives the entries that end at a place longest first, and so by where they start."""
        if not self.single.issuperset(part) or self.name in part:
            return self._strange(part)
        score, count, last = [0.0] * (len(part) + 1), [0] * (len(part) + 1), -1
        for end, (length, s, _) in self.automaton.iter(part):
            start = end + 1 - length
            s += score[start]
            if end != last or s > score[end + 1]:
                last = end
                score[end + 1] = s
                count[end + 1] = count[start] + 1
        return count[-1]

    def _strange(self, part: str) -> int:
        """The same for a part with characters that have no entry."""
        n = len(part)
        score, count = [0.0] * (n + 1), [0] * (n + 1)  # best score so far, tokens before the run of unknown text
        run, alone = [0] * (n + 1), [False] * (n + 1)  # bytes of that run, and whether it is the unknown entry's own name
        found: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(part):
            found[end].append(match)
        for end in range(1, n + 1):
            best, start, unknown, single = None, 0, False, False
            for length, s, name in sorted(found[end - 1], reverse=True):
                single |= length == 1
                if best is None or s + score[end - length] > best:
                    best, start, unknown = s + score[end - length], end - length, name
            if not single and (best is None or self.cost + score[end - 1] > best):
                best, start, unknown = self.cost + score[end - 1], end - 1, True
            score[end] = best
            if unknown:
                count[end], run[end] = count[start], run[start] + len(part[start:end].encode("utf-8", "surrogatepass"))
                alone[end] = end - start > 1 and not run[start]
            else:
                count[end] = self._closed(count[start], run[start], alone[start]) + 1
        return self._closed(count[n], run[n], alone[n])

    def _closed(self, count: int, run: int, alone: bool) -> int:
        return count + (run if run and self.bytes and not alone else bool(run))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        parts = text.replace(SIGN, " ").split(" ")
        if not parts[0]:
            del parts[0]
        known = self.known
        return sum([known[SIGN + p] for p in parts])


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of whole texts. vocabulary: a SentencePiece file, the same place on every executor."""
    path = vocabulary or tokenizer_path("piece_bpe_32k.model")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.shared(path)
        for part in parts:
            counts = [counter.count(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(tidied(run), "doc_id long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of `documents`."""
    return count_tokens(table(spark, sf_dir, "documents"))
