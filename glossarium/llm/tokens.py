"""Token ids of whole texts by a word-BPE vocabulary file of the `tokenizers` library.

The vocabulary drops white space and never forms a token across it, so a text's ids are those of its blank-separated
chunks in order, and a chunk's are those of its words. Words repeat far more than texts do: Arrow's kernels cut a batch into words and number
its distinct ones, each new word is encoded once by the library's model and kept in tables of bounded size, and the ids of the batch are
gathered from there. Words of lower-case Latin letters and the marks behind them are cut by Arrow, other chunks of Latin letters by the pattern
below, and all others go through the library's own normaliser and splitter.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and chunks that are kept, and the longest of them.
KEEP, LONGEST = 250_000, 48
#: The vocabulary's own rule for words, as it is for lower-case text within the range of LATIN.
LATIN = re.compile(r"[\x21-ɏ]+")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµº²³¹¼½¾ß-öø-ɏ]+")
#: Letters that lowering and composing leave as they are; a word of them; marks between such a letter and a blank, which are words of their own.
LETTERS = "a-zß-öø-ÿ"
ONE_WORD = f"^[{LETTERS}]+$"
MARKS_BEHIND = rf"([{LETTERS}])([!-&(-/:-@\[-`{{-~]+)(\s|$)"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """Keys and their ids, laid end to end."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.ends = np.zeros(1 << 16, np.int64)  # entry i lies between ends[i] and ends[i + 1]
        self.entries = 0

    def add(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """keys' ids are slices of ids that end at ends."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.entries + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.entries + 1 : self.entries + 1 + len(keys)] = self.used + np.asarray(ends, np.int64)
        self.at.update(zip(keys, range(self.entries, self.entries + len(keys))))
        self.entries += len(keys)
        self.used += len(ids)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries that are asked for, end to end, and how many each has."""
        starts = self.ends[which]
        sizes = self.ends[which + 1] - starts
        ends = np.cumsum(sizes)
        shift = np.repeat(starts - (ends - sizes), sizes)
        return self.ids[shift + np.arange(len(shift))], sizes


class WordPieces:
    """text -> ids as bytes of little-endian unsigned 32-bit numbers."""

    _shared: dict[str, WordPieces] = {}

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.keep, self.known, self.older = keep, Table(), Table()

    @classmethod
    def shared(cls, path: str) -> WordPieces:
        """One for each worker process and file: its words stay known from task to task."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; ASCII white space separates chunks."""
        array = pa.array(texts, pa.large_string())
        if not pc.any(pc.match_substring(array, "<|")).as_py():  # special tokens are read before letters are lowered
            array = pc.replace_substring_regex(pc.ascii_lower(array), MARKS_BEHIND, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(array)
        numbered = lists.flatten().dictionary_encode()
        if self.known.entries > self.keep or self.known.used > 32 * self.keep:
            self.known, self.older = Table(), self.known  # what is used again comes back from there
        distinct = numbered.dictionary.to_pylist()
        at = self.known.at
        new = [w for w in distinct if w not in at]
        self._learn(new)
        which = np.fromiter(map(at.__getitem__, distinct), np.int64, len(distinct))
        for w in new:
            if len(w) > LONGEST:
                del at[w]
        ids, sizes = self.known.gather(which[numbered.indices.to_numpy()] if len(distinct) else which)
        ends = np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()] * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _learn(self, new: list[str]) -> None:
        """Puts chunks that aren't known into the table."""
        old = self.older.at
        if again := [w for w in new if w in old]:
            ids, sizes = self.older.gather(np.fromiter(map(old.__getitem__, again), np.int64, len(again)))
            self.known.add(again, ids, np.cumsum(sizes))
            new = [w for w in new if w not in old]
        if not new:
            return
        array = pa.array(new, pa.large_string())
        one = pc.match_substring_regex(array, ONE_WORD)
        self._learn_words(array.filter(one).to_pylist())
        plain, parts, strange = [], [], []
        for w in array.filter(pc.invert(one)).to_pylist():
            if len(w) <= LONGEST and LATIN.fullmatch(w) and "<|" not in w:
                plain.append(w)
                parts.append(WORDS.findall((w if w.isascii() else unicodedata.normalize("NFC", w)).lower()))
            else:
                strange.append(w)
        at, flat = self.known.at, [p for some in parts for p in some]
        self._learn_words([p for p in dict.fromkeys(flat) if p not in at])
        ids, sizes = self.known.gather(np.array([at[p] for p in flat], np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(some) for some in parts], dtype=np.int64)]
        self.known.add(plain, ids, ends)
        for w, e in zip(strange, self.tokenizer.encode_batch_fast(strange, add_special_tokens=False)):
            self.known.add([w], np.array(e.ids, "<u4"), np.array([len(e.ids)]))

    def _learn_words(self, words: list[str]) -> None:
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            self.known.add(some, ids, ends)
