"""Text functions: columns of built-in expressions; Arrow functions where Unicode forms or order matter."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters without width, and punctuation with its plain form.
NO_WIDTH = "​‌‍‎‏⁠﻿­"
PLAIN = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "―": "-", "−": "-", "…": "...", "´": "'", "`": "'", "•": "-", "·": "."}
#: Full-width punctuation for speech synthesis.
SPEECH = {"：": ",", "；": ",", "，": ",", "。": ".", "！": "!", "？": "?", "\n": " ", "、": ",", "（": "'", "）": "'", "《": "'", "》": "'", "【": "'", "】": "'", "「": "'", "」": "'", "～": "-"}
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition."""
    import unicodedata as u

    return text.map(lambda t: None if t is None else u.normalize("NFKC", t))


def ascii_only(text: str | Column) -> Column:
    """Zero-width characters go, curly punctuation becomes plain, all else beyond ASCII goes (F1, without the composition before it)."""
    t = F.translate(_col(text), NO_WIDTH, "")
    for a, b in PLAIN.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[^\x00-\x7F]", "")


def sanitised(text: str | Column) -> Column:
    """composition, then ascii_only."""
    return ascii_only(nfkc(_col(text)))


def mark_normalised(text: str | Column) -> Column:
    """Lowered and trimmed, with letters, digits and apostrophes only (F2)."""
    return F.regexp_replace(F.lower(F.trim(_col(text))), r"[^\p{L}\p{N}']", "")


def tokens(text: str | Column) -> Column:
    """Lowered runs of ASCII letters, digits and apostrophes."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit("([A-Za-z0-9']+)"), 1), F.lower)


def words(text: str | Column) -> Column:
    return F.filter(F.split(_col(text), r"[ \n\t\r\f\x0b]+"), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    """Parts between white space."""
    return F.size(words(text))


def cutoffs_named(text: str | Column, mark: str = "<cutoff>") -> Column:
    """A mark before a word becomes a mark of that word."""
    return F.regexp_replace(_col(text), re.escape(mark) + r"\s+([^\s<]+)", f"{mark[:-1]}-$1> $1")


def cutoffs_plain(text: str | Column) -> Column:
    """Marks of words stripped again."""
    return F.regexp_replace(_col(text), r"<cutoff-[^>]*>", "<cutoff>")


def speech_text(text: str | Column) -> Column:
    """Full-width punctuation as plain (F10; numbers and contractions are left as they are)."""
    t = _col(text)
    for a, b in SPEECH.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def cjk_tokens(text: str | Column) -> Column:
    """Each CJK character alone, other runs as they are, upper case."""
    spaced = F.regexp_replace(_col(text), f"({CJK})", " $1 ")
    return F.upper(F.array_join(words(spaced), " "))


def cjk_joined(text: str | Column) -> Column:
    """The blanks around CJK characters taken out again."""
    return F.regexp_replace(F.regexp_replace(_col(text), f"(?<={CJK})\\s+", ""), f"\\s+(?={CJK})", "")


def is_chinese(text: str | Column, share: float = 0.3) -> Column:
    """More than a share of the length is CJK."""
    t = _col(text)
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"[^\x{4e00}-\x{9fff}]", "")), F.length(t)) > share, F.lit(False))


def syllables(text: str | Column) -> Column:
    """One for each CJK character or digit, else groups of vowels of words, a silent final e apart."""
    t = F.lower(_col(text))
    vowels = F.size(F.regexp_extract_all(F.regexp_replace(t, r"(?<=[a-z]{2})e\b", ""), F.lit("([aeiouy]+)"), 1))
    return F.size(F.regexp_extract_all(t, F.lit(r"([0-9\x{4e00}-\x{9fff}])"), 1)) + vowels


def without_position(label: str | Column) -> Column:
    """Suffixes _B, _S, _E and _I taken off."""
    return F.regexp_replace(_col(label), r"_[BSEI]\b", "")


def position(label: str | Column) -> Column:
    """What follows the last underscore."""
    return F.regexp_extract(_col(label), r"_([^_]*)$", 1)


def known_graphemes(word: str | Column, known: Sequence[str]) -> tuple[Column, Column]:
    """The known characters of a word, and the distinct others."""
    chars = F.filter(F.split(_col(word), ""), lambda c: c != "")
    return F.array_join(F.filter(chars, lambda c: c.isin(list(known))), ""), F.array_sort(F.array_distinct(F.filter(chars, lambda c: ~c.isin(list(known)))))


def stem(path: str | Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(_col(path), "/"), -1), r".(\.[^.]*)$", 1))


def relative(path: str | Column, root: str | Column) -> Column:
    p, r = _col(path), F.rtrim(_col(root), F.lit("/"))
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2)).otherwise(p)


def char_class(chars: Iterable[str]) -> str:
    """A pattern's class of the characters."""
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


class Sanitizer:
    """Splits a text into words: brackets stay whole, punctuation at the ends and word breaks go, clitic marks stay."""

    def __init__(self, punctuation: str = ".,;:!?¿¡\"()[]{}<>«»“”", clitics: str = "'’", compounds: str = "-/", brackets: Sequence[tuple[str, str]] = (("[", "]"), ("<", ">"), ("{", "}"), ("(", ")"))):
        self.bracketed = re.compile("|".join(re.escape(a) + "[^" + re.escape(a + b) + "]*" + re.escape(b) for a, b in brackets))
        self.ends, self.clitics, self.compounds = punctuation, clitics, compounds

    def __call__(self, text: str) -> list[str]:
        out, at = [], 0
        text = unicodedata.normalize("NFKC", text)
        for m in [*self.bracketed.finditer(text), None]:
            for w in (text[at : m.start()] if m else text[at:]).split():
                w = w.replace("İ", "i̇").lower().strip(self.ends + self.compounds)
                for c in self.clitics[1:]:
                    w = w.replace(c, self.clitics[0])
                if w.strip(self.clitics[0]):
                    out.append(w)
            if m:
                out.append(m[0].lower())
                at = m.end()
        return out


class Splitter:
    """Splits compounds and clitics of unknown words where that makes known parts."""

    def __init__(self, vocabulary: Iterable[str], initial: Iterable[str] = (), final: Iterable[str] = (), compounds: str = "-/", clitic: str = "'"):
        self.known, self.initial, self.final, self.compounds, self.clitic = set(vocabulary), sorted(initial, key=len, reverse=True), sorted(final, key=len, reverse=True), compounds, clitic

    def __call__(self, word: str) -> list[str]:
        if word in self.known or word[:1] in "[<{(":
            return [word]
        parts = [p for p in re.split("[" + re.escape(self.compounds) + "]", word) if p] or [word]
        out: list[str] = []
        for p in parts:
            out += self._clitics(p)
        return out if any(p in self.known for p in out) else [word]

    def _clitics(self, word: str) -> list[str]:
        if word in self.known:
            return [word]
        front, back = [], []
        for c in self.initial:
            if word.startswith(c) and len(word) > len(c):
                front, word = [c], word[len(c) :]
                break
        for c in self.final:
            if word.endswith(c) and len(word) > len(c) and word not in self.known:
                back, word = [c], word[: -len(c)]
                break
        return [*front, word, *back]


def tokenizer(sanitizer: Sanitizer, splitter: Splitter | None = None, clitic: str = "'"):
    """An Arrow function text -> (normalized, characters, oovs): words, their characters with <space> between words, and the words that are unknown."""
    schema = "normalized string, characters string, oovs array<string>"

    @F.pandas_udf(schema)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            out = [p for w in sanitizer(t or "") for p in (splitter(w) if splitter else [w])]
            chars = []
            for k, w in enumerate(out):
                seam = k and (out[k - 1].endswith(clitic) or w.startswith(clitic))
                chars += (["<space>"] if k and not seam else []) + list(w)
            oovs = sorted({w for w in out if splitter and w not in splitter.known and w[:1] not in "[<{("})
            rows.append((" ".join(out), " ".join(chars), oovs))
        return pd.DataFrame(rows, columns=["normalized", "characters", "oovs"])

    return run


def packed_sentences(text: str, budget: int, size=lambda s: len(s.split())) -> list[str]:
    """Pieces of at most `budget` by their size: cut after sentence ends, then at commas, then at hyphens, then hard; small neighbours are joined."""

    def cut(s: str, level: int) -> list[str]:
        if size(s) <= budget or not s:
            return [s] if s else []
        if level == 3:
            w = s.split()
            return [" ".join(w[i : i + budget]) for i in range(0, len(w), budget)] if len(w) > 1 else [s[i : i + budget] for i in range(0, len(s), budget)]
        parts = [p.strip() for p in re.split((r"(?<=[.!?。！？])\s*", r"(?<=[,，、])\s*", r"(?<=-)")[level], s)]
        return [x for p in parts for x in cut(p, level + 1)]

    out: list[str] = []
    for p in cut(text.strip(), 0):
        if out and size(out[-1] + " " + p) <= budget:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def sentence_packer(budget: int):
    """packed_sentences as an Arrow function to array<string>."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: packed_sentences(t or "", budget))

    return run
