"""Quality rules: plain text rules and tokeniser fertility.

Words are runs of anything but ASCII white space.  The base rules count words,
symbols, repeated lines and repeated three-word windows.  Fertility asks public
vocabularies how well a text fits them:

* chars_per_token: letters and digits per token of a byte-level BPE;
* fallback_share: share of byte tokens under a BPE with byte fallback;
* token_entropy: bits per token of the text's own token distribution, over
  its largest possible value for so many tokens (1: all tokens differ).

A text is rejected when a measure lies outside the band of its stated language,
or where that has none, of its script (the script of most of its words).
Bands are parameters; the defaults for Latin, Greek and Cyrillic come from prose and junk
of the sf0.1 table, those of the other scripts from short prose samples and made-up junk
(tests/llm/test_quality_bands.py); all remaining scripts share OTHER.  They don't depend on the rest of the corpus, so one pass over the rows
suffices, nothing is shuffled, and a hot source or group changes nothing.

Null or empty texts have no words and fail the base rules; a null language means
the script's band.  Repeated rows are each judged alone.  Columns other than those
named are not read.
"""

from __future__ import annotations

import unicodedata
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import load_ranks
from .common import kept, map_batches, map_rows

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: unicodedata names begin with the script; others count as "other".
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARABIC", "HEBREW", "DEVANAGARI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK")


@dataclass(frozen=True)
class Band:
    """Allowed range of each measure, ends included."""
    chars_per_token: tuple[float, float] = (0.2, 12.0)
    fallback_share: tuple[float, float] = (0.0, 1.0)
    token_entropy: tuple[float, float] = (0.35, 1.0)


BANDS = {
    "de": Band((2.0, 8.0), (0.0, 0.15)),
    "en": Band((1.85, 8.0), (0.0, 0.15)),
    "es": Band((1.79, 8.0), (0.0, 0.15)),
    "fr": Band((1.7, 8.0), (0.0, 0.15)),
    "LATIN": Band((1.6, 8.0), (0.0, 0.15)),
    "GREEK": Band((0.5, 8.0), (0.0, 0.6)),
    "CYRILLIC": Band((0.5, 8.0), (0.0, 0.3)),
    # between prose and random letters or mojibake; marks are no letters, so scripts with vowel signs get less a token
    "ARABIC": Band((0.7, 8.0), (0.0, 0.3), (0.3, 1.0)),
    "HEBREW": Band((0.7, 8.0), (0.0, 0.3), (0.3, 1.0)),
    "DEVANAGARI": Band((0.2, 8.0), (0.0, 0.35), (0.25, 1.0)),
    "HANGUL": Band((0.6, 8.0), (0.0, 0.4), (0.3, 1.0)),
    "HIRAGANA": Band((0.5, 8.0), (0.0, 0.35), (0.25, 1.0)),
    "KATAKANA": Band((0.5, 8.0), (0.0, 0.2), (0.25, 1.0)),
    "CJK": Band((0.5, 8.0), (0.0, 0.4), (0.3, 1.0)),
    "OTHER": Band((0.15, 8.0), (0.0, 0.6), (0.15, 1.0)),  # also rejects scripts that the vocabulary has no pieces for
    "NONE": Band((1.2, 8.0), (0.0, 0.15)),  # no letters at all
}


class Fertility:
    """Per-word measures under both vocabularies, kept once per Python worker."""

    def __init__(self, ranks_path: str, pieces_path: str, pattern: str, limit: int = 200_000):
        import sentencepiece
        import tiktoken
        ranks = load_ranks(ranks_path)
        self.bpe = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.byte_ids = frozenset(i for i in range(self.pieces.get_piece_size()) if self.pieces.is_byte(i))
        self.limit = limit
        self.seen: dict[bytes, tuple] = {}

    @classmethod
    def of(cls, *key: str) -> Fertility:
        return kept((cls, *key), lambda: cls(*key))

    def word(self, word: bytes) -> tuple[bytes, int, int, str]:
        """(packed BPE ids, letters and digits, pieces, byte pieces, script) of a word after a space."""
        text = word.decode()
        ids = array("I", self.bpe.encode_ordinary(" " + text)).tobytes()
        got = self.pieces.encode(text)
        script = next((_script(c) for c in text if c.isalpha()), "NONE")
        out = ids, sum(map(str.isalnum, text)), len(got), 0 if self.byte_ids.isdisjoint(got) else sum(map(self.byte_ids.__contains__, got)), script
        if len(word) <= 64:
            if len(self.seen) >= self.limit:
                self.seen.clear()
            self.seen[word] = out
        return out

    def measure(self, words: list[bytes]) -> tuple[float, float, float, str]:
        seen, word = self.seen, self.word
        ids, chars, n, low, scripts = [], 0, 0, 0, {}
        for w in words:
            a, k, b, c, s = seen.get(w) or word(w)
            ids.append(a)
            chars += k
            n += b
            low += c
            scripts[s] = scripts.get(s, 0) + 1
        tokens = np.frombuffer(b"".join(ids), "<u4")
        if not len(tokens):
            return 0.0, 0.0, 0.0, "NONE"
        counts = np.bincount(tokens)
        p = counts[counts > 0] / len(tokens)
        bits = float(-(p * np.log2(p)).sum())
        letters = {s: k for s, k in scripts.items() if s != "NONE"} or scripts
        return (chars / len(tokens), low / n if n else 0.0,
                min(1.0, bits / float(np.log2(len(tokens)))) if len(tokens) > 1 else 0.0,
                max(letters, key=lambda s: (letters[s], s)))


_script_of: dict[str, str] = {}


def _script(c: str) -> str:
    got = _script_of.get(c)
    if got is None:
        name = unicodedata.name(c, "").split(" ")[0]
        got = _script_of[c] = name if name in SCRIPTS else "OTHER"
    return got


def base_counts(text: str | None) -> tuple[list[bytes], int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if not text:
        return [], 0, 0, 0, 0
    words = text.encode().split()  # splits at ASCII white space only
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return words, chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    pairs = ids[:-2] * m + ids[1:-1]
    if m < 1 << 20:
        keys = pairs * m + ids[2:]
    else:  # three ids don't fit one integer: name the pairs first
        keys = np.unique(pairs, return_inverse=True)[1] * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def base_fails(n_words: int, n_repeat: int, min_words: int = 50, max_repeat_pct: int = 50) -> bool:
    return n_words < min_words or 100 * n_repeat > max_repeat_pct * n_words


def in_band(measures: tuple[float, float, float, str], lang: str | None, bands: dict[str, Band]) -> bool:
    band = bands.get(lang) or bands.get(measures[3]) or Band()
    return all(lo <= x <= hi for x, (lo, hi) in zip(
        measures, (band.chars_per_token, band.fallback_share, band.token_entropy)))


#: columns of ``judge`` after the id
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
          ("chars_per_token", pa.float64()), ("fallback_share", pa.float64()), ("token_entropy", pa.float64()),
          ("script", pa.string())]


def verdict(text: str | None, lang: str | None, fertility: Fertility, bands: dict[str, Band]) -> tuple:
    words, chars, symbols, dup, repeat = base_counts(text)
    failed = base_fails(len(words), repeat)
    m = fertility.measure(words)
    return len(words), chars, symbols, dup, repeat, failed, not failed and in_band(m, lang, bands), *m


def judge(df: DataFrame, id_col: str, text_col: str, lang_col: str, ranks_path: str, pieces_path: str, pattern: str,
          bands: dict[str, Band] | None = None) -> DataFrame:
    """One row per document: its counts, measures and verdict."""
    bands = BANDS if bands is None else bands

    def run(rows):
        f = Fertility.of(ranks_path, pieces_path, pattern)
        for i, text, lang in rows:
            yield i, *verdict(text, lang, f, bands)

    return map_rows(df.select(id_col, text_col, lang_col), run, pa.schema([(id_col, pa.int64()), *FIELDS]))


def keep(df: DataFrame, text_col: str, lang_col: str, ranks_path: str, pieces_path: str, pattern: str,
         bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows whose text passes, all their columns unchanged."""
    bands = BANDS if bands is None else bands
    at, lang = df.columns.index(text_col), df.columns.index(lang_col)

    def run(it):
        f = Fertility.of(ranks_path, pieces_path, pattern)
        for b in it:
            yield b.filter(pa.array(
                [verdict(t, x, f, bands)[6] for t, x in zip(b.column(at).to_pylist(), b.column(lang).to_pylist())],
                pa.bool_()))

    return map_batches(df, run, df.schema)
