"""Visually identical text with different characters (problem 1).

``canonical`` brings a text to one consistent form: compatibility decomposition, removal of default-ignorable
characters, look-alike letters mapped to one prototype, white space mapped to plain spaces (line ends stay line
ends), full case folding unless case is to be kept, and composition, repeated until nothing changes. It works on the distinct values
of each Arrow batch, so a value that fills a third of the rows is converted once per batch.

Look-alikes are letters of Cyrillic, Greek, Armenian, Cherokee, Coptic, Lisu, Deseret, the phonetic and small-capital letters of Latin, and the Arabic letters and digits that
have one shape in several code points; full-width, mathematical and other compatibility forms of any script are covered by the decomposition.

``hidden_phrases`` finds watched phrases that stand in a text as a reader sees them, at least once in other
characters. Phrases and texts are compared in the canonical form that keeps letter case; the phrases are searched by an
Aho-Corasick automaton, in blocks of bounded size. A phrase counts as hidden where the canonical form shows it more
often than the text itself holds it.

Cases: null gives null, an empty text an empty text; a text of default-ignorables alone becomes empty; converting a
canonical text again leaves it unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.arrow import map_batches, named

# The default-ignorable code points of Unicode (DerivedCoreProperties).
DEFAULT_IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Letters that look like a letter of another script, as a string of look-alikes for each prototype. In the order of the scripts above.
LOOK_ALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ",
    "K": "КΚᏦK", "L": "Ꮮ", "M": "МΜᎷϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ",
    "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "кκĸ", "l": "ӏ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγү",
    "ی": "يىﻱ", "ک": "كڪ", "ه": "ہەھ",
    "0": "٠۰", "-": "‐‑‒–⁃−˗﹘",
}
# Extended Arabic-Indic digits are the prototypes of the Arabic-Indic ones that look the same.
# Look-alikes in Coptic, Lisu and Deseret, and small capitals that have the shape of the small letter.
MORE_LOOK_ALIKES = {
    "A": "ꓮ", "B": "Ⲃꓐ", "C": "Ⲥꓚ𐐕", "D": "ꓓ", "E": "ꓰ", "F": "ꓝ", "G": "ꓖ", "H": "Ⲏꓧ", "I": "Ⲓꓲ", "J": "ꓙ", "K": "Ⲕꓗ", "L": "ꓡ𐐛", "M": "Ⲙꓟ", "N": "Ⲛꓠ", "O": "Ⲟꓳ𐐄",
    "P": "Ⲣꓑ", "R": "ꓣ", "S": "ꓢ𐐠", "T": "Ⲧꓔ", "U": "ꓴ", "V": "ꓦ", "W": "ꓪ", "X": "Ⲭꓫ", "Y": "Ⲩꓬ", "Z": "Ⲍꓜ",
    "c": "ⲥᴄ𐐽", "o": "ⲟᴏ𐐬", "p": "ⲣ", "s": "ꜱ𐑈", "u": "ᴜ", "v": "ᴠ", "w": "ᴡ", "x": "ⲭ", "z": "ᴢ",
}
_DIGITS = {0x0660 + d: chr(0x06F0 + d) for d in (0, 1, 2, 3, 7, 8, 9)}

_SPACES = {c: " " for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs"} | {0x09: " "}
_BREAKS = {0x0B: "\n", 0x0C: "\n", 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}


@cache
def _table() -> dict[int, str | None]:
    looks = {ord(c): p for known in (LOOK_ALIKES, MORE_LOOK_ALIKES) for p, cs in known.items() if p != "0" for c in cs}
    ignored = {c: None for a, b in DEFAULT_IGNORABLE for c in range(a, b + 1)}
    return looks | _DIGITS | _SPACES | _BREAKS | ignored


_line_ends = re.compile(r"\r\n?")
_space_runs = re.compile(r"  +")
_plain = re.compile(r"[^\x20-\x7e\n]").search


def _once(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text).translate(_table())
    return unicodedata.normalize("NFC", decomposed)


def canonical_text(text: str | None, fold_case: bool = True) -> str | None:
    """The consistent form of one text."""
    if text is None:
        return None
    if _plain(text):
        before, text = None, _line_ends.sub("\n", text)
        while before != text:  # letters whose look-alike appears only after composition or folding; two or three rounds
            before = text
            text = _once(text.casefold() if fold_case else text)
    elif fold_case:
        text = text.casefold()
    return _space_runs.sub(" ", text) if "  " in text else text


def canonical(df: DataFrame, id_col: str, text_col: str, fold_case: bool = True) -> DataFrame:
    """(id_col, canonical STRING) of every row."""

    def run(batches):
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            forms = pa.array([canonical_text(t, fold_case) for t in coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), forms.take(coded.indices)], ["id", "canonical"])

    return map_batches(named(df, id_col, text_col), run, "id bigint, canonical string").withColumnRenamed("id", id_col)


def _word_char(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] in "LMN" or kind == "Pc"


class PhraseFinder:
    """Searches texts for phrases as they look."""

    def __init__(self, phrases: list[tuple[int, str]]) -> None:
        self.automaton = ahocorasick.Automaton()
        by_form: dict[str, list[tuple[int, str]]] = {}
        for ref, phrase in phrases:
            form = canonical_text(phrase, fold_case=False).strip()
            if form:
                by_form.setdefault(form, []).append((ref, phrase))
        for form, refs in by_form.items():
            self.automaton.add_word(form, (len(form), refs))
        self.empty = not by_form
        if by_form:
            self.automaton.make_automaton()

    @staticmethod
    def _whole(text: str, start: int, end: int) -> bool:
        # characters that cannot be seen are no part of a word
        while start > 0 and _table().get(ord(text[start - 1]), "") is None:
            start -= 1
        while end < len(text) and _table().get(ord(text[end]), "") is None:
            end += 1
        return not (start > 0 and _word_char(text[start - 1])) and not (end < len(text) and _word_char(text[end]))

    def hidden(self, text: str | None) -> list[int]:
        """Ids of the phrases that the text shows at least once in other characters."""
        if not text or self.empty:
            return []
        form = canonical_text(text, fold_case=False)
        seen: dict[int, int] = {}
        exact: dict[int, str] = {}
        for last, (size, refs) in self.automaton.iter(form):
            if self._whole(form, last + 1 - size, last + 1):
                for ref, phrase in refs:
                    seen[ref] = seen.get(ref, 0) + 1
                    exact[ref] = phrase
        if not seen:
            return []
        return [ref for ref, n in seen.items() if n > self._exactly(text, exact[ref])]

    def _exactly(self, text: str, phrase: str) -> int:
        n, at = 0, text.find(phrase)
        while at >= 0:
            n += self._whole(text, at, at + len(phrase))
            at = text.find(phrase, at + 1)
        return n


MOST_PHRASES = 200_000  # phrases that one automaton holds


def hidden_phrases(df: DataFrame, id_col: str, text_col: str, phrases: DataFrame, ref_col: str = "ref_id", phrase_col: str = "phrase", block: int = MOST_PHRASES) -> DataFrame:
    """(record_id, ref_id) of every record that shows a phrase in other characters.

    Phrases are sent to the tasks in blocks of at most ``block``, so that what is sent is bounded; up to that many they take one pass over the texts.
    """
    ids = phrases.where(F.col(phrase_col).isNotNull()).select(F.col(ref_col).cast("bigint").alias("ref"), F.col(phrase_col).alias("phrase"))
    n_blocks = max(1, -(-ids.count() // block))
    out = None
    for k in range(n_blocks):
        part = ids.where(F.pmod(F.xxhash64("ref"), F.lit(n_blocks)) == k) if n_blocks > 1 else ids
        found = _hidden_of(df, id_col, text_col, [tuple(r) for r in part.collect()])
        out = found if out is None else out.unionByName(found)
    return out


def _hidden_of(df: DataFrame, id_col: str, text_col: str, phrases: list[tuple[int, str]]) -> DataFrame:
    def run(batches):
        finder = PhraseFinder(phrases)
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            refs = [finder.hidden(t) for t in coded.dictionary.to_pylist()]
            records, found = [], []
            for i, k in zip(batch.column(0).to_pylist(), coded.indices.to_pylist(), strict=True):
                if k is not None and refs[k]:
                    records += [i] * len(refs[k])
                    found += refs[k]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.int64()), pa.array(found, pa.int64())], ["record_id", "ref_id"])

    return map_batches(named(df, id_col, text_col), run, "record_id bigint, ref_id bigint")
