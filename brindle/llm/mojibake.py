"""Garbled text from a wrong character encoding (problem 10).

1. Every distinct text throws its distinct adjacent character pairs and characters into a table of fixed size; the table gives in what
   share of all texts a pair and its two characters occur. Stretches beyond ASCII that decode to plausible UTF-8 are left out, so that however
   frequent they are they do not vouch for themselves. The score of a pair is its pointwise mutual
   information over records, with the characters' shares floored: without the floor, characters that occur only in garbled
   records would vouch for each other.
2. In each record with a character beyond ASCII improbable pairs score positive and probable ones negative, and maximum-scoring segments isolate the
   improbable runs; stretches that decode to plausible UTF-8 are runs, too, whatever their score. Replacement characters, and question marks that
   stand where words should be, are what an encoding without the letters leaves: found but not restorable.
3. Inverse mappings are tested inside those runs only, whatever their length: encode with the wrong encoding, decode with the right one. A mapping holds
   if the restored run, read with its neighbours, is more probable by a margin; mappings are repeated for text that was garbled more than
   once. A reading by single bytes, which fits anything, must also find the run's pairs among the rarest of the corpus and save further bits. A mapping into UTF-8
   that holds in one place is tried on the record's other stretches, too. Bytes that no longer make sense leave the run as it is.

Cases: null and empty texts are never marked, ASCII texts only for lost words; every text is whole, without a limit on length; an
empty table gives no rows.
"""

from __future__ import annotations

import codecs
import functools
import operator
import re
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.arrow import map_batches, named

CELLS = 1 << 22  # pair cells of the table; characters have a cell each behind them
_CHARS = 0x110000

# Names of the encodings that text is commonly read in by mistake, and of those it was written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "koi8-r", "mac-roman", "mac-cyrillic", "cp437", "cp850", "cp866", "iso8859-5", "iso8859-6")
WRITTEN_AS = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "cp1256", "iso8859-5", "iso8859-6", "mac-roman", "mac-cyrillic", "cp850", "cp437")


def _cells(codes: np.ndarray) -> np.ndarray:
    """Table cells of the adjacent pairs of a text's code points."""
    a, b = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    x = (a << np.uint64(21)) ^ b
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(42)).astype(np.int64)


# Arabic yeh and kaf count as their Persian forms, for which the Arabic code pages have no place.
_FOLD = {0x064A: 0x06CC, 0x0643: 0x06A9}
_folded = re.compile("[\u064a\u0643]").search


def _codes(text: str) -> np.ndarray:
    if _folded(text):
        text = text.translate(_FOLD)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pair_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(cell, n): in how many distinct texts each pair cell and each character (behind the pair cells) occurs, outside suspect stretches."""

    def run(batches):
        suspects = Suspects()
        counts = np.zeros(CELLS + _CHARS, dtype=np.int32)
        records = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    codes = _codes(f" {text} ")
                    cells = _cells(codes)
                    if not text.isascii() and (found := suspects.of(text)):
                        outside = np.ones(len(codes), dtype=bool)
                        for start, end in found:
                            outside[start + 1 : end + 1] = False
                        cells, codes = cells[outside[:-1] & outside[1:]], codes[outside]
                    counts[np.unique(cells)] += 1
                    counts[CELLS + np.unique(codes).astype(np.int64)] += 1
                    records += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], records).astype(np.int64))], ["cell", "n"])

    texts = df.select(F.col(f"`{text_col}`").alias("text")).where("text <> ''").distinct()
    return map_batches(texts, run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


class PairModel:
    """Scores of adjacent pairs; of fixed size whatever the corpus."""

    FLOOR = 2.0**-3  # share of records below which a character's share is not taken lower
    UNSEEN = 0.25  # count of a pair that no record has

    RARE = 0.008  # the rarest pairs, those that together make up this part of all occurrences by text, are rare ones

    def __init__(self, cells: np.ndarray, counts: np.ndarray) -> None:
        # shares in eighths of a bit below 1 (a byte each)
        total = max(1, int(counts[cells < 0].sum()))
        level = np.full(CELLS + _CHARS, self._level(self.UNSEEN / total), dtype=np.uint8)
        kept = cells >= 0
        level[cells[kept]] = np.minimum(255, np.round(-8 * np.log2(counts[kept] / total))).astype(np.uint8)
        self.levels = level
        pairs = np.sort(counts[(cells >= 0) & (cells < CELLS)])
        at = np.searchsorted(np.cumsum(pairs), self.RARE * pairs.sum())
        self.rare = self._level(pairs[at] / total) / 8 if len(pairs) else 0.0  # bits of the most frequent rare pair
        self._costs = _Costs(level)

    @staticmethod
    def _level(share: float) -> int:
        return int(min(255, round(-8 * np.log2(share))))

    def information(self, codes: np.ndarray) -> np.ndarray:
        """Floored pointwise mutual information of each adjacent pair, in bits."""
        floor = -8 * np.log2(self.FLOOR)
        single = np.minimum(self.levels[CELLS + codes.astype(np.int64)], floor)
        return (single[:-1] + single[1:] - self.levels[_cells(codes)].astype(np.float64)) / 8

    def cost(self, text: str) -> float:
        """Bits that it takes to meet all adjacent pairs of a text: the sum of -log2 of their shares of records."""
        if _folded(text):
            text = text.translate(_FOLD)
        if len(self._costs) > self._costs.MEMORY:
            self._costs.clear()
        return sum(map(self._costs.__getitem__, map(operator.add, text, text[1:]))) / 8


class _Costs(dict):
    """Level of a pair of characters, looked up once."""

    MEMORY = 1 << 18

    def __init__(self, levels: np.ndarray) -> None:
        super().__init__()
        self.levels = levels

    def __missing__(self, pair: str) -> int:
        self[pair] = level = int(self.levels[_cells(np.array([ord(pair[0]), ord(pair[1])], dtype=np.uint32))[0]])
        return level


def improbable_runs(information: np.ndarray, expected: float = -1.0, least: float = 1.0, drop: float = 6.0, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Maximum-scoring segments [start, end) of pairs, a pair scoring ``expected`` minus its information.

    A segment ends where the score has fallen by ``drop`` below its height or to nothing, and counts if its height is at least ``least``. Of the
    segments only those near an ``asked`` pair are given, if some are.
    """
    sums = np.concatenate([[0.0], np.cumsum(expected - information)])
    gained = sums - np.minimum.accumulate(sums)
    zeros = np.flatnonzero(gained == 0)
    peaks = np.maximum.reduceat(gained, zeros)
    ends = np.append(zeros[1:], len(gained))
    tall = peaks >= least
    if asked is not None:
        before = np.concatenate([[0], np.cumsum(asked), [asked.sum()]])
        tall &= before[ends] > before[zeros]
    runs: list[tuple[int, int]] = []
    for k in np.flatnonzero(tall).tolist():
        start = int(zeros[k])
        part = gained[start : ends[k]].tolist()
        low = high = part[0]
        first = top = 0
        for j, value in enumerate(part):
            if value > high:
                high, top = value, j
            elif value <= low or value < high - drop:
                if high - low >= least:
                    runs.append((start + first, start + top))
                low = high = value
                first = top = j
        if high - low >= least:
            runs.append((start + first, start + top))
    return runs


_pair_of_stretch = re.compile(r"[^\x00-\x7f]{2,}")


@cache
def _tables() -> list[tuple[str, object]]:
    """For each encoding that text is read in its encoding map; bytes that it leaves undefined stand for themselves."""
    out = []
    for name in READ_AS:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        out.append((name, codecs.charmap_build("".join(chars))))
    return out


class _Readable(dict):
    """For each character the encodings that have it, as bits in the order of READ_AS."""

    def __missing__(self, char: str) -> int:
        self[char] = bits = sum(1 << i for i, (_, table) in enumerate(_tables()) if _encode(char, table) is not None)
        return bits


_readable_in = _Readable()


def _encode(text: str, table: object) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", table)[0]
    except UnicodeEncodeError:
        return None


def _inverses(run: str, by_bytes: bool) -> list[tuple[str, str, str]]:
    """(read as, written as, text) of every mapping that the run's characters allow and that changes it."""
    out, seen = [], {run}
    if not by_bytes and not _pair_of_stretch.search(run):  # a byte above 127 alone is no UTF-8
        return out
    usable = functools.reduce(operator.and_, map(_readable_in.__getitem__, set(run)), -1)
    for i, (wrong, table) in enumerate(_tables() if usable else ()):
        if not usable >> i & 1:
            continue
        raw = _encode(run, table)
        if raw is None or raw.isascii():
            continue
        for right in WRITTEN_AS if by_bytes else WRITTEN_AS[:1]:
            if right == wrong:
                continue
            try:
                text = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if text not in seen:
                seen.add(text)
                out.append((wrong, right, text))
    return out


class Suspects:
    """Stretches beyond ASCII that decode to plausible UTF-8 from an encoding that text is read in by mistake; no share of records enters.

    A single character is plausible as Latin, Cyrillic, Greek, Arabic or common punctuation, and several of any script. Words of single-byte
    alphabets and box drawings can be valid UTF-8 by chance: letters alone that give one character, and signs alone that give Latin
    letters and touch none, are not suspect.
    """

    MEMORY = 1 << 16

    def __init__(self) -> None:
        self._known: dict[tuple[str, bool, bool], bool] = {}
        self._never: set[str] = set()  # stretches that decode to nothing

    def of(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the suspect stretches of a text."""
        out = []
        for m in _pair_of_stretch.finditer(text):
            if m[0] in self._never:
                continue
            start, end = m.span()
            key = (m[0], start > 0 and text[start - 1].isalpha(), end < len(text) and text[end].isalpha())
            if key not in self._known:
                if len(self._known) > self.MEMORY:
                    self._known.clear()
                if not _inverses(m[0], False):
                    if len(self._never) > self.MEMORY:
                        self._never.clear()
                    self._never.add(m[0])
                    continue
                self._known[key] = self._suspect(*key)
            if self._known[key]:
                out.append((start, end))
        return out

    def _suspect(self, stretch: str, after_letter: bool, before_letter: bool) -> bool:
        letters = [c.isalpha() for c in stretch]
        for _, _, text in _inverses(stretch, False):
            if _control.search(text):
                if self._suspect(text, after_letter, before_letter):  # garbled more than once
                    return True
                continue
            latin = all(ord(c) < 0x250 for c in text)
            if len(text) > 1:
                if any(map(str.isalpha, text)) and (any(letters) or after_letter or before_letter or not latin):
                    return True
            elif not all(letters) and self._plausible(text, before_letter) and (letters[0] or (text.isalpha() and (after_letter or before_letter or not latin))):
                return True
        return False

    @staticmethod
    def _plausible(char: str, before_letter: bool) -> bool:
        code = ord(char)
        if 0x100 <= code < 0x180:  # a capital and a closing quotation mark look the same at the end of a word
            return before_letter
        return 0xA0 <= code < 0x100 or 0x386 <= code < 0x3CF or 0x400 <= code < 0x460 or 0x60C <= code < 0x6D0 or 0x2010 <= code < 0x203B or code in (0x20AC, 0x2122)


@cache
def _table_of() -> dict[str, object]:
    return dict(_tables())


def _undone(run: str, path: tuple[tuple[str, str], ...]) -> str | None:
    """The run after a known sequence of mappings, or None where it does not allow them."""
    for wrong, right in path:
        raw = _encode(run, _table_of()[wrong])
        try:
            run = raw.decode(right) if raw is not None else ""
        except UnicodeDecodeError:
            return None
        if not run:
            return None
    return run


_control = re.compile("[\x7f-\x9f]")
# a replacement character; words of question marks side by side, or one that is longer than emphasis
_lost = re.compile(r"\ufffd|(?<![^\s\"«(\[])\?{2,}(?:[.,;:!)\]\"»]*\s+\S*?(?<![^\s\"«(\[])\?{2,}|\?{3,})(?![^\W_])")
_beyond = re.compile(r"[^\x00-\x7f]")
_stretch = re.compile(r"[^\x00-\x7f]+")


Path = tuple[tuple[str, str], ...]  # mappings (read as, written as) in the order in which they are undone


class Repairer:
    """Finds and restores garbled runs of texts under a pair model."""

    MARGIN = 2.0  # bits that each character beyond ASCII of a garbled run must save by being restored
    SHORT = 12.0  # further bits, shared by them, that a reading by single bytes must save
    MEMORY = 1 << 17

    def __init__(self, model: PairModel) -> None:
        self.model = model
        self._known: dict[tuple[str, str, str], tuple[str, tuple[Path, ...]] | None] = {}
        self._suspects = Suspects()

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Improbable runs of a text as character ranges, with at least one character beyond ASCII in each."""
        codes = _codes(f" {text} ")
        beyond = codes > 127
        found = improbable_runs(self.model.information(codes), asked=beyond[:-1] | beyond[1:])
        out: list[tuple[int, int]] = []
        for a, b in found:
            # pair i joins the characters i - 1 and i of the text; a run takes in whole stretches beyond ASCII
            start, end = max(0, a - 1), min(len(text), b + 1)
            while start > 0 and ord(text[start - 1]) > 127:
                start -= 1
            while end < len(text) and ord(text[end]) > 127:
                end += 1
            while start < end and ord(text[start]) < 128:
                start += 1
            while end > start and ord(text[end - 1]) < 128:
                end -= 1
            if start >= end:
                continue
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        # a run takes in whole stretches, so a suspect one lies in a run or apart from all
        starts = [start for start, _ in out]
        apart = [(a, b) for a, b in self._suspects.of(text) if not (k := bisect_right(starts, a)) or out[k - 1][1] <= a]
        return sorted(out + apart)

    def restored(self, run: str, before: str = " ", after: str = " ") -> tuple[str, tuple[Path, ...]] | None:
        """The run as it was written and the mappings used, or None where no mapping makes it more probable."""
        key = (before, run, after)
        if key not in self._known:
            if len(self._known) > self.MEMORY:
                self._known.clear()
            whole = self._best(before, run, after)
            found = (whole[0], (whole[1],)) if whole else self._by_stretches(before, run, after)
            if whole and any(right != "utf-8" for _, right in whole[1]) and self._suspects.of(run):
                # suspect stretches are rare by construction, so that single bytes may seem right for a run that is garbled in part
                other = self._by_stretches(before, run, after)
                if other and self.model.cost(before + other[0] + after) < self.model.cost(before + whole[0] + after):
                    found = other
            self._known[key] = found
        return self._known[key]

    def _best(self, before: str, run: str, after: str) -> tuple[str, Path] | None:
        text, path = run, ()
        for _ in range(3):
            n = len(_beyond.findall(text))
            if not n or text.isspace():  # white space of any width is no sign of anything
                break
            own = self.model.cost(before + text + after)
            # improbable throughout, not only at one place
            by_bytes = own >= self.model.rare * (len(text) + 1)
            saved = [((own - self.model.cost(before + t + after) - (right != "utf-8") * self.SHORT - (_control.search(t) is not None) * self.SHORT) / n, t, (wrong, right)) for wrong, right, t in _inverses(text, by_bytes)]
            gain, made, mapping = max(saved, default=(0.0, None, None))
            if made is None or gain < self.MARGIN:
                break
            text, path = made, (*path, mapping)
        # control characters may stand between two mappings, but not in the end
        return (text, path) if path and not _control.search(text) else None

    def _by_stretches(self, before: str, run: str, after: str) -> tuple[str, tuple[Path, ...]] | None:
        """Each stretch beyond ASCII by itself, for runs that are garbled only in part or in several ways."""
        stretches = list(_stretch.finditer(run))
        if len(stretches) == 1 and stretches[0][0] == run:
            return None
        whole, shift, paths = before + run + after, len(before), {}
        restored: dict[int, str] = {}
        for m in sorted(stretches, key=lambda m: (m.start() - m.end(), m.start())):  # the longest decide for the others
            around = whole[shift + m.start() - 1], m[0], whole[shift + m.end()]
            made = self._best(*around)
            if paths and (made is None or made[1] not in paths):
                other = self._as_before(around[1], around[0], around[2], paths)
                made = (other[0], other[1][0]) if other else made
            if made:
                restored[m.start()] = made[0]
                paths[made[1]] = None
        return (_stretch.sub(lambda m: restored.get(m.start(), m[0]), run), tuple(paths)) if paths else None

    def _as_before(self, run: str, before: str, after: str, paths: dict[Path, None]) -> tuple[str, tuple[Path, ...]] | None:
        """The run by the first mapping that held in the record before and makes it more probable by the margin."""
        least = self.model.cost(before + run + after) - self.MARGIN * len(_beyond.findall(run))
        for path in paths:
            made = _undone(run, path)
            if made is not None and self.model.cost(before + made + after) <= least:
                return made, (path,)
        return None

    def _rest(self, text: str, paths: list[Path], doubtful: dict[Path, None]) -> str:
        """The text with further stretches undone by mappings that hold elsewhere in it: where that makes them more probable at all, and
        by the margin if the mapping is a reading by single bytes."""

        def one(m: re.Match) -> str:
            before, after = text[m.start() - 1 : m.start()] or " ", text[m.end() : m.end() + 1] or " "
            best, least = m[0], self.model.cost(before + m[0] + after)
            for path in paths:
                made = _undone(m[0], path)
                if made is not None and (cost := self.model.cost(before + made + after)) < least:
                    best, least = made, cost
            if best == m[0] and doubtful and not m[0].isspace() and (other := self._as_before(m[0], before, after, doubtful)):
                return other[0]
            return best

        return _stretch.sub(one, text)

    def examine(self, text: str | None) -> tuple[bool, str | None]:
        """(whether the text holds a garbled run, the text with what could be restored); a restored text is read again, as it may hold more."""
        garbled, made = self._examine(text)
        for _ in range(2 if made != text else 0):
            text, (_, made) = made, self._examine(made)
            if made == text:
                break
        return garbled, made

    def _examine(self, text: str | None) -> tuple[bool, str | None]:
        if not text or text.isascii():
            return bool(text and "??" in text and _lost.search(text)), text
        found, paths = {}, {}
        # long runs first: what was read wrongly in them decides for those that are too short to tell
        for start, end in sorted(self.runs(text), key=lambda r: (r[0] - r[1], r[0])):
            run, before, after = text[start:end], text[start - 1] if start else " ", text[end] if end < len(text) else " "
            made = self.restored(run, before, after)
            if made is not None:
                if paths and not any(p in paths for p in made[1]):
                    made = self._as_before(run, before, after, paths) or made
                found[start] = (end, made[0])
                paths |= dict.fromkeys(made[1])
        if not paths:
            return bool(_lost.search(text)), text
        parts, at = [], 0
        for start, (end, made) in sorted(found.items()):
            parts += [(False, text[at:start]), (True, made)]
            at = end
        parts.append((False, text[at:]))
        # only UTF-8 refuses most of what it was not; single bytes would fit anything
        sure = [p for p in paths if all(right == "utf-8" for _, right in p)]
        doubtful = {p: None for p in paths if p not in sure}
        return True, "".join(t if done else self._rest(t, sure, doubtful) for done, t in parts)


def model_of(df: DataFrame, text_col: str) -> PairModel:
    """The pair model of a corpus. The driver gets at most CELLS plus the number of characters counters."""
    counted = pair_counts(df, text_col).toPandas()
    return PairModel(counted["cell"].to_numpy(np.int64), counted["n"].to_numpy(np.int64))


def repair(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, garbled BOOLEAN, text) of every row: the text with its garbled runs restored where possible."""
    model = df.sparkSession.sparkContext.broadcast(model_of(df, text_col))

    def run(batches):
        repairer = Repairer(model.value)
        for batch in batches:
            seen = [repairer.examine(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g for g, _ in seen], pa.bool_()), pa.array([t for _, t in seen], pa.string())], ["id", "garbled", "text"])

    return map_batches(named(df, id_col, text_col), run, "id bigint, garbled boolean, text string").withColumnRenamed("id", id_col)
