"""Markup residue in text documents (problem 5).

A document is given its one notation (HTML, Markdown, wiki text, LaTeX or none) by a linear classifier over evidence, of which the file name is
only a little. A scanner for that notation cuts it into blocks and names the structure in each. A minimum cut
then labels the blocks content or boilerplate (see mincut): the costs come from a linear classifier over what a block is by
itself; neighbouring blocks, blocks under the same parent element, and blocks and the element of the page's frame that holds them are tied together. The clean
text is made of the content blocks: headings are written with #, list items with -, code between fences, formulas between
dollar signs, links and emphasis as their text.

Both classifiers are fitted on a bounded sample of the collection (``FIT_ROWS`` records, ``FIT_BLOCKS`` blocks each) and held to a prior: the notation's labels are the
file names that the text does not contradict, a block's label is its kind where that gives it away. Without such rows the prior stands.

Cases: null and empty contents and texts without markup are plain: no notation, no elements, the text as it is; a
wrong, missing or odd file name only withdraws its small weight; texts are read to their end, whatever their length, in time
in proportion to it; unclosed tags, fences or environments run to the end of the text; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.arrow import map_batches, named
from brindle.llm.mincut import label

ELEMENTS = ("heading", "list", "code", "formula", "link", "emphasis")


@dataclass(slots=True)
class Block:
    """A piece of a document: kind is a structure name, ``text``, or the name of a kind of boilerplate."""

    kind: str
    text: str
    parent: int = 0
    level: int = 0
    elements: set[str] = field(default_factory=set)
    links: int = 0
    frame: int = 0  # number of the element of the page's frame, such as its head, that holds the block


# ---- notation ------------------------------------------------------------------------------------------------

# Extensions that suggest a notation.
EXTENSIONS = {
    "html": "html", "htm": "html", "xhtml": "html", "md": "markdown", "markdown": "markdown", "mdown": "markdown",
    "wiki": "wiki", "mediawiki": "wiki", "tex": "latex", "latex": "latex", "ltx": "latex",
}

# Evidence: (notation, weight of the first occurrence before anything is fitted, pattern). Every pattern takes time in proportion to a text's length:
# what may be long ends at the next mark or is never given back.
EVIDENCE = [
    ("html", 6.0, re.compile(r"<!doctype\s+html|</?(?:html|head|body)\b", re.I)),
    ("html", 3.0, re.compile(r"<(?:p|ul|ol|li|div|table|tr|td|h[1-6]|pre)(?:\s[^<>]*)?>", re.I)),
    ("html", 1.3, re.compile(r"<(?:a\s(?:(?!href)[^<>])*+href[^<>]*|b|i|em|strong|span(?:\s[^<>]*)?|i\s[^<>]*|br\s?/?)>", re.I)),
    ("html", 1.0, re.compile(r"&(?:nbsp|amp|lt|gt|quot|#\d+);")),
    ("html", 2.0, re.compile(r"<math[^<>]*>\s?<m\w+>")),
    ("markdown", 3.0, re.compile(r"^ {0,3}(?:```|~~~)", re.M)),
    ("markdown", 2.5, re.compile(r"(?:\A|\n\n) {0,3}#{1,6}[ \t]\S?[^\n]*(?=\n\n|\Z|\n {0,3}(?:[-*+>]|\d))")),
    ("markdown", 2.5, re.compile(r"^[^\s#>*+=-][^\n]*\n(?:={3,}|-{3,})$", re.M)),
    ("markdown", 4.0, re.compile(r"(?<!\])\[[^\[\]\n]+\](?:\(<?[^\s()<>]++>?[^()\n]*+\)|\[[^\[\]\n]*\])")),
    ("markdown", 3.0, re.compile(r"^\[[^\[\]\n]+\]:[ \t]\S", re.M)),
    ("markdown", 4.0, re.compile(r"<https?://[^\s<>]+>")),
    ("markdown", 2.0, re.compile(r"(?<![\w*\\])(\*\*?\*?)(?=[^\s*])[^*\n]*[^\s*]\1(?![\w*])")),
    ("markdown", 2.0, re.compile(r"(?<![\w_\\])(__?_?)(?=[^\s_])[^_\n]*[^\s_]\1(?![\w_])")),
    ("markdown", 2.0, re.compile(r"(?:\A|\n\n)(?:[ ]{0,3}(?:[-*+]|\d{1,9}[.)]) [^\n]+\n?){2,}")),
    ("markdown", 2.0, re.compile(r"^ {0,8}[-*+] \[[ xX]\] ", re.M)),
    ("markdown", 1.0, re.compile(r"^ {2,4}[-*+] \S", re.M)),
    ("markdown", 1.5, re.compile(r"^ {0,3}(?:(?:- ?){3,}|(?:\* ?){3,}|(?:_ ?){3,})$", re.M)),
    ("markdown", 1.5, re.compile(r"^> \S", re.M)),
    ("markdown", 2.0, re.compile(r"(?:\A|\n\n) {4}\S")),
    ("markdown", 2.5, re.compile(r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*[^\s$\\]\$(?![\d$\w])|^\$\$", re.M)),
    ("markdown", 1.6, re.compile(r"\\\((?:(?!\\[()])[^\n])++\\\)|\\\[")),
    ("markdown", 2.0, re.compile(r"(?<!`)`[^`\n]+`(?!`)")),
    ("wiki", 3.5, re.compile(r"^(={2,6})[ \t]?[^=\s][^\n]*\1$", re.M)),
    ("wiki", 4.0, re.compile(r"\[\[[^\[\]\n]+\]\]")),
    ("wiki", 4.0, re.compile(r"\{\{[^{}\n]+\}\}|^\{\|", re.M)),
    ("wiki", 4.0, re.compile(r"(?<!')'{2,5}(?=[^\s'])[^'\n]*[^\s']'{2,5}(?!')")),
    ("wiki", 5.0, re.compile(r"<(?:syntaxhighlight|source|ref|nowiki)\b[^<>]*>", re.I)),
    ("wiki", 4.0, re.compile(r"(?<!\[)\[https?://[^\s\[\]]++[^\[\]\n]*+\]")),
    ("wiki", 3.0, re.compile(r"<math[^<>]*>(?!\s?<)")),
    ("wiki", 2.5, re.compile(r"^(?:\*{1,4}|#{1,4})[^\s*#][^\n]*$(?:\n(?:[*#])[^\n]*$)", re.M)),
    ("wiki", 2.5, re.compile(r"^#+ ?\S[^\n]*\n#+ ?\S", re.M)),
    ("wiki", 3.0, re.compile(r"^\*{2,4} ?[^\s*][^*\n]*$", re.M)),
    ("wiki", 1.0, re.compile(r"^\*+ \S", re.M)),
    ("wiki", 2.0, re.compile(r"^:+[^\s:]", re.M)),
    ("latex", 6.0, re.compile(r"\\(?:documentclass|usepackage|begin\{|end\{)")),
    ("latex", 4.0, re.compile(r"\\(?:(?:sub)*section|chapter|paragraph|textbf|textit|emph|href|url|cite|label|item|noindent|ldots)\b")),
    ("latex", 3.0, re.compile(r"\{\\(?:bf|it|em)\b")),
    ("latex", 1.0, re.compile(r"\\[&%#_]")),
    ("latex", 1.5, re.compile(r"^%", re.M)),
    ("latex", 1.5, re.compile(r"\\\((?:(?!\\[()])[^\n])++\\\)|\\\[|(?<![\\$\w])\$(?=[^\s$])[^$\n]*[^\s$\\]\$(?![\d$\w])")),
]
NOTATIONS = ("plain", "html", "markdown", "wiki", "latex")
NAME_WEIGHT = 1.5  # weight of an extension before anything is fitted
LEAST = 1.75  # evidence that makes up for the prior of a plain text

_marks = re.compile(r"[<>#*_`\[\]{}\\$='~&|]|^[ \t]*(?:[-+>:]|\d+[.)])\s|^ {4}|^-{3,}$", re.M)
_fence = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_raw_code = re.compile(
    r"(<(pre|syntaxhighlight|source)\b[^<>]*>).*?(</\2>|\Z)|(\\begin\{(verbatim|lstlisting|minted)\}).*?(\\end\{\5\}|\Z)", re.I | re.S
)


def _without_code(text: str) -> str:
    """The text with the insides of code blocks taken out, so that they are no evidence."""
    text = _raw_code.sub(lambda m: f"{m[1] or m[4]}{m[3] or m[6] or ''}", text)
    return _fence.sub(lambda m: f"{m[1]}\n{m[1]}", text)


def _tidy(text: str) -> str:
    """Lines without white space at their ends, blank ones never side by side."""
    out: list[str] = []
    for line in text.split("\n"):
        line = line.rstrip()
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).rstrip("\n")


_document = re.compile(r"\A\s*<(?:!doctype|html)", re.I)
_block_tag = re.compile(r"<(?:p|ul|ol|li|div|h[1-6])(?:\s[^<>]*)?>", re.I)
_hints = tuple(NOTATIONS[1:])


def evidence(text: str, file_name: str | None) -> np.ndarray:
    """What speaks for a notation: log2(1 + occurrences) of every pattern, a whole HTML document, block tags, the notation that the name suggests
    if anything in the text does, too, and one."""
    text = text.lstrip("\ufeff")
    body = _tidy(_without_code(text))
    counts = [sum(1 for _ in pattern.finditer(body)) for _, _, pattern in EVIDENCE]
    hint = hint_of(file_name)
    blocks_of = sum(1 for _ in _block_tag.finditer(body)) if "<" in body else 0
    there = {kind for (kind, _, _), n in zip(EVIDENCE, counts, strict=True) if n}
    rest = [float(_document.search(body) is not None), np.log2(1 + blocks_of), *[float(hint == n and n in there) for n in _hints], 1.0]
    return np.concatenate([np.log2(1 + np.array(counts)), rest])


def hint_of(file_name: str | None) -> str | None:
    """The notation that a file name suggests."""
    return EXTENSIONS.get(file_name.rsplit(".", 1)[1].strip().lower()) if file_name and "." in file_name else None


N_EVIDENCE = len(EVIDENCE) + 3 + len(_hints)


def prior_weights() -> np.ndarray:
    """Weights of the evidence for each of NOTATIONS where nothing is fitted."""
    w = np.zeros((len(NOTATIONS), N_EVIDENCE))
    for i, (kind, weight, _) in enumerate(EVIDENCE):
        w[NOTATIONS.index(kind), i] = weight
    at = len(EVIDENCE)
    w[1, at], w[1, at + 1] = 6.0, 1.0
    for j, kind in enumerate(_hints):
        w[NOTATIONS.index(kind), at + 2 + j] = NAME_WEIGHT
    w[0, -1] = LEAST
    return w


@dataclass(slots=True)
class Model:
    """Weights of the notation's evidence, a row for each of NOTATIONS, and of a block's features."""

    notation: np.ndarray = field(default_factory=prior_weights)
    block: np.ndarray = field(default_factory=lambda: np.array([BLOCK_PRIOR[f] for f in BLOCK_FEATURES]))


@cache
def _prior() -> Model:
    return Model()


def notation(text: str | None, file_name: str | None = None, model: Model | None = None) -> str | None:
    """html, markdown, wiki, latex, or None for a plain text."""
    if not text or not _marks.search(text):
        return None
    found = evidence(text, file_name)
    if not found[: len(EVIDENCE)].any():
        return None
    score = (model or _prior()).notation @ found
    best = int(np.argmax(score[1:])) + 1
    return NOTATIONS[best] if score[best] >= score[0] else None


# ---- inline structure ----------------------------------------------------------------------------------------

_tag_emphasis = re.compile(r"<(b|strong|i|em)(?:\s[^<>]*)?>", re.I)
_tag_link = re.compile(r"<a\s[^<>]*href\s*=", re.I)
_tag = re.compile(r"</?[a-zA-Z][^<>]*>")
_tag_math = re.compile(r"<math\b[^<>]*>(.*?)(?:</math>|\Z)", re.I | re.S)
_dollar = re.compile(r"(?<![\\$])\$\$(.+?)\$\$|(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\d$\w])|(?<![\\$\w])\$([^\s$\\])\$(?![\d$\w])", re.S)
_md_link = re.compile(r"(!?)\[([^\[\]]*)\]\((?:<[^<>\n]*>|[^\s()<>]++)(?:\s++(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?\)")
_md_reference = re.compile(r"\[([^\[\]]+)\]\[([^\[\]]*)\]")
_md_definition = re.compile(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]+(\S+)[^\n]*$", re.M)
_md_auto = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_wiki_link = re.compile(r"\[\[:?([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
_wiki_url = re.compile(r"(?<!\[)\[((?:https?|ftp)://[^\s\[\]]+)(?:\s+([^\[\]\n]*))?\]")
_wiki_quotes = re.compile(r"(?<!')('{5}|'{3}|'{2})(?!')(.+?)(?<!')\1(?!')")
_tex_link = re.compile(r"\\href\s*\{([^{}]*)\}\s*\{([^{}]*)\}|\\url\s*\{([^{}]*)\}")
_tex_emphasis = re.compile(r"\\(?:textbf|textit|emph|textsl|underline)\s*\{([^{}]*)\}|\{\\(?:bf|it|em|sl|bfseries|itshape)\b\s*([^{}]*)\}")


def _note(block: Block, name: str) -> None:
    block.elements.add(name)
    if name == "link":
        block.links += 1


def _tags(text: str, block: Block) -> str:
    """Tags of any notation's text: emphasis, links and formulas are noted, all tags go."""
    if "<" in text:
        if _tag_math.search(text):
            _note(block, "formula")
            text = _tag_math.sub(lambda m: f"${_tag.sub('', m[1]).strip()}$", text)
        if _tag_emphasis.search(text):
            _note(block, "emphasis")
        if _tag_link.search(text):
            _note(block, "link")
        text = _tag.sub(lambda m: "\n" if m[0][:3].lower() == "<br" else "", text)
    return html.unescape(text) if "&" in text else text


# Characters that stand for pieces taken out of a text for a while; a text that holds them has them exchanged for others until it is done.
HELD = "\ufdd1\ufdd2\ufdd3\ufdd4\ufdd5"


def _without_held(text: str) -> tuple[str, dict[int, str]]:
    """The text without the characters of HELD, and the table that brings them back."""
    used = [c for c in HELD if c in text]
    if not used:
        return text, {}
    known = set(text)
    free = (chr(c) for c in range(0xF0000, 0x110000) if chr(c) not in known)
    there = {ord(c): next(free) for c in used}
    return text.translate(there), {ord(f): chr(c) for c, f in there.items()}


def _between(text: str, openers: dict[str, str]):
    """(start, end, inside) of the pieces between an opener and the next of its closers, not empty; one pass."""
    at, gone = 0, set()
    opener = re.compile("|".join(map(re.escape, openers)))
    while m := opener.search(text, at):
        end = -1 if m[0] in gone else text.find(openers[m[0]], m.end() + 1)
        if end < 0:
            gone.add(m[0])  # there is no closer behind this place
            at = m.end()
            continue
        yield m.start(), end + len(openers[m[0]]), text[m.end() : end]
        at = end + len(openers[m[0]])


def _formulas(text: str, block: Block, dollars: bool = True) -> tuple[str, list[str]]:
    """The text with formulas noted and taken out of the way of other marks, and what ``_put_back`` puts in their places."""
    held: list[str] = []

    def hold(inside: str) -> str:
        _note(block, "formula")
        held.append(f"${inside.strip()}$")
        return f"\ufdd1{len(held) - 1}\ufdd2"

    if "\\(" in text or "\\[" in text:
        out, at = [], 0
        for start, end, inside in _between(text, {"\\(": "\\)", "\\[": "\\]"}):
            out += [text[at:start], hold(inside)]
            at = end
        text = "".join(out) + text[at:]
    if dollars and "$" in text:
        text = _dollar.sub(lambda m: hold(next(g for g in m.groups() if g is not None)), text)
    return text, held


_backticks = re.compile(r"`+")


def _code_spans(text: str) -> tuple[str, list[str]]:
    """The text with code spans taken out, and their insides; a span ends at the next run of as many backticks."""
    runs = [(m.start(), m.end()) for m in _backticks.finditer(text)]
    later: dict[int, list[int]] = {}
    for i in range(len(runs) - 1, -1, -1):
        later.setdefault(runs[i][1] - runs[i][0], []).append(i)
    out, code, at, i = [], [], 0, 0
    while i < len(runs):
        start, end = runs[i]
        same = later[end - start]
        while same and same[-1] <= i:
            same.pop()
        if same:
            close = runs[same[-1]]
            out += [text[at:start], f"\ufdd3{len(code)}\ufdd4"]
            code.append(text[end : close[0]])
            at, i = close[1], same[-1]
        i += 1
    return "".join(out) + text[at:], code


_runs = {"*": re.compile(r"\*+"), "_": re.compile(r"_+")}


def _emphasis(text: str, mark: str) -> str:
    """The text without the outermost pairs of runs of one to three marks around a text; underscores only at the borders of words."""
    openers, closers = [], {1: [], 2: [], 3: []}
    for m in _runs[mark].finditer(text):
        n = m.end() - m.start()
        if n > 3:
            continue
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        inside = mark == "_"
        if before != "\\" and after and not after.isspace() and not (inside and before.isalnum()):
            openers.append((m.start(), n))
        if before and before != "\\" and not before.isspace() and not (inside and after.isalnum()):
            closers[n].append(m.start())
    gone, at = [], 0
    for start, n in openers:
        if start < at:
            continue
        k = bisect_right(closers[n], start)
        if k < len(closers[n]):
            end = closers[n][k]
            gone += [(start, n), (end, n)]
            at = end + n
    out, at = [], 0
    for start, n in gone:
        out.append(text[at:start])
        at = start + n
    return "".join(out) + text[at:]


def _put_back(text: str, held: list[str]) -> str:
    return re.sub("\ufdd1([0-9]+)\ufdd2", lambda m: held[int(m[1])], text) if held else text


def _inline_markdown(text: str, block: Block, names: dict[str, str]) -> str:
    code: list[str] = []
    if "`" in text:
        text, code = _code_spans(text)
    text, held = _formulas(text, block)
    if "[" in text:

        def link(m: re.Match) -> str:
            if not m[1]:
                _note(block, "link")
            return m[2]

        text = _md_link.sub(link, text)

        def reference(m: re.Match) -> str:
            if (m[2] or m[1]).lower() not in names:
                return m[0]
            _note(block, "link")
            return m[1]

        if names:
            text = _md_reference.sub(reference, text)
    if "<" in text:
        if _md_auto.search(text):
            _note(block, "link")
            text = _md_auto.sub(r"\1", text)
        text = _tags(text, block)
    elif "&" in text:
        text = html.unescape(text)
    for mark in "*_":
        if mark in text:
            changed = _emphasis(text, mark)
            if changed != text:
                _note(block, "emphasis")
                text = _emphasis(changed, mark)
    if code:
        text = re.sub("\ufdd3([0-9]+)\ufdd4", lambda m: code[int(m[1])], text)
    return _put_back(text, held)


# Prefixes of page links that are no links to pages.
NO_PAGES = ("category", "file", "image", "media", "kategorie", "catégorie", "categoría", "رده", "категория", "datei", "fichier", "archivo")
_template = re.compile(r"\{\{[^{}]*\}\}")
_ref = re.compile(r"<ref\b[^<>]*>", re.I)
_ref_end = re.compile(r"</ref\s?>", re.I)


def _without_references(text: str) -> str:
    """The text without notes; a note that is not closed stays, but for its tag."""
    ends = [(m.start(), m.end()) for m in _ref_end.finditer(text)]
    out, at = [], 0
    for m in _ref.finditer(text):
        if m.start() < at:
            continue
        out.append(text[at : m.start()])
        at = m.end()
        if not m[0].endswith("/>") and (k := bisect_right(ends, (m.end(), -1))) < len(ends):
            at = ends[k][1]
    return "".join(out) + text[at:]




def _inline_wiki(text: str, block: Block) -> str:
    if "<ref" in text.lower():
        text = _without_references(text)
    if "{{" in text:
        text = _template.sub("", text)
    if "<" in text:
        text = _tags(text, block)
    elif "&" in text:
        text = html.unescape(text)
    if "[" in text:

        def page(m: re.Match) -> str:
            if m[1].split(":", 1)[0].strip().lower() in NO_PAGES and ":" in m[1]:
                return ""
            _note(block, "link")
            return m[2] or m[1]

        def url(m: re.Match) -> str:
            _note(block, "link")
            return m[2] or m[1]

        text = _wiki_url.sub(url, _wiki_link.sub(page, text))
    if "''" in text:
        changed = _wiki_quotes.sub(r"\2", text)
        if changed != text:
            _note(block, "emphasis")
            text = _wiki_quotes.sub(r"\2", changed)
    return text


_tex_command = re.compile(r"\\(?:label|cite[tp]?|ref|eqref|vspace|hspace|includegraphics)\*?(?:\[[^\[\]\n]*\])?\{[^{}]*\}|\\(?:noindent|centering|clearpage|newpage|maketitle|tableofcontents|par)\b[ ]?")
_tex_escape = re.compile(r"\\([&%#_$\{}])")
_tex_other = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\[\]\n]*\])?|[{}]")


def _inline_latex(text: str, block: Block) -> str:
    text, held = _formulas(text, block)
    if "\\" in text:
        if _tex_link.search(text):
            _note(block, "link")
            text = _tex_link.sub(lambda m: m[2] if m[2] is not None else m[3], text)
        if _tex_emphasis.search(text):
            _note(block, "emphasis")
            text = _tex_emphasis.sub(lambda m: m[1] if m[1] is not None else m[2], text)
        text = _tex_command.sub("", text).replace("\\ldots", "…").replace("\\\\", "\n")
        text = _tex_escape.sub("\ufdd5\\1", text)
        text = _tex_other.sub("", text).replace("\ufdd5", "")
    return _put_back(text.replace("~", " "), held)


# ---- blocks --------------------------------------------------------------------------------------------------

_comment = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_html_piece = re.compile(r"<!--.*?(?:-->|\Z)|<!\w[^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)/?>|[^<]+|<", re.S)
_chrome = {"head", "style", "script", "nav", "footer", "aside", "form", "title"}
_breaks = {"p", "div", "li", "ul", "ol", "table", "tr", "section", "article", "body", "html", "br", "hr", "dl", "dt", "dd", "blockquote", "main", "header"} | _chrome
_inline_tags = {"b", "strong", "i", "em"}
_no_container = {"p", "li", "tr", "dt", "dd"}


def _blocks_html(text: str) -> list[Block]:
    """Blocks with the number of the element that holds them as parent, and that of the element of ``_chrome`` as frame."""
    blocks: list[Block] = []
    parents, number = [0], 0
    path: list[str] = []
    open_tags: Counter[str] = Counter()
    frames = [0]
    fresh, parts = Block("text", ""), []

    def close() -> None:
        nonlocal fresh, parts
        text = html.unescape("".join(parts))
        text = text.strip("\n") if fresh.kind == "code" else text.strip()
        if text or fresh.elements or fresh.kind not in ("text", "item"):
            fresh.text = text
            blocks.append(fresh)
        fresh, parts = Block("text", "", parents[-1], frame=frames[-1]), []

    raw = math = None
    for m in _html_piece.finditer(text):
        piece, tag = m[0], (m[2] or "").lower()
        closing = m[1] == "/"
        if raw:
            if tag == raw and closing:
                close()
                raw = None
            elif not tag or raw in ("style", "script"):
                parts.append("" if piece.startswith("<!--") else piece)
            continue
        if math:
            if tag == "math" and closing:
                parts.append("$")
                math = None
            elif not tag:
                parts.append(piece)
            continue
        if piece.startswith("<!"):
            close()
            blocks.append(Block("comment", piece, parents[-1], frame=frames[-1]))
            continue
        if not tag:
            if "\\(" in piece or "\\[" in piece:
                piece = _put_back(*_formulas(piece, fresh, dollars=False))
            parts.append(piece)
            continue
        if tag in ("pre", "style", "script") and not closing:
            close()
            fresh.kind = "code" if tag == "pre" else "script"
            if tag == "pre":
                fresh.elements.add("code")
            raw = tag
        elif tag == "math" and not closing:
            fresh.elements.add("formula")
            parts.append("$")
            math = tag
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            close()
            if not closing:
                fresh.kind, fresh.level = "heading", int(tag[1])
                fresh.elements.add("heading")
        elif tag in _breaks:
            close()
            if tag in ("br", "hr"):
                continue
            if closing:
                if open_tags[tag]:
                    while True:
                        last = path.pop()
                        parents.pop()
                        open_tags[last] -= 1
                        if last in _chrome:
                            frames.pop()
                        if last == tag:
                            break
            elif tag not in _no_container:
                number += 1
                path.append(tag)
                open_tags[tag] += 1
                parents.append(number)
                if tag in _chrome:
                    frames.append(number)
            fresh.parent, fresh.frame = parents[-1], frames[-1]
            if tag == "li" and not closing:
                fresh.kind, fresh.level = "item", open_tags["ul"] + open_tags["ol"]
                fresh.elements.add("list")
        elif not closing:
            if tag in _inline_tags:
                fresh.elements.add("emphasis")
            elif tag == "a" and "href" in m[3].lower():
                _note(fresh, "link")
            elif tag in ("span", "div") and "math" in m[3]:
                fresh.elements.add("formula")
    close()
    return blocks


_md_fence_open = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_md_atx = re.compile(r" {0,3}(#{1,6})(?:[ \t]|$)")
_md_quote = re.compile(r"(?:> ?)+")
_md_rule = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_md_setext = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_md_item = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(.*)$")
_raw_open = re.compile(r"<(pre|syntaxhighlight|source)\b[^<>]*>", re.I)


def _blocks_markdown(text: str) -> list[Block]:
    names = {m[1].lower(): m[2] for m in _md_definition.finditer(text)}
    blocks: list[Block] = []
    lines = text.split("\n")
    paragraph: list[str] = []
    section, in_list, i = 0, False, 0

    def close(kind: str = "text", level: int = 0) -> None:
        if paragraph:
            b = Block(kind, "", section, level)
            if kind == "heading":
                b.elements.add("heading")
            b.text = _inline_markdown("\n".join(paragraph), b, names).strip()
            blocks.append(b)
            paragraph.clear()

    while i < len(lines):
        line = lines[i]
        if line.startswith(">"):
            line = line[_md_quote.match(line).end() :]
        if m := _md_fence_open.match(line):
            close()
            mark, body = m[1], []
            i += 1
            while i < len(lines) and not ((e := _md_fence_open.match(lines[i])) and e[1].startswith(mark) and not lines[i].strip().strip(mark[0])):
                body.append(lines[i])
                i += 1
            formula = "math" in line[m.end() :].split()
            blocks.append(Block("formula" if formula else "code", "\n".join(body), section, 0, {"formula" if formula else "code"}))
        elif (m := _raw_open.search(line)) and not paragraph:
            body, end = [line[m.end() :]], f"</{m[1].lower()}>"
            while end not in body[-1].lower() and i + 1 < len(lines):
                i += 1
                body.append(lines[i])
            whole = "\n".join(body)
            at = whole.lower().find(end)
            blocks.append(Block("code", html.unescape(_tag.sub("", whole[: at if at >= 0 else None])), section, 0, {"code"}))
        elif not line.strip():
            close()
            if not (i + 1 < len(lines) and (lines[i + 1].startswith(" ") or _md_item.match(lines[i + 1]))):
                in_list = False
        elif m := _md_atx.match(line):
            close()
            section += 1
            title = line[m.end() :].strip(" \t")
            bare = title.rstrip("#")
            paragraph.append(bare.rstrip(" \t") if not bare or bare[-1] in " \t" else title)
            close("heading", len(m[1]))
            in_list = False
        elif paragraph and not in_list and (m := _md_setext.match(line)):
            section += 1
            close("heading", 1 if m[1][0] == "=" else 2)
        elif _md_rule.match(line):
            close()
            blocks.append(Block("rule", "", section))
        elif line.startswith(("    ", "\t")) and not paragraph and not in_list:
            body = []
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or (not lines[i].strip() and i + 1 < len(lines) and lines[i + 1].startswith("    "))):
                body.append(lines[i][4:] if lines[i].startswith("    ") else lines[i][1:])
                i += 1
            i -= 1
            blocks.append(Block("code", "\n".join(body), section, 0, {"code"}))
        elif (m := _md_item.match(line)) and (in_list or not paragraph):
            close()
            in_list = True
            b = Block("item", "", section, len(m[1].expandtabs(4)) // 2 + 1, {"list"})
            b.text = _inline_markdown(m[2], b, names)
            blocks.append(b)
        elif _md_definition.match(line):
            close()
            blocks.append(Block("definition", line, section))
        elif line.strip().startswith("$$") and not paragraph:
            body = [line.strip()]
            while (len(body) == 1 and not (len(body[0]) > 4 and body[0].endswith("$$"))) or (len(body) > 1 and not body[-1].rstrip().endswith("$$")):
                if i + 1 >= len(lines):
                    break
                i += 1
                body.append(lines[i])
            blocks.append(Block("formula", "\n".join(body).strip("$\n "), section, 0, {"formula"}))
        else:
            paragraph.append(line.strip())
        i += 1
    close()
    return blocks


def _wiki_heading(line: str) -> tuple[int, str] | None:
    """(level, text) of a line between as many equals signs, up to six, on both sides."""
    line = line.rstrip(" \t")
    if line[:1] != "=" or line[-1] != "=":
        return None
    level = min(len(line) - len(line.lstrip("=")), len(line) - len(line.rstrip("=")), 6, (len(line) - 1) // 2)
    inside = line[level : len(line) - level].strip(" \t")
    return (level, inside) if level and inside else None


_wiki_item = re.compile(r"^([*#]+)[ \t]*(.*)$")
_wiki_category = re.compile(r"(?:\[\[[^\[\]|:]+:[^\[\]]*\]\]\s*+)++\Z")


def _blocks_wiki(text: str) -> list[Block]:
    blocks: list[Block] = []
    paragraph: list[str] = []
    section = 0

    def close() -> None:
        if paragraph:
            b = Block("text", "", section)
            b.text = _inline_wiki("\n".join(paragraph), b).strip()
            blocks.append(b)
            paragraph.clear()

    at = 0
    for m in [*_raw_code.finditer(text), None]:
        for line in text[at : m.start() if m else None].split("\n"):
            if not line.strip():
                close()
            elif h := _wiki_heading(line):
                close()
                section += 1
                b = Block("heading", "", section, h[0], {"heading"})
                b.text = _inline_wiki(h[1], b)
                blocks.append(b)
            elif h := _wiki_item.match(line):
                close()
                b = Block("item", "", section, len(h[1]), {"list"})
                b.text = _inline_wiki(h[2], b)
                blocks.append(b)
            elif _wiki_category.match(line.strip()) and line.strip().strip("[").split(":", 1)[0].strip().lower() in NO_PAGES:
                close()
                blocks.append(Block("category", line.strip(), section))
            else:
                paragraph.append(line.strip().lstrip(":") if line.startswith(":") else line.strip())
        if m:
            close()
            code = m[0][len(m[1] or m[4]) : len(m[0]) - len(m[3] or m[6] or "")].strip("\n")
            blocks.append(Block("code", html.unescape(code) if (m[2] or "").lower() == "pre" else code, section, 0, {"code"}))
            at = m.end()
    close()
    return blocks


# Names of LaTeX environments by what they hold.
TEX_CODE = ("verbatim", "lstlisting", "minted", "Verbatim")
TEX_LISTS = ("itemize", "enumerate", "description")
TEX_FORMULAS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math", "alignat", "flalign")

_tex_code = re.compile(r"\\begin\{(verbatim\*?|Verbatim|lstlisting|minted)\}(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_tex_comment = re.compile(r"(?<!\\)%[^\n]*")
_tex_formula = re.compile(r"\\begin\{((?:" + "|".join(TEX_FORMULAS) + r")\*?)\}(.*?)(?:\\end\{\1\}|\Z)|\\\[(.+?)(?:\\\]|\Z)|(?<!\\)\$\$(.+?)(?:\$\$|\Z)", re.S)
_tex_heading = re.compile(r"\\(part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?(?:\[[^\[\]\n]*\])?\{((?:[^{}]++|\{[^{}]*+\})*+)\}")
_tex_structure = re.compile(r"\\(?:begin|end)\{(\w+\*?)\}(?:\[[^\[\]\n]*\])?|\\item\b(?:\[[^\[\]\n]*\])?")
_tex_preamble = re.compile(r"\\(?:documentclass|usepackage|title|author|date|newcommand|input|bibliography\w*)\b[^\n]*")


def _blocks_latex(text: str) -> list[Block]:
    blocks: list[Block] = []
    section, depth = 0, 0

    def add(kind: str, body: str, level: int = 0, *elements: str) -> None:
        b = Block(kind, "", section, level, set(elements))
        b.text = body.strip("\n") if kind in ("code", "formula", "preamble", "comment") else _inline_latex(body.strip(), b)
        if b.text or b.elements:
            blocks.append(b)

    def prose(part: str, kind: str = "text") -> None:
        level = depth
        for k, paragraph in enumerate(re.split(r"\n\s*\n", part)):
            if paragraph.strip():
                if kind == "item" and k == 0:
                    add("item", paragraph, level, "list")
                else:
                    add("text", paragraph)

    def structured(part: str) -> None:
        nonlocal depth, section
        for line in _tex_preamble.findall(part):
            add("preamble", line)
        part = _tex_preamble.sub("", part)
        at, kind = 0, "text"
        marks = sorted([*_tex_structure.finditer(part), *_tex_heading.finditer(part)], key=lambda m: m.start())
        for m in marks:
            if m.start() < at:
                continue
            prose(part[at : m.start()], kind)
            at, kind = m.end(), "text"
            if m.re is _tex_heading:
                section += 1
                add("heading", m[2], 1 + m[1].count("sub") + (m[1] != "chapter"), "heading")
            elif m[0].startswith("\\item"):
                kind = "item"
            elif m[1].rstrip("*") in TEX_LISTS:
                depth = max(0, depth + (1 if m[0].startswith("\\begin") else -1))
        prose(part[at:], kind)

    def with_formulas(part: str) -> None:
        part = _tex_comment.sub("", part)
        at = 0
        for m in _tex_formula.finditer(part):
            structured(part[at : m.start()])
            add("formula", next(g for g in m.groups()[1:] if g is not None).strip(), 0, "formula")
            at = m.end()
        structured(part[at:])

    at = 0
    for m in _tex_code.finditer(text):
        with_formulas(text[at : m.start()])
        add("code", m[2], 0, "code")
        at = m.end()
    with_formulas(text[at:])
    return blocks


def blocks(text: str, syntax: str) -> list[Block]:
    """The blocks of a text in a notation."""
    text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if syntax == "html":
        return _blocks_html(text)
    if syntax == "latex":
        return _blocks_latex(text)
    text = _comment.sub("", text) if "<!--" in text else text
    return _blocks_markdown(text) if syntax == "markdown" else _blocks_wiki(text)


# ---- content and boilerplate ---------------------------------------------------------------------------------

# Features of a block by itself; what holds it and what stands beside it is the business of the edges.
BLOCK_FEATURES = (
    "text", "heading", "item", "code", "formula", "script", "comment", "preamble", "category", "definition", "rule",
    "words", "sentence", "marked", "links",
)
# Weights where nothing is fitted.
BLOCK_PRIOR = {
    "text": 0.5, "heading": 3.0, "item": 2.5, "code": 4.0, "formula": 4.0, "script": -6.0, "comment": -6.0, "preamble": -6.0, "category": -6.0, "definition": -5.0, "rule": -3.0,
    "words": 0.5, "sentence": 1.0, "marked": 1.5, "links": -4.0,
}
NEXT_WEIGHT, PARENT_WEIGHT, NEAR = 0.5, 0.5, 3
FRAME_WEIGHT, FRAME_COST = 2.5, 1e6  # tie of a block to the element of the frame that holds it; such an element itself is never content
_sentence = re.compile(r"[.!?:;…؟。]\W*\Z")


def block_features(b: Block) -> list[float]:
    words = b.text.count(" ") + bool(b.text)
    kinds = [float(b.kind == f) for f in BLOCK_FEATURES[:11]]
    return [*kinds, float(np.log2(1 + words)), float(_sentence.search(b.text[-20:]) is not None), float(not b.elements.isdisjoint(("emphasis", "formula"))), b.links / (1 + words)]


def own_costs(found: list[Block], model: Model | None = None) -> list[float]:
    """What speaks for content in each block by itself."""
    return (np.array([block_features(b) for b in found]) @ (model or _prior()).block).tolist()


def labels(found: list[Block], model: Model | None = None) -> list[bool]:
    """True for the content blocks, by the minimum cut.

    Nodes are the blocks, at the classifier's costs, and the elements of a page's frame, which are boilerplate. Ties join neighbours, near blocks under the same
    parent, and blocks with the element of the frame that holds them.
    """
    if not found:
        return []
    own, n = own_costs(found, model), len(found)
    edges = [(i, i + 1, NEXT_WEIGHT) for i in range(n - 1)]
    edges += [(i, j, PARENT_WEIGHT / (j - i)) for i in range(n) for j in range(i + 1, min(i + 1 + NEAR, n)) if found[i].parent == found[j].parent]
    frames = {f: n + k for k, f in enumerate(sorted({b.frame for b in found if b.frame}))}
    edges += [(i, frames[b.frame], FRAME_WEIGHT) for i, b in enumerate(found) if b.frame]
    own += [-FRAME_COST] * len(frames)
    return label([max(0.0, w) for w in own], [max(0.0, -w) for w in own], edges)[:n]


def _write(b: Block) -> str:
    if b.kind == "heading":
        return f"{'#' * max(1, b.level)} {b.text}"
    if b.kind == "item":
        return f"{'  ' * max(0, b.level - 1)}- {b.text}"
    if b.kind == "code":
        return f"```\n{b.text}\n```"
    if b.kind == "formula":
        return f"$${b.text}$$"
    return b.text


def convert(text: str | None, file_name: str | None = None, model: Model | None = None) -> tuple[str | None, list[str], str | None]:
    """(notation, kinds of elements in the content, clean text) of one document."""
    syntax = notation(text, file_name, model)
    if syntax is None:
        return None, [], text
    text, back = _without_held(text)
    found = blocks(text, syntax)
    content = [b for b, keep in zip(found, labels(found, model), strict=True) if keep]
    elements = set().union(*(b.elements for b in content))
    clean = []
    for k, b in enumerate(content):
        if k:
            clean.append("\n" if b.kind == "item" and content[k - 1].kind == "item" else "\n\n")
        clean.append(_write(b))
    made = "".join(clean)
    return syntax, [e for e in ELEMENTS if e in elements], made.translate(back) if back else made


# ---- fit -----------------------------------------------------------------------------------------------------

FIT_ROWS = 3000  # records that the classifiers are fitted on
FIT_BLOCKS = 40  # blocks of each of them
HOLD_NOTATION, HOLD_BLOCK = 3.0, 3.0  # strength of the prior, in records and blocks


def fit_notation(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Softmax regression over the notations on labelled evidence, held to the prior weights; labels are those of the file names.

    Rows whose name the prior contradicts are taken for misnamed and left out. Names tell nothing about plain texts, so their row
    stays as it is and what makes a text plain is the lack of evidence.
    """
    w0 = prior_weights()
    named_well = np.argmax((x @ w0.T)[:, 1:], axis=1) + 1 == y
    x, y = x[named_well], y[named_well]
    if not len(x):
        return w0
    w, v = w0.copy(), np.zeros_like(w0)
    target = np.eye(len(NOTATIONS))[y]
    rate = 0.5 / (1.0 + (x**2).sum(axis=1).mean())
    for _ in range(steps):
        z = x @ w.T
        z[:, 0] = -np.inf
        e = np.exp(z - z.max(axis=1, keepdims=True))
        slope = (e / e.sum(axis=1, keepdims=True) - target).T @ x / len(x) + HOLD_NOTATION / len(x) * (w - w0)
        slope[0] = 0.0
        v = 0.9 * v - rate * slope
        w = w + v
    return w


def fit_blocks(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression on blocks whose kind gives their label away, held to the prior weights."""
    w0 = Model().block
    w, v = w0.copy(), np.zeros_like(w0)
    rate = 2.0 / (1.0 + (x**2).sum(axis=1).mean())
    for _ in range(steps):
        slope = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(x) + HOLD_BLOCK / len(x) * (w - w0)
        v = 0.9 * v - rate * slope
        w = w + v
    return w


_FRAME = ("script", "comment", "preamble", "category", "definition", "rule")


def sample_of(text: str | None, file_name: str | None) -> tuple[list[float] | None, int, list[list[float]], list[bool]]:
    """Evidence and label of a record (None and -1 where its name tells nothing), features and labels of its first blocks."""
    if not text or not _marks.search(text):
        return None, -1, [], []
    hint = hint_of(file_name)
    found = evidence(text, None)  # the name is the label, so it is no evidence here
    y = NOTATIONS.index(hint) if hint and found[: len(EVIDENCE)].any() else -1
    syntax = NOTATIONS[int(np.argmax(_prior().notation @ found))]
    seen = blocks(_without_held(text)[0], syntax)[:FIT_BLOCKS] if syntax != "plain" else []
    sure = [b for b in seen if b.kind in _FRAME or not b.frame]  # other blocks inside the frame are left to the cut
    return found.tolist() if y >= 0 else None, y, [block_features(b) for b in sure], [b.kind not in _FRAME for b in sure]


def fit(df: DataFrame, text_col: str = "content", name_col: str = "file_name", rows: int = FIT_ROWS) -> Model:
    """The classifiers, fitted on the first ``rows`` records with a text; of each the driver gets evidence and features of at most ``FIT_BLOCKS`` blocks."""

    def run(batches):
        for batch in batches:
            got = [sample_of(t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.int32()),
                 pa.array([sum(g[2], []) for g in got], pa.list_(pa.float64())), pa.array([g[3] for g in got], pa.list_(pa.bool_()))],
                ["evidence", "y", "features", "labels"],
            )

    texts = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{name_col}`").alias("name")).where("text <> ''").limit(rows)
    got = texts.mapInArrow(run, "evidence array<double>, y int, features array<double>, labels array<boolean>").collect()
    model = Model()
    if known := [g for g in got if g.evidence is not None]:
        model.notation = fit_notation(np.array([g.evidence for g in known]), np.array([g.y for g in known]))
    if marked := [g for g in got if g.labels]:
        x = np.concatenate([np.array(g.features).reshape(-1, len(BLOCK_FEATURES)) for g in marked])
        model.block = fit_blocks(x, np.concatenate([np.array(g.labels, dtype=float) for g in marked]))
    return model


def clean_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "content", name_col: str = "file_name", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id_col, syntax, elements ARRAY<STRING>, text) of every row; syntax is null for plain documents."""
    model = fit(df, text_col, name_col, fit_rows)

    def run(batches):
        for batch in batches:
            rows = [convert(t, n, model) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.string())],
                ["id", "syntax", "elements", "text"],
            )

    return map_batches(named(df, id_col, text_col, name_col), run, "id bigint, syntax string, elements array<string>, text string").withColumnRenamed("id", id_col)
