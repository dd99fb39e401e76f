"""Markup residue: clean text from HTML, Markdown, wiki and LaTeX, with its structure kept readable.

Method: site template removal. Element subtrees are hashed bottom up (tag, text and child hashes), and
Spark counts on how many pages of a host each hash occurs. Subtrees on at least ``MIN_PAGES`` pages and a
share of ``SHARE`` of the host's pages are its template (menus, banners, footers) and are deleted; the
rest is converted. A host's template is bounded: with s subtrees a page on average it has at most
s / SHARE hashes. The hashes of all hosts are counted before the templates are broadcast; beyond the bound
they meet their pages by a skew-safe join. A text counts as marked up if template was deleted from it or the
conversion of the rest finds a construct. Parsing takes time in proportion to the text, whatever is unclosed.

Clean text keeps headings as ``# ...``, items as ``- ...`` or ``1. ...``, code blocks between fences,
tables as rows with `` | ``, formulas in dollars; everything else becomes plain text.

Defined results: null text gives null, blank text itself; text without markup comes back as it is; the
current row of an artifact counts, repeated rows once; broken and unclosed markup never fails.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.skew import unique_lookup
from corpusmill.runtime import cut

#: The element names of HTML.
ELEMENTS = (
    "a abbr address area article aside audio b base blockquote body br button canvas caption center cite code col colgroup data datalist dd del "
    "details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input "
    "ins kbd label legend li link main map mark meta nav noscript object ol optgroup option p param picture pre progress q ref s samp script "
    "section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr "
    "track tt u ul var video wbr"
).split()
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

#: A construct is named, guarded by substrings of which one must occur, and matched by a pattern that both
#: Python and RE2 understand (so without look-around).
CONSTRUCTS: dict[str, tuple[tuple[str, ...], str]] = {
    "html_tag": (("<",), r"(?i)</?(?:" + "|".join(ELEMENTS) + r")(?:\s[^<>]*)?/?>"),
    "html_comment": (("<!",), r"(?i)<!--|<!doctype\s"),
    "html_reference": (("&",), r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"),
    "md_fence": (("```", "~~~"), r"(?m)^ {0,3}(?:```|~~~)"),
    "md_code": (("`",), r"`[^`\n]+`"),
    "md_strong": (("**", "__"), r"\*\*[^\s*](?:[^*\n]*[^\s*])?\*\*|(?:^|[^\w_])__[^\s_](?:[^\n]*[^\s_])?__(?:[^\w_]|$)"),
    "md_emphasis": (("*", "_"), r"(?m)(?:^|[^\w*])\*[^\s*](?:[^*\n]*[^\s*])?\*(?:[^\w*]|$)|(?:^|[^\w_/])_[^\s_](?:[^_\n]*[^\s_])?_(?:[^\w_]|$)"),
    "md_strike": (("~~",), r"~~[^\s~][^~\n]*~~"),
    "md_link": (("](",), r"\[[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"),
    "md_footnote": (("[^",), r"\[\^[^\]\s]+\]"),
    "md_heading": (("#",), r"(?m)^#{1,6} \S"),
    "md_underlined": (("\n==", "\n--", "\n=", "\n-"), r"(?m)^[^\s].*\n(?:={2,}|-{2,})[ \t]*\r?$"),
    "md_rule": (("---", "***", "___"), r"(?m)^ {0,3}(?:-{3,}|\*{3,}|_{3,})[ \t]*\r?$"),
    "md_quote": ((">",), r"(?m)^ {0,3}> "),
    "md_list": (("- ", "* ", "+ "), r"(?m)^[ \t]*[-*+] \S"),
    "md_numbered": ((". ",), r"(?m)^[ \t]*[0-9]{1,9}\. \S"),
    "md_table": (("|",), r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*\|"),
    "wiki_link": (("[[",), r"\[\[[^\[\]\n]+\]\]"),
    "wiki_template": (("{{",), r"\{\{[^{}\s]"),
    "wiki_table": (("{|",), r"(?m)^\{\|"),
    "wiki_heading": (("==",), r"(?m)^={2,6}[ \t]*[^=\s][^=\n]*={2,6}[ \t]*\r?$"),
    "wiki_quotes": (("''",), r"'{2,5}[^'\s][^\n]*?'{2,5}"),
    "wiki_list": (("** ", "*# ", "#* "), r"(?m)^(?:[*#]+\*|\*[*#]+) \S"),
    "tex_command": (("\\",), r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"),
    "tex_item": (("\\item",), r"(?m)^[ \t]*\\item\s"),
    "tex_math": (("$", "\\[", "\\("), r"\$[^$\n]*[\\^_][^$\n]*\$|\\\[(?:[^\n\\]|\\{1,2}[^\[\]\\\n])*\\\]|\\\((?:[^\n\\]|\\{1,2}[^()\\\n])*\\\)"),
}
_COMPILED = {k: (guards, re.compile(p)) for k, (guards, p) in CONSTRUCTS.items()}


def constructs(text: str | None) -> list[str]:
    """Names of the constructs that occur in a text."""
    if not text:
        return []
    return [k for k, (guards, p) in _COMPILED.items() if any(g in text for g in guards) and p.search(text)]


# --- element subtrees ----------------------------------------------------------------------------

MIN_PAGES, SHARE = 10, 0.2
#: A subtree with less text is no template: short cells and labels recur by themselves.
MIN_TEXT = 24
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)/?>")
_KNOWN = frozenset(ELEMENTS)


#: Opening one of these ends an open element of the right, as HTML implies (fixed values).
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}} | {
    t: {"p"} for t in ("p", "div", "ul", "ol", "dl", "table", "pre", "blockquote", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "form")
}


def subtrees(text: str) -> list[tuple[int, int, int]]:
    """``(hash, start, end)`` of every closed element with enough text, inner ones first.

    Unclosed elements end where HTML implies it or an outer one closes; closing tags without an opening are
    passed over. Every tag is opened and popped once.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []  # [tag, start, parts, length of text]
    opened: dict[str, int] = {}
    at = 0

    def fold(end: int) -> str:
        top = stack.pop()
        opened[top[0]] -= 1
        if top[3] >= MIN_TEXT or stack:
            body = " ".join("\x1f".join(top[2]).split())
            digest = int.from_bytes(blake2b(f"{top[0]}\x1e{body}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            if top[3] >= MIN_TEXT:
                out.append((digest, top[1], end))
            if stack:
                stack[-1][2].append(f"\x1d{digest}\x1d")
                stack[-1][3] += top[3]
        return top[0]

    for m in _TAG.finditer(text):
        tag = m.group(2).lower()
        if tag not in _KNOWN:
            continue
        if stack and m.start() > at:
            piece = text[at : m.start()]
            stack[-1][2].append(piece)
            stack[-1][3] += len(piece.strip())
        at = m.end()
        if not m.group(1):
            ends = _ENDS.get(tag, ())
            while stack and stack[-1][0] in ends:
                fold(m.start())
            if tag not in VOID:
                stack.append([tag, m.start(), [], 0])
                opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag):
            while stack[-1][0] != tag:
                fold(m.start())
            fold(m.end())
    return out


def without(text: str, hashes: set[int]) -> str:
    """The text without the subtrees whose hash is in ``hashes``."""
    spans = sorted((a, -b) for h, a, b in subtrees(text) if h in hashes)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out.append(text[at:a])
            at = -b
    return "".join([*out, text[at:]])


#: Stands for the page itself among its subtrees, so that one pass counts both.
_PAGE = 0


def templates(pages: DataFrame, host: str, text: str) -> DataFrame:
    """``(host, hashes)``: the subtrees of each host's template. One row of ``pages`` is one page."""

    def run(batches):
        for batch in batches:
            rows, hashes = [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                own = {h for h, _, _ in subtrees(t)} | {_PAGE}
                rows += [r] * len(own)
                hashes += own
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(hashes, pa.int64())], ["host", "hash"])

    kept = pages.where(F.col(text).contains("</")).select(F.col(host).alias("host"), text)
    found = kept.mapInArrow(run, T.StructType([T.StructField("host", T.StringType()), T.StructField("hash", T.LongType())]))
    counts = found.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= MIN_PAGES)
    # per host: its pages, and its frequent subtrees; a subtree on MIN_PAGES pages is kept with its count until the share is known
    per = counts.groupBy("host").agg(F.max(F.when(F.col("hash") == _PAGE, F.col("pages"))).alias("of"))
    frequent = counts.where(F.col("hash") != _PAGE).join(per, "host").where(F.col("pages") >= SHARE * F.col("of"))
    return frequent.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


# --- conversion ----------------------------------------------------------------------------------

_MARK = "\ue000"
_FENCE = re.compile(r" {0,3}(```+|~~~+)(.*)")
#: Blocks up to their closing mark: (name, mark that closes, pattern). A text is searched up to the last closing mark only, so every try ends.
_BLOCKS = [
    ("pre", "</pre>", re.compile(r"<pre\b[^<>]*>(.*?)</pre>", re.S | re.I)),
    *(("code", f"\\end{{{e}}}", re.compile(rf"\\begin\{{{e}\}}(.*?)\\end\{{{e}\}}", re.S | re.I)) for e in ("verbatim", "lstlisting")),
    *(("code", f"</{e}>", re.compile(rf"<{e}\b[^<>]*>(.*?)</{e}>", re.S | re.I)) for e in ("nowiki", "syntaxhighlight")),
]
_FORMULAS = [
    *((f"\\end{{{e}}}", re.compile(rf"\\begin\{{{re.escape(e)}\}}(.*?)\\end\{{{re.escape(e)}\}}", re.S | re.I)) for n in ("equation", "align", "gather", "displaymath", "math") for e in (n, n + "*")),
    ("\\]", re.compile(r"\\\[(.*?)\\\]", re.S)), ("\\)", re.compile(r"\\\((.*?)\\\)", re.S)), ("$$", re.compile(r"\$\$([^$]+)\$\$")),
    ("$", re.compile(r"\$([^$\n]*[\\^_][^$\n]*)\$")), ("</math>", re.compile(r"<math\b[^<>]*>(.*?)</math>", re.S | re.I)),
]
_INLINE = re.compile(r"`([^`\n]+)`")
_DROPPED = [
    ("-->", re.compile(r"<!--.*?-->", re.S)), (">", re.compile(r"<!doctype[^<>]*>", re.I)),
    *((f"</{t}", re.compile(rf"<{t}\b[^<>]*>.*?</{t}\s*>", re.S | re.I)) for t in ("script", "style", "head", "noscript", "template")),
]
_STEPS: list[tuple[tuple[str, ...], re.Pattern, object]] = [
    # wiki
    (("{|",), re.compile(r"^\{\|[^\n]*\n?|^\|\}[^\n]*\n?|^\|-[^\n]*\n?", re.M), ""),
    (("{{",), re.compile(r"\{\{([^{}]*)\}\}"), lambda m: "\n".join(p.strip() for p in m.group(1).split("|") if p.strip())),
    (("[[",), re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]"), r"\1"),
    (("==",), re.compile(r"^(={2,6})[ \t]*([^=\s][^=\n]*?)[ \t]*={2,6}[ \t]*$", re.M), lambda m: "#" * len(m.group(1)) + " " + m.group(2)),
    (("''",), re.compile(r"'{2,5}([^'\s](?:[^\n]*?[^'\s])?)'{2,5}"), r"\1"),
    (("** ", "*# ", "#* "), re.compile(r"^([*#]+\*|\*[*#]+) (?=\S)", re.M), lambda m: "  " * (len(m.group(1)) - 1) + "- "),
    # LaTeX
    (("\\",), re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}(?:\s*\\label\{[^{}]*\})?"), r"\n# \1\n"),
    (("\\",), re.compile(r"[ \t]*\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?[ \t]*\n?"), "\n"),
    (("\\item",), re.compile(r"^[ \t]*\\item(?:\[[^\]\n]*\])?\s+", re.M), "- "),
    (("\\",), re.compile(r"~?\\(?:cite|citep|citet|ref|eqref|label|index|footnotemark)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}"), ""),
    (("\\",), re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}"), r"\1"),
    # Markdown
    (("\n",), re.compile(r"^([^\s#>|-][^\n]*)\n(=+|-{3,})[ \t]*$", re.M), lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1)),
    (("|",), re.compile(r"^[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)+(?:[ \t]*:?-+:?)?[ \t]*(?:\n|$)", re.M), ""),
    (("|",), re.compile(r"^[ \t]*[|!][ \t]*([^\n]*?)[ \t]*\|?[ \t]*$", re.M), lambda m: re.sub(r"[ \t]*(?:\|{1,2}|!!)[ \t]*", " | ", m.group(1))),
    (("---", "***", "___"), re.compile(r"^ {0,3}(?:-{3,}|\*{3,}|_{3,})[ \t]*\n?", re.M), ""),
    (("](",), re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (("[^",), re.compile(r"^\[\^[^\]\s]+\]:[ \t]*", re.M), ""),
    (("[^",), re.compile(r"\[\^[^\]\s]+\]"), ""),
    ((">",), re.compile(r"^ {0,3}(?:> ?)+", re.M), ""),
    (("* ", "+ "), re.compile(r"^([ \t]*)[*+] (?=\S)", re.M), r"\1- "),
    (("**", "__"), re.compile(r"\*\*([^\s*](?:[^*\n]*[^\s*])?)\*\*|(?<![\w_])__([^\s_](?:[^\n]*?[^\s_])?)__(?![\w_])"), lambda m: m.group(1) or m.group(2)),
    (("*", "_"), re.compile(r"(?<![\w*])\*([^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])|(?<![\w_/])_([^\s_](?:[^_\n]*[^\s_])?)_(?![\w_])"), lambda m: m.group(1) or m.group(2)),
    (("~~",), re.compile(r"~~([^\s~][^~\n]*)~~"), r"\1"),
]
_BREAK = re.compile(r"<(?:br|/p|p|/div|div|/tr|/table|table|/ul|ul|/ol|ol|/dl|section|/section|article|/article|blockquote|/blockquote|hr)\b[^<>]*>", re.I)
_HEADS = {n: re.compile(rf"<h{n}\b[^<>]*>(.*?)</h{n}\s*>", re.S | re.I) for n in "123456"}
_ITEM = re.compile(r"<(?:li|dt|dd)\b[^<>]*>", re.I)
_CELL = re.compile(r"(?<!^)<t[dh]\b[^<>]*>", re.I | re.M)
_ROW = re.compile(r"(<tr\b[^<>]*>)\s*<t[dh]\b[^<>]*>", re.I)
_ANY = re.compile(r"</?(?:" + "|".join(ELEMENTS) + r")(?:\s[^<>]*)?/?>", re.I)
_SPACE = re.compile(r"[ \t]+\n"), re.compile(r"\n{3,}")


def _closed(text: str, mark: str, pattern: re.Pattern, to) -> str:
    """The pattern's matches replaced, tried only where a closing mark is still to come."""
    low = text.lower() if mark.lower() != mark.upper() else text
    last = low.rfind(mark.lower()) if len(low) == len(text) else text.rfind(mark)  # lower case may change the length
    if last < 0:
        return text
    last = max(last + len(mark), text.find(">", last) + 1 if mark.startswith("</") else 0)
    return pattern.sub(to, text[:last]) + text[last:]


def _fenced(text: str, code) -> str:
    """Fenced code taken out line by line; a fence without an end is none."""
    lines, out = text.split("\n"), []
    ends: dict[str, list[int]] = {}
    for n, line in enumerate(lines):
        m = _FENCE.fullmatch(line)
        if m and not m.group(2).strip():
            ends.setdefault(m.group(1), []).append(n)
    n = 0
    while n < len(lines):
        m = _FENCE.fullmatch(lines[n])
        close = None
        if m:
            own = ends.get(m.group(1), [])
            k = bisect_right(own, n)
            close = own[k] if k < len(own) else None
        if close is None:
            out.append(lines[n])
            n += 1
        else:
            out.append(code("\n".join(lines[n + 1 : close])))
            n = close + 1
    return "\n".join(out)


def converted_page(text: str | None, template: set[int] | None = None) -> tuple[list[str], str | None]:
    """``(kinds, clean text)``: what was found in a text, ``site_template`` first if any was deleted, and the text without it."""
    kinds: list[str] = []
    if text and template and "</" in text:
        rest = without(text, template)
        if rest != text:
            kinds, text = ["site_template"], rest
    found = constructs(text)
    return kinds + found, _clean(text) if found else text.strip() if kinds else text


def clean(text: str | None, template: set[int] | None = None) -> str | None:
    """The text without markup. ``template``: hashes of subtrees to delete first."""
    return converted_page(text, template)[1]


def _clean(text: str) -> str:
    text = text.replace("\r\n", "\n").replace(_MARK, "")
    kept: list[str] = []

    def keep(content: str) -> str:
        kept.append(content)
        return f"{_MARK}{len(kept) - 1}{_MARK}"

    def code(body: str) -> str:
        return keep("\n```\n" + body.strip("\n") + "\n```\n")

    def formula(m: re.Match) -> str:
        return keep("$" + " ".join(m.group(1).split()) + "$")

    if "```" in text or "~~~" in text:
        text = _fenced(text, code)
    if "</" in text or "\\end{" in text:
        for name, mark, pattern in _BLOCKS:
            text = _closed(text, mark, pattern, (lambda m: code(html.unescape(_ANY.sub("", m.group(1))))) if name == "pre" else lambda m: code(m.group(1)))
    if "`" in text:
        text = _INLINE.sub(lambda m: keep(m.group(1)), text)
    if "$" in text or "\\" in text or "</math" in text:
        for mark, pattern in _FORMULAS:
            text = _closed(text, mark, pattern, formula)
    if "&lt;" in text:
        text = _ESCAPED.sub(r"<\1>", text)
    if "\n# " in text:
        text = _numbered(text)
    if "<" in text:
        for mark, pattern in _DROPPED:
            text = _closed(text, mark, pattern, "")
        for n in "123456":
            text = _closed(text, f"</h{n}", _HEADS[n], lambda m, n=n: "\n" + "#" * int(n) + " " + " ".join(_ANY.sub("", m.group(1)).split()) + "\n")
        text = _CELL.sub(" | ", _ROW.sub(r"\1", text))
        text = _ANY.sub("", _ITEM.sub("\n- ", _BREAK.sub("\n", text)))
    for guards, pattern, to in _STEPS:
        if any(g in text for g in guards):
            text = pattern.sub(to, text)
    if "&" in text:
        text = _unescape(text)
    while _MARK in text and kept:
        text = re.sub(f"{_MARK}(\\d+){_MARK}", lambda m: kept[int(m.group(1))], text)
    text = _SPACE[1].sub("\n\n", _SPACE[0].sub("\n", text))
    return text.strip()


#: Tags that were escaped as a whole page would be: they are markup twice over.
_ESCAPED = re.compile(r"&lt;(/?(?:p|div|span|br|b|i|em|strong|h[1-6]|ul|ol|li|table|tr|td|th|a|pre|code|blockquote)(?:\s[^<>&]*)?/?)&gt;", re.I)


def _numbered(text: str) -> str:
    """``# item`` right after a wiki list line is an item, not a heading."""
    lines, listed = text.split("\n"), False
    for k, line in enumerate(lines):
        if listed and line.startswith("# "):
            lines[k] = "- " + line[2:]
        else:
            listed = line.startswith(("* ", "** ", "#* ", "*# "))
    return "\n".join(lines)


def _unescape(text: str) -> str:
    for _ in range(3):  # references of references, as nested escaping leaves them
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    return text.replace("\xa0", " ")


#: So many hashes of all hosts' templates are broadcast (8 bytes each); more meet their pages by a join.
HASHES_BROADCAST = 1_000_000


def converted(pages: DataFrame, keys: list[str], host: str, text: str, hashes_broadcast: int = HASHES_BROADCAST) -> DataFrame:
    """``(keys, kinds, clean)``: what was found in each text and its clean form, template removed."""
    found = cut(templates(pages, host, text))
    size = found.agg(F.sum(F.size("hashes")).alias("n")).first()["n"] or 0
    if size == 0:
        paired = pages.withColumn("__hashes", F.lit(None).cast("array<bigint>"))
    else:
        named = found.select(F.col("host").alias(host), F.col("hashes").alias("__hashes"))
        paired = pages.join(F.broadcast(named), host, "left") if size <= hashes_broadcast else unique_lookup(pages, named, [host], "left")

    def run(batches):
        for batch in batches:
            texts, hashes = (batch.column(len(keys) + k).to_pylist() for k in range(2))
            made = [converted_page(t, set(h) if h else None) for t, h in zip(texts, hashes)]
            kinds, out = pa.array([k for k, _ in made], pa.list_(pa.string())), pa.array([c for _, c in made], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), kinds, out], [*keys, "kinds", "clean"])

    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType())])
    return paired.select(*keys, text, "__hashes").mapInArrow(run, schema)
