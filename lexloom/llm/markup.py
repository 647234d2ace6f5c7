"""Turning pages of HTML, Markdown, wiki text or LaTeX into clean text that keeps headings, lists, code and formulas.

The site's own parts of HTML pages are found by deducing each host's template from its pages: text and tag tokens that
occur equally often in the very same pages form a class; a class of several tokens over pages of enough subjects is
valid if its tokens keep one order and it nests with the others. The valid classes are the template; what lies in the
slots between their tokens is the page's content.
"""

from __future__ import annotations

import codecs
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize, small_batches, spread

KINDS = ("heading", "list_item", "code", "formula")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_META = re.compile(rb"<meta[^>]{0,200}charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def decode(body: bytes | None, content_type: str | None) -> str | None:
    """The text of a body: by its byte order mark, as UTF-8, by the charset it or its header names, or by what reads best."""
    if body is None:
        return None
    body = bytes(body)
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    if body.count(0) * 3 > len(body):
        return body.decode("utf-16-le" if body[1:2] == b"\0" else "utf-16-be", "replace")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        pass
    named = [m[1] for m in [_CHARSET.search(content_type or "")] if m] + [m[1].decode("ascii", "ignore") for m in [_META.search(body)] if m]
    for name in named:
        try:
            if codecs.lookup(name).name != "iso8859-1":
                return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    best, score = body.decode("latin-1"), 0.0
    for name in ("cp1251", "koi8-r", "gb18030", "big5", "cp1258", "cp874"):
        try:
            t = body.decode(name)
        except UnicodeDecodeError:
            continue
        strange = [c for c in t if ord(c) > 127]
        good = sum("а" <= c <= "я" or "一" <= c <= "鿿" or c in "ОПРСТАВ，。（）" for c in strange) / max(1, len(strange))
        if good > max(0.8, score):
            best, score = t, good
    return best


# ---- formulas in running text -------------------------------------------------------------------------------------

_MATH = re.compile(r"(?<!\\)\$\$(?=\S|\s*\n)(.+?)(?<!\\)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s\\$])\$(?![\d$])", re.S)


def formulas(text: str) -> list[str]:
    """The formulas between dollars or backslashed brackets, in a line or displayed; amounts of money are none."""
    return [next(g for g in m.groups() if g is not None).strip() for m in _MATH.finditer(text)]


# ---- HTML ---------------------------------------------------------------------------------------------------------

_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "wbr", "source", "track", "embed", "param"}
_BLOCK = {
    "p", "div", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "body", "html", "pre", "blockquote", "dl", "dt", "dd", "form",
    "nav", "header", "footer", "aside", "figure", "center", "br", "hr", "thead", "tbody",
}
_UNSEEN = {"script", "style", "head", "noscript", "template", "title", "select", "iframe", "svg"}
#: What counts as the site's own on hosts that have too few pages for a template, beside the template.
_SITE = {"nav", "header", "footer", "aside"}
_SITE_ROLES = {"navigation", "banner", "contentinfo", "search", "complementary"}
_PRE = {"pre", "listing", "xmp"}
_LISTS = {"ul", "ol", "menu"}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}

# a comment, a marked section, a declaration, or a tag whose quoted values may hold ">"; else a tag with open quotes
_MARK = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:.-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:.-]*)([^>]*)>", re.S)
_ROLE = re.compile(r"(?:^|\s)(role|aria-level)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style")}
_NAME_END = re.compile(r"[^\w:-]")


def token_digest(token: str) -> int:
    """A token of a page as a number; tokens of texts are odd, those of tags even."""
    n = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return n & ~1 if token[0] == "<" else n | 1


class Part:
    """A part of a page: its kind, level and text, the places of its tokens, and whether it lies in a site element."""

    __slots__ = ("at", "kind", "level", "pieces", "site")

    def __init__(self, kind: str, level: int, site: bool, at: list[int]):
        self.kind, self.level, self.site, self.at, self.pieces = kind, level, site, at, []

    @property
    def text(self) -> str:
        s = "".join(self.pieces)
        return s.strip("\n") if self.kind == "code" else " ".join(s.split())


class Page:
    """Walks a page once and gives its tokens in order and its parts, each with the places of its tokens.

    A part's `at` are the places of the texts in it, or of its own tag where it has none.
    """

    def __init__(self, text: str):
        self.tokens: list[str] = []  # <path> of a tag, path|text of a text; the path has all tags around it
        self.parts: list[Part] = []
        self.stack: list[tuple[str, str, bool, bool]] = []  # tag, path, content left out, site element
        self.out = self.site = self.pre = self.code = self.math = self.lists = 0
        self.open: list[tuple[int, Part, int]] = []  # depth of the stack, part, place of its tag
        self.run: list[str] = []
        self.sums: list[str] = []  # as run, without code in the line
        self.run_at: list[int] = []
        self._feed(text)
        self._pop(0)

    def _feed(self, text: str) -> None:
        pos, n = 0, len(text)
        while pos < n:
            m = _MARK.search(text, pos)
            if m is None:
                self._data(text[pos:])
                return
            if m.start() > pos:
                self._data(text[pos : m.start()])
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag = _NAME_END.split(name.lower(), maxsplit=1)[0]
            if m[1] or m[4]:
                self._end(tag)
                continue
            rest = (m[3] if m[2] else m[6]) or ""
            if not (rest.endswith("/") and tag not in _VOID):
                self._start(tag, rest)
            if tag in _RAW_END:
                end = _RAW_END[tag].search(text, pos)
                pos = end.start() if end else n

    def _flush(self) -> None:
        if not self.run:
            return
        text, sums, at = "".join(self.run), "".join(self.sums), self.run_at
        self.run, self.sums, self.run_at = [], [], []
        if "$" in sums or "\\" in sums:
            for f in formulas(sums):
                self.parts.append(Part("formula", 0, False, []))
                self.parts[-1].pieces.append(f)
        if not self.open and text.strip():
            self.parts.append(Part("text", 0, bool(self.site), at))
            self.parts[-1].pieces.append(text)

    def _start(self, tag: str, rest: str) -> None:
        if tag in ("h1", "p", "body") and any(s[0] == "head" for s in self.stack):
            self._end("head")  # a head that was never closed
        if tag in _BLOCK:
            self._flush()
        if tag in _VOID:
            if tag == "br":
                self.run.append("\n")
                self.sums.append("\n")
            return
        if tag == "li":  # an item that was never closed ends with the next of its list
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "li":
                    self._pop(i)
                    break
                if self.stack[i][0] in _LISTS:
                    break
        elif tag in _BLOCK and self.stack and self.stack[-1][0] == "p":
            self._pop(len(self.stack) - 1)
        about = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ROLE.finditer(rest)} if "ole" in rest or "OLE" in rest else {}
        role = about.get("role", "").lower()
        hide, site = tag in _UNSEEN, tag in _SITE or role in _SITE_ROLES
        path = f"{self.stack[-1][1] if self.stack else ''}>{tag}"
        self.stack.append((tag, path, hide, site))
        here = len(self.tokens)
        self.tokens.append(f"<{path}>")
        self.out += hide
        self.site += site
        if self.out:
            return
        if tag == "ul" or tag == "ol":
            self.lists += 1
        if tag in _PRE:
            self.pre += 1
            if self.pre == 1:
                self._begin("code", 0, here)
        elif self.pre:
            return
        elif tag == "math":
            self.math += 1
            if self.math == 1:
                self._begin("formula", 0, here)
        elif tag == "code":
            self.code += 1
        elif tag in _HEADINGS:
            self._begin("heading", _HEADINGS[tag], here)
        elif role == "heading":
            level = about.get("aria-level", "2")
            self._begin("heading", int(level) if level.isdigit() else 2, here)
        elif tag == "li":
            self._begin("list_item", self.lists, here)

    def _begin(self, kind: str, level: int, here: int) -> None:
        self.parts.append(Part(kind, level, bool(self.site), []))
        self.open.append((len(self.stack), self.parts[-1], here))

    def _pop(self, depth: int) -> None:
        """Closes the element at a depth and all within it."""
        self._flush()
        while len(self.stack) > depth:
            tag, _, hide, site = self.stack[-1]
            while self.open and self.open[-1][0] >= len(self.stack):
                _, part, here = self.open.pop()
                if not part.at:
                    part.at = [here]
            self.stack.pop()
            self.out -= hide
            self.site -= site
            if not self.out and not hide:
                if tag in _PRE and self.pre:
                    self.pre -= 1
                elif tag == "math" and self.math:
                    self.math -= 1
                elif tag == "code" and self.code and not self.pre:
                    self.code -= 1
                elif (tag == "ul" or tag == "ol") and self.lists:
                    self.lists -= 1

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
            if self.stack[i][0] in ("table", "body") and tag in ("p", "b", "em", "span", "a"):
                return

    def _data(self, raw: str) -> None:
        data = html.unescape(raw) if "&" in raw else raw
        text = " ".join(data.split())
        here = len(self.tokens)
        if text:
            self.tokens.append(f"{self.stack[-1][1] if self.stack else ''}|{text}")
        if self.out:
            return
        for _, part, _ in self.open:
            part.pieces.append(data)
            if text:
                part.at.append(here)
        if not self.pre and not self.math:
            self.run.append(data)
            self.sums.append(" " if self.code else data)
            if text:
                self.run_at.append(here)


def parse_html(text: str, template: set[str] | frozenset[str] = frozenset()) -> list[tuple[str, int, str]]:
    """(kind, level, text) of a page's parts in order, without those whose tokens a template has; kinds are text,
    heading, list_item, code and formula. Without a template, site elements are left out."""
    page = Page(text)
    known = [t in template for t in page.tokens]
    hide = lambda p: all(known[i] for i in p.at) if template else p.site
    return [(p.kind, p.level, p.text) for p in page.parts if not p.at or p.kind == "code" or not hide(p)]


def html_tokens(text: str) -> Counter:
    """How often each token of a page occurs: tags and texts, each with the tags around it."""
    return Counter(Page(text).tokens)


# ---- line-based markup --------------------------------------------------------------------------------------------

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_BULLET = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(\S.*)$")
_INLINE_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)


def _plain_markdown(s: str) -> str:
    s = _INLINE_CODE.sub(lambda m: m[2].strip(), s)
    s = re.sub(r"!?\[([^\]]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", r"\1", s)
    s = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", s)
    s = re.sub(r"(?<![\w*])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])(.+?)(?<=[^\s_])_(?![\w_])", lambda m: m[1] or m[2], s)
    return html.unescape(re.sub(r"\\([\\`*_{}\[\]()#+.!$|>~-])", r"\1", _INLINE_TAG.sub("", s)))


def parse_markdown(text: str) -> list[tuple[str, int, str]]:
    """As parse_html, of Markdown."""
    out: list[tuple[str, int, str]] = []
    lines = re.sub(r"<!--.*?-->", "", text.replace("\r\n", "\n").replace("\r", "\n"), flags=re.S).split("\n")
    para: list[str] = []
    in_list = False

    def flush() -> None:
        if para:
            whole = "\n".join(para)
            out.extend(("formula", 0, f) for f in formulas(_INLINE_CODE.sub(" ", whole)))
            shown = " ".join(_plain_markdown(whole).split())
            if shown:
                out.append(("text", 0, shown))
            para.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        bare = re.sub(r"^(?:\s{0,3}>\s?)+", "", line)
        if m := _FENCE.match(bare.lstrip() if in_list else bare):
            flush()
            mark, block = m[1], []
            i += 1
            while i < len(lines) and not re.match(rf"^\s*{re.escape(mark[0])}{{{len(mark)},}}\s*$", re.sub(r"^(?:\s{0,3}>\s?)+", "", lines[i])):
                block.append(lines[i])
                i += 1
            out.append(("code", 0, "\n".join(block)))
        elif not bare.strip():
            flush()
        elif re.match(r"^ {4,}\S|^\t\S", line) and not para and not in_list:
            block = []
            while i < len(lines) and (re.match(r"^ {4,}|^\t", lines[i]) or not lines[i].strip()):
                block.append(lines[i])
                i += 1
            out.append(("code", 0, "\n".join(block).strip("\n")))
            continue
        elif m := _ATX.match(bare):
            flush()
            in_list = False
            title = m[2] or ""
            out.append(("heading", len(m[1]), _plain_markdown(title)))
            out.extend(("formula", 0, f) for f in formulas(_INLINE_CODE.sub(" ", title)))
        elif re.match(r"^ {0,3}(=+|-+)\s*$", bare) and para and not in_list:
            title = " ".join(para)
            para.clear()
            out.append(("heading", 1 if "=" in bare else 2, _plain_markdown(title)))
            out.extend(("formula", 0, f) for f in formulas(_INLINE_CODE.sub(" ", title)))
        elif re.match(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$", bare):
            flush()
        elif bare.strip() == "$$":
            flush()
            block = []
            i += 1
            while i < len(lines) and lines[i].strip() != "$$":
                block.append(lines[i])
                i += 1
            out.append(("formula", 0, "\n".join(block)))
        elif m := _BULLET.match(bare):
            flush()
            in_list = True
            out.append(("list_item", 1 + len(m[1].expandtabs(4)) // 2, _plain_markdown(m[2])))
            out.extend(("formula", 0, f) for f in formulas(_INLINE_CODE.sub(" ", m[2])))
        else:
            if not line.startswith(" "):
                in_list = False
            para.append(bare)
        i += 1
    flush()
    return out


_WIKI_CODE = re.compile(r"<(syntaxhighlight|source|pre)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)


def _innermost(pattern: str, by: str, s: str) -> str:
    """Replaces what a pattern finds, from the inside out, until nothing is left to replace."""
    n = 1
    while n:
        s, n = re.subn(pattern, by, s)
    return s


def _plain_wiki(s: str) -> str:
    s = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", "", s, flags=re.S | re.I)
    s = _innermost(r"\{\{[^{}]*\}\}", "", s)
    s = re.sub(r"\[\[(?:File|Image):[^\]]*\]\]", "", s, flags=re.I)
    s = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[https?://\S+\s+([^\]]*)\]", r"\1", s)
    return html.unescape(_INLINE_TAG.sub("", re.sub(r"'{2,5}", "", s)))


def parse_wiki(text: str) -> list[tuple[str, int, str]]:
    """As parse_html, of wiki text."""
    text = re.sub(r"<!--.*?-->", "", text.replace("\r\n", "\n").replace("\r", "\n"), flags=re.S)
    text = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: html.escape(m[1]).replace("=", "&#61;").replace("*", "&#42;").replace("#", "&#35;"), text, flags=re.S | re.I)
    held: list[tuple[str, str]] = []

    def hold(kind: str, value: str) -> str:
        held.append((kind, value))
        return f"\x00{len(held) - 1}\x00"

    text = _WIKI_CODE.sub(lambda m: "\n" + hold("code", m[2].strip("\n")) + "\n", text)
    text = re.sub(r"<math\b[^>]*>(.*?)</math\s*>", lambda m: hold("formula", m[1].strip()), text, flags=re.S | re.I)
    out: list[tuple[str, int, str]] = []
    for line in text.split("\n"):
        marks = [held[int(k)] for k in re.findall("\x00(\\d+)\x00", line)]
        bare = re.sub("\x00\\d+\x00", " ", line)
        if m := re.match(r"^\s*(={1,6})\s*(.+?)\s*={1,6}\s*$", bare):
            out.append(("heading", len(m[1]), _plain_wiki(m[2])))
        elif m := re.match(r"^([*#:;]*[*#])\s*(.*)$", bare):
            out.append(("list_item", len(m[1]), _plain_wiki(m[2])))
        elif not re.match(r"^\s*(\{\||\|\}|\|-)", bare):
            shown = " ".join(_plain_wiki(re.sub(r"^[:;|!]+", "", bare).replace("||", " ")).split())
            if shown:
                out.append(("text", 0, shown))
        out.extend((kind, 0, value) for kind, value in marks)
    return out


_TEX_CODE = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|alltt|Verbatim)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_TEX_MATH = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math|alignat|flalign)(\*?)\}(.*?)(?:\\end\{\1\2\}|\Z)", re.S)
_TEX_PIECE = re.compile(
    "\x00(\\d+)\x00|\\\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)(\\*?)\\s*(?:\\[[^\\]]*\\])?\\s*\\{((?:[^{}]|\\{(?:[^{}]|\\{[^{}]*\\})*\\})*)\\}|\\\\begin\\{(itemize|enumerate|description)\\}|\\\\end\\{(itemize|enumerate|description)\\}|\\\\item(?![a-zA-Z])(?:\\s*\\[[^\\]]*\\])?"
)
_TEX_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


def _plain_tex(s: str) -> str:
    s = re.sub("\x00\\d+\x00", " ", s)
    s = re.sub(r"\\(?:label|ref|cite|pageref|index)\{[^}]*\}", "", s)
    s = re.sub(r"\\footnote\{((?:[^{}]|\{[^{}]*\})*)\}", "", s)
    s = _innermost(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?", " ", s)
    s = re.sub(r"\\\\|&(?!\w)|~", " ", s)
    return re.sub(r"\\([%$&#_{}])", r"\1", re.sub(r"\\[a-zA-Z]+\*?\s?", "", s))


def parse_latex(text: str) -> list[tuple[str, int, str]]:
    """As parse_html, of LaTeX; what stands before \\begin{document} and after its end is left out."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if (a := text.find("\\begin{document}")) >= 0:
        text = text[a + len("\\begin{document}") :]
    held: list[tuple[str, str]] = []

    def hold(kind: str, value: str) -> str:
        held.append((kind, value.strip()))
        return f"\x00{len(held) - 1}\x00"

    text = _TEX_CODE.sub(lambda m: hold("code", m[2].strip("\n")), text)
    text = text.split("\\end{document}")[0]
    text = re.sub(r"(?<!\\)%.*", "", text)
    text = _TEX_MATH.sub(lambda m: hold("formula", m[3]), text)
    text = _MATH.sub(lambda m: hold("formula", next(g for g in m.groups() if g is not None)), text)
    out: list[tuple[str, int, str]] = []
    depth, item, last = 0, None, 0

    def say(s: str) -> None:
        shown = [" ".join(p.split()) for p in re.split(r"\n\s*\n", _plain_tex(s))]
        for p in filter(None, shown):
            if item is not None and out[item][2] == "":
                out[item] = (out[item][0], out[item][1], p)
            else:
                out.append(("text", 0, p))

    for m in _TEX_PIECE.finditer(text):
        say(text[last : m.start()])
        last = m.end()
        if m[1] is not None:
            out.append((*held[int(m[1])][:1], 0, held[int(m[1])][1]))
        elif m[2]:
            out.append(("heading", _TEX_LEVEL[m[2]], " ".join(_plain_tex(m[4]).split())))
            out.extend((held[int(k)][0], 0, held[int(k)][1]) for k in re.findall("\x00(\\d+)\x00", m[4]))
            item = None
        elif m[5]:
            depth += 1
        elif m[6]:
            depth, item = max(0, depth - 1), None
        else:
            out.append(("list_item", max(1, depth), ""))
            item = len(out) - 1
    say(text[last:])
    return out


# ---- which markup -------------------------------------------------------------------------------------------------

_HTML_SIGN = re.compile(r"</(?:h[1-6]|p|li|ul|ol|div|td|tr|table|body|html|head|title|footer|nav|header)\s*>|<(?:!doctype|html|body|head)\b", re.I)
_HTML_OPEN = re.compile(r"<(?:p|li|h[1-6]|ul|ol|div|br)\b[^<>]*>", re.I)
_ESCAPED = re.compile(r"&lt;/?(?:html|body|head|h[1-6]|p|li|ul|ol|div|table)\b", re.I)
_FENCED = re.compile(r"(?ms)^\s{0,3}(```+|~~~+).*?^\s{0,3}\1\s*$")
_TEX_SIGN = re.compile(r"\\documentclass|\\begin\{[a-z*]+\}|^\s*\\(?:sub)*(?:section|paragraph)\*?\{|^\s*\\chapter\*?\{", re.M)
_WIKI_SIGN = re.compile(r"^\s*={1,6}[^=\n].*?={1,6}\s*$|^\{\||\[\[[^\]\n]+\]\]|<syntaxhighlight|<ref\b|<math>|'''|\{\{[a-z]+\|", re.M | re.I)
_MD_SIGN = re.compile(r"^ {0,3}#{1,6}\s+\S|^(?:```|~~~)|^\S.*\n(?:={4,}|-{4,})\s*$|^ {0,3}[-*+]\s+\S|^\|.*\|\s*$|^\$\$|\*\*\S|\]\(\S+\)|^> |`[^`\n]+`|^ {0,3}\d{1,3}\.\s+\S|^\\\[|\\\(.+?\\\)", re.M)


def sniff(text: str) -> tuple[str, str]:
    """(kind, text): html, latex, wiki, markdown or plain, and the text to parse. HTML whose tags were escaped once too
    often is put right; code blocks of one markup that show another do not decide."""
    text = text.lstrip("\ufeff")
    if len(_ESCAPED.findall(text)) > 2 and not re.match(r"\s*<", text) and len(_HTML_SIGN.findall(text)) == 0:
        return "html", html.unescape(text)
    bare = _TEX_CODE.sub(" ", _WIKI_CODE.sub(" ", _FENCED.sub(" ", text)) if not re.match(r"\s*<", text) else text)
    if _HTML_SIGN.search(bare) or len(_HTML_OPEN.findall(bare)) >= 3 and not _WIKI_SIGN.search(bare):
        return "html", text
    if _TEX_SIGN.search(_FENCED.sub(" ", text)) and not re.search(r"(?m)^={2,6}[^=\n]+={2,6}\s*$|^#{1,6} \S", bare):
        return "latex", text
    if _WIKI_SIGN.search(bare):
        return "wiki", text
    if _MD_SIGN.search(text):
        return "markdown", text
    if re.search(r"</(?:b|i|em|strong|span|a|u|code|sup|sub|font|small)\s*>|<br\s*/?>", text, re.I):
        return "html", text
    return "plain", text


def read_page(text: str | None) -> tuple[str, list[Part], list[str]]:
    """(kind of markup, parts, tokens) of a page; a null, empty or blank page is plain and has no parts, and only HTML has tokens."""
    if not text or not text.strip():
        return "plain", [], []
    kind, text = sniff(text)
    if kind == "html":
        page = Page(text)
        return kind, page.parts, page.tokens
    if kind == "plain":
        found = [("text", 0, p) for p in re.split(r"\n\s*\n", text) if p.strip()]
    else:
        found = {"latex": parse_latex, "wiki": parse_wiki, "markdown": parse_markdown}[kind](text)
    parts = []
    for k, level, t in found:
        parts.append(Part(k, level, False, []))
        parts[-1].pieces.append(t)
    return kind, parts, []


def parse(text: str | None) -> tuple[str, list[tuple[str, int, str]]]:
    """(kind of markup, parts) of a page by itself: site elements are left out, as there is no template."""
    kind, parts, _ = read_page(text)
    return kind, [(p.kind, p.level, p.text) for p in parts if not p.site or not p.at or p.kind == "code"]


def clean_text(parts: list[tuple[str, int, str]]) -> str:
    """Clean text in which headings (#), list items (-), code (fenced) and formulas ($$) can still be told apart."""
    show = {"heading": lambda n, t: f"{'#' * max(1, n)} {t}", "list_item": lambda n, t: f"{'  ' * (max(1, n) - 1)}- {t}", "code": lambda n, t: f"```\n{t}\n```", "formula": lambda n, t: f"$${t}$$", "text": lambda n, t: t}
    return "\n".join(show[k](n, t) for k, n, t in parts)


# ---- operators ----------------------------------------------------------------------------------------------------


def _host(c):
    return F.coalesce(F.lower(F.regexp_extract(c, r"^[a-zA-Z][\w+.-]*://([^/?#:]+)", 1)), F.lit(""))


def _subject(parts: list[Part], tokens: list[str]) -> int:
    """What a page is about, as a number: its title and its headings of the highest level."""
    levels = [p.level for p in parts if p.kind == "heading"]
    said = [t for t in tokens if ">title|" in t] + [p.text for p in parts if p.kind == "heading" and p.level == min(levels)]
    return token_digest("|" + "\n".join(said))


#: In how many pages and subjects of a host, and in what share of them, a class must be to belong to the template.
LEAST_PAGES, LEAST_SHARE = 5, 0.04

READ = "host string, page long, subject long, markup string, kind array<string>, level array<int>, said array<string>, at array<array<int>>, site array<boolean>, tokens array<long>"


def read_pages(pages: DataFrame) -> DataFrame:
    """One row for each raw page with url, final_url, html, body and content_type, read once and written: fetch_id, host,
    a number that equal texts share, its subject, its markup, and its parts and tokens as parallel arrays.

    html goes before body. `at` has the places in `tokens` of each part's texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.bool_()), pa.list_(pa.int64())]
        names = ["host", "page", "subject", "markup", "kind", "level", "said", "at", "site", "tokens"]
        for b in small_batches(batches):
            rows = []
            for host, page, body, about in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                text = page if page is not None else decode(body, about)
                markup, parts, tokens = read_page(text)
                rows.append((
                    host, token_digest("|" + (text or "")), _subject(parts, tokens), markup, [p.kind for p in parts], [p.level for p in parts], [p.text for p in parts],
                    [p.at if p.kind != "code" else [] for p in parts], [p.site and p.kind != "code" for p in parts], [token_digest(t) for t in tokens],
                ))
            cols = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["fetch_id", *names])

    kind = pages.schema["fetch_id"].dataType.simpleString()
    raw = pages.select("fetch_id", _host(F.coalesce("final_url", "url")).alias("host"), "html", "body", "content_type")
    return materialize(spread(raw).mapInArrow(run, f"fetch_id {kind}, {READ}"), "p2-read")


def nest(found: list[tuple[int, int, int]]) -> dict[int, tuple[int, bool, int, int, list[int]]]:
    """How the classes stand in one page, of (place, token, class) in page order: (digest of the order of the class's
    tokens, whether it is whole and nested, class around it, gap of that class, places) by class.

    A class is whole if its tokens come in one order, again and again; it is nested if no other class begins before
    it and ends within it, and if it always lies in the same gap between two tokens of the class around it.
    """
    order: dict[int, list[int]] = {}
    places: dict[int, list[int]] = {}
    for place, token, c in found:
        order.setdefault(c, []).append(token)
        places.setdefault(c, []).append(place)
    size = {c: len(set(o)) for c, o in order.items()}
    bad = {c for c, o in order.items() if o != o[: size[c]] * (len(o) // size[c])}
    around: dict[int, tuple[int, int]] = {}
    stack: list[list[int]] = []  # class, tokens seen
    for _, _, c in found:
        if c in bad:
            continue
        if any(s[0] == c for s in stack):
            while stack[-1][0] != c:
                bad.add(stack.pop()[0])
            stack[-1][1] += 1
        else:
            where = (stack[-1][0], stack[-1][1]) if stack else (0, 0)
            if around.setdefault(c, where) != where:
                bad.add(c)
            stack.append([c, 1])
        if stack[-1][1] == size[c]:
            stack.pop()
    return {c: (token_digest("|" + " ".join(map(str, o[: size[c]]))), c not in bad, *around.get(c, (0, 0)), places[c]) for c, o in order.items()}


PLACED = "host string, page long, subject long, class long, sequence long, fits boolean, around long, gap int, at array<int>"


def placed_classes(read: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, page, subject, class, sequence, fits, around, gap, at): how each equivalence class stands in each page.

    Every distinct page of a host gives its tokens and how often each occurs; tokens whose occurrence vectors over the
    host's pages are the same form a class. Kept are classes of at least two tokens, a text among them, that occur in
    at least `least_pages` pages and `least_share` of the host's. Vectors are compared by digests that are summed on
    the map side, so a host with a third of all pages is no larger to a task than any other; what is gathered is the
    tokens of one page.
    """
    n = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = read.where("size(tokens) > 0").select("host", "page", "subject", "tokens").repartition(n, "host", "page").dropDuplicates(["host", "page"])
    counts = distinct.select("host", "page", F.explode("tokens").alias("token")).groupBy("host", "page", "token").agg(F.count("*").alias("n"))
    vector = counts.groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("class"), F.sum(F.xxhash64("n", "page") % 1000003).alias("check"))
    total = distinct.groupBy("host").agg(F.count("*").alias("all"))
    classes = vector.groupBy("host", "pages", "class", "check").agg(F.count("*").alias("size"), F.sum(F.abs(F.col("token") % 2)).alias("texts"))
    kept = classes.join(total, "host").where((F.col("size") >= 2) & (F.col("texts") > 0) & (F.col("pages") >= F.greatest(F.lit(float(least_pages)), F.col("all") * least_share)))
    member = vector.join(kept.select("host", "pages", "class", "check"), ["host", "pages", "class", "check"]).select("host", "token", "class")
    tokens = distinct.select("host", "page", "subject", F.posexplode("tokens").alias("place", "token")).join(member, ["host", "token"])
    by_page = tokens.groupBy("host", "page", "subject").agg(F.sort_array(F.collect_list(F.struct("place", "token", "class"))).alias("found"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for host, page, subject, found in zip(f["host"], f["page"], f["subject"], f["found"]):
                for c, (sequence, fits, around, gap, at) in nest([(x["place"], x["token"], x["class"]) for x in found]).items():
                    rows.append((host, page, subject, c, sequence, fits, around, gap, at))
            yield pd.DataFrame(rows, columns=["host", "page", "subject", "class", "sequence", "fits", "around", "gap", "at"])

    return materialize(by_page.mapInPandas(run, PLACED), "p2-classes")


def valid_classes(placed: DataFrame, read: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, class, around, gap, pages): the classes that make up each host's template, nested in one another.

    Valid is a class that is whole and nested in every page it is in, has one order and, within each class around it,
    one gap, and is found in pages of at least `least_pages` subjects and `least_share` of the host's subjects: what
    only the versions of one law share is no template. `around` is the class around it in most pages (0: none).
    """
    subjects = read.where("size(tokens) > 0").groupBy("host").agg(F.countDistinct("subject").alias("all"))
    whole = placed.groupBy("host", "class").agg(F.min("fits").alias("fits"), F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.countDistinct("subject").alias("subjects"), F.count("*").alias("pages"))
    where = placed.groupBy("host", "class", "around").agg(F.min("gap").alias("gap"), F.max("gap").alias("last"), F.count("*").alias("n"))
    steady = where.groupBy("host", "class").agg(F.min(F.col("gap") == F.col("last")).alias("steady"), F.max_by(F.struct("around", "gap"), F.struct("n", "around")).alias("w"))
    ok = whole.join(subjects, "host").join(steady, ["host", "class"]).where("fits and a = b and steady").where(F.col("subjects") >= F.greatest(F.lit(float(least_pages)), F.col("all") * least_share))
    return ok.select("host", "class", "w.around", "w.gap", "pages")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, class, around, gap, pages): the template of each host of raw pages, as `valid_classes` gives it."""
    read = read_pages(pages)
    return valid_classes(placed_classes(read, least_pages, least_share), read, least_pages, least_share)


def page_parts(pages: DataFrame) -> DataFrame:
    """(fetch_id, markup, parts ARRAY<STRUCT<kind, seq, level, text>>, clean) of every raw page.

    `markup` is html, markdown, wiki, latex or plain; seq counts within a kind in page order. What the host's template
    holds is left out (a part all of whose texts stand at places of valid classes), as are comments, scripts, styles
    and heads. Only on hosts with too few subjects for every variant of a template to show (LEAST_PAGES / LEAST_SHARE),
    what stands in elements and roles of navigation, banners and footers is left out too. Pages that are null, empty or blank are plain and have no parts; repeated rows
    give repeated results.
    """
    read = read_pages(pages)
    shown = _shown(read, ["level", "said"])
    parts = F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), p["seq"].alias("seq"), p["level"].alias("level"), p["said"].alias("text")))
    show = lambda p: (
        F.when(p["kind"] == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), p["level"])), F.lit(" "), p["said"]))
        .when(p["kind"] == "list_item", F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(1), p["level"]) - 1), F.lit("- "), p["said"]))
        .when(p["kind"] == "code", F.concat(F.lit("```\n"), p["said"], F.lit("\n```")))
        .when(p["kind"] == "formula", F.concat(F.lit("$$"), p["said"], F.lit("$$")))
        .otherwise(p["said"])
    )
    return shown.select("fetch_id", "markup", parts.alias("parts"), F.array_join(F.transform("parts", show), "\n").alias("clean"))


def page_elements(pages: DataFrame) -> DataFrame:
    """(fetch_id, markup, parts ARRAY<STRUCT<i, kind, seq>>) of every raw page, as `page_parts` without the texts."""
    return _shown(read_pages(pages), [])


def _shown(read: DataFrame, fields: list[str]) -> DataFrame:
    """The pages of `read` with their parts that no template holds, numbered within each kind, in page order."""
    placed = placed_classes(read)
    valid = materialize(valid_classes(placed, read), "p2-valid")
    hidden = placed.join(valid.select("host", "class"), ["host", "class"], "left_semi").groupBy("host", "page").agg(F.flatten(F.collect_list("at")).alias("hidden"))
    large = read.where("size(tokens) > 0").groupBy("host").agg((F.countDistinct("subject") * LEAST_SHARE >= LEAST_PAGES).alias("large"))
    joined = read.join(hidden, ["host", "page"], "left").join(large, "host", "left")
    held = lambda p: F.coalesce(F.forall(p["at"], lambda i: F.array_contains("hidden", i)), F.lit(False)) | (~F.col("large") & p["site"])
    zipped = F.arrays_zip("kind", "at", "site", *fields)
    kept = F.filter(F.transform(zipped, lambda p, i: F.struct(i.alias("i"), *(p[c].alias(c) for c in ("kind", "at", "site", *fields)))), lambda p: (F.size(p["at"]) == 0) | ~held(p))
    own = joined.select("fetch_id", "markup", kept.alias("kept"))
    numbered = lambda k: F.transform(F.filter("kept", lambda p: p["kind"] == k), lambda p, i: F.struct(p["i"].alias("i"), p["kind"].alias("kind"), (i + 1).alias("seq"), *(p[c].alias(c) for c in fields)))
    return own.select("fetch_id", "markup", F.array_sort(F.concat(*(numbered(k) for k in (*KINDS, "text")))).alias("parts"))
