"""What a page holds, read from its markup in Arrow batches; whole pages, never prefixes."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import urls

SCHEMA = "anchors array<struct<href:string,text:string>>, forms array<struct<action:string,method:string,inputs:array<struct<type:string,name:string,id:string>>>>, n_password long, n_hidden long, image_alts array<string>, title string, meta_description string, visible_text string, has_favicon boolean"
_SILENT = {"script", "style", "noscript", "head", "title"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.anchors, self.forms, self.alts, self.title, self.said = [], [], [], [], []
        self.n_password = self.n_hidden = 0
        self.description, self.icon, self.form, self.link, self.silent = None, False, None, None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "body":
            self.silent = []
        if tag in _SILENT:
            self.silent.append(tag)
        elif tag == "a":
            self.link = None
            if a.get("href") and not a["href"].startswith(("#", "javascript:")):
                self.link = {"href": a["href"], "text": ""}
                self.anchors.append(self.link)
        elif tag == "form" and self.form is None:
            self.form = {"action": a.get("action", ""), "method": (a.get("method") or "get").lower(), "inputs": []}
            self.forms.append(self.form)
        elif tag == "input":
            if self.form is not None:
                self.form["inputs"].append({"type": a.get("type") or "text", "name": a.get("name", ""), "id": a.get("id", "")})
            self.n_password += a.get("type", "").lower() == "password"
            self.n_hidden += a.get("type", "").lower() == "hidden"
        elif tag == "img" and a.get("alt", "").strip():
            self.alts.append(a["alt"].strip())
        elif tag == "meta" and a.get("name") == "description" and self.description is None:
            self.description = a.get("content", "")
        elif tag == "link":
            self.icon |= "icon" in a.get("rel", "").split()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag):
        if tag in self.silent:
            del self.silent[self.silent.index(tag) :]
        elif tag == "form":
            self.form = None
        elif tag == "a":
            self.link = None

    def handle_data(self, data):
        if self.link is not None:
            self.link["text"] += data
        if "title" in self.silent:
            self.title.append(data)
        if not self.silent:
            self.said.append(data)


#: Scripts and styles, whose ampersands stand for themselves anyway, or one reference, closed or not.
_REFERENCE = re.compile(r"<(script|style)\b.*?</\1|&(#[0-9]+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?", re.I | re.S)


def _only_closed(html: str) -> str:
    """The markup with every ampersand escaped that begins no whole reference up to its semicolon."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] or (m[2] or "").startswith("#") or m[2] in html5 else "&amp;" + m[0][1:], html)


def _read(html, closed: bool = False) -> tuple:
    if html is None:
        return (None,) * 9
    p = _Page()
    p.feed(_only_closed(html) if closed else html)
    p.close()
    for a in p.anchors:
        a["text"] = a["text"].strip()
    return p.anchors, p.forms, p.n_password, p.n_hidden, p.alts, "".join(p.title).strip(), p.description or "", " ".join("".join(p.said).split()), p.icon


def page(html: Column, closed: bool = False) -> Column:
    """H1-H5, H7, H10 and H11 as one struct; every field is null for null markup, and empty or 0 for an empty page.

    HTML reads ``&amp`` without its semicolon as a reference too, as in titles cut short; with ``closed`` it stays as it is written.
    """
    names = [f.split(" ")[0] for f in ("anchors", "forms", "n_password", "n_hidden", "image_alts", "title", "meta_description", "visible_text", "has_favicon")]

    @F.pandas_udf(SCHEMA)
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(h, closed) for h in pages], columns=names, dtype=object)

    return read(html)


def scripts(html: Column) -> dict[str, Column]:
    """H6 and H8, native: calls in inline scripts that hide code, and a disabled context menu."""
    inline = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script(?![^>]*\ssrc)[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    count = lambda p: F.regexp_count(inline, F.lit(p)).cast("long")
    return {
        "n_eval": count(r"\beval\s*\("), "n_unescape": count(r"\b(?:unescape|decodeURIComponent)\s*\("),
        "right_click_disabled": html.rlike("(?i)oncontextmenu\\s*=\\s*[\"'][^\"']*return\\s+false") | (inline.contains("oncontextmenu") & inline.rlike(r"(?i)return\s+false")),
    }


def content_hashes(html: Column) -> dict[str, Column]:
    """Hashes of a page for three uses: as it is, without scripts and with blanks evened out, and of its body alone; null for null."""
    even = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))

    def body(bare: Column) -> Column:
        """From the first tag of a body to the last end of one, found by position; all of it where either is missing."""
        at = F.regexp_instr(bare, F.lit("(?i)<body"))
        opened = F.when(at > 0, F.instr(F.substring(bare, at, F.length(bare)), ">"))
        rest = F.when(opened > 0, F.substring(bare, at + opened, F.length(bare)))
        return urls.let(rest, lambda r: F.when(r.rlike("(?i)</body>"), F.regexp_extract(r, "(?is)^(.*)</body>", 1)).otherwise(bare))

    bare = F.regexp_replace(html, "(?is)<script.*?</script>", "")
    return {"raw_hash": F.sha2(html, 256), "content_hash": F.sha2(even(F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", "")), 256), "body_hash": F.sha2(urls.let(bare, lambda b: even(body(b))), 256)}


def offline_scripts(html: Column) -> dict[str, Column]:
    """H6, H8-H11 as the offline extractor reads them: by patterns over the whole markup; null for null."""
    inside = F.array_join(F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), lambda s: F.trim(s) != ""), " ")
    count = lambda t, p: F.regexp_count(t, F.lit(p)).cast("long")
    lower = F.lower(html)
    return {
        "n_eval": count(inside, r"\beval\s*\("), "n_unescape": count(inside, r"\b(?:unescape|decodeURIComponent)\s*\("), "right_click_disabled": html.rlike("(?i)oncontextmenu\\s*=\\s*[\"'][^\"']*return\\s+false"),
        "handler_empty": lower.contains('action=""') | html.contains("action=''"), "handler_blank": lower.contains("about:blank"), "has_favicon": html.rlike("(?i)<link[^>]+rel\\s*=\\s*[\"'](?:shortcut\\s+)?icon[\"']"),
        "n_hidden": count(html, "(?i)<input[^>]+type\\s*=\\s*[\"']hidden[\"']"),
    }


_UNSEEN = {"script", "style", "noscript", "template", "svg", "canvas", "title"}


class _Words(HTMLParser):
    """Text nodes, each on its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.said, self.silent = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in _UNSEEN:
            self.silent.append(tag)

    def handle_startendtag(self, tag, attrs):
        return

    def handle_endtag(self, tag):
        if tag in self.silent:
            del self.silent[self.silent.index(tag) :]

    def handle_data(self, data):
        t = " ".join(data.split())
        if t and (not self.silent or self.silent == ["title"]):
            (self.title if self.silent else self.said).append(t)


def _spoken(html) -> str | None:
    if html is None:
        return None
    p = _Words()
    p.feed(html)
    p.close()
    return " ".join([*p.title, *p.said])


def offline_text(html: Column) -> Column:
    """H7 as the offline extractor reads it: the title, then every text node with blanks evened out, joined by blanks; null for null."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(_spoken)

    return read(html)
