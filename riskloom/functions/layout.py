"""What a page's markup is built of (H9, H12), and features of stored form lists (H13-H15).  Native but for empty buttons."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = "array<struct<action:string,method:string,inputs:array<struct<type:string,name:string>>>>"
_IMAGE = r"(?i)data:image/(?:png|jpe?g|webp);base64,([A-Za-z0-9+/=\s]+)"


class _Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.images = self.embedded = self.forms = self.passwords = self.empty = 0
        self.buttons: list[bool] = []  # whether each open one is a submit button without text so far

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "").lower() for k, v in attrs}
        self.forms += tag == "form"
        self.passwords += tag == "input" and a.get("type") == "password"
        if tag == "img":
            self.images += 1
            self.embedded += a.get("src", "").startswith("data:image/")
        elif tag == "button":
            self.buttons.append(a.get("type", "submit") == "submit")

    def handle_data(self, data):
        if self.buttons and data.strip():
            self.buttons[-1] = False

    def handle_endtag(self, tag):
        if tag == "button" and self.buttons:
            self.empty += self.buttons.pop()


def _count(html: str | None) -> tuple:
    if html is None:
        return (None,) * 5
    t = _Tags()
    t.feed(html)
    return t.images, t.embedded, t.forms, t.passwords, t.empty


def tags(html: Column) -> Column:
    """Images, embedded images, forms, password inputs and empty submit buttons; null for null markup."""
    names = ["images", "embedded", "forms", "passwords", "empty_buttons"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_count(h) for h in pages], columns=names, dtype="Int64")

    return read(html)


def structure(html: Column, found: Column) -> dict[str, Column]:
    """Sixteen features of a page, of its markup and the struct of ``tags``; null for null markup."""
    lower = F.lower(html)
    has = lambda p: lower.rlike(p)
    count = lambda p: F.regexp_count(lower, F.lit(p)).cast("long")
    size = F.transform(F.regexp_extract_all(html, F.lit(_IMAGE), F.lit(1)), lambda d: F.coalesce(F.octet_length(F.try_to_binary(F.regexp_replace(d, r"\s", ""), F.lit("base64"))), F.lit(0)))
    depth = F.array_max(F.transform(F.regexp_extract_all(lower, F.lit(r"z-index\s*:\s*(-?[0-9]+)"), F.lit(1)), lambda z: z.try_cast("long")))
    see_through = has(r"background\s*:\s*transparent")
    return {
        "n_images": found["images"], "n_embedded_images": found["embedded"], "embedded_bytes": F.aggregate(size, F.lit(0), lambda a, n: a + n).cast("long"), "n_forms": found["forms"], "n_password_inputs": found["passwords"],
        "n_canvas": count(r"<canvas\b"), "n_svg": count(r"<svg\b"), "n_empty_submit": found["empty_buttons"], "max_z_index": F.when(html.isNotNull(), F.coalesce(depth, F.lit(0))).cast("long"),
        "n_absolute": count(r"position\s*:\s*absolute"), "n_fixed": count(r"position\s*:\s*fixed"), "full_viewport_image": has(r"<img\b") & has(r"width\s*:\s*100vw") & has(r"height\s*:\s*100vh"), "object_fit": has(r"object-fit\s*:\s*(?:cover|fill)"),
        "transparent_controls": see_through & has(r"<(?:input|button)\b"), "fullscreen_form": has(r"<form\b") & has(r"inset\s*:\s*0") & has(r"z-index\s*:\s*[1-9]"),
        "form_over_image": (found["images"] > 0) & (found["forms"] > 0) & (found["passwords"] > 0) & has(r"position\s*:\s*(?:fixed|absolute)") & see_through,
    }


def handlers(forms: Column) -> dict[str, Column]:
    """H9: whether a form leads nowhere, or to a blank page; false without forms, null for null."""
    to = lambda f: F.lower(F.trim(F.coalesce(f["action"], F.lit(""))))
    return {"handler_empty": F.exists(forms, lambda f: to(f).isin("", "#")), "handler_blank": F.exists(forms, lambda f: to(f) == "about:blank")}


def stored_forms(text: Column) -> dict[str, Column]:
    """H13 and H14 of a JSON list of forms: counts, 0 for null and unreadable text, and the first form's target and method."""
    forms = F.coalesce(F.from_json(text, FORMS), F.array().cast(FORMS))
    inputs = F.flatten(F.transform(forms, lambda f: F.coalesce(f["inputs"], F.array().cast("array<struct<type:string,name:string>>"))))
    first = F.get(forms, F.lit(0))
    return {"n_forms": F.size(forms).cast("long"), "n_inputs": F.size(inputs).cast("long"), "n_hidden": F.size(F.filter(inputs, lambda i: i["type"] == "hidden")).cast("long"), "first_action": first["action"], "first_method": first["method"]}


def listed(text: Column) -> Column:
    """1 if a stored list holds anything, else 0, also for null."""
    return F.when(F.trim(text).isin("", "[]") | text.isNull(), 0).otherwise(1)
