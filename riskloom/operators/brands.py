"""Brand layers of a page: what it claims to be against where it is.

The catalogue is configuration of bounded size (a dict of brand to domains, aliases and perhaps a category).  A text is read by one
pattern that joins all names, hosts are looked up by their suffixes, and what is known of a brand comes from constant maps, so a plan
has as many expressions for seven brands as for seven hundred.  Only the nearest domain and the sound codes run Python, in Arrow
batches, once a distinct host.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import brand_catalogue, config
from riskloom.functions import phonetic, urls

#: Brand to (domains, aliases, ...).
Catalogue = dict[str, tuple]
CATALOGUE: Catalogue = brand_catalogue.BRANDS
_WORD = "[A-Za-z0-9_]"


def _constant(value, kind: str) -> Column:
    """A value as one constant of the plan."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def _variants(cat: Catalogue) -> dict[str, list[str]]:
    """Names and aliases of three characters or more, each with its brands."""
    out: dict[str, list[str]] = {}
    for b in sorted(cat):
        for v in (b, *cat[b][1]):
            if len(v) >= 3 and b not in out.setdefault(v.lower(), []):
                out[v.lower()].append(b)
    return out


def _found(text: Column, variants: dict[str, list[str]]) -> Column:
    """At each place of a text where whole words of the catalogue start, the longest (ASCII letters, digits and _ make words)."""
    if not variants:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    names = "|".join(re.escape(v).replace("/", "\\/") for v in sorted(variants, key=lambda v: (-len(v), v)))
    first = "".join(sorted({re.escape(v[0]) for v in variants}))
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?<!{_WORD})(?=[{first}])(?=({names})(?!{_WORD}))"), F.lit(1)))


def mentions(text: Column, cat: Catalogue = CATALOGUE) -> Column:
    """The brands that a text names as whole words, by name; none for null."""
    variants = _variants(cat)
    # what a longer one that starts at the same place hides
    within = {v: sorted({b for w, bs in variants.items() if v == w or v.startswith(w) and not re.match(_WORD, v[len(w)]) for b in bs}) for v in variants}
    brands = _constant(within, "map<string,array<string>>")
    named = F.array_sort(F.array_distinct(F.flatten(F.transform(_found(text, variants), lambda v: brands[v]))))
    return F.coalesce(named, F.array().cast("array<string>"))


def page_brand(named: Column) -> Column:
    """The brand of a page by those it names: the first by name; null without any."""
    return F.get(named, F.lit(0))


def primary(text: Column, cat: Catalogue = CATALOGUE) -> Column:
    """the brand of the longest variant named, the first by name of those; null if none is."""
    variants = _variants(cat)
    rank = _constant({v: {"n": -len(v), "b": bs[0]} for v, bs in variants.items()}, "map<string,struct<n:int,b:string>>")
    return F.array_min(F.transform(_found(text, variants), lambda v: rank[v]))["b"]


def _owners(cat: Catalogue) -> Column:
    """Domain to the brands that own it."""
    out: dict[str, list[str]] = {}
    for b in cat:
        for d in cat[b][0]:
            out.setdefault(d.lower(), []).append(b)
    return _constant(out, "map<string,array<string>>")


def canonical(host: Column, brand: Column, cat: Catalogue = CATALOGUE) -> Column:
    """Whether the host is a domain of the brand or under one (J5, by equality of its suffixes); null for no brand."""
    owners = _owners(cat)
    own = F.exists(urls.suffixes(host), lambda s: F.coalesce(F.array_contains(owners[s], brand), F.lit(False)))
    return F.when(brand.isNotNull(), F.coalesce(own, F.lit(False)))


def owners_of(rows: DataFrame, host: str, cat: Catalogue = CATALOGUE) -> DataFrame:
    """The rows whose host is a domain of a brand or under one, once for each: adds domain, brand and category.

    Hosts are listed by suffix and looked up by equality, never compared with each domain.
    """
    owners, kinds = _owners(cat), categories(cat)
    at = rows.select("*", F.explode(urls.suffixes(F.lower(F.col(host)))).alias("domain")).select("*", F.explode(owners[F.col("domain")]).alias("brand"))
    return at.withColumn("category", kinds[F.col("brand")])


def spoofed(host: Column, brand: Column, cat: Catalogue = CATALOGUE) -> Column:
    """Whether a label of the host begins or ends with the brand or an alias, hyphens, underscores and digits aside."""
    clean = {b: sorted({re.sub("[-_0-9]", "", t.lower()) for t in (b, *cat[b][1])} - {""}) for b in cat}
    tokens = _constant(clean, "map<string,array<string>>")
    labels = F.transform(F.split(host, r"\."), lambda p: F.regexp_replace(p, "[-_0-9]", ""))
    return F.coalesce(urls.let(tokens[brand], lambda own: F.exists(labels, lambda p: F.exists(own, lambda t: F.startswith(p, t) | F.endswith(p, t)))), F.lit(False))


def page_mismatch(host: Column, named: Column, cat: Catalogue = CATALOGUE) -> Column:
    """A5, of the brands a page names: 0 without any or on the first one's domain, 0.95 if a label imitates it, 0.85 if the host
    contains it, else by the number of brands."""
    brand = page_brand(named)
    by_number = F.round(F.least(F.lit(0.9), F.size(named) * 0.15 + 0.4), 3)
    return F.when(brand.isNull() | canonical(host, brand, cat), 0.0).when(spoofed(host, brand, cat), 0.95).when(host.contains(brand), 0.85).otherwise(by_number)


def anchor_hosts(anchors: Column, page_host: Column) -> Column:
    """Where each anchor leads; an address without a host to the page's own."""
    return F.transform(anchors, lambda a: F.when(a["href"].startswith("http"), urls.host(a["href"])).otherwise(page_host))


def anchors_off(anchors: Column, page_host: Column, cat: Catalogue = CATALOGUE, domains: Column | None = None) -> Column:
    """Anchors (href, text) that name a brand but lead elsewhere, once a brand and domain, as (brand, domain, severity, href, text,
    expected) by falling severity, then in order; empty for null.  ``domains``: the anchors' registered domains where rules gave them."""
    owners = _owners(cat)
    first = _constant({b: ds[0] for b, (ds, *_) in cat.items() if ds}, "map<string,string>")
    domains = F.transform(anchor_hosts(anchors, page_host), urls.registered) if domains is None else domains
    led = F.zip_with(anchors, domains, lambda a, d: F.struct(a["href"].alias("href"), a["text"].alias("text"), d.alias("domain")))
    known = F.filter(led, lambda a: (F.coalesce(a["href"], F.lit("")) != "") & (F.coalesce(a["text"], F.lit("")) != ""))
    named = F.transform(known, lambda a: F.struct(primary(a["text"], cat).alias("brand"), a["domain"].alias("domain"), a["href"].alias("href"), a["text"].alias("text")))
    off = F.filter(named, lambda m: m["brand"].isNotNull() & (m["domain"] != "") & ~canonical(m["domain"], m["brand"], cat))
    key = lambda m: F.concat_ws("::", m["brand"], m["domain"])
    first_of = lambda ms, keys: F.filter(ms, lambda m, i: F.array_position(keys, key(m)) == i + 1)
    once = urls.let(off, lambda ms: urls.let(F.transform(ms, key), lambda keys: first_of(ms, keys)))
    hosted = lambda d: urls.total(F.endswith(d, F.lit(h)).cast("int") for h in config.FREE_HOSTING) > 0
    severity = lambda m: F.when(owners[m["domain"]].isNotNull(), 0.2).when(hosted(m["domain"]), 0.7).when(F.contains(m["domain"], m["brand"]), 0.9).otherwise(0.5)
    ranked = F.array_sort(F.transform(once, lambda m, i: F.struct((-severity(m)).alias("s"), i.alias("i"), m.alias("m"))))
    out = F.transform(ranked, lambda r: F.struct(r["m"]["brand"].alias("brand"), r["m"]["domain"].alias("domain"), (-r["s"]).alias("severity"), r["m"]["href"].alias("href"), r["m"]["text"].alias("text"), first[r["m"]["brand"]].alias("expected")))
    return F.coalesce(out, F.array().cast("array<struct<brand:string,domain:string,severity:double,href:string,text:string,expected:string>>"))


def anchor_score(off: Column) -> Column:
    """Severities in falling order, those after three count 0.3, of 2.5."""
    total = F.aggregate(F.transform(off, lambda m, i: m["severity"] * F.when(i < 3, 1.0).otherwise(0.3)), F.lit(0.0), lambda a, s: a + s)
    return F.round(F.least(F.lit(1.0), total / 2.5), 3)


def anchor_details(off: Column) -> Column:
    """The first ten mismatches, texts cut to 100 and addresses to 200 characters."""
    return F.transform(F.slice(off, 1, 10), lambda m: F.struct(F.substring(m["text"], 1, config.LIMITS["anchor_text"]).alias("text"), F.substring(m["href"], 1, config.LIMITS["href"]).alias("href"), m["expected"].alias("expected"), m["domain"].alias("domain"), m["brand"].alias("brand"), m["severity"].alias("severity")))


def combosquat(host: Column, brand: Column, cat: Catalogue = CATALOGUE) -> dict[str, Column]:
    """Brand and trust words side by side in a host; 0 and null without both."""
    names, trusted = (_constant(sorted(x), "array<string>") for x in (cat, config.TRUST_WORDS))
    tokens = F.filter(F.split(F.lower(host), "[^a-z0-9]"), lambda t: t != "")
    whole = F.filter(tokens, lambda t: F.array_contains(names, t))
    brands = F.when(F.size(whole) > 0, whole).when(F.lower(host).contains(brand), F.array(brand)).otherwise(F.array().cast("array<string>"))
    trust = F.filter(tokens, lambda t: ~F.array_contains(names, t) & F.array_contains(trusted, t))
    both = (F.size(brands) > 0) & (F.size(trust) > 0)
    return {"combosquat_score": F.when(both, F.round(F.least(F.lit(1.0), F.size(trust) * 0.2 + 0.5), 3)).otherwise(0.0), "combosquat_pattern": F.when(both, F.array_join(F.concat(brands, trust), " + "))}


def composite(layers: list[Column]) -> Column:
    """A4: six layers by fixed weights, 1 at most, three decimals; a null layer counts 0."""
    return F.round(F.least(F.lit(1.0), urls.total(F.coalesce(c, F.lit(0.0)) * w for c, w in zip(layers, config.LAYER_WEIGHTS, strict=True))), 3)


def jaro(a: str, b: str) -> float:
    """F12, with half transpositions kept as fractions."""
    if a == b:
        return 1.0
    reach, taken, first = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if j is not None:
            taken.add(j)
            first.append(c)
    if not first:
        return 0.0
    m, swapped = len(first), sum(x != b[j] for x, j in zip(first, sorted(taken))) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """a common start of up to four characters always adds."""
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    return (j := jaro(a, b)) + same * 0.1 * (1 - j)


def common_run(a: str, b: str) -> int:
    """length of the longest common substring."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *[row[k] + 1 if x == y else 0 for k, y in enumerate(b)]]
        best = max(best, *row)
    return best


def edit_distance(a: str, b: str) -> int:
    """least number of insertions, deletions and substitutions."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
    return row[-1]


def closer(label: str, domain: str) -> str:
    """The closer by F13 of a domain's first label and the whole domain."""
    return max((domain.split(".")[0], domain), key=lambda d: jaro_winkler(label, d))


def similarity(label: str, domain: str) -> float:
    """the closer of the domain's first label and the whole domain, blended with its common run."""
    best = closer(label, domain)
    return round(0.7 * jaro_winkler(label, best) + 0.3 * common_run(label, best) / max(len(label), len(best), 1), 4)


class Domains:
    """The domains of a catalogue, in its order, with what bounds their similarity to a label from above."""

    def __init__(self, cat: Catalogue):
        self.pairs = [(b, d.lower()) for b, (ds, *_) in cat.items() for d in ds]
        self.own = {b: {d.lower() for d in ds} for b, (ds, *_) in cat.items()}
        self.by_label: dict[str, int] = {}
        for i, (_, d) in enumerate(self.pairs):
            self.by_label.setdefault(d.split(".")[0], i)
        forms = [x for _, d in self.pairs for x in (d.split(".")[0], d)]
        self.letters = sorted({c for f in forms for c in f})
        self.counts = np.array([[f.count(c) for c in self.letters] for f in forms], np.int64).reshape(len(forms), -1)
        self.sizes = np.array([len(f) for f in forms], np.int64)
        self.starts = np.array([[ord(c) for c in f[:4].ljust(4, "\0")] for f in forms], np.int64).reshape(len(forms), 4)

    def bound(self, label: str) -> np.ndarray:
        """No domain is more similar than this: characters in common bound both parts of the similarity."""
        n, count = len(label), Counter(label)
        both = np.minimum(self.counts, [count[c] for c in self.letters]).sum(1)
        same = np.cumprod(self.starts == [ord(c) for c in label[:4].ljust(4, "\1")], 1).sum(1)
        jaro_ = np.where(both > 0, (both / n + both / self.sizes + 1) / 3, 0.0)
        jw, run = jaro_ + same * 0.1 * (1 - jaro_), both / np.maximum(n, self.sizes)
        return 0.7 * jw.reshape(-1, 2).max(1) + 0.3 * run.reshape(-1, 2).max(1) + 1e-3

    def nearest(self, domain: str) -> tuple[str | None, float, float, str | None, int]:
        """(brand, similarity, score, closest domain, edit distance), the first domain on ties; -1 without any."""
        label = domain.split(".")[0]
        if not label or not self.pairs:
            return None, 0.0, 0.0, None, -1
        if label in self.by_label:
            (brand, own), sim, distance = self.pairs[self.by_label[label]], 1.0, 0
        else:
            bound, best, at = self.bound(label), 0.0, -1
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < best:
                    break
                s = similarity(label, self.pairs[i][1])
                if s > best or s == best and s > 0 and i < at:
                    best, at = s, int(i)
            if at < 0:
                return None, 0.0, 0.0, None, -1
            (brand, own), sim = self.pairs[at], best
            distance = edit_distance(label, closer(label, own))
        off = domain not in self.own[brand]
        return brand, sim, min(((sim - 0.7) / 0.3) ** 1.5, 1.0) if off and sim > 0.7 else 0.0, own, distance


def nearest(host: Column, cat: Catalogue = CATALOGUE, own: Column | None = None) -> Column:
    """(brand, similarity, score, domain, distance) of the nearest domain, the first by the catalogue's order on ties.

    Null and empty hosts have no brand and score 0; a host on a domain of the brand scores 0.  Each distinct domain of a batch is
    compared once, and only with those domains of the catalogue that can still be nearer than the nearest so far.
    """
    domains = Domains(cat)

    @F.pandas_udf("brand string, similarity double, score double, domain string, distance int")
    def near(domain: pd.Series) -> pd.DataFrame:
        found = {d: domains.nearest(d) for d in domain.dropna().unique()}
        return pd.DataFrame([found.get(d, (None, 0.0, 0.0, None, -1)) for d in domain], columns=["brand", "similarity", "score", "domain", "distance"])

    return near(urls.registered(F.lower(host)) if own is None else own)


def sound_alike(host: Column, brand: Column, cat: Catalogue = CATALOGUE) -> dict[str, Column]:
    """0.8 if the host's first label sounds like the brand named, without a known one 0.7 if like any, the first by name.

    Labels lose hyphens, underscores and digits; one under three characters, or equal to the brand, is no match.
    """
    label = F.regexp_replace(F.lower(F.substring_index(host, ".", 1)), "[-_0-9]", "")
    by_code: dict[str, list[dict]] = {}
    for b in sorted(cat):
        bare = re.sub("[-_]", "", b)
        for code in sorted(set(phonetic.keys(bare))):
            by_code.setdefault(code, []).append({"brand": b, "bare": bare})
    sounds = _constant(by_code, "map<string,array<struct<brand:string,bare:string>>>")
    alike = F.filter(F.flatten(F.filter(F.transform(F.array_distinct(phonetic.codes(label)), lambda c: sounds[c]), lambda x: x.isNotNull())), lambda x: x["bare"] != label)
    names = F.transform(alike, lambda x: x["brand"])
    known = F.coalesce(F.array_contains(_constant(sorted(cat), "array<string>"), brand), F.lit(False))
    found = F.when(F.length(label) >= 3, F.when(known, F.when(F.array_contains(names, brand), brand)).otherwise(F.array_min(names)))
    return {"phonetic_brand": found, "phonetic_score": F.when(found.isNull(), 0.0).when(known, 0.8).otherwise(0.7)}


def categories(cat: Catalogue = CATALOGUE) -> Column:
    """Brand to its category, as one constant map."""
    return _constant({b: e[2] for b, e in cat.items() if len(e) > 2}, "map<string,string>")
