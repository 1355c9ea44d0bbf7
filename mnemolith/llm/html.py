"""Operator 1: main text of web pages by equivalence-class template deduction.

Every page is read as tokens: elements, told apart by their path, and runs of text at a path. Tokens of one host with the
same occurrence vector (how often on each page) form an equivalence class; a class with enough support and members is
valid. The elements of valid classes, nested by path, are the host's template, its text runs are the template's own words,
and what lies between them are its slots. The slot that holds most unlinked text is the article's. In it, slots that are
mostly links are menus, and a slot with a telling class name is set aside unless it holds nearly all text. Extraction then reads the
remaining slots of each page.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut

#: A class needs tokens on this share of the host's pages, on two pages at least, and so many members.
SUPPORT, MEMBERS = 0.5, 3
#: The template's words inside the main slot go if nearly all pages have them, and only if they are a small part of
#: that slot: else they are copies of articles.
OWN_WORDS_SUPPORT, OWN_WORDS_SHARE = 0.8, 0.2
#: The main slot is the innermost container of the template that holds more than this share of the page's unlinked text.
NARROW = 0.5
#: A slot with this share of linked text is a menu; one with a telling name is what the name says, unless it holds this share of the text.
LINKED, MOST = 0.7, 0.8
#: Digits in names count, unless names without them bring this many times as much text under the template.
STRIPPED_GAIN = 2
#: Templates up to so many bytes in all are broadcast, more are joined by host.
BROADCAST_BYTES = 16_000_000
#: Tokens counted in a task before they are passed on.
HELD_TOKENS = 200_000

#: Elements without article text; the first two hold raw text up to their end tag or the page's end.
RAW = ("script", "style")
SWALLOWED = (*RAW, "noscript", "template", "svg", "iframe", "textarea", "title", "select", "button", "object", "canvas", "audio", "video", "math")
IN_HEAD = frozenset("title meta link base script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div body td center html".split())
LISTS = frozenset("ul ol dl table tbody thead".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements and roles of what isn't the article; a header is one unless it stands inside an article, whose own head it is.
ASIDE_TAGS = frozenset("nav footer aside form dialog menu fieldset head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class names and ids that hint at the same.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored banner promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar "
    "sidebars sidenav footer masthead topbar comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager search form skip teaser outbrain taboola".split()
)
HEAD_WORDS = frozenset(["header", "head"])

#: A tag with quoted values, and one that ends at the next bracket, for pages whose quotes don't match; neither goes back over what it has read.
TAG = re.compile(r"""<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attr>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""", re.I)
PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attr>[^>]*+)>", re.I)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?(?=[\s/]|$)""", re.I)
SAME_TAG = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in SWALLOWED}
END_TAG = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ROOT, ALL = 0, 1
#: Longer names stand by their hash, and what longer attributes say is not kept in mind.
LONG_NAME, LONG_ATTRIBUTES = 100, 500


@lru_cache(maxsize=20_000)
def _element(tag: str, attr: str, inside: bool) -> tuple[str, bool, bool]:
    """An element's name in paths, whether it is set aside by what it is, and whether its names hint at that."""
    aside, hint, name = tag in ASIDE_TAGS or (tag == "header" and not inside), False, tag
    if attr.strip(" /"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attr)}
        names = [x for k in ("class", "id") if found.get(k) for x in found[k].split()]
        words = {w.lower() for x in names for w in NAME_WORD.findall(x)}
        hint = bool(words & ASIDE_WORDS) or (bool(words & HEAD_WORDS) and not inside)
        aside |= found.get("role", "").lower() in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag in ("body", "html", "main") or (tag == "article" and not words & {"comment", "comments", "reply", "teaser", "related"}):
            aside = hint = False
        name += "".join("." + (x if len(x) <= LONG_NAME else str(_hash(x.encode("utf-8", "surrogatepass")))) for x in names[:2])
    return name, aside, hint


def _hash(raw: bytes) -> int:
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=100_000)
def _child(parent: int, name: str) -> int:
    """The token of an element's path, from its parent's."""
    return _hash(parent.to_bytes(8, "little", signed=True) + name.encode("utf-8", "surrogatepass"))


def run_hash(path: int, text: str) -> int:
    return _hash(path.to_bytes(8, "little", signed=True) + b"\n" + text.encode("utf-8", "surrogatepass"))


def tags(page: str):
    """(text before, whether an end tag, tag or None, attributes) over a page, which is read once from left to right.

    Comments and elements without article text are passed over. An unclosed script or comment lasts to the page's end, any
    other unclosed element is a tag like others. From the first tag whose quotes never match on, tags end at their first bracket;
    where no bracket is left, the page ends.
    """
    at = seek = 0
    pattern, unclosed = TAG, set()
    while (lt := page.find("<", seek)) >= 0:
        after = page[lt + 1 : lt + 3]
        if not after or not (after[0] in "!?/" or (after[0].isascii() and after[0].isalpha())):
            seek = lt + 1
            continue
        if after[0] in "!?" or (after[0] == "/" and not (after[1:].isascii() and after[1:].isalpha())):
            end = page.find("-->", lt + 2) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            yield page[at:lt], False, None, ""
            if end < lt:
                return
            at = seek = end + 1
            continue
        m = pattern.match(page, lt)
        if not m and pattern is TAG:
            pattern = PLAIN_TAG
            m = pattern.match(page, lt)
        if not m:
            yield page[at:lt], False, None, ""
            return
        tag = m["tag"].lower()
        yield page[at:lt], bool(m["end"]), tag, m["attr"]
        at = seek = m.end()
        if tag in SAME_TAG and not m["end"] and not m["attr"].endswith("/") and tag not in unclosed:
            close = (END_TAG if tag in RAW else SAME_TAG)[tag].search(page, at)
            if close and (tag in RAW or close[1]):
                at = seek = close.start()
            elif tag in RAW:
                return
            elif not close:
                unclosed.add(tag)
    yield page[at:], False, None, ""


def blocks(page: str, strip: bool = False) -> tuple[list[tuple[int, bool, str, int]], dict[int, list]]:
    """Runs (path, set aside, text, linked characters) of a page in order, and its elements: path to [parent, name, count, hint].

    Tags are matched leniently: an unknown end tag is passed over, a block element ends an open paragraph, the end of a page ends
    all. strip: names without their digits. Time is linear in the page, however deep its elements are.
    """
    out: list[tuple[int, bool, str, int]] = []
    elements: dict[int, list] = {ROOT: [None, "", 1, False]}
    # tag, path of the block, set aside, in a link, in an article, open inline elements of the block, open elements since the last container
    stack: list[tuple] = [("", ROOT, False, False, False, {}, {})]
    count: dict[str, int] = {}
    parts: list[str] = []
    linked, where = 0, (ROOT, False)

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((*where, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def pop() -> str:
        tag, _, _, _, _, inline, scope = stack.pop()
        own = inline if tag in INLINE else scope
        own[tag] -= 1
        count[tag] -= 1
        return tag

    for text, end, tag, attr in tags(page):
        top = stack[-1]
        if text and not (top[2] and not where[1] and top[0] in INLINE and parts):  # else set aside in the middle of a block
            if not parts:
                where = top[1], top[2]
            parts.append(text)
            linked += len(text) * top[3]
        if tag is None:
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if end:
            if (top[5] if inline else count).get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if not inline:
            if count.get("head") and tag not in IN_HEAD:
                while pop() != "head":
                    pass
            ends = CLOSES.get(tag, ("p",))
            while any(map(stack[-1][6].get, ends)):
                pop()
        _, path, aside, link, inside, opened, scope = stack[-1]
        name, own, hint = _element(tag, attr, inside) if len(attr) <= LONG_ATTRIBUTES else _element.__wrapped__(tag, attr, inside)
        if inline:
            own |= hint
        else:
            name = re.sub(r"\d+", "", name[len(tag) :]) if strip else name[len(tag) :]
            parent, path, opened = path, _child(path, tag + name), {}
            if path in elements:
                elements[path][2] += 1
            else:
                elements[path] = [parent, tag + name, 1, hint]
            if tag in CONTAINERS or tag in LISTS:
                scope = {}
        within = opened if inline else scope
        within[tag] = within.get(tag, 0) + 1
        count[tag] = count.get(tag, 0) + 1
        stack.append((tag, path, aside or own, link or tag == "a", inside or tag in ("article", "main"), opened, scope))
    flush()
    return out, elements


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty without one."""
    return F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _mix(page: int, count: int) -> int:
    """A page's share of an occurrence vector's fingerprint, 31 bits, to be summed."""
    return zlib.crc32(count.to_bytes(8, "little"), zlib.crc32(page.to_bytes(8, "little", signed=True))) >> 1


def page_tokens(page: str, strip: bool = False) -> dict[int, list]:
    """token to [parent, name, hint, times, seen, linked] of a page; runs of text have no name. ALL stands for the whole page."""
    runs, elements = blocks(page, strip)
    found = {path: [parent, name, int(hint), n, 0, 0] for path, (parent, name, n, hint) in elements.items()}
    whole = found[ALL] = [None, None, 0, 1, 0, 0]
    for path, aside, text, linked in runs:
        if not aside:
            for mass in (found[path], whole):
                mass[4] += len(text)
                mass[5] += linked
            found.setdefault(run_hash(path, text), [path, None, 0, 0, len(text), 0])[3] += 1
    return found


SUMS = ("pages", "print", "seen", "linked", "times")


def _tokens(batches):
    """(host, kind, token, parent, name, hint, pages, print, seen, linked, times): each task's tokens, summed over its pages.

    kind: 0 for pages without digits in names; others come twice, as 1 with digits and as 2 without.
    """
    held: dict[tuple, list] = {}
    names = ["host", "kind", "token", "parent", "name", "hint", *SUMS]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6]

    def batch_of():
        rows = [(*k, *v) for k, v in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        hosts, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for at, to in slices(texts):
            for own, key, page in zip(hosts[at:to], keys[at:to], texts.slice(at, to - at).to_pylist()):
                found = page_tokens(page or "")
                digits = any(x[1] and not x[1].isalpha() and re.search(r"\.[^.]*\d", x[1]) for x in found.values())
                for kind, tokens in ((1, found), (2, page_tokens(page or "", True))) if digits else ((0, found),):
                    for token, (parent, name, hint, n, seen, linked) in tokens.items():
                        x = held.setdefault((own, kind, token), [parent, name, hint, 0, 0, 0, 0, 0])
                        x[3] += 1
                        x[4] += _mix(key, n)
                        x[5] += seen
                        x[6] += linked
                        x[7] += n
                if len(held) >= HELD_TOKENS:
                    yield batch_of()
    if held:
        yield batch_of()


def _under(tokens: list[dict], value) -> dict[int, int]:
    """The sum of value over each element and all in it."""
    parent = {t["token"]: t["parent"] for t in tokens}
    depth: dict[int, int] = {}
    for x in parent:
        way = []
        while x is not None and x in parent and x not in depth:
            way.append(x)
            x = parent[x]
        base = depth.get(x, -1)
        for i, y in enumerate(reversed(way)):
            depth[y] = base + 1 + i
    out = {t["token"]: value(t) for t in tokens}
    for x in sorted(parent, key=depth.get, reverse=True):
        if parent[x] in out:
            out[parent[x]] += out[x]
    return out


def _inside(tokens: list[dict], roots: set[int]) -> set[int]:
    """The elements that are one of roots or stand in one."""
    parent = {t["token"]: t["parent"] for t in tokens}
    known: dict = {None: False}
    for x in parent:
        way = []
        while x not in known and x not in roots and x in parent:
            way.append(x)
            x = parent[x]
        known |= dict.fromkeys(way, x in roots or known.get(x, False))
    return {x for x in parent if x in roots or known.get(x)}


def deduce(tokens: list[dict], pages: int) -> dict:
    """The template of one host from its tokens (token, parent, name, hint, pages, print, seen, linked, times): its main slot, the slots set aside in it, and its own words.

    A main slot stands once on a page; an element that repeats, as a paragraph does, is part of one. cover: the unlinked text in elements of the template.
    """
    tokens = [t for t in tokens if t["pages"] >= max(2, SUPPORT * pages) and t["token"] != ALL]
    classes: dict[tuple, list] = {}
    for t in tokens:
        classes.setdefault((t["pages"], t["print"]), []).append(t)
    valid = [t for c in classes.values() if len(c) >= MEMBERS for t in c]
    every = [t for t in tokens if t["name"] is not None]
    free = lambda t: t["seen"] - t["linked"]
    under = _under(every, free)
    whole = under.get(ROOT, 0)
    drop = {t["token"] for t in every if t["hint"] and under[t["token"]] < MOST * max(1, whole)}
    gone = _inside(every, drop)
    under = _under(every, lambda t: 0 if t["token"] in gone else free(t))
    elements = [t for t in valid if t["name"] is not None and t["token"] not in gone]
    tag = lambda t: t["name"].split(".")[0]
    named = [t for t in elements if tag(t) in ("article", "main")]
    best = max(named, key=lambda t: (under[t["token"]], tag(t) == "article", t["token"]), default=None)
    main = best["token"] if best and under[best["token"]] else ROOT
    if main == ROOT:
        inner = {t["token"] for t in elements if tag(t) in CONTAINERS and t["times"] <= 1.2 * t["pages"]}
        children: dict[int, list[int]] = {}
        for t in every:
            children.setdefault(t["parent"], []).append(t["token"])
        at = main
        while (at := max(children.get(at, []), key=under.get, default=None)) is not None and under[at] > NARROW * under[ROOT]:
            main = at if at in inner else main
    slots = _inside(every, {main})
    seen = _under(every, lambda t: t["seen"])
    menus = {t["token"] for t in valid if t["name"] is not None and t["token"] in slots and t["token"] != main and (tag(t) in CONTAINERS or tag(t) in LISTS) and seen[t["token"]] and seen[t["token"]] - under[t["token"]] >= LINKED * seen[t["token"]]}
    words = [t for t in valid if t["name"] is None and t["pages"] >= OWN_WORDS_SUPPORT * pages and t["parent"] in slots]
    few = sum(t["seen"] for t in words) <= OWN_WORDS_SHARE * max(1, under.get(main, 0))
    return {"main": main, "drop": sorted((drop | menus) & slots), "own": sorted(t["token"] for t in words) if few else [], "cover": sum(free(t) for t in every if t["token"] not in gone)}


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template): a template as JSON for each host with two pages or more and a name.

    Tokens are counted in each task first; only those with enough support come together by host, so a host's
    group is bounded by the size of a page, whatever the number of its pages. Digits in names count, unless a host numbers its elements
    page by page, so that only names without digits bring its text under a template.
    """
    rows = pages.select(host(F.col(url_col)).alias("host"), F.xxhash64(F.col(id_col).cast("string"), F.col(url_col)).alias("page"), F.col(html_col).cast("string").alias("html"))
    each = rows.mapInArrow(_tokens, "host string, kind int, token bigint, parent bigint, name string, hint bigint, pages bigint, print bigint, seen bigint, linked bigint, times bigint")
    sums = [F.coalesce(F.sum(F.when(F.col("kind") != 2 - i, F.col(c))), F.lit(0)).alias(f"{c}{i}") for i in (0, 1) for c in SUMS]
    total = each.where("host != ''").groupBy("host", "token").agg(F.min("parent").alias("parent"), F.min("name").alias("name"), F.max("hint").alias("hint"), *sums).where("greatest(pages0, pages1) > 1")
    total = cut(total)
    roots = total.where(F.col("token") == ALL).select("host", F.col("pages0").alias("all_pages"))
    near = total.join(roots, "host").where(F.greatest("pages0", "pages1") >= SUPPORT * F.col("all_pages"))

    def build(key, table):
        rows, pages_ = table.to_pylist(), table["all_pages"][0].as_py()
        exact, stripped = (deduce([{k: t[k] for k in ("token", "parent", "name", "hint")} | {c: t[f"{c}{i}"] for c in SUMS} for t in rows], pages_) for i in (0, 1))
        strip = stripped["cover"] >= STRIPPED_GAIN * max(1, exact["cover"])
        found = (stripped if strip else exact) | {"strip": strip}
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "template": pa.array([json.dumps(found)], pa.string())})

    return near.groupBy("host").applyInArrow(build, "host string, template string")


@lru_cache(maxsize=500)
def _read(template: str) -> tuple[int, frozenset, frozenset, bool]:
    found = json.loads(template)
    return found["main"], frozenset(found["drop"]), frozenset(found["own"]), found["strip"]


def main_text(page: str, template: str | None = None) -> str:
    """The text of the remaining slots of a page; a page without the main slot, or of a host without template, is its own template."""
    main, drop, own, strip = _read(template) if template else (None, frozenset(), frozenset(), False)
    runs, elements = blocks(page, strip)
    tokens = [{"token": path, "parent": parent, "name": name, "hint": hint, "pages": 2, "print": 0, "seen": 0, "linked": 0, "times": 2 * n} for path, (parent, name, n, hint) in elements.items()]
    if main not in elements:
        at = {t["token"]: t for t in tokens}
        for path, aside, text, linked in runs:
            if not aside:
                at[path]["seen"] += len(text)
                at[path]["linked"] += linked
        found = deduce(tokens, 2)
        main, drop, own = found["main"], frozenset(found["drop"]), frozenset()
    slots = _inside(tokens, {main}) - _inside(tokens, set(drop))
    return " ".join(text for path, aside, text, _ in runs if not aside and path in slots and (not own or run_hash(path, text) not in own))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row of pages.

    Null or empty html, and a page without text of its own, give the empty text; an empty table gives an empty result. A null url or
    one without a host has no template. Rows are extracted one by one, so repeated rows give repeated rows; of containers with equal
    text the innermost is taken, in a fixed order. Pages of any length and depth are read whole, in linear time. Only the three
    columns are looked at. Templates reach the pages by a broadcast if they are small, which is measured, and else by a join on host.
    """
    found = cut(templates(pages, id_col, url_col, html_col))
    size = found.agg(F.coalesce(F.sum(F.length("template") + F.length("host") + 16), F.lit(0))).first()[0]
    rows = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("key"), host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left").select("key", "html", "template")

    def run(batches):
        for batch in batches:
            keys, texts, templates_ = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for at, to in slices(texts):
                out = [main_text(x or "", t) for x, t in zip(texts.slice(at, to - at).to_pylist(), templates_[at:to])]
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.array(out, pa.string())], names=["key", "text"])

    kind = rows.schema["key"].dataType.simpleString()
    done = rows.mapInArrow(run, f"key {kind}, text string")
    return done.select(F.col("key.id").alias(id_col), F.col("key.url").alias(url_col), "text")
