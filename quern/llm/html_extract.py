"""HTML extraction with wrappers that are inferred by host.

A wrapper is a union-free regular expression over a page's tokens: tags, text slots, optional groups (...)? and repeated
groups (...)+. All different pages of a host are dealt into blocks of a few. In each, the first page is the first wrapper; each
further page's token stream is aligned with it, and a mismatch becomes a slot (two different texts), a repeated group (one side goes
on with another copy of what came just before) or an optional group (one side has what the other lacks). The host's wrapper has
what more than half of its blocks' wrappers have.

The wrapper decides what main text is. Spark sums up the text in its slots over all of the host's pages: the main part is the
innermost element of the wrapper that holds most of what varies outside of links, and the pages' h1; whatever varies
elsewhere (teasers, adverts) is left out, whatever the elements are called. Its fixed texts are candidates for the template: Spark
counts on how many pages with different main text a block of them stands at one path; on most, it is main text on none.
Pages of hosts with too few pages to compare or whose text is spread over the body, and pages without text in the host's main part,
are judged by their elements' names.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quern.llm.store import written
from quern.llm.tokens import small_batches

BLOCK_PAGES = 6  # of a host in a block, at least if it has as many
HOSTS = 200_000  # of a table by host that is broadcast; more are joined by shuffle
LEAST_PAGES = 3  # that show what is the same on all of a host's pages
MOST_PAGES = 0.8  # of a host's pages with different main text have what is its template's
MOST_TEXT = 0.5  # of what varies on a host's pages lies in their main part
LEVELS = 40  # of nested elements in which the main part is looked for; deeper text counts for its ancestor there
TEMPLATE_BYTES = 8 << 20  # of all tables by host that are broadcast; beyond it they are joined by shuffle

# Element names and words in class and id attributes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
DROPPED = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "head", "nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu"}
CELLS, LINES = {"td", "th"}, {"td", "th", "tr"}
#: What an element ends by its start, where that is innermost: end tags that may be left out.
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "td": CELLS | {"p"}, "th": CELLS | {"p"}, "tr": LINES | {"p"}, **dict.fromkeys(("thead", "tbody", "tfoot"), LINES | {"thead", "tbody", "tfoot", "p"}),
}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
MAIN = {"article", "main"}
DROPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments",
    "disqus", "respond", "reply", "replies", "pagination", "pager", "widget", "toolbar", "skip", "paywall",
}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)>|(?P<text>[^<]++|<)",
    re.S,
)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): open with the attributes, close, or text with character references decoded."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            yield "text", "", html.unescape(m["text"])
        elif m["cdata"] is not None:
            yield "text", "", m["cdata"]
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                yield "close", name, ""
                continue
            yield "open", name, m["rest"]
            if name in RAW and not m["rest"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else n


def _dropped(name: str, rest: str, in_main: bool) -> bool:
    if name in DROPPED or name == "header" and not in_main:
        return True
    if not rest:
        return False
    for a in _ATTR.finditer(rest):
        key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in DROPPED_ROLES:
            return True
        if key in ("class", "id") and name not in ("body", "html") and name not in MAIN and not DROPPED_WORDS.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return False


def signature(name: str, rest: str) -> str:
    """What a wrapper knows of an opening tag: its name, class, id without digits, and role."""
    found = sorted(f"{a[1].lower()}={re.sub('[0-9]+', '', a[2] or a[3] or a[4] or '')}" for a in _ATTR.finditer(rest)) if rest else ()
    return " ".join(["<" + name, *found])


def fits(sign: str, wanted: str) -> bool:
    """Whether an element has a wrapper element's signature; one without attributes stands for any of its name."""
    return sign == wanted or " " not in wanted and sign.split(" ", 1)[0] == wanted


def stream(page: str, part: list[str] | None = None) -> list[tuple[str, str, bool, bool, int]]:
    """(token, text, dropped, main, path) for each tag and each text; a text's token is '#', or ' ' for white space.

    path is a checksum of the open elements' names. main: in the part that the wrapper gives, the signatures of nested
    elements from the outermost on, or else in an article or main element. Tags that are left open end with the element
    around them.
    """
    out, stack = [], []  # stack of (name, dropped, in main, path, elements of part so far or -1)
    places: dict[str, list[int]] = {}  # of each name's open elements in the stack
    size = len(part) if part is not None else -1

    def end(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()[0]].pop()

    for kind, name, value in tokens(page):
        dropped, main, path, got = stack[-1][1:] if stack else (False, size == 0, 0, 0)
        if kind == "text":
            if value and not (value.isspace() and (not stack or dropped)):
                out.append(("#" if not value.isspace() else " ", value, dropped, main, path))
        elif kind == "open":
            while stack and stack[-1][0] in ENDS.get(name, ()):
                end(len(stack) - 1)
                dropped, main, path, got = stack[-1][1:] if stack else (False, size == 0, 0, 0)
            sign = signature(name, value)
            out.append((sign, "", dropped, main, path))
            if name not in VOID and not value.endswith("/"):
                if part is None:
                    inside = main or name in MAIN
                elif name not in INLINE and 0 <= got < size:
                    got = got + 1 if fits(sign, part[got]) else -1
                    inside = got == size
                else:
                    inside = main
                places.setdefault(name, []).append(len(stack))
                stack.append((name, dropped or _dropped(name, value, main or inside and part is not None), inside, zlib.crc32(f"<{name}".encode("utf-8", "replace"), path), got))
        else:
            if places.get(name):
                end(places[name][-1])
            out.append(("</" + name, "", *(stack[-1][1:4] if stack else (False, size == 0, 0))))
    return out


def slots(page: str, tags: set[str]) -> Iterator[tuple[tuple[str, ...], str, bool]]:
    """(signatures of the elements around, text, h1) of each text outside of links and of elements that are never content.

    Signatures that the wrapper's tags don't have are cut to the name. Inline elements don't count.
    """
    stack: list[tuple[str, bool, tuple[str, ...], bool]] = []  # (name, left out, signatures, h1)
    places: dict[str, list[int]] = {}
    for kind, name, value in tokens(page):
        if kind == "open":
            while stack and stack[-1][0] in ENDS.get(name, ()):
                places[stack.pop()[0]].pop()
        _, out, path, head = stack[-1] if stack else ("", False, (), False)
        if kind == "text":
            if not out and not value.isspace():
                yield path, value, head
        elif kind == "open":
            if name not in VOID and not value.endswith("/"):
                places.setdefault(name, []).append(len(stack))
                if name not in INLINE and len(path) < LEVELS:
                    sign = signature(name, value)
                    path = (*path, sign if sign in tags else "<" + name)
                stack.append((name, out or name == "a" or _dropped(name, value, True), path, head or name == "h1"))
        elif places.get(name):
            depth = places[name][-1]
            while len(stack) > depth:
                places[stack.pop()[0]].pop()


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def whole(text: str) -> str:
    """What texts are compared by: the stripped text, or its digest if it is long."""
    text = text.strip()
    return text if len(text) <= 200 else "\0" + digest(text)


# A wrapper's nodes: ["<p", ...] a tag, ["#", text or None] a text that is always the same or a slot, ["?", nodes], ["+", nodes].


def folded(seq: list[str], texts: list[str]) -> list:
    """Nodes of a token sequence; equal neighbours that end with the same closing tag become repeated groups."""
    nodes: list = []
    opens: dict[str, list[int]] = defaultdict(list)  # where each tag opens in nodes, the last one last
    for token, text in zip(seq, texts, strict=True):
        if token == "#":
            nodes.append(["#", text])
            continue
        if not token.startswith("</"):
            opens[token.split(" ", 1)[0]].append(len(nodes))
        nodes.append([token])
        if token.startswith("</") and (at := opens["<" + token[2:]]):
            _fold_tail(nodes, at.pop())
            if at and at[-1] >= len(nodes):
                opens["<" + token[2:]] = [x for x in at if x < len(nodes)]
    return nodes


def _fold_tail(nodes: list, begin: int) -> None:
    """Join the group from begin on with an equal one, or one repeated already, just before it."""
    group = nodes[begin:]
    if not group:
        return
    if begin and nodes[begin - 1][0] == "+" and (new := aligned(nodes[begin - 1][1], group, False)) is not None:
        nodes[begin - 1 :] = [["+", new]]
    elif begin >= len(group) and nodes[begin - len(group)][0] == group[0][0] and shape(nodes[begin - len(group) : begin]) == shape(group):
        nodes[begin - len(group) :] = [["+", aligned(nodes[begin - len(group) : begin], group, False) or group]]


def shape(nodes: list) -> list:
    return [n[0] if n[0] not in "?+" else [n[0], shape(n[1])] for n in nodes]


def _places(nodes: list) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for k, node in enumerate(nodes):
        out[node[0]].append(k)
    return out


def _next(places: dict[str, list[int]], token: str, after: int) -> int | None:
    """The first place of a token after another place."""
    at = places.get(token, ())
    k = bisect_left(at, after + 1)
    return at[k] if k < len(at) else None


def aligned(a: list, b: list, loose: bool = True) -> list | None:
    """The least wrapper found that covers both node lists; None if loose is false and they aren't alike."""
    out, i, j = [], 0, 0
    places: tuple | None = None
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x[0] == y[0] == "#":
            out.append(["#", x[1] if x[1] == y[1] else None])
            i, j = i + 1, j + 1
        elif x[0] == y[0] and x[0] in "?+":
            out.append([x[0], aligned(x[1], y[1]) or x[1]])
            i, j = i + 1, j + 1
        elif x[0] == y[0]:
            out.append(x)
            i, j = i + 1, j + 1
        elif x[0] in "+?" and (new := aligned(x[1], b[j : j + len(x[1])], False)) is not None:  # one copy of what repeats
            out.append([x[0], new])
            i, j = i + 1, j + len(x[1])
        elif y[0] in "+?" and (new := aligned(y[1], a[i : i + len(y[1])], False)) is not None:
            out.append([y[0], new])
            i, j = i + len(y[1]), j + 1
        elif not loose:
            return None
        elif out and out[-1][0] == "+" and (new := aligned(out[-1][1], a[i : i + len(out[-1][1])], False)) is not None:
            out[-1], i = ["+", new], i + len(out[-1][1])
        elif out and out[-1][0] == "+" and (new := aligned(out[-1][1], b[j : j + len(out[-1][1])], False)) is not None:
            out[-1], j = ["+", new], j + len(out[-1][1])
        elif x[0] == "?":
            out.append(x)
            i += 1
        elif y[0] == "?":
            out.append(y)
            j += 1
        else:
            places = places or (_places(a), _places(b))
            skip_a, skip_b = _next(places[0], y[0], i), _next(places[1], x[0], j)
            if skip_a is not None and (skip_b is None or skip_a - i <= skip_b - j):
                out.append(["?", a[i:skip_a]])
                i = skip_a
            elif skip_b is not None:
                out.append(["?", b[j:skip_b]])
                j = skip_b
            else:
                out += [["?", [x]], ["?", [y]]]
                i, j = i + 1, j + 1
    if not loose and (i < len(a) or j < len(b)):
        return None
    for rest in (a[i:], b[j:]):
        if rest:
            out.append(["?", rest])
    return out


def infer(pages: list[str]) -> list:
    """The wrapper of some pages of a host."""
    wrapper: list | None = None
    for page in pages:
        own = [t for t in stream(page) if t[0] != " "]
        nodes = folded([t[0] for t in own], [whole(t[1]) for t in own])
        wrapper = nodes if wrapper is None else aligned(wrapper, nodes)
    return (wrapper or []) if len(pages) >= LEAST_PAGES else opened(wrapper or [])


def opened(nodes: list) -> list:
    """The same wrapper with every text a slot: a few pages don't show what all pages have."""
    return [["#", None] if n[0] == "#" else [n[0], opened(n[1])] if n[0] in "?+" else n for n in nodes]


def fixed_texts(wrapper: list) -> set[str]:
    """Texts that the wrapper has as the same on all pages."""
    found: set[str] = set()
    todo = [wrapper]
    while todo:
        for node in todo.pop():
            if node[0] in "?+":
                todo.append(node[1])
            elif node[0] == "#" and node[1] is not None:
                found.add(node[1])
    return found


def wrapper_tags(wrapper: list) -> set[str]:
    """The signatures of the wrapper's opening tags."""
    found: set[str] = set()
    todo = [wrapper]
    while todo:
        for node in todo.pop():
            if node[0] in "?+":
                todo.append(node[1])
            elif node[0] != "#" and not node[0].startswith("</"):
                found.add(node[0])
    return found


def blocks(page: str | None, part: list[str] | None = None) -> list[tuple[int, str, list[str]]]:
    """(path, text, the texts it is made of) of each block of text in the main part, less what lies in elements that are never content.

    Where the page has no text in that part, or part is None, the main part is what lies in an article or main element, or,
    on a page without any, in the body.
    """
    if not page:
        return []
    seq = stream(page, part)
    has_main = any(t[0] == "#" and t[3] and not t[2] for t in seq)
    if part is not None and not has_main:
        return blocks(page)
    out: list[tuple[int, str, list[str]]] = []
    now: list[str] = []
    at, parts = 0, []

    def end() -> None:
        if text := " ".join("".join(now).split()):
            out.append((at, text, parts))

    for token, text, dropped, main, path in seq:
        if token in "# ":
            if not dropped and (main or not has_main):
                now.append(text)
                if token == "#":
                    at = at if parts else path
                    parts.append(text)
        elif (name := token.lstrip("</").split(" ")[0]) not in INLINE:
            end()
            now, at, parts = [], 0, []
        elif name in ("br", "wbr", "img"):
            now.append(" " if name == "br" else "")
    end()
    return out


def main_part(texts: list[tuple[list[str], int, int]]) -> list[str]:
    """The innermost element that holds MOST_TEXT of all characters and nearly all of h1's, from (path, characters, h1's) by path.

    A list of signatures from the outermost element on; a name alone stands for every element of that name, where no
    signature among them has most of the text. An element without further elements in it, such as a paragraph, is none.
    """
    total, heads, part = sum(t[1] for t in texts), sum(t[2] for t in texts), []
    while True:
        n = len(part)
        inner = [t for t in texts if len(t[0]) > n]
        names: dict[str, int] = defaultdict(int)
        signs: dict[str, int] = defaultdict(int)
        for path, chars, _ in inner:
            names[path[n].split(" ", 1)[0]] += chars
            signs[path[n]] += chars
        if not names:
            return part
        name = max(names, key=lambda x: (names[x], x))
        sign = max((x for x in signs if x.split(" ", 1)[0] == name), key=lambda x: (signs[x], x))
        for wanted, share in ((sign, signs[sign]), (name, names[name])):
            held = [t for t in inner if fits(t[0][n], wanted)]
            deeper = sum(t[1] for t in held if len(t[0]) > n + 1)
            if share >= MOST_TEXT * total and deeper >= MOST_TEXT * share and sum(t[2] for t in held) >= 0.9 * heads:
                part, texts = [*part, wanted], held
                break
        else:
            return part


def block_key(path: int, text: str) -> str:
    return f"{path:08x}{digest(text)}"


def candidates(read: list[tuple[int, str, list[str]]], fixed: set[str]) -> list[str]:
    """Keys of those of a page's blocks that are made of fixed texts alone."""
    return sorted({block_key(path, text) for path, text, parts in read if all(whole(p) in fixed for p in parts)})


def main_text(page: str | None, wrapper: list, template: set[str] | None = None, part: list[str] | None = None) -> str:
    """Blocks of the main part, joined by newlines; less those of the template's keys and those that the wrapper has as fixed."""
    fixed = fixed_texts(wrapper) if wrapper else ()
    gone = template or ()
    return "\n".join(text for path, text, parts in blocks(page, part) if not (fixed and all(whole(p) in fixed for p in parts) or gone and block_key(path, text) in gone))


def host_key(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def wrappers(rows: DataFrame, size: int = BLOCK_PAGES) -> DataFrame:
    """(host, tags, fixed): tags and fixed texts that more than half of the wrappers of a host's blocks have.

    Each different page is in one block, by its hash; a host has a block for each `size` pages. Fixed texts are those of most
    blocks of at least LEAST_PAGES, as fewer pages don't show any.
    """
    known = rows.select("host", F.xxhash64("html").alias("h"), "html").where(F.length("html") > 0)
    # Blocks are counted on hashes alone, and copies collapse before pages are moved: a hot host's pages are gathered nowhere.
    n = known.select("host", "h").distinct().groupBy("host").agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") / size)).alias("n"))
    n = written(n, "blocks")
    dealt = known.join(F.broadcast(n) if n.count() <= HOSTS else n, "host").withColumn("block", F.expr("pmod(h, n)"))
    some = small_batches(dealt.groupBy("host", "block").agg(F.collect_set("html").alias("pages")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for host, pages in zip(pdf["host"], pdf["pages"], strict=True):
                wrapper = infer(sorted(pages, key=digest))
                enough = len(pages) >= LEAST_PAGES
                found += [(host, "block", "", enough), *[(host, "tag", x, enough) for x in wrapper_tags(wrapper)], *[(host, "fixed", x, enough) for x in fixed_texts(wrapper)]]
            yield pd.DataFrame(found, columns=["host", "kind", "what", "enough"])

    votes = some.mapInPandas(run, "host string, kind string, what string, enough boolean").groupBy("host", "kind", "what").agg(F.count("*").alias("n"), F.count_if("enough").alias("some"))
    votes = written(votes, "votes")
    of = votes.where("kind = 'block'").select("host", F.col("n").alias("blocks"), F.col("some").alias("telling"))
    most = votes.where("kind <> 'block'").join(F.broadcast(of) if of.count() <= HOSTS else of, "host").where("kind = 'tag' and 2 * n > blocks or kind = 'fixed' and 2 * some > telling")
    told = most.groupBy("host").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("what")))).alias(name) for k, name in (("tag", "tags"), ("fixed", "fixed"))])
    none = F.array().cast("array<string>")
    return of.select("host").join(told, "host", "left").select("host", F.coalesce("tags", none).alias("tags"), F.coalesce("fixed", none).alias("fixed"))


def _by_host(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Rows with the arrays of their host, broadcast only if their size, which is checked, is small."""
    sizes = [F.coalesce(F.length(F.array_join(c, " ")), F.lit(0)) for c in table.columns if c != "host"]
    size = table.agg(F.coalesce(F.sum(sum(sizes, F.length("host"))), F.lit(0))).first()[0]
    return rows.join(F.broadcast(table) if size <= TEMPLATE_BYTES else table, "host", how)


def _counted(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a pass over all pages of hosts finds: (host, part), the main part of each host's wrapper, and then (host, template).

    A wrapper whose main part is the whole body tells nothing: part is null, and element names judge.

    Text in slots is summed by path before it is moved; a host's paths are made of its wrapper's tags, so they are few.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            for host, page, tags, fixed in zip(pdf["host"], pdf["html"], pdf["tags"], pdf["fixed"], strict=True):
                tags, fixed = set(tags), set(fixed)
                for path, text, head in slots(page, tags):
                    if whole(text) not in fixed:
                        own = sums[host, path]
                        own[0] += len(text)
                        own[1] += head
            yield pd.DataFrame([(host, list(path), n, heads) for (host, path), (n, heads) in sums.items()], columns=["host", "path", "n", "heads"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        part = main_part([(list(p), int(n), int(h)) for p, n, h in zip(pdf["path"], pdf["n"], pdf["heads"], strict=True)])
        told = [s for s in part if s.split(" ", 1)[0] not in ("<html", "<body")]
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [part if told else None]})

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [None if p is None else list(p) for p in pdf["part"]]
            own, found = [], []
            for page, fixed, part in zip(pdf["html"], map(set, pdf["fixed"]), parts, strict=True):
                read = blocks(page, part)
                own.append(digest("\n".join(text for _, text, _ in read)))
                found.append(["", *candidates(read, fixed)])
            yield pd.DataFrame({"host": pdf["host"], "page": own, "keys": found})

    rows = rows.where(F.length("html") > 0)
    sums = _by_host(rows, known, "inner").select("host", "html", "tags", "fixed").mapInPandas(texts, "host string, path array<string>, n long, heads long")
    sums = sums.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("heads").alias("heads"))
    parts = written(sums.groupBy("host").applyInPandas(choose, "host string, part array<string>"), "main-parts")
    own = _by_host(_by_host(rows, known.select("host", "fixed"), "inner"), parts, "left").select("host", "html", "fixed", "part")
    each = own.mapInPandas(keys, "host string, page string, keys array<string>").select("host", "page", F.explode("keys").alias("key")).distinct()
    counts = written(each.groupBy("host", "key").agg(F.count("*").alias("n")), "template-counts")
    pages = counts.where("key = ''").select("host", F.col("n").alias("pages"))
    parts = parts.join(pages, "host").where(F.col("pages") >= LEAST_PAGES).select("host", "part")
    most = counts.where("key <> ''").join(pages, "host").where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= MOST_PAGES * F.col("pages")))
    return parts, most.groupBy("host").agg(F.collect_list("key").alias("template"))


def templates(rows: DataFrame) -> DataFrame:
    """(host, part, template): the main part and the keys of blocks that stand on most of a host's pages; rows has host and html.

    Only hosts with LEAST_PAGES pages of different main text have a part, null otherwise. Pages with the same main text count
    once, so copies of one text don't make it a template.
    """
    known = written(wrappers(rows), "wrappers")
    parts, gone = _counted(rows, known)
    return parts.join(gone, "host", "full").select("host", "part", "template")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row: the main text of the whole page, decoded, a line for each block.

    Null and empty pages have empty text; null ids and URLs stay (the URL's host is then empty); repeated rows are read each;
    an empty table gives an empty one; other columns are not carried.
    """
    df = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), F.col(html_col).alias("html"))
    rows = small_batches(df).withColumn("host", host_key(F.col(url_col)))
    found = written(templates(rows.select("host", "html")), "templates")
    rows = _by_host(rows, found, "left").select(id_col, url_col, "html", "part", "template")
    schema = df.select(id_col, url_col).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = zip(pdf["html"], pdf["part"], pdf["template"], strict=True)
            texts = [main_text(page, [], None if gone is None else set(gone), None if part is None else list(part)) for page, part, gone in columns]
            yield pdf[[id_col, url_col]].assign(text=texts, n_chars=[len(t) for t in texts])

    return rows.mapInPandas(run, schema)
