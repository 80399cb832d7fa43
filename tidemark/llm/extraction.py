"""HTML extraction by equivalence classes of tokens over the pages of a host.

A page is a sequence of tokens: elements with their classes and where they stand, and blocks of text. Tokens of a host with
the same occurrence vector over its pages form an equivalence class, and frequent classes are its template. The class of
elements that every page has once is the root; its elements bound the slots. Another class is valid on a page if its tokens
stand in the template's order and inside one slot, so that it nests there; text that is a token of a valid class is template.
What else stands in the slots is content. Slots whose texts repeat from page to page, against those of the heaviest slot,
are not main ones. Element and class names are a prior: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments are left out, and where a page marks its article, only that counts.
"""

import html as html_chars
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, pieces, text_batches, text_udf

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title svg math object canvas audio video xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
BOILERPLATE = frozenset("nav header footer aside form button select option menu dialog fieldset datalist optgroup".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
#: Words that name a part of a page when they are a whole class or id, or end one.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promotion related share sharing sidebar social sponsor sponsored subscribe teaser toolbar widget".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An open element that a start tag of the key closes.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that a stray end tag or a sibling doesn't reach beyond.
WALLS = frozenset("article body div footer header html main nav section table ul ol aside form td th".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>\"'=<]*")
_QUOTE_OR_END = re.compile(r"[\"'>]")
#: Every alternative takes all that it has read, so that the scan is linear.
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++))?)?|[\s=/"'>]""")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)


class Block:
    """A run of text without a block boundary in it: whether names rule it out, whether an article holds it, the elements around it."""

    __slots__ = ("text", "position", "boiler", "article", "around")

    def __init__(self, text, position, boiler, article, around):
        self.text, self.position, self.boiler, self.article, self.around = text, position, boiler, article, around


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for name, *values in _ATTR.findall(raw):
            if name:
                out.setdefault(name.lower(), "".join(values))
    return out


def _names_boilerplate(value: str) -> bool:
    """A class or id is such a word, or ends in one behind a hyphen or underscore (site-header, but not notice-of-award)."""
    return any(re.split(r"[-_]", w)[-1] in BOILERPLATE_WORDS for w in value.lower().split())


def _is_boiler(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in BOILERPLATE and not (tag == "header" and inside_article):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or _HIDDEN_STYLE.search(attrs.get("style", "")) or attrs.get("role", "").strip().lower() in BOILERPLATE_ROLES:
        return True
    return tag not in ("body", "html", "article", "main") and (_names_boilerplate(attrs.get("class", "")) or _names_boilerplate(attrs.get("id", "")))


class _Ahead:
    """Where the next one of a string begins; each part of the source is searched once, whatever was asked."""

    def __init__(self, source: str, what: str):
        self.source, self.what, self.at = source, what, -2

    def __call__(self, start: int) -> int:
        if self.at != -1 and self.at < start:
            self.at = self.source.find(self.what, start)
        return self.at


def markup(source: str):
    """(kind, name, attributes, start, end) of the source's tags and comments; kind is open, close or skip. Time is linear."""
    ends, comment_ends, ahead, at = _Ahead(source, ">"), _Ahead(source, "-->"), {q: _Ahead(source, q) for q in "\"'"}, 0
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            stop = comment_ends(start + 4)
            at = len(source) if stop < 0 else stop + 3
            yield "skip", "", "", start, at
            continue
        nxt = source[start + 1 : start + 2]
        if nxt in ("!", "?"):
            stop = ends(start)
            if stop < 0:
                return
            at = stop + 1
            yield "skip", "", "", start, at
            continue
        closing = nxt == "/"
        m = _NAME.match(source, start + 1 + closing)
        if not m or ends(m.end()) < 0:
            at = start + 1
            continue
        stop = m.end()
        while (q := _QUOTE_OR_END.search(source, stop)) and q[0] != ">":
            other = ahead[q[0]](q.end())
            if other < 0:  # a quote that nothing ends
                q = None
                break
            stop = other + 1
        if not q:
            stop = ends(m.end())
        else:
            stop = q.start()
        at = stop + 1
        yield "close" if closing else "open", m[0].lower(), source[m.end() : stop], start, at


class _Stack:
    """Open elements, with the place of the last one of each name and of the last wall, so that closing takes no search."""

    def __init__(self):
        self.items: list[tuple[str, bool, int, int]] = []  # name, in boilerplate, number of the article (0: none), hash of the path
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []

    def push(self, name, boiler, article, path):
        self.places.setdefault(name, []).append(len(self.items))
        if name in WALLS:
            self.walls.append(len(self.items))
        self.items.append((name, boiler, article, path))

    def reach(self, name: str) -> int:
        """Where the element stands that an end of this name closes, -1 for none."""
        found = self.places.get(name)
        if not found or (name not in WALLS and self.walls and self.walls[-1] > found[-1]):
            return -1
        return found[-1]

    def cut(self, place: int):
        while len(self.items) > place:
            name = self.items.pop()[0]
            self.places[name].pop()
            if name in WALLS:
                self.walls.pop()


_PATHS: dict[tuple[int, str], int] = {}


def _hash(token: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(token.encode())).view(np.int64))


def _path(above: int, token: str) -> int:
    key = above, token
    if key not in _PATHS:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        _PATHS[key] = _hash(f"{above}\n{token}")
    return _PATHS[key]


#: Elements around a block that are told apart, from the outermost; what lies deeper counts as their content.
DEPTH = 64


def parse(source: str | None) -> tuple[list[tuple[int, int]], list[Block]]:
    """Elements (hash of name, classes and path; position) and the blocks of text, in page order."""
    source = source or ""
    tags: list[tuple[int, int]] = []
    blocks: list[Block] = []
    stack, articles, position, at, held, skip_to = _Stack(), 0, 0, 0, [], 0

    def flush():
        nonlocal position
        text = " ".join(html_chars.unescape("".join(held)).split())
        held.clear()
        if text:
            boiler, article = (stack.items[-1][1], stack.items[-1][2]) if stack.items else (False, 0)
            blocks.append(Block(text, position, boiler, article, tuple(x[3] for x in stack.items[:DEPTH] if x[0] not in INLINE)))
            position += 1

    def close(name: str):
        place = stack.reach(name)
        if place >= 0:
            if name not in INLINE:
                flush()
            stack.cut(place)

    raw_ends: dict[str, re.Pattern] = {}
    for kind, name, raw, start, end in markup(source):
        if start < skip_to:
            continue
        if start > at:
            held.append(source[at:start])
        at = end
        if kind == "skip":
            continue
        if kind == "close":
            close(name)
            continue
        if name in RAW:
            flush()
            pattern = raw_ends.setdefault(name, re.compile(rf"</{name}\b[^>]*>", re.I))
            stop = pattern.search(source, end) if not raw.endswith("/") or name in ("script", "style") else None
            if stop or not raw.endswith("/"):
                at = skip_to = stop.end() if stop else len(source)
            continue
        attrs = attributes(raw)
        above = stack.items[-1] if stack.items else ("", False, 0, 0)
        path = above[3]
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                close("p")
            for other in SIBLINGS.get(name, ()):
                close(other)
            above = stack.items[-1] if stack.items else ("", False, 0, 0)
            words = " ".join(sorted({w for n in ("class", "id") for w in attrs.get(n, "").lower().split()}))
            path = _path(above[3], f"{name} {words}")
            tags.append((path, position))
            position += 1
        if name in VOID or raw.endswith("/"):
            continue
        boiler = above[1] or _is_boiler(name, attrs, above[2] > 0)
        article = above[2]
        if not boiler and not article and (name in ("article", "main") or "articlebody" in attrs.get("itemprop", "").lower() or attrs.get("role", "").strip().lower() == "main"):
            articles += 1
            article = articles
        stack.push(name, boiler, article, path)
    if at < len(source):
        held.append(source[at:])
    flush()
    return tags, blocks


def _text_token(block: Block) -> int:
    return _hash(f"{block.around[-1] if block.around else 0}\n\n{block.text}")


def page_key(source: str | None, blocks) -> int:
    """Equal for copies of a page: a digest of its article, else of its text outside boilerplate, else of the html."""
    own = [b.text for b in blocks if not b.boiler]
    return _hash("\n".join([b.text for b in blocks if not b.boiler and b.article] or own or [source or ""]))


def _emit(batches):
    """(host, page, token, n, first): occurrences and first position of each token of a page."""
    for batch in batches:
        rows = []
        for hosts, sources in pieces(batch, "host", "html"):
            for host, source in zip(hosts, sources, strict=True):
                tags, blocks = parse(source)
                page, seen = page_key(source, blocks), {}
                for token, at in sorted(tags + [(_text_token(b), b.position) for b in blocks], key=lambda x: x[1]):
                    n, first = seen.get(token, (0, at))
                    seen[token] = n + 1, first
                rows += [(host, page, t, n, first) for t, (n, first) in seen.items()]
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["host", "page", "token", "n", "first"])


def templates(pages: DataFrame, share: float = 0.9, min_pages: int = 5) -> DataFrame:
    """(host, template): for each host (a hash) its frequent tokens with class and whether it is the root's, in order.

    pages: (host, html). Pages with one article text count once, whatever advert or script differs. A class is the tokens of
    one occurrence vector; the vector's digest is an exclusive or over pages, so it is put together in any order and no host is
    gathered. A token belongs to the template if it is in `share` of the host's pages, and these are min_pages or more; a
    host's template is no longer than 1 / share of a page. The root is the class that all pages have once.
    """
    rows = pages.where("host IS NOT NULL").mapInArrow(_emit, "host long, page long, token long, n long, first long")
    once = rows.groupBy("host", "token", "page").agg(F.max("n").alias("n"), F.min("first").alias("first"))
    vectors = once.groupBy("host", "token").agg(F.count("*").alias("pages"), F.max("n").alias("most"), F.bit_xor(F.xxhash64("page", "n")).alias("class"), F.avg("first").alias("place"))
    vectors = checkpointed(vectors)
    sizes = vectors.groupBy("host").agg(F.max("pages").alias("all_pages"))  # a token that every page has gives the number of pages
    frequent = vectors.join(sizes, "host").where((F.col("pages") >= min_pages) & (F.col("pages") >= share * F.col("all_pages")))
    root = (F.col("pages") == F.col("all_pages")) & (F.col("most") == 1)
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "token", "class", root.alias("root")))).alias("template"))


def content(tags, blocks, template: list[dict] | None) -> tuple[list[tuple[Block, int]], list[tuple[Block, int]]]:
    """Blocks that names don't rule out, each with its slot: those that are content, and those that are tokens of valid classes.

    A slot is the innermost element of the root class around a block, 0 if there is none.
    """
    if not template:
        return [(b, 0) for b in blocks if not b.boiler], []
    of = {t["token"]: t for t in template}
    roots = {t["token"] for t in template if t["root"]}
    slot = {id(b): next((p for p in reversed(b.around) if p in roots), 0) for b in blocks}
    # each class that isn't the root's: do its tokens, where they first stand, keep the template's order and one slot?
    last: dict[int, float] = {}
    inside: dict[int, int] = {}
    broken, seen, current = set(), set(), 0
    there = sorted([(p, 0, t, 0) for t, p in tags] + [(b.position, 1, _text_token(b), slot[id(b)]) for b in blocks])
    for _, is_text, token, own_slot in there:
        if not is_text and token in roots:
            current = token
        known = of.get(token)
        if known is None or known["root"] and not is_text or token in seen:
            continue
        seen.add(token)
        c = known["class"]
        if known["place"] < last.get(c, -1.0) or (is_text and inside.setdefault(c, own_slot) != own_slot and not known["root"]):
            broken.add(c)
        last[c] = max(known["place"], last.get(c, -1.0))
    own, repeated = [], []
    for b in blocks:
        if not b.boiler:
            known = of.get(_text_token(b))
            (repeated if known is not None and known["class"] not in broken else own).append((b, slot[id(b)]))
    return own, repeated


def _slots(batches):
    """(host, slot, digest, chars, fixed): the texts of each slot; fixed are those that are the template's."""
    for batch in batches:
        rows = []
        for hosts, sources, found in pieces(batch, "host", "html", "template"):
            for host, source, template in zip(hosts, sources, found, strict=True):
                if template:
                    own, repeated = content(*parse(source), template)
                    rows += [(host, s, _hash(b.text), len(b.text), f) for f, part in ((0, own), (1, repeated)) for b, s in part]
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["host", "slot", "digest", "chars", "fixed"])


def slot_model(pages: DataFrame, variety: float = 0.5, most_fixed: float = 0.5) -> DataFrame:
    """(host, dull, keep_fixed) from pages (host, html, template).

    dull: slots whose share of distinct texts is below `variety` of that of the host's heaviest slot. keep_fixed: template text is
    over `most_fixed` of all, as on a host whose pages are near copies of one article; then it isn't taken for template.
    """
    rows = pages.where("template IS NOT NULL").mapInArrow(_slots, "host long, slot long, digest long, chars long, fixed long")
    texts = rows.groupBy("host", "slot", "digest", "fixed").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    slots = texts.groupBy("host", "slot").agg(F.count_if(F.col("fixed") == 0).alias("kinds"), F.coalesce(F.sum(F.when(F.col("fixed") == 0, F.col("n"))), F.lit(0)).alias("n"),
                                              F.coalesce(F.sum(F.when(F.col("fixed") == 0, F.col("chars"))), F.lit(0)).alias("chars"), F.sum(F.col("chars") * F.col("fixed")).alias("fixed"))
    slots = checkpointed(slots.withColumn("varied", F.coalesce(F.try_divide("kinds", "n"), F.lit(0.0))))  # read twice
    best = slots.groupBy("host").agg(F.max_by("varied", "chars").alias("best"), (F.sum("fixed") > most_fixed * F.sum(F.col("chars") + F.col("fixed"))).alias("keep_fixed"))
    dull = slots.join(best, "host").groupBy("host", "keep_fixed").agg(F.collect_list(F.when((F.col("n") > 0) & (F.col("varied") < variety * F.col("best")), F.col("slot"))).alias("dull"))
    return dull.select("host", "dull", "keep_fixed")  # a host has no more slots than root tokens


def main_text(source: str | None, template: list[dict] | None = None, dull=(), keep_fixed: bool = False) -> str:
    """The article's text: blocks of the main slots, in page order, joined by blanks; of the marked article where there is one."""
    tags, blocks = parse(source)
    own, repeated = content(tags, blocks, template)
    if keep_fixed:
        own = sorted(own + repeated, key=lambda x: x[0].position)
    marked = [b for b, _ in own if b.article]
    if marked or any(b.article for b, _ in repeated):
        return " ".join(b.text for b in marked)
    off = set(dull or ())
    return " ".join(b.text for b, s in own if s not in off)


#: Tokens of all templates together up to which they are sent to every executor; beyond it they are joined by shuffle.
BROADCAST_TOKENS = 500_000
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def extract_main_text(pages: DataFrame, share: float = 0.9, min_pages: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null and empty pages have an empty text. Pages without a host in their URL, or of a host with few pages, have no
    template and are cut by their elements alone. Repeated rows are extracted each. An empty table gives no rows. Other columns
    of pages are left out, whatever their names.
    """
    text_batches(pages)
    url = F.col(f"`{url_col}`").cast("string")
    named = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    src = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), F.when(named != "", F.xxhash64(named)).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    found = checkpointed(templates(src.select("host", "html"), share, min_pages))
    small = (found.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_TOKENS
    sized = F.broadcast if small else (lambda df: df)
    model = checkpointed(found.join(slot_model(src.join(sized(found), "host").select("host", "html", "template")), "host", "left"))

    @text_udf("string")
    def text_of(sources, models):
        return [main_text(s, m["template"], m["dull"], bool(m["keep_fixed"])) for s, m in zip(sources, models, strict=True)]

    out = src.join(sized(model), "host", "left").select("page_id", "url", text_of("html", F.struct("template", "dull", "keep_fixed")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
