"""HTML main text by equivalence-class template deduction over the pages of a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Mapping
from types import MappingProxyType
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import materialize, spread

#: Pages that a layout stands on at least, and its least share of a host's pages (so a host has 100 disjoint layouts at most).
MIN_PAGES, LAYOUT_SHARE = 3, 0.01
#: Tags that share a page set make it a layout.
LAYOUT_TAGS = 2
#: Least share of a layout's text that varies; pages more alike than that are copies, and what they share is no furniture.
VARYING = 0.2
#: A container with this share of the varying text of its page's largest one may hold the main text.
MAIN_SHARE = 0.5
#: Template tokens broadcast at most (about 32 bytes each, by host); beyond that the join shuffles.
BROADCAST_TOKENS = 500_000
#: Hosts whose template a worker remembers.
HELD_HOSTS = 200
#: Distinct tokens that a task counts before it hands them on.
FLUSH_TOKENS = 200_000

# --- a tolerant tokenizer -------------------------------------------------------
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)\]\]>"
    r"|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|select|title)\b(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|lang|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
# Fixed sets of element names.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never main text.
DROPPED = frozenset("nav footer aside form head button dialog menu object canvas audio video map label fieldset".split())
#: Words in class, id or role that mark a part as none of the main text.
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay "
    "cookie cookies consent gdpr notice notices notification alert "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip "
    "sidebar aside complementary widget widgets related recommended recommendations trending "
    "footer foot contentinfo copyright header masthead topbar toolbar search login signup subscribe subscription newsletter "
    "share sharing social follow comment comments disqus replies reply respondents discussion".split()
)
#: Compounds of those words that mark the main text all the same.
MAIN = frozenset("article content main post entry story body text".split())
ROOTS = frozenset(("article", "main"))
#: Blocks that hold words rather than blocks.
PROSE = frozenset("p li br dd dt h1 h2 h3 h4 h5 h6 pre td th legend figcaption caption summary option".split())
#: Elements that an opening tag of the same group ends, and the elements that keep the group apart.
SIBLINGS = {n: g for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for n in g}
SCOPES = frozenset("ul ol menu dl table select article main section div body".split())


def _marks(name: str, attrs: str, inside_root: bool) -> tuple[bool, bool]:
    """(never main text, named like page furniture) of an element."""
    hard = name in DROPPED or name == "header" and not inside_root
    soft = False
    for key, value in _NAMES.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            hard = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hard = True
        elif key in ("class", "id", "role"):
            for label in value.split():
                words = set(_WORD.findall(label))
                if words & {"with", "has", "no", "without"}:
                    continue  # tells of the page around it
                heads = inside_root or words & {"article", "entry", "post", "story"}  # a header of the story, not of the site
                found = words & (CHROME - {"header"} if heads else CHROME)
                if found and not (words & MAIN and name in ("article", "main", "body", "html")):
                    soft = True
    return hard, soft


class Page:
    """The element tree of a page, flat: nodes by opening tag, text runs by node; unclosed and stray tags are tolerated.

    A node or run is named by a 64-bit key of its path: the tags (name, class, id, role and lang) from the top, and for a run its text.
    """

    def __init__(self, page: str):
        self.keys, self.parents, self.names = [0], [-1], [""]
        self.hard, self.soft, self.root, self.h1 = [False], [False], [False], [False]
        #: (node, block number, raw text, key or None for white space)
        self.runs: list[tuple[int, int, str, int | None]] = []
        stack, where, block = [0], {}, 0

        def pop(size: int) -> None:
            while len(stack) > size:
                where[self.names[stack.pop()]].pop()

        for m in _TOKEN.finditer(page):
            text = m["text"] if m["text"] is not None else m["cdata"]
            if text is not None:
                bare = text.strip()
                key = _key(self.keys[stack[-1]], bare) if bare else None
                self.runs.append((stack[-1], block, text if bare else " ", key))
                continue
            name = (m["name"] or "").lower()
            if not name:
                block += (m["raw"] or "").lower() in ("textarea", "select", "title", "iframe", "noscript")
                continue
            if name in BLOCKS:
                block += 1
            if m["close"]:
                at = where.get(name)
                if at and (name in ("body", "html") or not self._between(stack, at[-1], name)):
                    pop(at[-1])
                continue
            if name in BLOCKS and name != "br" and where.get("p") and all(self.names[n] not in BLOCKS for n in stack[where["p"][-1] + 1 :]):
                pop(where["p"][-1])  # a paragraph ends where a block begins
            group = SIBLINGS.get(name)
            if group:
                at = max((where[n][-1] for n in group if where.get(n)), default=0)
                if at and not any(self.names[n] in SCOPES for n in stack[at + 1 :]):
                    pop(at)
            attrs, up = m["attrs"] or "", stack[-1]
            hard, soft = _marks(name, attrs, self.root[up])
            tag = name + "".join(f" {k.lower()}={v}" for k, v in _NAMES.findall(attrs) if k.lower() in ("class", "id", "role", "lang")) if attrs else name
            self.keys.append(_key(self.keys[up], "<" + tag))
            self.parents.append(up)
            self.names.append(name)
            self.hard.append(self.hard[up] or hard)
            self.soft.append(self.soft[up] or soft)
            self.root.append(self.root[up] or name in ROOTS)
            self.h1.append(self.h1[up] or name == "h1")
            if name not in VOID and not attrs.rstrip().endswith("/"):
                where.setdefault(name, []).append(len(stack))
                stack.append(len(self.keys) - 1)

    def _between(self, stack: list[int], at: int, name: str) -> bool:
        """Whether an end tag would end more than it can: an inline one a block, any other an article."""
        ends = ROOTS if name in BLOCKS else BLOCKS
        return name not in ROOTS and any(self.names[n] in ends for n in stack[at + 1 :])

    def tokens(self) -> Iterator[tuple[int, int, bool]]:
        """(key, key of the container, is a tag) of all opening tags and text runs, in page order by kind."""
        for n in range(1, len(self.keys)):
            yield self.keys[n], self.keys[self.parents[n]], True
        for node, _, _, key in self.runs:
            if key is not None:
                yield key, self.keys[node], False

    def slots(self) -> list[bool]:
        """Whether each run may be main text by its elements: never in an element that holds none, nor in one named like
        furniture, unless the page has no article element and no text elsewhere."""
        held = [not self.hard[n] for n, *_ in self.runs]
        plain = [h and not self.soft[r[0]] for h, r in zip(held, self.runs, strict=True)]
        return plain if any(self.root) or any(p and r[3] is not None for p, r in zip(plain, self.runs, strict=True)) else held

    def below(self, varying: list[int]) -> list[int]:
        """Characters of varying runs (chars by run) inside each node."""
        out = [0] * len(self.keys)
        for (node, *_), n in zip(self.runs, varying, strict=True):
            out[node] += n
        for n in range(len(out) - 1, 0, -1):  # children come after their parents
            out[self.parents[n]] += out[n]
        return out


def _key(parent: int, token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), seed=parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class Template(NamedTuple):
    """What the pages of a host share: keys of furniture text, and varying characters a page inside each container."""

    furniture: frozenset[int] = frozenset()
    containers: Mapping[int, float] = MappingProxyType({})


def _main_node(page: Page, containers: Mapping[int, float]) -> int | None:
    """The innermost container that holds MAIN_SHARE of what the largest one of the page holds by the template, or the article around it."""
    known = [(n, containers[k]) for n, k in enumerate(page.keys) if k in containers]
    most = max((x for _, x in known), default=0)
    if most <= 0:
        return None
    main = max(n for n, x in known if x >= MAIN_SHARE * most)
    while page.root[page.parents[main]]:
        main = page.parents[main]
    return main


def main_text(html_text: str, template: Template = Template()) -> str:
    """The blocks of the slots that hold the article, one newline between, white space collapsed.

    Slots are what lies between template tokens. With a template, the main text is what is inside the container
    whose slots hold most of the varying text (_main_node), and an h1; furniture, which is text of the template, goes, as long as
    something else is left. Without one, or on a page without that container, an article or main element holds it, or the
    whole page. Inside, an article or main element is preferred too, and elements that hold no main text
    or are named like furniture go (Page.slots), as adverts and reader comments vary like a story.
    """
    page = Page(html_text)
    runs = [r for r, held in zip(page.runs, page.slots(), strict=True) if held]
    told = lambda some: any(r[3] is not None for r in some)
    main = _main_node(page, template.containers)
    if main is not None:
        inside = [False] * len(page.keys)
        for n in range(1, len(page.keys)):
            inside[n] = n == main or inside[page.parents[n]]
        if told(r for r in runs if inside[r[0]]):
            runs = [r for r in runs if inside[r[0]] or page.h1[r[0]]]
    if told(r for r in runs if page.root[r[0]]):
        runs = [r for r in runs if page.root[r[0]]]
    slots = [r for r in runs if r[3] not in template.furniture]
    if not told(slots):
        slots = runs
    blocks: list[list[str]] = []
    last = None
    for _, block, text, _ in slots:
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(text)
    joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


# --- template deduction ----------------------------------------------------------
def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _halves(x: int) -> tuple[int, int]:
    """The halves of a sum of 64-bit hashes, which are summed apart and so can't overflow."""
    return (x >> 32) & 0xFFFFFFFF, x & 0xFFFFFFFF


_SEEN = "host string, key long, parent long, tag boolean, pages long, set_hi long, set_lo long, vec_hi long, vec_lo long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per token of a host: pages that hold it, and the sums of hashes of its pages, and of (page, times) over them.

    Tokens with equal sums have, but for 64-bit collisions, the same page set or occurrence vector. Key null counts pages.
    """
    held: dict[tuple[str, int | None], list] = {}

    def out():
        rows = [(h, k, v[0], v[1], v[2], *_halves(v[3]), *_halves(v[4])) for (h, k), v in held.items()]
        held.clear()
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = [c.split()[0] for c in _SEEN.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _SEEN.split(", ")])
    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            times: dict[int | None, list] = {None: [1, 0, False]}
            for key, parent, tag in Page(page).tokens():
                entry = times.setdefault(key, [0, parent, tag])
                entry[0] += 1
            name = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))
            for key, (n, parent, tag) in times.items():
                entry = held.setdefault((host, key), [parent, tag, 0, 0, 0])
                entry[2] += 1
                entry[3] += name
                entry[4] += xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed=name)
            if len(held) > FLUSH_TOKENS:
                yield out()
    if held:
        yield out()


def deduce_classes(rows: DataFrame) -> DataFrame:
    """(host, key, tag, layout, class) of tokens on the page set of a layout, from rows (host, html).

    Tokens are grouped by page set; LAYOUT_TAGS tags of one set make it a layout. A class is the tokens of a layout
    with one occurrence vector and one container. Only counts are shuffled, summed map-side first, so a host of any size is
    counted in parallel; a host has no more tokens on LAYOUT_SHARE of its pages than 1 / LAYOUT_SHARE pages have.
    """
    seen = rows.mapInArrow(_occurrences, _SEEN).groupBy("host", "key").agg(
        F.min("parent").alias("parent"), F.max("tag").alias("tag"), *(F.sum(c).alias(c) for c in ("pages", "set_hi", "set_lo", "vec_hi", "vec_lo"))
    )
    seen = materialize(seen.where(f"pages >= {MIN_PAGES}"), "tokens")
    hosts = seen.where("key is null").select("host", F.col("pages").alias("of"))
    often = seen.where("key is not null").join(hosts, "host").where(f"pages >= {LAYOUT_SHARE} * of")
    often = often.withColumn("layout", F.xxhash64("pages", "set_hi", "set_lo"))
    layouts = often.groupBy("host", "layout").agg(F.count_if("tag").alias("tags")).where(f"tags >= {LAYOUT_TAGS}")
    return often.join(layouts, ["host", "layout"]).select("host", "key", "tag", "layout", F.xxhash64("layout", "parent", "vec_hi", "vec_lo").alias("class"))


_FACTS = "host string, kind int, id long, a long, b long, lo long, hi long"
#: Kinds of facts about a host that its pages give: order of a class, text of a layout, text in a container.
ORDER, TEXT, INSIDE = 0, 1, 2


def page_facts(page: Page, known: Mapping[int, tuple[bool, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(kind, id, a, b, x) of one page with tokens known: key -> (tag, layout, class).

    ORDER: x is a hash of the order of the class's tokens, a counts 1 if they don't repeat in one order. TEXT: a fixed and b
    varying characters on a page of the layout. INSIDE: a varying characters inside the container, b 1, x times it occurs.
    """
    order: dict[int, list[int]] = {}
    layouts = set()
    for key, _, _ in page.tokens():
        if key in known:
            _, layout, group = known[key]
            order.setdefault(group, []).append(key)
            layouts.add(layout)
    for group, keys in order.items():
        k = len(set(keys))
        same = all(x == keys[i % k] for i, x in enumerate(keys))
        yield ORDER, group, int(not same), 0, xxhash.xxh64_intdigest(b"".join(x.to_bytes(8, "little", signed=True) for x in keys[:k])) - (1 << 63)
    fixed: dict[int, int] = dict.fromkeys(layouts, 0)
    varying = [0] * len(page.runs)
    for i, ((_, _, text, key), held) in enumerate(zip(page.runs, page.slots(), strict=True)):
        if key is None or not held:
            continue
        if key in known:
            fixed[known[key][1]] += len(text)
        else:
            varying[i] = len(text)
    total = sum(varying)
    for layout, n in fixed.items():
        yield TEXT, layout, n, total, 0
    times: dict[int, int] = {}
    for key in page.keys[1:]:
        times[key] = times.get(key, 0) + 1
    for node, n in enumerate(page.below(varying)):
        if node and page.keys[node] in known and page.names[node] in BLOCKS and page.names[node] not in PROSE:
            yield INSIDE, page.keys[node], n, 1, times[page.keys[node]]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_facts of all pages (host, html, classes), summed by host."""
    names = [c.split()[0] for c in _FACTS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _FACTS.split(", ")])
    held: dict[tuple[str, int, int], list[int]] = {}
    known = _Held(lambda classes: {c["key"]: (c["tag"], c["layout"], c["class"]) for c in classes.as_py()})

    def out():
        rows = [dict(zip(names, (*k, *v), strict=True)) for k, v in held.items()]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema)

    for b in batches:
        for i, (host, page) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            for kind, key, a, extra, x in page_facts(Page(page), known.of(host, b.column(2), i)):
                entry = held.setdefault((host, kind, key), [0, 0, x, x])
                entry[0] += a
                entry[1] += extra
                entry[2], entry[3] = min(entry[2], x), max(entry[3], x)
            if len(held) > FLUSH_TOKENS:
                yield out()
    if held:
        yield out()


class _Held:
    """What a worker remembers of hosts, read from their rows; of HELD_HOSTS at most."""

    def __init__(self, read):
        self.read, self.hosts = read, {}

    def of(self, host: str, column: pa.Array, i: int):
        if host not in self.hosts:
            if len(self.hosts) >= HELD_HOSTS:
                self.hosts.clear()
            self.hosts[host] = self.read(column[i])
        return self.hosts[host]


def _with_host(rows: DataFrame, hosts: DataFrame, sizes: str, how: str) -> DataFrame:
    """rows joined to one row a host, by broadcast up to BROADCAST_TOKENS tokens, else by a join whose hot hosts adaptive execution splits."""
    tokens = hosts.agg(F.sum(F.expr(sizes))).first()[0] or 0
    return rows.join(F.broadcast(hosts) if tokens <= BROADCAST_TOKENS else hosts, "host", how)


def deduce_templates(rows: DataFrame) -> DataFrame:
    """(host, furniture, containers) from rows (host, html).

    A class is valid when its tokens come in one order on all pages of the layout; a layout when VARYING of its text is in no
    class. Classes nest by their containers: the template is the tree of valid classes, its slots what lies between their tokens.
    furniture: keys of text in valid classes of valid layouts. containers: block elements that occur once on a
    page, with the varying characters a page inside, so slots are weighed.
    """
    classes = materialize(deduce_classes(rows), "classes")
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("key", "tag", "layout", "class")).alias("classes"))
    by_host = materialize(by_host, "host_classes")
    met = _with_host(rows, by_host, "size(classes)", "inner").select("host", "html", "classes")
    facts = met.mapInArrow(_facts, _FACTS).groupBy("host", "kind", "id").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    facts = materialize(facts, "facts")
    ordered = facts.where(f"kind = {ORDER} and a = 0 and lo = hi").select("host", F.col("id").alias("class"))
    varied = facts.where(f"kind = {TEXT} and b >= {VARYING} * (a + b)").select("host", F.col("id").alias("layout"))
    fixed = classes.where("not tag").join(ordered, ["host", "class"], "left_semi").join(varied, ["host", "layout"], "left_semi")
    fixed = fixed.groupBy("host").agg(F.collect_list("key").alias("furniture"))
    once = facts.where(f"kind = {INSIDE} and hi = 1 and a > 0").groupBy("host").agg(
        F.collect_list(F.struct(F.col("id").alias("key"), (F.col("a") / F.col("b")).alias("chars"))).alias("containers")
    )
    return fixed.join(once, "host", "full")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Held(lambda t: Template(frozenset(t["furniture"].as_py() or ()), {c["key"]: c["chars"] for c in t["containers"].as_py() or ()}))
    for b in batches:
        texts = []
        shared = pa.StructArray.from_arrays([b.column(4), b.column(5)], ["furniture", "containers"])
        for i, (host, page) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            texts.append(main_text(page, known.of(host, shared, i)))
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points): the main text of the whole html.

    Null or empty html gives an empty text. A null or hostless url shares the template of all such pages.
    Repeated rows repeat, and each counts as a page of its host; unclosed and stray tags are tolerated, and nesting of any depth
    and pages of any length are read whole, in time linear in their length. Of containers with equally much text the later one
    on the page counts. Hosts of fewer than MIN_PAGES pages have no template: there names of elements and classes alone
    decide. Other columns are ignored; an empty table gives an empty result.
    """
    rows = spread(pages.select("page_id", "url", _host().alias("host"), F.coalesce("html", F.lit("")).alias("html")))
    templates = materialize(deduce_templates(rows.select("host", "html")), "templates")
    size = "coalesce(size(furniture), 0) + coalesce(size(containers), 0)"
    rows = _with_host(rows, templates, size, "left").select("page_id", "url", "host", "html", "furniture", "containers")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
