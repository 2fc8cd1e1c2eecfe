"""Main text of web pages by inferred wrappers (operator 9).

A page is a stream of tags and texts.  Neighbouring repeats in a stream fold into repeated
groups, inner ones first.  The streams of pages of a host are aligned one after another
with the wrapper so far: equal tags stay, differing texts become slots, items that one
side lacks become optional, groups are aligned inside.  The result is a regular expression
without unions (tags, fixed texts, slots, optional items, repeated groups), one per host.
Pages are aligned in short runs; what a page of a run lacks cannot be template and goes with
the run's end, and the wrappers of runs are aligned with each other, keeping what all have.

Elements select the texts of a page: those in its article or main element, else those of
its body, without regions that are marked as navigation, adverts, notices, comments and the
like.  Outside articles, extraction aligns the folded stream with the host's wrapper and
takes the template's fixed texts out: single ones, and repeated groups (menus) of which all
texts are fixed.  Texts that the wrapper doesn't know, and pages of hosts without a template,
go by their elements alone.

The form of a wrapper is learned from all distinct pages of a host, in parts of about ``PART``
by a hash of their streams.  Which of its texts are fixed is counted over all of them, too: a text is template only if every page has it at that place, and it is left out of a
page only where the page's own text equals it.  Every page is extracted.  Null or empty html: empty text.  A url without a host,
or null, is of the host "".  Repeated rows are kept.  Only the named columns are read.
Empty table: empty result.
"""

from __future__ import annotations

import difflib
import hashlib
import html as entities
import json
import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeforge.operators.skew import shuffled
from scopeforge.session import materialize

from .common import table, text_slices

#: Streams that are aligned one after another with their optional items.
RUN = 12
#: Distinct pages, or wrappers of such parts, of a host that one task aligns at a time.
PART = 128
#: Streams and alignments that a worker remembers.
REMEMBERED = 1024
#: Distinct pages of a host from which on a text that never changes counts as template.
SURE = 4

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead
title tr ul""".split())
NOT_TEXT = frozenset("""aside button dialog footer form head iframe label menu nav noscript object option script select
style svg template textarea title""".split())
MAIN = ("article", "main")
#: Elements that hold a piece of prose: inside an article no mark makes them anything else.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong code dt dd td th q cite mark".split())
ENDS_PARAGRAPH = BLOCK - {"option", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"},
             "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</\1\s*>|\Z)|<[/!?]?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?]?[a-zA-Z][^<>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=>/]|\Z)|display\s*:\s*none", re.I)
_WORD = (r"(?:ads?|adverts?|advertisements?|advertising|anzeigen?|banner|breadcrumbs?|byline[-_]share|comments?"
         r"|commentlist|commentaires?|comentarios?|consent|cookies?|cookie(?:bar|banner|hinweis|notice)|disqus|footer|header"
         r"|kommentare?|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promos?"
         r"|publicidad|publicit[eé]|related|replies|respond|share|sharing|sidebar|skip[-_]?link|social|sponsor(?:ed|s)?"
         r"|subscribe|subscriptions?|toolbar|werbung|widget)")
_BESIDE = r"(?:site|top|bottom|list|bar|area|posts|articles|links?|buttons?|form|box|block|trail|panel|strip|container|wrapper|\d+)"
#: Whole tokens of classes, ids and roles of parts that are no article text: words of such parts,
#: by themselves or with each other and words that tell place or kind (not "no-sidebar").
_ASIDE = re.compile(rf"(?:{_BESIDE}[-_])*{_WORD}(?:[-_](?:{_WORD}|{_BESIDE}))*", re.I)


def aside(marks: str, main: bool) -> bool:
    """Whether a class, id or role marks a part as no article text; an article's header is text."""
    return any(_ASIDE.fullmatch(t) and not (main and t.lower() == "header") for t in marks.split())


def stream(page: str) -> list[tuple]:
    """Tags ``("t", signature)`` and texts ``("x", text, role, block)`` of a page.

    Role 2: inside an article or main element; 1: elsewhere in the body; 0: no main text
    by its elements.  ``block`` numbers the stretches between block tags."""
    items: list[tuple] = []
    # of every element: parent, name, excluded by its name or hidden, marked, in main
    tree = [(0, "", False, False, False)]
    stack = [0]
    block, gap = 0, ""
    for m in _TOKEN.finditer(page):
        part = m.group()
        if part[0] != "<" or part == "<":
            if part.isspace():
                gap = " "
                continue
            items.append(("x", gap + part, stack[-1], block))
            gap = ""
            continue
        if m.group(1) or part.startswith(("<!", "<?")):
            continue
        close, name = _NAME.match(part).groups()
        name = name.lower()
        if close:
            at = next((i for i in range(len(stack) - 1, 0, -1) if tree[stack[i]][1] == name), 0)
            if at:
                del stack[at:]
            items.append(("t", f"/{name}"))
        else:
            if name in ENDS_PARAGRAPH:
                at = next((i for i in range(len(stack) - 1, 0, -1) if tree[stack[i]][1] == "p"), 0)
                if at:
                    del stack[at:]
            if name in SAME_ENDS:
                for i in range(len(stack) - 1, 0, -1):
                    if tree[stack[i]][1] in SAME_ENDS[name]:
                        break
                    if tree[stack[i]][1] == name:
                        del stack[i:]
                        break
            marks = " ".join(a or b or c for a, b, c in _MARK.findall(part)) if "=" in part else ""
            items.append(("t", f"{name}.{marks}" if marks else name))
            if name not in VOID and not part.endswith("/>"):
                main = name in MAIN or tree[stack[-1]][4]
                out = (name in NOT_TEXT and name != "form"
                       or bool(("hidden" in part or "none" in part) and _HIDDEN.search(part)))
                marked = (name == "header" and not main) or bool(
                    marks and name not in ("html", "body", *MAIN) and not (main and name in PROSE) and aside(marks, main))
                stack.append(len(tree))
                tree.append((stack[-2], name, out, marked, main))
        if name in BLOCK:
            block, gap = block + 1, ""
        elif name == "br":
            gap = " "
    roles = _roles(tree, [(i[2], len(i[1])) for i in items if i[0] == "x"])
    return [("x", i[1], roles[i[2]], i[3]) if i[0] == "x" else i for i in items]


def _roles(tree: list[tuple], texts: list[tuple[int, int]]) -> list[int]:
    """The role of every element's own texts; ``texts``: (element, characters).

    A mark does not count on an element that holds a main element, or that holds articles
    where the page has none outside marked elements.  A form does not count that holds an
    article, a main element or more than half of the text that is left.  Where that leaves no
    text at all, marks and forms do not count."""
    n = len(tree)
    out, under, mains = [False] * n, [False] * n, [0] * n
    for e, (up, name, off, marked, _) in enumerate(tree[1:], 1):
        out[e], under[e] = out[up] or off, under[up] or marked
        # main elements around it that no mark excludes
        mains[e] = mains[up] + (name == "main" and not out[e] and not under[e])

    def total(own: list[int]) -> list[int]:
        for e in range(n - 1, 0, -1):
            own[tree[e][0]] += own[e]
        return own

    def size(hidden: list[bool]) -> list[int]:
        own = [0] * n
        for e, chars in texts:
            own[e] += 0 if hidden[e] else chars
        return total(own)

    chars = size(out)
    holds = {k: total([int(t[1] == k and not out[e] and chars[e] > 0) for e, t in enumerate(tree)]) for k in MAIN}
    free = any(t[1] == "article" and not out[e] and not under[e] and chars[e] for e, t in enumerate(tree))
    free_mains = sum(t[1] == "main" and not out[e] and not under[e] and chars[e] > 0 for e, t in enumerate(tree))
    soft = out[:]
    for e, (up, _, _, marked, _) in enumerate(tree[1:], 1):
        soft[e] = out[e] or soft[up] or (marked and not holds["main"][e] and not (
            holds["article"][e] and not free and free_mains <= mains[e]))
    left = size(soft)
    for e, (up, name, *_) in enumerate(tree[1:], 1):
        soft[e] = soft[e] or soft[up] or (name == "form" and not holds["main"][e] and not holds["article"][e]
                                          and 2 * left[e] <= left[0])
    if not size(soft)[0]:
        soft = out
    return [0 if soft[e] else 2 if tree[e][4] else 1 for e in range(n)]


def key(item) -> str:
    return item[1] if item[0] == "t" else "#" if item[0] == "x" else "+" + key(item[1][0][0])


def fold(items: list) -> list:
    """Neighbouring repeats as ``("+", [instance, ...])``, short bodies first, of any length."""
    return _placed(_folded(tuple(map(key, items))), items)


def _placed(plan: list, items: list) -> list:
    return [items[p] if isinstance(p, int) else ("+", [_placed(body, items) for body in p[1]]) for p in plan]


@lru_cache(REMEMBERED)
def _folded(names: tuple) -> list:
    """The places of a stream with these names, folded; pages of a host share few streams.

    A body of ``size`` names repeats at a place where the next ``size`` names equal those
    ``size`` further on; such places are found for the whole stream at once."""
    items, names = list(range(len(names))), list(names)
    codes: dict[str, int] = {}
    at = np.array([codes.setdefault(n, len(codes)) for n in names], np.int64)
    size = 1
    while 2 * size <= len(items):
        equal = np.concatenate([[0], np.cumsum(at[size:] == at[:-size])])
        places = np.flatnonzero(equal[size:] - equal[:-size] == size).tolist()
        places = [i for i in places if names[i] != "#" and names[i][0] != "/"]
        if not places:
            size += 1
            continue
        out, out_names, begin = [], [], 0
        repeats = set(places)
        for i in places:
            if i < begin:
                continue
            out += items[begin:i]
            out_names += names[begin:i]
            n = 2
            while i + (n - 1) * size in repeats:
                n += 1
            out.append(("+", [items[i + k * size:i + (k + 1) * size] for k in range(n)]))
            out_names.append("+(" + " ".join(names[i:i + size]) + ")")
            begin = i + n * size
        items, names = out + items[begin:], out_names + names[begin:]
        at = np.array([codes.setdefault(n, len(codes)) for n in names], np.int64)
        size = 1 if size > 1 else 2
    return items


def pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal names in an alignment of two lists."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    return _aligned(tuple(a), tuple(b))


@lru_cache(REMEMBERED)
def _aligned(a: tuple, b: tuple) -> list[tuple[int, int]]:
    found = []
    for i, j, n in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks():
        found += [(i + k, j + k) for k in range(n)]
    return found


def group_digest(group: tuple, of) -> str:
    """Of all texts of a repeated group, in order."""
    def texts(items):
        for i in items:
            if i[0] == "x":
                yield of(i)
            elif i[0] == "+":
                for instance in i[1]:
                    yield from texts(instance)
    return digest(" ".join(texts([group])))


def packed_digest(text: tuple) -> str:
    return text[1]


def begin_wrapper(items: list) -> list:
    """A wrapper that is one page: [kind, value, optional], for groups also the digest of all
    their texts."""
    out = []
    for i in items:
        if i[0] == "t":
            out.append(["t", i[1], False])
        elif i[0] == "x":
            out.append(["x", " ".join(i[1].split()), False])
        else:
            body = begin_wrapper(i[1][0])
            for more in i[1][1:]:
                body = merge(body, more)
            out.append(["+", body, False, group_digest(i, packed_digest)])
    return out


def wrapper_key(item: list) -> str:
    return item[1] if item[0] == "t" else "#" if item[0] == "x" else "+" + wrapper_key(item[1][0])


def merge(wrapper: list, items: list) -> list:
    """The wrapper generalised to a further page (or instance of a group)."""
    out, i, j = [], 0, 0
    for a, b in [*pairs([wrapper_key(w) for w in wrapper], [key(x) for x in items]), (len(wrapper), len(items))]:
        out += [[*w[:2], True, *w[3:]] for w in wrapper[i:a]]
        out += [[*w[:2], True, *w[3:]] for w in begin_wrapper(items[j:b])]
        if a < len(wrapper):
            kind, value, optional, *whole = wrapper[a]
            if kind == "x" and value is not None and value != " ".join(items[b][1].split()):
                value = None
            elif kind == "+":
                for instance in items[b][1]:
                    value = merge(value, instance)
                whole = [whole[0] if whole[0] == group_digest(items[b], packed_digest) else None]
            out.append([kind, value, optional, *whole])
        i, j = a + 1, b + 1
    return out


def matched(wrapper: list, items: list, of=packed_digest, within: list | None = None):
    """(page text, wrapper item, enclosing group of which the page has all the fixed texts)
    for each text of a folded page; for each repeated group of the wrapper whose texts are
    fixed (("+", digest), item, None); and for each fixed text or group that the page lacks
    (None, item, None)."""
    hit = {b: a for a, b in pairs([wrapper_key(w) for w in wrapper], [key(x) for x in items])}
    for j, x in enumerate(items):
        w = wrapper[hit[j]] if j in hit else None
        if x[0] == "x":
            yield x, w, within
        elif x[0] == "+":
            same = within
            if w and w[3] is not None:
                mine = group_digest(x, of)
                yield ("+", mine), w, None
                if mine == w[3]:
                    same = w
            for instance in x[1]:
                yield from matched(w[1] if w else [], instance, of, same)
    met = set(hit.values())
    for w in constants([w for a, w in enumerate(wrapper) if a not in met]):
        yield None, w, None


def constants(wrapper: list) -> list:
    """The texts of a wrapper that aren't slots, and its groups whose texts are fixed, in order."""
    out = []
    for w in wrapper:
        if w[0] == "+":
            out += [w] * (w[3] is not None) + constants(w[1])
        elif w[0] == "x" and w[1] is not None:
            out.append(w)
    return out


def fixed_value(w: list) -> str | None:
    return w[3] if w[0] == "+" else w[1]


def digest(text: str) -> str:
    return hashlib.blake2b(" ".join(text.split()).encode("utf-8", "replace"), digest_size=12).hexdigest()


def pack(items: list[tuple]) -> list[str]:
    """A stream as signatures of tags and ``#``, role and digest of texts."""
    return [i[1] if i[0] == "t" else f"#{i[2]}{digest(i[1])}" for i in items]


def unpack(packed: list[str]) -> list[tuple]:
    return [("x", i[2:], int(i[1]), 0) if i[0] == "#" else ("t", i) for i in packed]


def infer(packed: list[list[str]]) -> list:
    """The wrapper of some streams; its fixed texts are digests."""
    wrapper: list = []
    for n, p in enumerate(packed):
        items = fold(unpack(p))
        wrapper = merge(wrapper, items) if n else begin_wrapper(items)
    return wrapper


def required(wrapper: list, inside: bool = False) -> list:
    """A wrapper without its optional items; the first item of a group tells the group and stays."""
    return [[kind, required(value, True) if kind == "+" else value, False, *whole]
            for n, (kind, value, optional, *whole) in enumerate(wrapper) if not optional or inside and not n]


def shared(a: list, b: list, inside: bool = False) -> list:
    """What two wrappers without optional items have in common; texts that differ are slots."""
    first = [(0, 0)] if inside else []
    n = len(first)
    rest = pairs([wrapper_key(w) for w in a[n:]], [wrapper_key(w) for w in b[n:]])
    out = []
    for i, j in [*first, *((i + n, j + n) for i, j in rest)]:
        kind, value, _, *whole = a[i]
        if kind == "x":
            value = value if value == b[j][1] else None
        elif kind == "+":
            value, whole = shared(value, b[j][1], True), [whole[0] if whole[0] == b[j][3] else None]
        out.append([kind, value, False, *whole])
    return out


def form(packed: list[list[str]]) -> list:
    """The wrapper of any number of streams: of all items that each of them has."""
    return reduce(shared, (required(infer(packed[i:i + RUN])) for i in range(0, len(packed), RUN)))


def tally(wrapper: list, packed: list[list[str]]) -> dict[int, list[int]]:
    """Over some streams, for each fixed text of the wrapper by its number: streams that have
    it wherever its place is, streams that have another text there, and body texts equal to
    it.  Under -1: the streams, 0, and all their body texts."""
    number = {id(w): n for n, w in enumerate(constants(wrapper))}
    counts = {n: [0, 0, 0] for n in range(-1, len(number))}
    for p in packed:
        equal: dict[int, int] = {}
        lacking, other = set(), set()
        counts[-1][0] += 1
        for x, w, _ in matched(wrapper, fold(unpack(p))):
            body = x is not None and x[0] == "x" and x[2] > 0
            counts[-1][2] += body
            n = number.get(id(w))
            if n is None:
                continue
            if x is None:
                lacking.add(n)
            elif x[1] != fixed_value(w):
                other.add(n)
            else:
                equal[n] = equal.get(n, 0) + body
        for n in other:
            counts[n][1] += 1
        for n, texts in equal.items():
            counts[n][0] += n not in other and n not in lacking
            counts[n][2] += texts
    return counts


def settle(wrapper: list, counts: dict[int, list[int]]) -> dict:
    """The wrapper with slots for all texts that some page lacks or has otherwise, and whether
    the others are template."""
    pages, _, texts = counts[-1]
    fixed = 0
    for n, w in enumerate(constants(wrapper)):
        always, other, equal = counts.get(n, (0, 0, 0))
        fixed += 0 if other else equal
        if always < pages:
            w[3 if w[0] == "+" else 1] = None
    # pages that are versions of each other share their article too: then nothing is template
    return {"wrapper": wrapper, "template": pages >= SURE and texts - fixed > fixed}


def learn(pages: list[str]) -> dict:
    """The wrapper of a host's pages and whether its fixed texts are template."""
    packed = [list(p) for p in sorted({tuple(pack(stream(p))) for p in pages})]
    wrapper = form(packed)
    return settle(wrapper, tally(wrapper, packed))


def main_text(page: str | None, learned: dict | None) -> str:
    """Blocks of the main text, joined by line feeds."""
    if not page:
        return ""
    items = stream(page)
    if learned and learned["template"]:
        texts = [t for t in matched(learned["wrapper"], fold(items), lambda t: digest(t[1])) if t[0] and t[0][0] == "x"]
    else:
        texts = [(x, None, None) for x in items if x[0] == "x"]
    least = 2 if any(x[2] == 2 for x, *_ in texts) else 1
    blocks: dict[int, list[str]] = {}
    for x, w, group in texts:
        if x[2] < least:
            continue
        # what an article element holds is the article, however often it comes
        if x[2] < 2 and (group is not None or w is not None and w[1] is not None and w[1] == digest(x[1])):
            continue
        blocks.setdefault(x[3], []).append(x[1])
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def streams(pages: DataFrame) -> DataFrame:
    """(host, stream): the distinct streams of every host as JSON; pages without body text
    have none."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "html"):
                packed = [pack(stream(page)) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), pa.array([json.dumps(p) if any(i[:2] in ("#1", "#2") for i in p) else None
                                                    for p in packed], pa.string())], names=["host", "stream"])

    return (pages.filter("html <> ''").select(host().alias("host"), "html")
            .mapInArrow(run, "host string, stream string").filter("stream IS NOT NULL").distinct())


def host_forms(found: DataFrame) -> DataFrame:
    """(host, wrapper): the form of every host's wrapper as JSON, from all its distinct streams.

    Streams are dealt to parts of a host by their hash; the wrappers of parts are dealt again,
    until a host has one.  A host's parts depend on its own pages only."""
    def of_streams(group: pa.Table) -> pa.Table:
        return joined(group, form([json.loads(s) for s in sorted(group["own"].to_pylist())]))

    def of_wrappers(group: pa.Table) -> pa.Table:
        return joined(group, reduce(shared, map(json.loads, sorted(group["own"].to_pylist()))))

    def joined(group: pa.Table, wrapper: list) -> pa.Table:
        return group.slice(0, 1).select(["host", "part", "parts"]).append_column("own", pa.array([json.dumps(wrapper)]))

    def deal(number):
        return F.ceil(number / F.lit(PART)).cast("long")

    sizes = materialize(found.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "wrapper-sizes")
    left = sizes.agg(F.max("n")).first()[0] or 0
    own = found.join(shuffled(sizes), "host").select(
        "host", F.pmod(F.xxhash64("stream"), deal(F.col("n"))).alias("part"), deal(F.col("n")).alias("parts"), F.col("stream").alias("own"))
    # the join leaves a host in one task; its parts are dealt over all
    own = own.repartition("host", "part")
    align = of_streams
    while True:
        own = materialize(own.groupBy("host", "part", "parts").applyInArrow(
            align, "host string, part long, parts long, own string"), "wrapper-forms")
        left, align = -(-left // PART), of_wrappers
        if left <= 1:
            return own.select("host", F.col("own").alias("wrapper"))
        own = own.select("host", F.pmod("part", deal(F.col("parts"))).alias("part"), deal(F.col("parts")).alias("parts"), "own")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, learned): the wrapper as JSON of every host that has a template."""
    found = materialize(streams(pages), "wrapper-streams")
    forms = host_forms(found)

    def count(batches):
        for batch in batches:
            by: dict[tuple, list] = {}
            for h, s, w in zip(*(batch.column(c).to_pylist() for c in ("host", "stream", "wrapper"))):
                by.setdefault((h, w), []).append(json.loads(s))
            out = [(h, n, *c) for (h, w), packed in by.items() for n, c in tally(json.loads(w), packed).items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), *[pa.int64()] * 4))] if out else
                [pa.array([], t) for t in (pa.string(), *[pa.int64()] * 4)], names=["host", "n", "always", "other", "equal"])

    counts = (found.join(forms, "host").select("host", "stream", "wrapper")
              .mapInArrow(count, "host string, n long, always long, other long, equal long")
              .groupBy("host", "n").agg(F.sum("always").alias("always"), F.sum("other").alias("other"), F.sum("equal").alias("equal"))
              .groupBy("host").agg(F.to_json(F.collect_list(F.array("n", "always", "other", "equal"))).alias("counts")))

    def close(batches):
        for batch in batches:
            learned = [settle(json.loads(w), {n: c for n, *c in json.loads(counted)}) for w, counted in zip(
                batch.column("wrapper").to_pylist(), batch.column("counts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([json.dumps(x) if x["template"] else None for x in learned], pa.string())],
                names=["host", "learned"])

    return (forms.join(counts, "host").select("host", "wrapper", "counts")
            .mapInArrow(close, "host string, learned string").filter("learned IS NOT NULL"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    own = pages.select("page_id", "url", "html", host().alias("host"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select("page_id", "url").schema)

    def run(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            for part in text_slices(batch, "html"):
                out = []
                for page, learned in zip(part.column("html").to_pylist(), part.column("learned").to_pylist()):
                    if learned is not None and learned not in known:
                        if len(known) > 500:
                            known.clear()
                        known[learned] = json.loads(learned)
                    out.append(main_text(page, known.get(learned)))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())],
                                                 names=["page_id", "url", "text"])

    # a table of its own: then both sides of the join are plain exchanges, and Spark splits a
    # host that holds a large share of the pages
    learned = materialize(wrappers(pages), "wrappers")
    return own.join(learned, "host", "left").select("page_id", "url", "html", "learned").mapInArrow(
        run, f"{schema}, text string")


def op9_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
