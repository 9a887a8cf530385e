"""Main text of web pages: markup, and the suffix order of each host.

1. A tolerant pass over the markup yields the blocks of a page in order, each in
   one of three zones: inside the page's article (or main) element, outside of
   it, or marked as something else (menus, headers, footers, asides, forms, and
   elements whose class, id or role say advert, notice, comment and the like).
   Scripts, styles and comments of the markup are no text at all.
2. All text of a page forms two token streams, that of its article and that
   outside of it. The suffixes of all streams of a host are ordered by prefix
   doubling, and its blocks of fewer than ``DEPTH`` tokens with them, each ending
   with a mark. Neighbours in the order that agree in ``DEPTH`` tokens (or in all
   of a short block) form a run, and its distinct pages are counted: all of them,
   those that have it outside of their article, and those that have it inside. A
   host of more than ``PART`` tokens is ordered in parts, by pages. What is on
   ``SHARE`` of a host's pages is on as many in one of its parts at least, so the
   parts name the runs in question, and all parts count these. Runs on at least
   ``LEAST`` pages and ``SHARE`` of the host's pages are repeats; longer ones are
   rows of suffixes that follow each other in a page. Repeats that so many pages
   have outside of an article, and more than have them inside, are boilerplate.
3. A page with an article keeps its article whole: copies and quoted passages
   repeat across pages just like boilerplate, so repeats alone must not cut
   there. A page without one keeps what boilerplate does not cover of its
   unmarked blocks, the unique runs and what articles of other pages quote. If
   fewer than ``LONG`` tokens are left, the page is a copy of others, and its long
   blocks stay whole.

Defined results: a null or empty html, or a page without main text, gives the
empty text; a page of any length is read whole; text in no element counts as a
block; a page without url shares its repeats with other such pages; repeats at
exactly ``LEAST`` pages and ``SHARE`` of a host count; repeated rows count as one
page and are all returned, and so do rows without id that are equal; an empty
table gives no rows. Other columns are ignored.
"""

import re
import sys
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxframe.llm import text as tx
from voxframe.session import bound_batches, ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH = 20
LONG = 20
LEAST, SHARE = 3, 0.05
#: Tokens of a host that are ordered at once (four times as many, before a part has
#: fewer than ``FEW`` pages), bytes of html for one, and the mark at the end of a short block.
PART, FEW, TOKEN_BYTES = 1 << 16, 40, 8
END = np.uint64(2**64 - 1)

# Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
SILENT = set("script style noscript template head title iframe object svg math canvas audio video textarea".split())
MARKED = set("nav footer aside form menu dialog button select fieldset".split())
HINTS = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pagination pager popup privacy promo promoted promotion recommended related replies respond responses share sharing "
    "sidebar signup sitemap skip social sponsor sponsored subscribe subscription toolbar tracking widget widgets".split()
)
OUTSIDE_HINTS = {"header", "topbar", "top", "bottom", "login", "search"}
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
ARTICLE_HINTS = set("ad advert comment comments promo related".split())
#: Inside an article these name its own sections as often as something else: some
#: never mark an element there, some only as a whole class.
OWN_SECTIONS = set("discussion privacy respond responses".split())
WHOLE_CLASSES = set("copyright disclaimer menu navigation notice notices promotion recommended related replies".split())
#: Elements whose content is no markup: without end tag they take the rest.
RAW = set("script style textarea title iframe".split())
PARAGRAPH = {"p"}
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

ARTICLE, PLAIN, OTHER = 2, 1, 0


# A comment, a tag with its attributes, or other markup; a quote that is never
# closed does not reach beyond the next ">".
TAG = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))|[!?/][^>]*(?:>|\Z))""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")


def attributes(source):
    out = {}
    for m in ATTRIBUTE.finditer(source.rstrip(">").rstrip("/")):
        value = m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


def marks(tag, source, region):
    """Whether an element is marked as something else than main text."""
    if tag in MARKED or (tag == "header" and region is None):
        return True
    if "=" not in source and "hidden" not in source:
        return False
    values = attributes(source)
    if "hidden" in values or re.search(r"display\s*:\s*none", values.get("style", "")):
        return True
    if values.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    words = set(re.split(r"[^a-z]+", f"{values.get('class', '')} {values.get('id', '')}".lower()))
    if tag == "article":
        return bool(words & ARTICLE_HINTS)
    if region is None:
        return bool(words & (HINTS | OUTSIDE_HINTS))
    whole = WHOLE_CLASSES & set(values.get("class", "").lower().split())
    return bool(whole or words & (HINTS - OWN_SECTIONS - WHOLE_CLASSES))


def blocks(html):
    """[(zone, text)] of a page; main stands in for a missing article."""
    found, parts, stack = [], [], []
    marked, region, at = False, None, 0

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                found.append((OTHER if marked else region or PLAIN, text))

    def add(text):
        if text:
            parts.append(unescape(text) if "&" in text else text)

    while True:
        m = TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, source = m[2].lower(), m[3]
        block = tag in BLOCK
        if m[1]:
            if block:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    marked, region = stack[i][1:]
                    del stack[i:]
                    break
                # A stray end tag of an inline element closes no block.
                if not block and stack[i][0] in BLOCK:
                    break
            continue
        if tag in SILENT:
            # Its text is none of the page's; it ends at its own end tag only.
            flush()
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if end is not None:
                at = end.end()
            elif tag in RAW:
                break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if block:
            flush()
            closes = SELF_CLOSING.get(tag, PARAGRAPH)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    marked, region = stack[i][1:]
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        stack.append((tag, marked, region))
        marked = marked or marks(tag, source, region)
        if tag == "article" and not marked:
            region = ARTICLE
        elif region is None and (tag == "main" or ("role" in source and attributes(source).get("role") == "main")):
            region = ARTICLE + 1  # main: stands in where no article is
    flush()
    zones = {z for z, _ in found}
    main = ARTICLE if ARTICLE in zones else ARTICLE + 1
    return [(ARTICLE if z == main else PLAIN if z > ARTICLE else z, t) for z, t in found]


def _words(texts):
    """Bytes of some texts, and starts, ends and text numbers of their tokens."""
    data, offsets = tx.raw(pa.array(texts, pa.string()))
    return data, *tx.words(data, offsets)


def _windows(n):
    """Suffixes of a stream of n tokens that a repeat can begin."""
    return max(0, n - DEPTH + 1)


def token_hashes(texts):
    """Hash of each token of some texts, and the number of tokens of each text."""
    data, starts, ends, rows = _words(texts)
    hashes = tx.slice_hash(tx.prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.bincount(rows, minlength=len(texts))


def suffix_ranks(tokens, ends):
    """Ranks of all suffixes by their first 1, 2, 4, ... tokens, DEPTH or more at last.

    ``ends`` holds for each token the end of its string; a string that has ended
    comes before one that goes on. Each level doubles the one before.
    """
    rank = np.unique(tokens, return_inverse=True)[1] + 1
    levels, at = [rank], np.arange(len(tokens))
    while 1 << (len(levels) - 1) < DEPTH:
        rest = at + (1 << (len(levels) - 1))
        second = np.where(rest < ends, rank[np.minimum(rest, len(tokens) - 1)], 0)
        rank = np.unique(rank * (len(tokens) + 1) + second, return_inverse=True)[1] + 1
        levels.append(rank)
    return levels


def common_prefixes(levels, ends, left, right):
    """Tokens that the suffixes at ``left`` and ``right`` have in common, as far as ranks go."""
    size = np.zeros(len(left), np.int64)
    room = np.minimum(ends[left] - left, ends[right] - right)
    for level in reversed(range(len(levels))):
        use = np.flatnonzero(size < room)
        use = use[levels[level][left[use] + size[use]] == levels[level][right[use] + size[use]]]
        size[use] += 1 << level
    return np.minimum(size, room)


def strings(sizes, tokens):
    """The strings of a host's pages, and the suffixes that repeats can begin.

    ``sizes`` and ``tokens`` have one array per page: the length of each block, and
    all tokens. Strings are the stream of a page and each short block, which ends
    with a mark. Returns tokens, ends of their strings, and of each suffix: start,
    tokens that a repeat needs, page (number) and place in it.
    """
    length = np.array([len(t) for t in tokens], np.int64)
    stream = np.concatenate([np.zeros(0, np.uint64), *tokens])
    end = np.cumsum(length)
    page = np.repeat(np.arange(len(length)), length)
    at = np.flatnonzero(end[page] - np.arange(len(stream)) >= DEPTH)
    count = np.array([len(b) for b in sizes], np.int64)
    size = np.concatenate([np.zeros(0, np.int64), *sizes])
    owner = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(size)) - np.repeat(np.cumsum(count) - count, count)
    short = np.flatnonzero((size > 0) & (size < DEPTH))
    need = size[short] + 1
    last = np.cumsum(need)
    token = np.arange(need.sum()) + np.repeat((np.cumsum(size) - size)[short] - (last - need), need)
    token[last - 1] = 0
    marked = stream[token] if len(stream) else np.zeros(0, np.uint64)
    marked[last - 1] = END
    first = len(stream)
    return (
        np.concatenate([stream, marked]),
        np.concatenate([end[page], first + np.repeat(last, need)]),
        np.concatenate([at, first + last - need]),
        np.concatenate([np.full(len(at), DEPTH, np.int64), need]),
        np.concatenate([page[at], owner[short]]),
        np.concatenate([at - (end - length)[page[at]], np.maximum(0, length - DEPTH + 1)[owner[short]] + number[short]]),
    )


def runs_of(tokens, ends, at, need):
    """(order of the suffixes, whether each begins a run that agrees as far as needed)."""
    levels = suffix_ranks(tokens, ends)
    order = np.argsort(levels[-1][at], kind="stable")
    left, right = order[:-1], order[1:]
    common = common_prefixes(levels, ends, at[left], at[right])
    return order, np.concatenate([[True], common < np.maximum(need[left], need[right])])


def distinct_pages(run, page, count):
    """Distinct pages of each of some runs."""
    size = int(page.max(initial=0)) + 1
    return np.bincount(np.unique(run * size + page) // size, minlength=count)


def repeats_of(tokens, ends, at, need, page):
    """(suffix, pages): one suffix of each run of the order that agrees as far as needed."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, new = runs_of(tokens, ends, at, need)
    return order[new], distinct_pages(np.cumsum(new) - 1, page[order], int(new.sum()))


def _keys(tokens, at, need):
    """Names of the first needed tokens of suffixes, the same in every part of a host."""
    return tx.slice_hash(tx.prefix_hash(tokens), at, at + need).view(np.int64)


def _host_hash(url):
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", url or "", re.I)
    data = np.frombuffer((m[1].lower() if m else "").encode(), np.uint8)
    return tx.slice_hash(tx.prefix_hash(data), np.array([0]), np.array([len(data)]))[0]


def _sizes(batches):
    """Host, page and size of each row, without its markup."""
    for batch in batches:
        hosts = np.array([_host_hash(url) for url in batch.column("url").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hosts), batch.column("page"), batch.column("size")], names=["host", "page", "size"])


class Streams:
    """The pages of a part of a host, each with all of its text as two streams.

    Entry 2 i is what page i has outside of its article, entry 2 i + 1 its article;
    ``sizes`` and ``tokens`` hold what ``strings`` takes. Equal rows are one page.
    """

    def __init__(self, table):
        ids = np.stack([table.column(name).to_numpy() for name in ("page", "version")], 1)
        rows, self.row = np.unique(ids, axis=0, return_index=True, return_inverse=True)[1:]
        self.row = self.row.reshape(-1)
        #: Rows of one id with other contents are parts of one page.
        self.ids, self.number = np.unique(ids[rows, 0], return_inverse=True)
        self.found = [_unpacked(r) for r in table.select(["zones", "size", "texts"]).take(rows).to_pylist()]
        texts, counts = [], []
        for found in self.found:
            for inside in (False, True):
                own = [t for z, t in found if (z == ARTICLE) == inside]
                texts += own
                counts.append(len(own))
        hashes, n = token_hashes(texts)
        self.sizes = np.split(n, np.cumsum(counts)[:-1])
        self.tokens = np.split(hashes, np.cumsum([int(s.sum()) for s in self.sizes])[:-1])

    def pages_of(self, entry):
        return self.number[entry // 2]


COUNTS = ["n", "outside", "inside"]


def _three_counts(run, entry, streams, count):
    """Pages of each run: all, those with it outside of their article, and inside."""
    page, inside = streams.pages_of(entry), entry % 2 == 1
    return [distinct_pages(run[use], page[use], count) for use in (slice(None), ~inside, inside)]


def _found(table, keys, counts):
    columns = [np.full(len(keys), table.column(name)[0].as_py() if table.num_rows else 0, np.int64) for name in ("host", "parts")]
    return pa.table([pa.array(c, pa.int64()) for c in [*columns, keys, *counts]], names=["host", "parts", "key", *COUNTS])


def _ordered(table):
    """Orders all suffixes of a part of a host: the runs in it that can be repeats, and their pages."""
    streams = Streams(table)
    tokens, ends, at, need, entry, _ = strings(streams.sizes, streams.tokens)
    if not len(at):
        return _found(table, np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 3)
    order, new = runs_of(tokens, ends, at, need)
    counts = _three_counts(np.cumsum(new) - 1, entry[order], streams, int(new.sum()))
    # Below the share by less than a rounding error; a whole host is counted here.
    use = counts[0] >= SHARE * len(streams.ids) * (1 - 1e-9)
    if table.column("parts")[0].as_py() == 1:
        use &= counts[0] >= LEAST
    suffix = order[new][use]
    return _found(table, _keys(tokens, at[suffix], need[suffix]), [c[use] for c in counts])


def _places(streams, known):
    """(entry, place, index in ``known``) of all suffixes with a known key, by entry and place."""
    tokens, _, at, need, entry, place = strings(streams.sizes, streams.tokens)
    keys = _keys(tokens, at, need)
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = np.flatnonzero(known[i] == keys)
    hit = hit[np.lexsort((place[hit], entry[hit]))]
    return entry[hit], place[hit], i[hit]


def _counted(table, runs):
    """Pages of the runs that any part of the host has named, in one part."""
    if not table.num_rows:
        runs = runs.slice(0, 0)
    if not runs.num_rows or table.column("parts")[0].as_py() == 1:
        # A host in one part has been counted.
        return _found(table, runs.column("key").to_numpy(), [runs.column(name).to_numpy() for name in COUNTS])
    streams, known = Streams(table), np.sort(runs.column("key").to_numpy())
    entry, _, i = _places(streams, known)
    counts = _three_counts(i, entry, streams, len(known))
    use = counts[0] > 0
    return _found(table, known[use], [c[use] for c in counts])


def _parsed(batches):
    """The blocks of each page, which move instead of its markup."""
    for batch in tx.blocks(batches, "html"):
        found = [blocks(html or "") for html in batch.column("html").to_pylist()]
        hosts = np.array([_host_hash(url) for url in batch.column("url").to_pylist()], np.uint64).view(np.int64)
        # A block holds no line break, so one joins them.
        texts = ["\n".join(t for _, t in f).encode() for f in found]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(name) for name in ("page_id", "page", "version", "url")],
                pa.array(hosts),
                pa.array([bytes(z for z, _ in f) for f in found], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in texts], pa.binary()),
            ],
            names=["page_id", "page", "version", "url", "host", "zones", "size", "texts"],
        )


def _unpacked(row):
    if not row["zones"]:
        return []
    content = pa.decompress(row["texts"], row["size"], codec="zstd", asbytes=True)
    return list(zip(row["zones"], content.decode().split("\n")))


def _runs(window, count):
    """The windows that belong to a repeat of its own.

    Where the pages of neighbouring windows drop to less than half, boilerplate
    ends and some pages happen to go on alike ("the"): what goes on for less than
    DEPTH tokens is none of it.
    """
    if not len(window):
        return window
    apart = np.diff(window) > 1
    new = np.concatenate([[True], apart | (2 * count[1:] < count[:-1]) | (2 * count[:-1] < count[1:])])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(window))
    use = end - first >= DEPTH
    for i, (a, z) in enumerate(zip(first.tolist(), end.tolist())):
        below = (a > 0 and not apart[a - 1] and count[a - 1] > count[a]) or (z < len(window) and not apart[z - 1] and count[z] > count[z - 1])
        use[i] |= not below
    return window[np.repeat(use, end - first)]


def _covered(size, places, pages):
    """Which tokens of a stream the repeats at some places (with their pages) cover."""
    last = np.cumsum(size)
    total = int(size.sum())
    n = _windows(total)
    change = np.zeros(total + 1, np.int64)
    window, block = _runs(places[places < n], pages[places < n]), places[places >= n] - n
    for first, end in ((window, window + DEPTH), (last[block] - size[block], last[block])):
        np.add.at(change, first, 1)
        np.add.at(change, end, -1)
    return np.cumsum(change)[:-1] > 0


def _kept(found, size, covered):
    """The text of a page; ``covered`` tells which tokens outside of an article are boilerplate."""
    if any(z == ARTICLE for z, _ in found):
        return "\n".join(t for z, t in found if z == ARTICLE)
    if not covered.any():
        return "\n".join(t for z, t in found if z == PLAIN)
    data, starts, ends, _ = _words([t for _, t in found])
    last = np.cumsum(size)
    keep, left = [], 0
    for i, (z, t) in enumerate(found):
        if z != PLAIN:
            continue
        own = np.arange(last[i] - size[i], last[i])
        use = own[~covered[own]]
        left += len(use)
        if len(use) == len(own):
            keep.append(t)
        elif len(use):
            keep.append(b" ".join(data[starts[j] : ends[j]].tobytes() for j in use).decode())
    if left < LONG:
        # A copy of other pages: its long blocks, and what is unique in the others.
        keep = []
        for i, (z, t) in enumerate(found):
            own = np.arange(last[i] - size[i], last[i])
            if z == PLAIN and (size[i] >= LONG or not covered[own].any()):
                keep.append(t)
            elif z == PLAIN and not covered[own].all():
                keep.append(b" ".join(data[starts[j] : ends[j]].tobytes() for j in own[~covered[own]]).decode())
    return "\n".join(keep)


def _texts(table, repeats):
    """The texts of a part of a host, by all repeats of the host."""
    texts, covers = [], []
    if table.num_rows:
        streams = Streams(table)
        repeats = repeats.sort_by("key")
        known, n, outside, cuts = (repeats.column(name).to_numpy(zero_copy_only=False) for name in ("key", "n", "outside", "cuts"))
        entry, place, i = _places(streams, known) if len(known) else np.zeros((3, 0), np.int64)
        first = np.searchsorted(entry, np.arange(len(streams.sizes) + 1))
        for page, found in enumerate(streams.found):
            count = 0
            for e in (2 * page, 2 * page + 1):
                at = slice(first[e], first[e + 1])
                count += int(_covered(streams.sizes[e], place[at], n[i[at]]).sum())
            at = slice(first[2 * page], first[2 * page + 1])
            use = cuts[i[at]]
            cover = _covered(streams.sizes[2 * page], place[at][use], outside[i[at]][use])
            texts.append(_kept(found, streams.sizes[2 * page], cover))
            covers.append(count)
        texts, covers = [texts[r] for r in streams.row], [covers[r] for r in streams.row]
    return pa.table(
        [table.column("page_id"), table.column("url"), pa.array(texts, pa.string()), pa.array(covers, pa.int64())],
        names=["page_id", "url", "text", "n_repeated"],
    )


def main_text(spark, pages):
    """One row per page: page_id, url, text, n_chars, n_repeated.

    ``n_repeated`` tokens of the page, its article included, are covered by
    repeats on pages of the host.
    """
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    version = F.xxhash64("url", "html")
    # The hash of an id is one to one; equal rows without id are one page.
    page = F.when(F.col("page_id").isNotNull(), F.xxhash64(F.col("page_id").cast("long"))).otherwise(version)
    pages = pages.select(F.col("page_id").cast("long"), page.alias("page"), version.alias("version"), "url", "html")
    sized = pages.select("page", "url", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"))
    hosts = sized.mapInArrow(_sizes, "host long, page long, size long").groupBy("host")
    hosts = hosts.agg(F.count_distinct("page").alias("pages"), F.sum("size").alias("size")).checkpoint()
    # Hosts beyond PART tokens are ordered in parts; there are few of those.
    fit = lambda tokens: F.ceil(F.col("size") / (TOKEN_BYTES * tokens))
    parts = F.greatest(fit(4 * PART), F.least(fit(PART), F.floor(F.col("pages") / FEW))).cast("long")
    large = hosts.select("host", parts.alias("parts")).filter("parts > 1")
    columns = "page_id long, page long, version long, url string, host long, zones binary, size long, texts binary"
    dealt = pages.mapInArrow(_parsed, columns).join(F.broadcast(large), "host", "left")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    # A page is in one part of its host only, so the pages of the parts add up.
    dealt = dealt.withColumn("part", F.pmod(F.col("page"), "parts")).groupBy("host", "part")
    counts = "host long, parts long, key long, n long, outside long, inside long"
    runs = dealt.applyInArrow(_ordered, counts).groupBy("host", "key", "parts").agg(*[F.max(c).alias(c) for c in COUNTS])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    sent = runs.select("host", "key", *COUNTS, each).groupBy("host", "part")
    share = SHARE * F.col("pages")
    repeats = (
        dealt.cogroup(sent)
        .applyInArrow(_counted, counts)
        .groupBy("host", "key", "parts")
        .agg(*[F.sum(c).alias(c) for c in COUNTS])
        .filter(F.col("n") >= LEAST)
        .join(hosts, "host")
        .filter(F.col("n") >= share)
        .withColumn("cuts", (F.col("outside") >= LEAST) & (F.col("outside") >= share) & (F.col("outside") > F.col("inside")))
        .select("host", "key", "n", "outside", "cuts", each)
        .groupBy("host", "part")
    )
    texts = dealt.cogroup(repeats).applyInArrow(_texts, "page_id long, url string, text string, n_repeated long")
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
