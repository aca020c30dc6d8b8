"""Markup residue in text documents (problem 5)."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import Scratch, small

#: The corpus's own elements, which are no foreign markup.
OWN = ("TITLE", "AUTHOR", "DATELINE", "BODY")
# Names of HTML and wiki elements by what they mark up.
HEADING_TAGS = "h1|h2|h3|h4|h5|h6"
LIST_TAGS = "ul|ol|li|dl|dt|dd|menu|dir"
CODE_TAGS = "pre|source|syntaxhighlight|listing|xmp"
INLINE_TAGS = (
    "a|abbr|acronym|address|article|aside|b|bdi|bdo|big|blockquote|br|button|caption|center|cite|code|col|colgroup|data|del|details|"
    "dfn|div|em|figcaption|figure|font|footer|form|gallery|header|hr|i|iframe|img|input|ins|kbd|label|link|main|mark|meta|nav|"
    "nowiki|p|param|q|ref|references|s|samp|script|section|small|span|strike|strong|style|sub|summary|sup|svg|table|tbody|td|"
    "template|tfoot|th|thead|time|tr|tt|u|var|video|wbr"
)
MATH_ENVIRONMENTS = "equation|align|alignat|displaymath|math|eqnarray|gather|multline|flalign"
CODE_ENVIRONMENTS = "verbatim|lstlisting|minted|Verbatim|alltt"
LIST_ENVIRONMENTS = "itemize|enumerate|description"
SECTIONS = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph"
OWN_REFERENCES = "lt|gt|amp"

_I = re.IGNORECASE
CODE = re.compile(
    rf"^[ ]{{0,3}}(?P<fence>`{{3,}}|~{{3,}})[^\n`]*\n(?P<c1>.*?)(?:^[ ]{{0,3}}(?P=fence)[`~]*[ \t]*$|\Z)"
    rf"|<(?P<tag>{CODE_TAGS})\b[^<>]*>(?P<c2>.*?)(?:</(?P=tag)\s*>|\Z)"
    rf"|\\begin\{{(?P<env>{CODE_ENVIRONMENTS})\*?\}}(?P<c3>.*?)(?:\\end\{{(?P=env)\*?\}}|\Z)",
    _I | re.M | re.S,
)
FORMULA = re.compile(
    rf"<math\b[^<>]*>(?P<f1>.*?)</math\s*>|\$\$(?P<f2>.+?)\$\$|\\\[(?P<f3>.+?)\\\]|\\\((?P<f4>.+?)\\\)"
    rf"|\\begin\{{(?P<menv>{MATH_ENVIRONMENTS})(?P<star>\*?)\}}(?P<f5>.*?)\\end\{{(?P=menv)(?P=star)\}}"
    r"|(?<![\\$\w])\$(?=[^\s$])(?P<f6>[^$\n]*?(?:\\[A-Za-z]+|\^|_\{|_[A-Za-z0-9]\b)[^$\n]*?)(?<=[^\s\\])\$(?![\d$])",
    _I | re.S,
)
HEADING = re.compile(
    rf"<(?P<hx>{HEADING_TAGS})\b[^<>]*>(?P<h1>.*?)(?:</(?P=hx)\s*>|\Z)"
    rf"|\\(?:{SECTIONS})\*?(?:\[[^\]]*\])?\{{(?P<h2>[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*)\}}"
    r"|^[ ]{0,3}(?P<wiki>={1,6})(?P<h3>[^=\n][^\n]*?)(?P=wiki)[ \t]*$"
    r"|^[ ]{0,3}#{1,6}[ \t]+(?P<h4>\S[^\n]*?)(?:[ \t]+#+)?[ \t]*$"
    r"|^[ ]{0,3}(?P<h5>[^\s=<#][^\n]*)\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$",
    re.M | re.S | _I,
)
BULLETS = re.compile(r"(?:^[ ]{0,3}(?:[-+]|[*#]+[:;]?|\d{1,3}[.)])[ \t]+\S[^\n]*(?:\n|\Z))+", re.M)
_bullet = re.compile(r"^[ ]{0,3}(?:([-+])|([*#]+)[:;]?|\d{1,3}[.)])[ \t]+", re.M)
LISTS = re.compile(rf"</?(?:{LIST_TAGS})\b[^<>]*>|\\(?:begin|end)\{{(?:{LIST_ENVIRONMENTS})\}}|^\s*\\item\b", _I | re.M)
INLINE = re.compile(
    rf"<!--.*?(?:-->|\Z)|</?(?:{INLINE_TAGS})(?:\s[^<>]*)?/?>|&(?!(?:{OWN_REFERENCES});)(?:#\d+|#x[0-9a-f]+|[a-z][a-z0-9]*);"
    r"|!?\[[^\[\]]*(?:\[[^\[\]]*\](?:\([^()\s]*\))?[^\[\]]*){0,9}\]\([^()\s]*(?:\s\"[^\"]*\")?\)|\[\[[^\[\]]+\]\]|\{\{[^{}]+\}\}|\[https?://[^\s\]]+[^\]]*\]"
    r"|\*\*(?=[^\s*]).{1,2000}?(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])[^_].{0,2000}?(?<=[^\s_])__(?!\w)|~~(?=[^\s~]).{1,2000}?(?<=[^\s~])~~"
    r"|(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<!\w)_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?!\w)|`[^`\n]+`"
    r"|'{2,3}(?=[^'\s])[^'\n]+?(?<=[^'\s])'{2,3}|\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{",
    _I | re.S,
)
# The two ends of bold, underlined and struck spans, which ``INLINE`` has up to a length.
ENDS = [
    (re.compile(opening), re.compile(closing))
    for opening, closing in (
        (r"\*\*(?=[^\s*])", r"(?<=[^\s*])\*\*"), (r"(?<!\w)__(?=[^\s_])", r"(?<=[^\s_])__(?!\w)"), (r"~~(?=[^\s~])", r"(?<=[^\s~])~~"),
    )
]
_own_tag = re.compile(rf"</?(?:{'|'.join(OWN)})>")


def _wiki(text: str) -> bool:
    return bool(re.search(r"\[\[|\{\{|'''|^={1,6}[^=\n].*=\s*$|^\*\*+\s|<ref\b|<nowiki|<syntaxhighlight|<source\b", text, re.M | _I))


def _headings_and_lists(text: str) -> tuple[str, bool, bool]:
    """The text with headings and list marks normalised to ``# `` and ``- ``, and whether it has such."""
    heading = listed = False
    wiki = _wiki(text)

    def items(m: re.Match) -> str:
        """List lines as ``- `` lines. A single ``#`` line is a heading unless the page is wiki text, a single line that
        begins with a number or a dash is a wrapped line of prose."""
        nonlocal listed
        out = []
        for numbered, run in groupby(m.group().splitlines(), key=lambda x: x.lstrip().startswith("#")):
            lines = list(run)
            if len(lines) > 1 or (wiki if numbered else not re.match(r"\s{0,3}[-+\d]", lines[0])):
                listed = True
                lines = [_bullet.sub("- ", x) for x in lines]
            out += lines
        return "\n".join(out) + "\n"

    def head(m: re.Match) -> str:
        nonlocal heading
        heading = True
        return "\n# " + " ".join(next(m[k] for k in ("h1", "h2", "h3", "h4", "h5") if m[k] is not None).split()) + "\n"

    text = BULLETS.sub(items, text)
    text = HEADING.sub(head, text)
    if LISTS.search(text):
        listed = True
        text = re.sub(r"<li\b[^<>]*>|^\s*\\item\b(?:\[[^\]]*\])?", "\n- ", text, flags=_I | re.M)
        text = LISTS.sub("\n", text)
    return text, heading, listed


def _plain(m: re.Match) -> str:
    """What an inline construct leaves in the clean text."""
    s = m.group()
    if s.startswith("<"):
        return " " if re.match(r"<(br|!)", s, _I) else ""
    if s.startswith("&"):
        return html.unescape(s)
    if s.startswith("[["):
        return s[2:-2].rpartition("|")[2]
    if s.startswith("{{"):
        return " ".join(s[2:-2].split("|")[1:])
    if s.startswith(("[", "![")):
        return re.sub(r"\]\([^()]*\)$", "", s.lstrip("!"))[1:] if s.endswith(")") else s[1:-1].partition(" ")[2]
    if s.startswith("\\"):
        return "{"
    return s.strip("*_~`'")


def _long_spans(text: str) -> str:
    """The text without the marks of spans of any length; each end is looked up once, so long texts take linear time."""
    for opening, closing in ENDS:
        closers = [m.start() for m in closing.finditer(text)]
        out, at = [], 0
        for m in opening.finditer(text):
            if m.start() < at:
                continue
            k = bisect_left(closers, m.end() + 1)
            if k == len(closers):
                break
            out += [text[at : m.start()], text[m.end() : closers[k]]]
            at = closers[k] + 2
        text = "".join(out) + text[at:]
    return text


def convert(lines: list[str | None], own: re.Pattern = _own_tag) -> tuple[str, list[str]]:
    """Clean text of an article and the kinds of structure that were marked up. Headings become ``# `` lines, list
    items ``- `` lines, code blocks are fenced by ```` ``` ````, formulas by ``$$``."""
    text = own.sub("\n", "\n".join(x or "" for x in lines))
    kinds: set[str] = set()
    kept: list[str] = []

    def hold(m: re.Match, kind: str, mark: str, end: str) -> str:
        kinds.add(kind)
        body = next(v for k, v in m.groupdict().items() if re.fullmatch(r"[cf]\d", k) and v is not None)
        if m.groupdict().get("tag") or m.groupdict().get("f1") is not None:
            body = html.unescape(re.sub(r"</?\w[^<>]*>", "", body))
        kept.append(mark + body.strip("\n") + end)
        return f"\x00{len(kept) - 1}\x01"

    text = text.replace("\x00", "").replace("\x01", "")
    text = CODE.sub(lambda m: "\n" + hold(m, "code", "```\n", "\n```") + "\n", text)
    text = FORMULA.sub(lambda m: hold(m, "formula", "$$", "$$"), text)
    text, heading, listed = _headings_and_lists(text)
    kinds |= {"heading"} if heading else set()
    kinds |= {"list"} if listed else set()
    while True:  # constructs nest; each round shortens the text, or an unknown reference is all that is left
        before = text
        text, n = INLINE.subn(_plain, text)
        if text == before:
            text = _long_spans(text)
        if n or text != before:
            kinds.add("inline")
        if text == before:
            break
        if n:
            text = re.sub(r"\{([^{}]*)\}", r"\1", text)
    text = html.unescape(text)
    text = re.sub("\x00(\\d+)\x01", lambda m: kept[int(m[1])], text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n"))).strip("\n"), sorted(kinds)


#: A class of tokens belongs to a host's template if it occurs in at least this share of its pages.
SUPPORT = 0.2
#: Template tokens are element tags in the file's own spelling; of the known foreign elements none is taken.
_TAG = r"</?[A-Za-z][A-Za-z0-9]*>"
_FOREIGN = rf"(?i)^</?(?:{HEADING_TAGS}|{LIST_TAGS}|{CODE_TAGS}|{INLINE_TAGS}|math)>$"
#: Hosts up to which their templates are sent to every executor.
MOST_HOSTS = 100_000


def template_classes(pages: DataFrame, scratch: Scratch, support: float = SUPPORT) -> DataFrame:
    """``(path, tokens, pages, depth)``: the equivalence classes of tag tokens of each host's template.

    Tokens with the same occurrence vector over a host's pages form a class. It belongs to the template if it occurs in at
    least ``support`` of the host's pages, each of its tokens once in each of them, if its tokens come
    in the same order on all pages, and if they nest: no tag closes another one than the last open. ``depth`` counts the
    valid classes of the host that enclose it, on all pages where both are. A vector is represented by the sum of hashes
    of its (page, count) entries, so a host of any size is aggregated in parts, and no page list is ever collected.
    """
    sizes = pages.groupBy("path").agg(F.count_distinct("doc_id").alias("size"))
    found = _places(pages).where(~F.col("token").rlike(_FOREIGN))
    counts = scratch.keep(found.groupBy("path", "doc_id", "token").agg(F.count("*").alias("n"), F.min("at").alias("at")))
    vectors = counts.groupBy("path", "token").agg(
        F.sum(F.xxhash64("doc_id", "n").cast("decimal(38,0)")).alias("vector"), F.count("*").alias("pages"), F.max("n").alias("most")
    )
    frequent = vectors.where("most = 1").join(sizes, "path").where(F.col("pages") >= support * F.col("size"))
    named = frequent.select("path", "token", "vector", "pages")
    seen = counts.join(named, ["path", "token"])
    orders = seen.groupBy("path", "doc_id", "vector", "pages").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("x"))
    rows = orders.select("path", "doc_id", "vector", "pages", F.col("x.token").alias("tokens"), F.col("x")[0]["at"].alias("first"), F.col("x")[F.size("x") - 1]["at"].alias("last"))
    classes = rows.groupBy("path", "vector", "pages").agg(F.min("tokens").alias("tokens"), F.max("tokens").alias("other")).where("tokens = other").drop("other")
    nested = classes.where(_nests(F.col("tokens")))
    outer = rows.select("path", "doc_id", F.col("vector").alias("of"), F.col("first").alias("a"), F.col("last").alias("b"))
    within = rows.join(outer, ["path", "doc_id"]).where("vector <> of")
    holds = within.groupBy("path", "vector", "of").agg(F.min((F.col("a") < F.col("first")) & (F.col("last") < F.col("b"))).alias("inside")).where("inside")
    depths = holds.join(nested.select("path", F.col("vector").alias("of")), ["path", "of"], "left_semi").groupBy("path", "vector").agg(F.count("*").alias("depth"))
    return nested.join(depths, ["path", "vector"], "left").select("path", "tokens", "pages", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


def _places(pages: DataFrame) -> DataFrame:
    """``(path, doc_id, at, token)``: the tags of each page with their places; a page that is repeated counts once."""
    tags = F.regexp_extract_all(F.array_join("text_lines", "\n"), F.lit(_TAG), 0)
    once = pages.select("path", "doc_id", tags.alias("tags")).dropDuplicates(["path", "doc_id"])
    return once.select("path", "doc_id", F.posexplode("tags").alias("at", "token"))


def _nests(tokens: Column) -> Column:
    """Whether no closing tag meets another open tag than its own; tags may stay open, as those of many files do."""
    state = F.struct(F.array().cast("array<string>").alias("open"), F.lit(True).alias("ok"))

    def step(s: Column, t: Column) -> Column:
        name = F.regexp_extract(t, "^</?([A-Za-z0-9]+)>$", 1)
        top = F.get(s["open"], F.size(s["open"]) - 1)
        closes, opens = t.startswith("</"), t.startswith("<") & ~t.startswith("</")
        opened = F.when(opens, F.concat(s["open"], F.array(name))).when(closes & (top == name), F.slice(s["open"], 1, F.size(s["open"]) - 1)).otherwise(s["open"])
        return F.struct(opened.alias("open"), (s["ok"] & ~(closes & F.coalesce(top != name, F.lit(False)))).alias("ok"))

    return F.aggregate(tokens, state, step, lambda s: s["ok"])


def _one_row_per_page(articles: DataFrame) -> DataFrame:
    """Rows with lines, repeats of the same content removed."""
    return articles.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), "text_lines").where(
        "doc_id is not null and text_lines is not null"
    )


def markup(articles: DataFrame, scratch: Scratch, support: float = SUPPORT) -> DataFrame:
    """``(doc_id, kinds, text)`` of each article with foreign markup: the kinds of structure marked up (``heading``,
    ``list``, ``code``, ``formula``, ``inline``) and the clean text of its slots.

    First the template of each host is deduced; its tags are the corpus's own and part the slots, from whose text the
    foreign constructs are parsed. Rows with a null id or null lines give nothing, a null line is an empty one,
    repeated articles give repeated rows, articles without foreign markup and empty tables none; other columns are
    ignored. One pass without a shuffle after the small template join; lines without any character of a construct
    keep an article from being sent to Python at all.
    """
    pages = _one_row_per_page(articles)
    tags = template_classes(pages, scratch, support).select("path", F.explode("tokens").alias("token"))
    templates = scratch.keep(tags.groupBy("path").agg(F.collect_set("token").alias("own")))
    own = "|".join(OWN)
    start = rf"(?:^|</?(?:{own})>) {{0,3}}(?:[-+#=]|\d{{1,3}}[.)]\s)"
    suspect = rf"<(?!/?(?:{own})>)[A-Za-z/!]|[\[{{\\`*^_]|~~|\$\$|&(?!(?:{OWN_REFERENCES});)[A-Za-z#]|''|{start}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[tuple[str, ...], re.Pattern] = {}
        for batch in batches:
            keys, texts, kinds = [], [], []
            for key, lines, own_tags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = tuple(sorted(own_tags or ()))
                if names not in patterns:
                    patterns[names] = re.compile("|".join(map(re.escape, names)) + "|" * bool(names) + _own_tag.pattern)
                text, marked = convert(lines, patterns[names])
                if marked:
                    keys.append(key)
                    texts.append(text)
                    kinds.append(marked)
            arrays = [pa.array(keys, pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "kinds", "text"])

    marked = pages.where(F.exists("text_lines", lambda x: F.coalesce(x.rlike(suspect), F.lit(False))))
    rows = marked.join(small(templates, MOST_HOSTS), "path", "left").select("doc_id", "text_lines", "own")
    return rows.mapInArrow(run, "doc_id long, kinds array<string>, text string")
