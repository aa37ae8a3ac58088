"""HTML clean-up and page probes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens.functions import fixed
from framelens.functions.matching import any_contains, any_true, first_case, let, total

MIN_BODY_HITS = 5


def decode_entities(text: Column) -> Column:
    for raw, ch in fixed.HTML_ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(ch))
    return text


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", " ")


def html_to_text(html: Column, cap: int | None = None, entities: bool = True) -> Column:
    """Readable text: boilerplate blocks dropped, tags to spaces, entities decoded, white space squeezed.

    ``cap=3000, entities=False`` is the variant used before a model reads the page.
    """
    blocks = r"(?is)<(" + "|".join(fixed.HTML_BLOCKS) + r")[^>]*>.*?</\1>"
    t = strip_tags(F.regexp_replace(F.coalesce(html, F.lit("")), blocks, ""))
    t = squeeze(decode_entities(t) if entities else t)
    return t if cap is None else F.left(t, F.lit(cap))


def head(body: Column, cap: int | None) -> Column:
    """The whole body, or its first ``cap`` characters; a null body is empty."""
    s = F.coalesce(body, F.lit(""))
    return s if cap is None else F.left(s, F.lit(cap))


def page_title(html: Column, cap: int = 200) -> Column:
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.left(F.trim(decode_entities(raw), F.lit(" \n\r\t")), F.lit(cap))


def feed_titles(xml: Column, skip: str = "Search Results") -> Column:
    """All non-empty titles of a feed except the feed's own."""
    got = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"<title[^>]*>(.*?)</title>"), F.lit(1))
    return F.filter(got, lambda t: (t != "") & ~F.contains(t, F.lit(skip)))


# A tag, whose quoted attribute values may hold any character, or the text up to the next one.
_TOKEN = r"""(?s)<(?:"[^"]*"|'[^']*'|[^'">])*>|<[^<]*|[^<]+"""
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_CLASS = r"""(?is)^<[a-z](?:[^"'>]|"[^"]*"|'[^']*')*?\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_LABEL = r"""(?is)^<nav\b(?:[^"'>]|"[^"]*"|'[^']*')*?\saria-label\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def breadcrumb(html: Column) -> Column:
    """JSON-LD breadcrumb block, else the text of the first element with a breadcrumb class, else of such a ``nav`` label, else empty.

    The page is a sequence of tags and texts. The element ends where its own end tag, or the end tag of one that holds it,
    stands; elements of the same name inside do not end it.
    """
    h = F.coalesce(html, F.lit(""))
    blocks = F.regexp_extract_all(
        h, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1)
    )
    ld = F.left(F.get(F.filter(blocks, lambda b: F.contains(b, F.lit("BreadcrumbList"))), F.lit(0)), F.lit(400))
    # Most pages name no breadcrumb at all and are not cut into tokens.
    shown = F.regexp_replace(h, r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    element = F.when(F.contains(F.lower(h), F.lit("breadcrumb")), let(F.regexp_extract_all(shown, F.lit(_TOKEN), F.lit(0)), _crumb_text))
    return F.coalesce(ld, F.left(squeeze(F.coalesce(element, F.lit(""))), F.lit(200)))


def _attribute(tag: Column, pattern: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _tag(token: Column) -> tuple[Column, Column, Column]:
    """Name of a tag (empty for text), whether it is an end tag, and whether it holds nothing."""
    name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
    return name, F.startswith(token, F.lit("</")), name.isin(*_VOID) | F.endswith(token, F.lit("/>"))


def _after(stack: Column, token: Column) -> Column:
    """The open elements, innermost first, after a token: an end tag closes all up to its own; one that is not open closes nothing."""
    name, ends, empty = _tag(token)
    at = F.array_position(stack, name)
    return F.when((name == "") | (~ends & empty), stack).when(~ends, F.concat(F.array(name), stack)).when(
        at > 0, F.slice(stack, (at + 1).cast("int"), F.size(stack))).otherwise(stack)


def _crumb_text(tokens: Column) -> Column:
    """Text of the element that the first matching tag opens, as one string; null without such a tag."""
    by_class = F.transform(tokens, lambda x: F.startswith(x, F.lit("<")) & F.contains(_attribute(x, _CLASS), F.lit("breadcrumb")))
    by_label = F.transform(tokens, lambda x: F.startswith(x, F.lit("<")) & F.contains(F.lower(_attribute(x, _LABEL)), F.lit("breadcrumb")))
    first = F.coalesce(F.nullif(F.array_position(by_class, True), F.lit(0)), F.nullif(F.array_position(by_label, True), F.lit(0))).cast("int")
    none = F.array().cast("array<string>")
    parts = F.struct(F.slice(tokens, first, F.size(tokens)).alias("rest"), F.aggregate(F.slice(tokens, 1, first - 1), none, _after).alias("around"))
    return F.when(first.isNotNull(), let(parts, lambda p: _element_text(p["rest"], p["around"])))


def _element_text(tokens: Column, around: Column) -> Column:
    """Text between the first token, a start tag, and the end of its element; entities stand as characters."""
    state = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, token: Column) -> Column:
        name, ends, _ = _tag(token)
        after = _after(s["open"], token)
        outer = ends & (F.array_position(s["open"], name) == 0) & (F.array_position(around, name) > 0)
        over = s["done"] | (F.size(after) == 0) | outer
        return F.struct(F.when(over, s["open"]).otherwise(after).alias("open"), F.when(over, s["n"]).otherwise(s["n"] + 1).alias("n"), over.alias("done"))

    inside = F.slice(tokens, 1, F.aggregate(tokens, state, step, lambda s: s["n"]))
    texts = F.filter(inside, lambda x: ~F.startswith(x, F.lit("<")))
    return decode_entities(F.array_join(texts, " "))


def ordered_codes(body: Column, limit: int = 20, cap: int | None = None) -> Column:
    """Country codes of a JSON-like body in order: quoted fields first, then ``country=XX``."""
    s = head(body, cap)
    jsonish = F.regexp_like(s, F.lit(r"^\s*[\[{]")) | F.contains(F.lower(s), F.lit("country="))
    codes = F.concat(
        F.regexp_extract_all(s, F.lit(r'"country"\s*:\s*"([A-Z]{2})"'), F.lit(1)),
        F.regexp_extract_all(s, F.lit(r"country=([A-Z]{2})\b"), F.lit(1)),
    )
    return F.when(jsonish, F.slice(codes, 1, limit)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class PageRules:
    """Patterns of a page probe. Patterns carry their own flags and run on the original text."""

    a_patterns: tuple[str, ...]
    b_patterns: tuple[str, ...]
    topic_pattern: str
    url_a: str
    url_b: str
    tz_a: str = ""
    tz_b: str = ""
    a: str = "a"
    b: str = "b"
    code_a: str = "A"
    code_b: str = "B"
    b_origin: str = field(default="B")


def url_signal(url: Column, rules: PageRules) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return F.when(F.regexp_like(u, F.lit(rules.url_a)), F.lit(rules.a)).when(
        F.regexp_like(u, F.lit(rules.url_b)), F.lit(rules.b)
    )


def mentions(text: Column, patterns: Sequence[str]) -> Column:
    return any_true(F.regexp_like(text, F.lit(p)) for p in patterns)


def body_hits(body: Column, patterns: Sequence[str], cap: int | None = None) -> Column:
    s = head(body, cap)
    return total((F.regexp_count(s, F.lit(p)) for p in patterns), F.lit(0))


def probe_page(url: Column, title: Column, body: Column, rules: PageRules, cap: int | None = None) -> Column:
    """Struct of everything :func:`page_status` looks at."""
    s = head(body, cap)
    never = F.lit(False)
    return F.struct(
        url_signal(url, rules).alias("url_signal"),
        mentions(title, rules.a_patterns).alias("title_a"),
        mentions(title, rules.b_patterns).alias("title_b"),
        F.regexp_like(title, F.lit(rules.topic_pattern)).alias("title_topic"),
        body_hits(body, rules.a_patterns, cap).alias("a_hits"),
        body_hits(body, rules.b_patterns, cap).alias("b_hits"),
        (F.regexp_like(s, F.lit(rules.tz_a)) if rules.tz_a else never).alias("tz_a"),
        (F.regexp_like(s, F.lit(rules.tz_b)) if rules.tz_b else never).alias("tz_b"),
        ordered_codes(body).alias("codes"),
    )


def page_status(prior: Column, http: Column, origin: Column, probe: Column, rules: PageRules) -> Column:
    """Struct (status, reason) by an ordered cascade; the first row that applies decides."""
    sig, codes = probe["url_signal"], probe["codes"]
    ta, tb, topic = probe["title_a"], probe["title_b"], probe["title_topic"]
    na, nb = probe["a_hits"], probe["b_hits"]
    hits = F.format_string("hits=%d/%d", na, nb)
    first = F.get(codes, F.lit(0))
    sig_a, sig_b = F.coalesce(sig == rules.a, F.lit(False)), F.coalesce(sig == rules.b, F.lit(False))
    from_b = F.coalesce(origin == rules.b_origin, F.lit(False))
    status_http = F.coalesce(http, F.lit(0))
    ui = "url_correct_ui_ambiguous"
    rows = [
        (prior == "untested", "untested", F.lit("not probed by design")),
        ((status_http == 0) | (status_http >= 400), "unreachable", F.format_string("http=%d", status_http)),
        (from_b & sig_a & (na > nb), "correct", F.concat(F.lit("origin B, switched; "), hits)),
        (from_b, "incorrect", F.concat(F.lit("origin B; "), hits)),
        (
            (first == rules.code_a) & F.array_contains(codes, F.lit(rules.code_b)),
            "correct",
            F.concat(F.lit("first code A; "), F.array_join(codes, ","), F.lit("; dual listing with B")),
        ),
        (first == rules.code_a, "correct", F.concat(F.lit("first code A; "), F.array_join(codes, ","))),
        (first == rules.code_b, "incorrect", F.concat(F.lit("first code B; "), F.array_join(codes, ","))),
        (sig_b | (tb & ~ta), "incorrect", F.concat(F.lit("URL or title B; "), hits)),
        (sig_a & ta, "correct", F.concat(F.lit("URL and title A; "), hits)),
        (sig_a & topic & ~tb, ui, F.concat(F.lit("URL A, title names topic only; "), hits)),
        (sig_a, "correct", F.concat(F.lit("URL A, title neutral; "), hits)),
        (ta & ~tb, "correct", F.concat(F.lit("title A; "), hits)),
        (topic, ui, F.concat(F.lit("title names topic only; "), hits)),
        (prior == "na", "na", F.concat(F.lit("not covered; "), hits)),
        ((na >= MIN_BODY_HITS) & (na > nb * 2), "correct", F.concat(F.lit("body A; "), hits)),
        ((nb >= MIN_BODY_HITS) & (nb > na * 2), "incorrect", F.concat(F.lit("body B; "), hits)),
    ]
    status = first_case(((c, s) for c, s, _ in rows), ui)
    reason = first_case(((c, r) for c, _, r in rows), F.concat(F.lit("no clear signal; "), hits))
    return F.struct(status.alias("status"), reason.alias("reason"))


def page_class(url: Column, content: Column, a_words: Sequence[str], b_words: Sequence[str], url_a: Sequence[str],
               url_b: Sequence[str], disputed: Sequence[str], a: str = "a", b: str = "b") -> Column:
    """Class of a page seen from one place."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    has_a, has_b = any_contains(t, a_words), any_contains(t, b_words)
    return (
        F.when(any_contains(u, url_a) | (has_a & ~has_b), F.lit(a))
        .when(any_contains(u, url_b) | (has_b & ~has_a), F.lit(b))
        .when(any_contains(t, disputed), F.lit("disputed"))
        .when(has_a & has_b, F.lit("both_mentioned"))
        .otherwise(F.lit("unclear"))
    )
