"""Scalar functions on identifiers, dates, numbers and nested values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens.functions import fixed
from framelens.functions.matching import blank_to_null, first_case, let, total


def rebuild_text(index: Column) -> Column:
    """Text from a map of word to positions; on a shared position the later word wins."""
    placed = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))),
        )
    )

    def last_words(ordered: Column) -> Column:
        last = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + F.lit(1))["p"] != x["p"], F.lit(True)))
        return F.array_join(F.transform(last, lambda x: x["w"]), " ")

    return F.coalesce(let(F.array_sort(placed), last_words), F.lit(""))


def word_positions(words: Column) -> Column:
    """Map of word to its positions from 0, built within the row; the inverse of :func:`rebuild_text`."""

    def runs(pairs: Column) -> Column:
        """Equal words stand together after sorting; each run of them is an entry."""
        n = F.size(pairs)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(pairs, i - 1)["w"] != F.get(pairs, i)["w"], F.lit(True)))

        def entry(here: Column, following: Column) -> Column:
            run = F.slice(pairs, here + 1, F.coalesce(following, n) - here)
            return F.struct(F.get(pairs, here)["w"].alias("w"), F.transform(run, lambda x: x["p"]).alias("ps"))

        return F.map_from_entries(let(starts, lambda s: F.transform(s, lambda here, k: entry(here, F.get(s, k + 1)))))

    pairs = F.array_sort(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<int>>"))
    return F.when(F.size(words) > 0, let(pairs, runs)).otherwise(none)


def find_doi(text: Column) -> Column:
    """First DOI in the text without trailing punctuation, else null."""
    raw = F.regexp_extract(F.coalesce(text, F.lit("")), fixed.DOI_PATTERN, 0)
    return F.nullif(F.rtrim(raw, F.lit(fixed.DOI_TRAILING)), F.lit(""))


def bare_doi(doi: Column) -> Column:
    """DOI without a resolver prefix; null when it is none."""
    d = F.trim(doi)
    pairs = [(F.startswith(d, F.lit(p)), F.substring(d, F.lit(len(p) + 1), F.length(d))) for p in fixed.DOI_RESOLVERS]
    return first_case([*pairs, (F.startswith(d, F.lit("10.")), d)], F.lit(None).cast("string"))


def doi_prefix(doi: Column) -> Column:
    return F.substring_index(doi, "/", 1)


def publisher(primary: Column, doi: Column, table: Mapping[str, str] = fixed.PREFIX_PUBLISHERS) -> Column:
    """Publisher given, else the one of the DOI prefix."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.nullif(primary, F.lit("")), names[doi_prefix(doi)])


def citation_count(text: Column, patterns: Sequence[str] = fixed.CITATION_PATTERNS) -> Column:
    """Matches over all citation formats."""
    return total((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))


def dedup_key(title: Column, url: Column) -> Column:
    both = F.concat(F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")))
    return F.md5(F.trim(F.lower(both)))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def year_text(date: Column, period: Column) -> Column:
    """First four characters of the date text, else of the period text."""
    return F.coalesce(blank_to_null(F.left(date, F.lit(4))), F.left(period, F.lit(4)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded percentage; zero for an empty whole."""
    return F.round(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), digits)


def human_number(text: Column) -> Column:
    """``12M``, ``255k/week``, ``1.2b`` as an integer; null when it is no number."""
    t = F.lower(F.trim(text))
    num = F.regexp_extract(t, r"^([0-9.]+)\s*([kmb]?)", 1)
    unit = F.regexp_extract(t, r"^([0-9.]+)\s*([kmb]?)", 2)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    usable = ~F.contains(t, F.lit("rate limited")) & (num != "")
    return F.when(usable, F.floor(num.try_cast("double") * factor).cast("long"))


def uri_tail(uri: Column) -> Column:
    return F.when(F.contains(uri, F.lit("/")), F.substring_index(uri, "/", -1)).otherwise(F.lit(""))


def fill_template(by_lang: Column, lang: Column, fallback: Column, value: Column, slot: str = "{city}") -> Column:
    """Prompt of the language, else the fallback, with the slot filled when there is a value."""
    prompt = F.coalesce(by_lang[lang], fallback)
    return F.when(F.coalesce(value, F.lit("")) != "", F.replace(prompt, F.lit(slot), value)).otherwise(prompt)


def spaced_hosts(prefix: Column, count: int) -> Column:
    """Up to ``count`` evenly spaced host addresses of an IPv4 prefix such as ``10.0.0.0/24``."""
    octets = F.split(F.substring_index(prefix, "/", 1), r"\.")
    bits = F.substring_index(prefix, "/", -1).cast("int")
    number = total((F.element_at(octets, i + 1).cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    net = number - F.pmod(number, size)
    edge = F.when(bits >= 31, F.lit(0)).otherwise(F.lit(1)).cast("long")
    n = size - edge * 2
    step = F.greatest(F.floor(n / F.lit(count + 1)), F.lit(1).cast("long"))
    every = F.transform(
        F.sequence(F.lit(1), F.lit(count)), lambda i: net + edge + F.least(step * i, n - F.lit(1))
    )
    some = F.when(n <= count, F.sequence(net + edge, net + edge + n - F.lit(1))).otherwise(every)
    return F.transform(some, ipv4_text)


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(
        ".", *[(F.shiftright(number, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)]
    )


def edition_links(sitelinks: Column) -> Column:
    """Language to title for encyclopaedia editions of a site-key map."""
    kept = F.map_filter(
        sitelinks, lambda k, _: F.endswith(k, F.lit("wiki")) & ~k.isin(*fixed.NON_EDITIONS)
    )
    return F.transform_keys(kept, lambda k, _: F.substring(k, F.lit(1), F.char_length(k) - F.lit(4)))


def abuse_tld(text: Column) -> Column:
    """TLD of an abuse address in free text, else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.nullif(F.regexp_extract(low, r"abuse@[\p{L}\p{N}_.\-]+\.([a-z]{2,6})", 1), F.lit(""))


def accuracy_band(pct: Column) -> Column:
    """0 (below 25) to 4 (90 and more)."""
    return first_case([(pct >= 90, 4), (pct >= 75, 3), (pct >= 50, 2), (pct >= 25, 1)], 0)


def token_match(historical: Column, holder: Column) -> Column:
    """Does the holder contain the first token of the historical label."""
    token = F.lower(F.substring_index(F.substring_index(historical, " ", 1), "-", 1))
    return F.contains(F.lower(holder), token)


def weekly(count: Column, weeks: int = 13) -> Column:
    """Integer weekly rate of a counter over ``weeks`` weeks."""
    return F.floor(F.coalesce(count, F.lit(0)) / F.lit(weeks)).cast("long")


def named_id(value: Column, names: Mapping[str, str]) -> Column:
    """Name of an identifier; an unknown identifier stays as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value], value)
