"""URL and domain functions. All lookups are ordered: the first rule wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens.functions import fixed
from framelens.functions.matching import any_contains, any_match, any_true, blank_to_null, first_case
from framelens.lexicon import DomainRule


def host(url: Column) -> Column:
    """Lower-cased host: scheme, path, query and one leading ``www.`` removed."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^(?s:.*?)://", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^www\.", "")


def netloc(url: Column, drop_www: bool = True) -> Column:
    """Authority part after ``//``; empty without one. Every ``www.`` is removed on request."""
    got = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    return F.replace(got, F.lit("www."), F.lit("")) if drop_www else got


def parent(domain: Column) -> Column:
    """Last two labels."""
    return F.substring_index(domain, ".", -2)


def tld(url: Column, compounds: Sequence[str] = fixed.COMPOUND_TLDS) -> Column:
    """Effective TLD with its leading dot; empty when the host has no dot."""
    d = netloc(url, drop_www=False)
    pairs = [(F.endswith(d, F.lit(c)), c) for c in compounds]
    last = F.when(F.contains(d, F.lit(".")), F.concat(F.lit("."), F.substring_index(d, ".", -1))).otherwise(F.lit(""))
    return first_case(pairs, last)


def literal_map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def is_under(domain: Column, known: str) -> Column:
    """The domain itself or one of its sub-domains."""
    return (domain == known) | F.endswith(domain, F.lit("." + known))


def domain_country(domain: Column, known: Mapping[str, str], tlds: Mapping[str, str] = fixed.TLD_COUNTRY,
                   compound: bool = False) -> Column:
    """Country of a known domain or sub-domain, else of its TLD, else empty.

    With ``compound`` a two-label TLD such as ``co.uk`` is tried before the last label.
    """
    d = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    by_name = first_case((is_under(d, k), v) for k, v in known.items())
    last = F.when(F.contains(d, F.lit(".")), F.substring_index(d, ".", -1)).otherwise(d if compound else F.lit(""))
    table = literal_map(tlds)
    candidates = [by_name]
    if compound:
        candidates.append(table[F.substring_index(d, ".", -2)])
    candidates += [table[last], F.lit("")]
    return F.coalesce(*candidates)


def domain_match(low_url: Column, domain: str, match: str) -> Column:
    """Does a listed domain match a lower-cased URL or host.

    ``boundary``: its first occurrence starts the string or follows ``/``, ``.`` or ``@``;
    ``substring``: it occurs anywhere; ``suffix``: the value is it or ends with ``.`` + it.
    """
    if match == "substring":
        return F.contains(low_url, F.lit(domain))
    if match == "suffix":
        return is_under(low_url, domain)
    if match == "boundary":
        pos = F.instr(low_url, F.lit(domain))
        before = F.substring(low_url, pos - F.lit(1), F.lit(1))
        return (pos == 1) | ((pos > 1) & before.isin("/", ".", "@"))
    raise ValueError(f"unknown match mode {match!r}")


def domain_value(url: Column, rules: Sequence[DomainRule], match: str = "boundary", default=None) -> Column:
    """Value of the first domain rule that matches."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return first_case(((domain_match(u, r.domain, match), r.value) for r in rules), default)


def source_tier(url: Column, tiers: Sequence[DomainRule], match: str = "boundary", default: str = "independent") -> Column:
    return domain_value(url, tiers, match, default)


def sanction(url: Column, rules: Sequence[DomainRule], match: str = "substring") -> Column:
    """``entity [regulation]`` of the first listed domain, else empty."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return first_case(((domain_match(u, r.domain, match), f"{r.value} [{r.note}]") for r in rules), "")


def origin(domain: Column, url: Column, tlds=fixed.ORIGIN_TLDS, marks=fixed.ORIGIN_MARKS,
           default: str = "international") -> Column:
    """Origin class from the country-code TLD; institutional marks in the URL come after the first two classes."""
    u = F.lower(F.coalesce(url, F.lit("")))
    ends = [(any_true(F.endswith(domain, F.lit(t)) for t in suffixes), cls) for cls, suffixes in tlds]
    has = [(any_contains(u, words), cls) for cls, words in marks]
    return first_case([*ends[:2], *has, *ends[2:]], default)


def institution(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(F.contains(u, F.lit(".gov.")) | F.endswith(u, F.lit(".gov")), F.lit("government"))
        .when(F.contains(u, F.lit(".edu.")) | F.endswith(u, F.lit(".edu")) | F.contains(u, F.lit(".ac.")), F.lit("education"))
        .when(F.contains(u, F.lit(".mil.")) | F.endswith(u, F.lit(".mil")), F.lit("military"))
        .otherwise(F.lit(""))
    )


def platform_class(url: Column, domain: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Class of a known platform. Rules are (class, how, value) with how one of
    ``host_has``, ``host_is``, ``url_has``; the first that applies wins."""
    u = F.lower(F.coalesce(url, F.lit("")))
    tests = {
        "host_has": lambda v: F.contains(domain, F.lit(v)),
        "host_is": lambda v: domain == v,
        "url_has": lambda v: F.contains(u, F.lit(v)),
    }
    return first_case(((tests[how](v), cls) for cls, how, v in rules), "")


def directory_type(kind: Column) -> Column:
    """Site type of a directory entry; null when there is no entry."""
    return F.when(kind.isNotNull(), F.coalesce(literal_map(fixed.DIRECTORY_TYPES)[kind], F.lit("other_categorized")))


def site_type(institution_: Column, entity: Column, platform: Column, directory: Column) -> Column:
    """Institution, else sanctioned, else platform, else directory type, else uncategorized."""
    return F.coalesce(
        F.nullif(institution_, F.lit("")),
        F.when(F.coalesce(entity, F.lit("")) != "", F.lit("sanctioned_media")),
        F.nullif(platform, F.lit("")),
        directory_type(directory),
        F.lit("uncategorized"),
    )


def is_news(url: Column, domains: Sequence[str]) -> Column:
    return any_contains(F.lower(F.coalesce(url, F.lit(""))), domains)


def academic_domain(url: Column, hosts: Sequence[str] = fixed.ACADEMIC_HOSTS) -> Column:
    """First listed academic host contained in the URL, else null."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return first_case((F.contains(u, F.lit(h)), h) for h in hosts)


def url_framing(url: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """First framing group with a matching pattern, else null."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return first_case((any_match(u, patterns), name) for name, patterns in groups)


def language_cluster(lang: Column, url: Column, clusters: Sequence[tuple[str, Sequence[str], Sequence[str]]],
                     default: str = "Other") -> Column:
    """First cluster that lists the declared language or the TLD of the URL."""
    t = tld(url)
    declared = F.trim(F.coalesce(lang, F.lit("")))
    return first_case(
        ((declared.isin(list(langs)) | any_true(F.endswith(t, F.lit(x)) for x in tlds), name)
         for name, langs, tlds in clusters),
        default,
    )


def infer_country(declared: Column, url: Column, table: Mapping[str, str] = fixed.SOURCE_COUNTRY) -> Column:
    return F.coalesce(blank_to_null(declared), literal_map(table)[tld(url)], F.lit("Unknown"))


def extract_urls(text: Column) -> Column:
    """Distinct URLs cited in free text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"""https?://[^\s\)\"\'>\]]+"""), F.lit(0)))


def citation_origin(url: Column, flagged: Sequence[str], government: Sequence[str],
                    country_tlds: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Flagged domain, else government domain, else country of the TLD, else international."""
    h = host(url)
    pairs: list[tuple[Column, object]] = [(any_true(is_under(h, d) for d in flagged), "sanctioned")]
    pairs.append((any_true(is_under(h, d) for d in government), "government"))
    pairs += [(any_true(F.endswith(h, F.lit(t)) for t in tlds), name) for name, tlds in country_tlds]
    return first_case(pairs, "international")
