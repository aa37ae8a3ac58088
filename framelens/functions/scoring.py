"""Two-pole scoring, labels, sub-types and group detection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens.functions.matching import (
    any_contains,
    any_match,
    any_true,
    any_word,
    count_matches,
    first_case,
    is_literal,
    let,
    matches,
    overlaps_itself,
    rules_case,
    total,
)
from framelens.lexicon import GroupPattern, Lexicon, Override, Signal, TextRule, group_names

NO_SIGNAL = "no_signal"
DISPUTED = "disputed"
NO_TOPIC = "no_topic_ref"
CONFIDENCE_CAP = 0.95


def presence_score(low: Column, signals: Sequence[Signal]) -> Column:
    """Sum of the weights of the signals that occur at least once."""
    return let(low, lambda t: _sum_signals(t, signals, F.contains, matches))


def occurrence_score(low: Column, signals: Sequence[Signal]) -> Column:
    """Sum over signals of weight times number of matches.

    A plain word that cannot overlap itself matches wherever it begins: all such words are found in one pass over the text.
    """
    def single(s: Signal) -> bool:
        return s.pattern != "" and is_literal(s.pattern) and not overlaps_itself(s.pattern)

    words, others = [s for s in signals if single(s)], [s for s in signals if not single(s)]
    return let(low, lambda t: _sum_signals(t, others, _count_plain, count_matches) + _sum_words(t, words))


def _sum_signals(text: Column, signals: Sequence[Signal], plain: Callable[[Column, Column], Column], regex: Callable[[Column, str], Column]) -> Column:
    """Weighted sum over a lexicon of any size.

    Plain patterns are one array literal that a higher-order function walks, so neither the plan nor the generated code grows
    with them. A regex must be a literal of the plan to be compiled once for each task; inside a lambda it is evaluated without
    generated code, whose methods the JVM stops compiling beyond 8,000 bytes.
    """
    words = [s for s in signals if is_literal(s.pattern)]
    parts = [_weight(regex(text, s.pattern), s.weight) for s in signals if not is_literal(s.pattern)]
    if words:
        lexicon = F.array(*[F.struct(F.lit(s.pattern).alias("p"), F.lit(float(s.weight)).alias("w")) for s in words])
        parts.append(F.aggregate(lexicon, F.lit(0.0), lambda acc, s: acc + _weight(plain(text, s["p"]), s["w"])))
    return total(parts, F.lit(0.0))


def _sum_words(text: Column, signals: Sequence[Signal]) -> Column:
    """Weighted number of places where words begin that do not overlap themselves.

    The lookahead yields the longest word at each place; the words that it begins with stand there too. Places are counted by
    weight before anything is multiplied, so the sum does not hang on their order.
    """
    if not signals:
        return F.lit(0.0)
    own: dict[str, list[Column]] = {}
    for s in signals:
        own.setdefault(s.pattern, []).append(F.lit(float(s.weight)))
    words = list(own)
    held = {w: [c for k in range(1, len(w) + 1) for c in own.get(w[:k], ())] for w in words}
    weights = F.create_map(*[c for w, of in held.items() for c in (F.lit(w), F.array(*of))])
    found = F.regexp_extract_all(text, F.lit(f"(?=({any_word(words)}))"), F.lit(1))
    every = F.flatten(F.transform(found, lambda w: F.element_at(weights, w)))
    classes = F.array(*[F.lit(w) for w in dict.fromkeys(float(s.weight) for s in signals)])
    # A null text has no words.
    return F.coalesce(let(every, lambda v: F.aggregate(classes, F.lit(0.0), lambda acc, w: acc + w * F.size(F.filter(v, lambda x: x == w)))), F.lit(0.0))


def _weight(hit: Column, weight: float | Column) -> Column:
    """The weight times a count, or once where a condition is true; zero for null."""
    return F.coalesce(hit.cast("double"), F.lit(0.0)) * (weight if isinstance(weight, Column) else F.lit(float(weight)))


def _count_plain(text: Column, word: Column) -> Column:
    """Non-overlapping leftmost occurrences of a plain word, by what their removal takes from the text."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, word, F.lit("")))
    return F.when(F.contains(text, word), gone / F.octet_length(word)).otherwise(F.lit(0.0))


def override_shift(low: Column, overrides: Sequence[Override]) -> Column:
    """Weight to move from pole B to pole A.

    The correction applies whenever a long official name occurs, also when the
    short name stands alone elsewhere in the text.
    """
    return total(
        (F.when(any_contains(low, o.names), F.lit(o.amount)).otherwise(F.lit(0.0)) for o in overrides), F.lit(0.0)
    )


def label(a: Column, b: Column, lex: Lexicon) -> Column:
    return (
        F.when((a == 0) & (b == 0), F.lit(NO_SIGNAL))
        .when(a > b, F.lit(lex.pole_a))
        .when(b > a, F.lit(lex.pole_b))
        .otherwise(F.lit(DISPUTED))
    )


def confidence(a: Column, b: Column) -> Column:
    """Share of the winning pole, capped; one half for a tie, zero without signals."""
    return (
        F.when((a == 0) & (b == 0), F.lit(0.0))
        .when(a == b, F.lit(0.5))
        .otherwise(F.least(F.lit(CONFIDENCE_CAP), F.greatest(a, b) / (a + b)))
    )


def is_attributed(low: Column, lex: Lexicon) -> Column:
    return any_match(low, lex.attribution)


def is_structured(low: Column, lex: Lexicon) -> Column:
    return any_match(low, lex.structured)


def framing_type(news: Column, attributed: Column, structured: Column) -> Column:
    """Sub-type of a pole-B document."""
    return (
        F.when(news, F.lit("reportage_news"))
        .when(attributed, F.lit("reportage_attribution"))
        .when(structured, F.lit("assertive_structured"))
        .otherwise(F.lit("assertive_pure"))
    )


def signal_hits(text: Column, signals: Sequence[Signal], k: int | None = 5, ctx: int = 50,
                low: Column | None = None) -> Column:
    """Matches with their surrounding text, in lexicon order, first ``k`` kept.

    Positions follow from the pieces between the matches, so neighbouring
    contexts may overlap exactly as when cutting around each match position.
    Matching is case-insensitive on the original text; ``low`` is its
    lower-cased form when there is one already.
    """
    low = F.lower(text) if low is None else low
    per_signal = [_hits_of(text, low, s, k, ctx) for s in signals]
    hits = F.concat(*per_signal) if len(per_signal) > 1 else per_signal[0]
    return hits if k is None else F.slice(hits, 1, k)


def _hits_of(text: Column, low: Column, s: Signal, k: int | None, ctx: int) -> Column:
    pattern = "(?iu)" + s.pattern
    empty = F.array().cast("array<struct<matched:string,pole:string,weight:double,kind:string,context:string>>")
    parsed = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, F.lit(pattern), -1).alias("pieces"),
        text.alias("text"),
    )

    def cut(v: Column) -> Column:
        n = F.size(v["found"]) if k is None else F.least(F.size(v["found"]), F.lit(k))

        def step(acc: Column, i: Column) -> Column:
            m = F.element_at(v["found"], i)
            start = acc["pos"] + F.char_length(F.element_at(v["pieces"], i))
            lo = F.greatest(start - F.lit(ctx), F.lit(0))
            hi = start + F.char_length(m) + F.lit(ctx)
            hit = F.struct(
                m.alias("matched"),
                F.lit(s.pole).alias("pole"),
                F.lit(s.weight).alias("weight"),
                F.lit(s.kind).alias("kind"),
                F.trim(F.substring(v["text"], lo + F.lit(1), hi - lo), F.lit(" \n\r\t")).alias("context"),
            )
            return F.struct((start + F.char_length(m)).alias("pos"), F.concat(acc["out"], F.array(hit)).alias("out"))

        zero = F.struct(F.lit(0).alias("pos"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda acc: acc["out"])

    # Most texts miss most signals: one search decides before anything is cut.
    return F.when(matches(low, s.pattern), let(parsed, cut)).otherwise(empty)


def mention_window(text: Column, low: Column, terms: Sequence[str], half: int, head: int = 2000) -> Column:
    """Text around the earliest topic mention, or the head of the text without one."""
    first = _earliest([F.nullif(F.instr(low, F.lit(t)), F.lit(0)) for t in terms])
    start = F.greatest(first - F.lit(half), F.lit(1))
    return F.when(first.isNotNull(), F.substring(text, start, first + F.lit(half) - start)).otherwise(
        F.left(text, F.lit(head))
    )


def _earliest(positions: list[Column]) -> Column:
    return positions[0] if len(positions) == 1 else F.least(*positions)


def preview(text: Column, n: int = 300, unit: str = "char") -> Column:
    """Head of the text on one line. ``unit="byte"`` cuts UTF-8 bytes at a character boundary."""
    if unit == "char":
        head = F.left(text, F.lit(n))
    else:
        cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
        head = F.when(F.octet_length(text) <= n, text).otherwise(F.rtrim(cut, F.lit("�")))
    return F.translate(head, "\n\r", " ")


def group_hits(low: Column, patterns: Sequence[GroupPattern]) -> Column:
    """Map of group to match count over its patterns; groups without a match are absent."""
    pairs: list[Column] = []
    for g in group_names(patterns):
        counts = total((count_matches(low, p.pattern) for p in patterns if p.group == g), F.lit(0))
        pairs += [F.lit(g), counts]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def groups_present(low: Column, patterns: Sequence[GroupPattern]) -> Column:
    """Sorted names of the groups with at least one match."""
    named = [F.when(any_match(low, [p.pattern for p in patterns if p.group == g]), F.lit(g)) for g in sorted(group_names(patterns))]
    return F.array_compact(F.array(*named))


def mention_label(low: Column, a_terms: Sequence[str], b_terms: Sequence[str], a="a", b="b", both=DISPUTED,
                  neither=NO_SIGNAL, priority: Sequence[str] = ()) -> Column:
    """A only, B only, both or neither; any ``priority`` term decides for A first."""
    has_a, has_b = any_contains(low, a_terms), any_contains(low, b_terms)
    out = F.when(any_contains(low, priority), F.lit(a)) if priority else F
    return (
        out.when(has_a & ~has_b, F.lit(a))
        .when(has_b & ~has_a, F.lit(b))
        .when(has_a & has_b, F.lit(both))
        .otherwise(F.lit(neither))
    )


def describe_label(desc: Column, extract: Column, mention: Sequence[TextRule], official: Sequence[TextRule],
                   body: Sequence[TextRule]) -> Column:
    """Label of a short description.

    Official-name rules override the generic mention and the last one that
    applies wins, hence the reversed order; the longer text is a fallback.
    """
    d = F.lower(F.coalesce(desc, F.lit("")))
    t = F.lower(F.concat_ws(" ", F.coalesce(desc, F.lit("")), F.coalesce(extract, F.lit(""))))
    return F.coalesce(
        rules_case(d, list(reversed(official))),
        rules_case(d, mention),
        rules_case(t, body),
        F.lit(NO_SIGNAL),
    )


def entity_class(ident: Column, name: Column, id_sets: Sequence[tuple[str, Sequence[str]]],
                 label_rules: Sequence[TextRule], default: str | Column = "other") -> Column:
    """Class from an identifier set, else from keywords of the name."""
    by_id = first_case((ident.isin(list(ids)), cls) for cls, ids in id_sets)
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(by_id, rules_case(F.lower(F.coalesce(name, F.lit(""))), label_rules), fallback)


def code_class(code: Column, a: str = "A", b: str = "B") -> Column:
    c = F.upper(F.coalesce(code, F.lit("")))
    return F.when(c == a, F.lit(a)).when(c == b, F.lit(b)).otherwise(F.lit("other"))


def listing_status(codes: Column, a: str, b: str) -> Column:
    """Status of a code list that may name A, B or both."""
    c = F.coalesce(codes, F.lit(""))
    return (
        F.when(c == a, F.lit("correct"))
        .when(c == b, F.lit("incorrect"))
        .when(F.contains(c, F.lit(a)) & F.contains(c, F.lit(b)), F.lit("ambiguous"))
        .otherwise(F.lit("unknown"))
    )


def listed_first(codes: Column, a: str, b: str) -> Column:
    """Which code comes first when both are listed."""
    c = F.coalesce(codes, F.lit(""))
    both = F.contains(c, F.lit(a)) & F.contains(c, F.lit(b))
    return F.when(both, F.when(F.startswith(c, F.lit(b)), F.lit(b)).otherwise(F.lit(a)))


def encoding_status(n_a: Column, n_b: Column, extra: Column) -> Column:
    """Status of a registry by entries under A, under B, and extra B-only entries."""
    return (
        F.when((n_b > 0) & (n_a > 0) & (extra > 0), F.lit("incorrect"))
        .when((n_a > 0) & (n_b == 0), F.lit("correct"))
        .when((n_b > 0) & (n_a == 0), F.lit("incorrect"))
        .otherwise(F.lit("na"))
    )


def majority_status(n_a: Column, n_b: Column, tie: str = "ambiguous") -> Column:
    return F.when(n_a > n_b, F.lit("correct")).when(n_b > n_a, F.lit("incorrect")).otherwise(F.lit(tie))


def field_side(value: Column, words: Sequence[str], exact: Sequence[str] = ()) -> Column:
    """Does a record field speak for a pole: substring or whole-value match."""
    v = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    return (v != "") & any_true([any_contains(v, words), *(v == e for e in exact)])


def parse_verdict(text: Column, rules: Sequence[tuple[str, str]], head: int = 20, default: str = "unclear") -> Column:
    """First keyword found in the upper-cased head of a verdict text."""
    t = F.left(F.upper(F.coalesce(text, F.lit(""))), F.lit(head))
    return first_case(((F.contains(t, F.lit(word)), verdict) for word, verdict in rules), default)


def final_framing(title: Column, url: Column, query_label: Column, title_rules: Sequence[TextRule],
                  url_rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Title keywords, else URL patterns, else the label of the query that found the page."""
    from framelens.functions.urls import url_framing

    t = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(rules_case(t, title_rules), url_framing(url, url_rules), query_label)
