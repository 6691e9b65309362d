"""String expressions: ids, tokens, page text, type notes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Legal-form words ignored when labels are compared.
LEGAL_SUFFIXES = [
    "corp", "corporation", "inc", "incorporated", "ag", "ltd", "limited",
    "group", "plc", "llc", "gmbh", "sa", "nv", "co", "company",
]
# Words dropped from a recall question.
RECALL_STOPWORDS = [
    "what", "did", "i", "you", "we", "ask", "asked", "about", "before", "earlier",
    "previously", "discuss", "discussed", "when", "where", "was", "were", "have",
    "has", "the", "this", "that", "said", "conversation",
]
LABEL_OVERLAP = 0.6
# Fixed value: where the narrative of a filing begins.
NARRATIVE_MARKER = "item 1."


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def slug(value) -> Column:
    """Lower case, runs of anything but a-z and 0-9 become one dash, no dash at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_c(value)), "[^a-z0-9]+", "-"), F.lit("-"))


def entity_id(graph, label) -> Column:
    return F.concat(_c(graph), F.lit(":"), slug(label))


def edge_id(graph, source, relation, target) -> Column:
    return F.concat(_c(graph), F.lit(":"), slug(source), F.lit("->"), slug(relation), F.lit("->"), slug(target))


def tokens(value) -> Column:
    """Distinct runs of a-z and 0-9 in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(value)), F.lit("([a-z0-9]+)"), 1))


def core_tokens(label) -> Column:
    return F.array_except(tokens(label), F.array(*[F.lit(w) for w in LEGAL_SUFFIXES]))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two arrays as sets; null when both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union)


def labels_plausibly_same(left, right) -> Column:
    a, b = core_tokens(left), core_tokens(right)
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.coalesce(jaccard(a, b), F.lit(0.0)) >= LABEL_OVERLAP)


def strip_html(html) -> Column:
    """Tags and the common entities become blanks; the bodies of scripts and styles stay."""
    text = F.regexp_replace(_c(html), "<[^>]+>", " ")
    text = F.regexp_replace(text, r"&nbsp;|&amp;|&#\d+;", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def skip_to_narrative(text, marker: str = NARRATIVE_MARKER) -> Column:
    """From the second marker, else the first, else the whole text."""
    text = _c(text)
    lowered = F.lower(text)
    first = F.locate(marker, lowered, 1)
    second = F.call_function("locate", F.lit(marker), lowered, first + F.lit(1))
    start = F.when(first == 0, F.lit(1)).when(second > 0, second).otherwise(first)
    return F.substr(text, start)


def fill_template(template, source, target) -> Column:
    return F.replace(F.replace(_c(template), F.lit("{source}"), _c(source)), F.lit("{target}"), _c(target))


def type_note(source_type, rule_source, target_type, rule_target) -> Column:
    """How node types were resolved to rule types, null if both are equal."""

    def part(node, rule):
        note = F.concat(F.lit('"'), _c(node), F.lit('" is-a "'), _c(rule), F.lit('"'))
        return F.when(F.lower(_c(node)) != F.lower(_c(rule)), note)

    return F.nullif(
        F.concat_ws("; ", part(source_type, rule_source), part(target_type, rule_target)), F.lit("")
    )


def local_name(uri) -> Column:
    """Text after the last '#', or after the last '/' if there is no '#'."""
    uri = _c(uri)
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def contains_ci(text, needle) -> Column:
    return F.contains(F.lower(_c(text)), F.lower(needle if isinstance(needle, Column) else F.lit(needle)))


def fixed2(value) -> Column:
    """Two decimals with exact halves to even, as the decimal value of the double is rounded."""
    return F.format_string("%.2f", F.bround(_c(value), 2))
