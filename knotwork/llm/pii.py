"""Personal data, and the terms that give it away, as DataFrame operations only.

Base patterns find e-mail addresses, IP numbers, card numbers and phone numbers with their positions. Each value found
is a protected entity; so are the local part and the domain of an e-mail address, which join addresses that occur once.
From the words near its occurrences the corpus tells how much a term reveals of an entity: the pointwise mutual
information of the two, over the information content of the entity. At 1 a term occurs with that entity only. A term
counts if chance would not bring the two together as often, however few their occurrences are. Terms above the
thresholds are generalised or removed wherever they occur in the corpus.

A pattern's gaps and matches come as two arrays per text; they are exploded, and positions are running sums over the
matches of a text, so that a text with very many matches is no different from others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from knotwork.llm.common import stored

# Fixed patterns. Possessive repeats and the look-behinds take the same matches as the plain forms without retrying
# each start of a long run: a match that fails from the start of a run fails from all its later characters, too.
_RUN = r"[A-Za-z0-9._%+-]"
KINDS = {
    "email": (rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
TERM = r"\p{L}{3,}"
#: Words on each side of an entity that are its context, and the characters they are sought in.
NEAR, REACH = 8, 200
#: Pairs of a term and an entity that chance may bring, in all pairs of the corpus together.
CHANCE = 0.5
#: Share of an entity's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.95


def row_key() -> Column:
    """Rows that agree in doc_id and text are one document."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text")), F.hex(F.xxhash64("text", F.lit(1))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: Column, match: Column) -> Column:
    parts = F.split(match, r"\.")
    bare = lambda p: F.ltrim(p, F.lit("0"))
    ip = F.forall(parts, lambda p: (F.length(bare(p)) <= 3) & (F.concat(F.lit("0"), F.substring(bare(p), 1, 3)).cast("int") <= 255))
    number, count = F.reverse(_digits(match)), F.length(_digits(match))

    def add(total, i):
        digit = F.substring(number, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    luhn = F.aggregate(F.sequence(F.lit(1), count), F.lit(0), add) % 10 == 0
    return (
        F.when(kind == "email", True).when(kind == "ip", ip)
        .when(kind == "card", F.when(count.between(16, 19), luhn).otherwise(False)).otherwise(count.between(8, 15))
    )


def _order(kind: str = "kind") -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in [*KINDS, "generalised", "removed"]]), F.col(kind))


def base_spans(docs: DataFrame) -> DataFrame:
    """(_key, kind, start, end, value): the valid base matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for kind, (pattern, sign) in KINDS.items():
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
        some = docs.filter(text.rlike(sign)).select(row_key().alias("_key"), F.lit(kind).alias("kind"), zipped.alias("_all"))
        found.append(some.filter(F.size("_all") > 1).select("_key", "kind", F.posexplode("_all").alias("at", "one")))
    rows = found[0].union(found[1]).union(found[2]).union(found[3]).select(
        "_key", "kind", "at", F.length("one.gap").alias("skip"), F.coalesce(F.length("one.match"), F.lit(0)).alias("long"), F.col("one.match").alias("value")
    )
    rows = rows.dropDuplicates(["_key", "kind", "at"])
    line = W.partitionBy("_key", "kind").orderBy("at")
    end = F.sum(F.col("skip") + F.col("long")).over(line)
    placed = rows.withColumn("end", end).filter("value IS NOT NULL")
    return placed.filter(_valid(F.col("kind"), F.col("value"))).select("_key", "kind", (F.col("end") - F.col("long")).alias("start"), "end", "value")


def contexts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(_key, kind, value, _near): the unlike words of the text around each match, ``NEAR`` on each side; parts of other addresses are none."""
    texts = docs.select(row_key().alias("_key"), "text").dropDuplicates(["_key"])
    rows = spans.join(texts, "_key")
    first = F.greatest(F.col("start") - REACH, F.lit(0))
    before = F.substring("text", (first + 1).cast("int"), (F.col("start") - first).cast("int"))
    after = F.substring("text", (F.col("end") + 1).cast("int"), F.lit(REACH))
    rows = rows.select(
        "_key", "kind", "value", F.when(first > 0, F.regexp_replace(before, r"^\S+", "")).otherwise(before).alias("before"),
        F.when(F.length(after) == REACH, F.regexp_replace(after, r"\S+$", "")).otherwise(after).alias("after"),
    )
    words = lambda c: F.regexp_extract_all(F.lower(F.regexp_replace(c, KINDS["email"][0], " ")), F.lit(TERM), F.lit(0))
    left = F.slice(F.reverse(words("before")), 1, NEAR)
    return rows.select("_key", "kind", "value", F.array_distinct(F.concat(left, F.slice(words("after"), 1, NEAR))).alias("_near"))


def _entities() -> Column:
    """What a match protects, with the words that it spells itself: the value, and the local part and the domain of an address."""
    value = F.lower("value")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    bare = F.when(F.col("kind").isin("card", "phone"), _digits(value)).otherwise(value)
    spelt = F.regexp_extract_all(local, F.lit(TERM), F.lit(0))
    none = F.array().cast("array<string>")
    one = lambda name, v, s: F.struct(F.concat_ws(":", name, v).alias("entity"), s.alias("spelt"))
    own = one(F.col("kind"), bare, F.when(F.col("kind") == "email", spelt).otherwise(none))
    return F.when(F.col("kind") == "email", F.array(own, one(F.lit("local"), local, spelt), one(F.lit("domain"), domain, none))).otherwise(F.array(own))


def revealing_terms(docs: DataFrame, spans: DataFrame, chance: float = CHANCE, generalise: float = GENERALISE) -> DataFrame:
    """(term, share): terms and the greatest share of an entity's information that each reveals, from ``generalise`` on.

    A document has one context of an entity and a term, known by the two least hashes of its words without the term.
    The contexts of a pair count as their effective number, (sum c)^2 / sum c^2 over documents of equal context, so
    copies of a passage, exact or near, are about one. The first context proposes the pair and those beyond it speak
    for it; so does the entity that spells the term itself (a name in an address). The bound m^k / k! of their Poisson
    tail, with k! by Stirling from below, times all pairs that could be spoken for, is what chance brings.
    """
    seen = contexts(docs, spans).select("_key", F.explode(_entities()).alias("_e"), "_near").select("_key", "_e.*", "_near")
    terms = seen.select("_key", "entity", "spelt", "_near", F.explode("_near").alias("term"))
    hashes = F.array_sort(F.transform(F.array_remove("_near", F.col("term")), lambda w: F.xxhash64(w)))
    each = terms.groupBy("entity", "term", "_key").agg(
        F.min(F.concat_ws(":", F.slice(hashes, 1, 2).cast("array<string>"))).alias("context"), F.max(F.array_contains("spelt", F.col("term"))).alias("spells")
    )
    alike = each.groupBy("entity", "term", "context").agg(F.count("*").alias("c"), F.max("spells").alias("spells"))
    pairs = alike.groupBy("entity", "term").agg(
        F.sum("c").alias("n_both"), (F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("contexts"), F.max("spells").alias("spells")
    )
    of_entity = seen.select("entity", "_key").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = stored(pairs.join(of_entity, "entity").filter("n_entity > 1 OR spells"))
    tried = F.lit(float(max(1, pairs.count())))
    candidates = pairs.withColumn("more", F.col("contexts") - 1 + F.col("spells").cast("int")).filter("more > 0")
    keys = docs.select(row_key().alias("_key"), "text").dropDuplicates(["_key"])
    sums = keys.agg(F.count("*").alias("n"), F.sum(F.size(_words())).alias("words")).first()
    n = F.lit(float(sums["n"]))
    of_term = occurring(keys, candidates.select("term").distinct()).groupBy("term").agg(F.count("*").alias("n_term"))
    further = F.col("n_entity") - 1 + F.col("spells").cast("int")
    expected = further * F.col("n_term") * F.lit(2.0 * NEAR / max(1, sums["words"] or 0))
    tail = F.col("more") * (1 + F.log(expected) - F.log("more")) - F.log(2 * math.pi * F.col("more")) / 2
    information = F.log(n / F.col("n_entity"))
    mutual = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    share = F.when(information > 0, mutual / information)
    rated = candidates.join(of_term, "term").filter((F.col("more") > expected) & (tail + F.log(tried) < math.log(chance)))
    return rated.groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= generalise)


def _words() -> Column:
    """The unlike words of ``text``."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))


def occurring(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(_key, term): the ``terms`` that occur as words in each of ``texts`` (_key, text)."""
    return texts.select("_key", F.explode(_words()).alias("term")).join(stored(terms), "term")


def term_spans(docs: DataFrame, terms: DataFrame, remove: float = REMOVE) -> DataFrame:
    """(_key, kind, start, end): every occurrence of the ``terms`` (term, share) in ``docs``."""
    hits = occurring(docs.select(row_key().alias("_key"), "text"), terms).groupBy("_key").agg(
        F.map_from_entries(F.collect_set(F.struct("term", F.when(F.col("share") >= remove, "removed").otherwise("generalised")))).alias("_terms")
    )
    some = docs.select(row_key().alias("_key"), "text").dropDuplicates(["_key"]).join(stored(hits), "_key")
    zipped = F.arrays_zip(F.split("text", TERM, -1).alias("gap"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("match"))
    rows = some.select("_key", "_terms", F.posexplode(zipped).alias("at", "one")).select(
        "_key", "at", F.length("one.gap").alias("skip"), F.coalesce(F.length("one.match"), F.lit(0)).alias("long"),
        F.element_at("_terms", F.lower("one.match")).alias("kind"),
    )
    end = F.sum(F.col("skip") + F.col("long")).over(W.partitionBy("_key").orderBy("at"))
    return rows.withColumn("end", end).filter("kind IS NOT NULL").select("_key", "kind", (F.col("end") - F.col("long")).alias("start"), "end")


def spans(docs: DataFrame) -> DataFrame:
    """(_key, kind, start, end) of all base matches and all revealing terms; code points, end exclusive."""
    base = stored(base_spans(docs))
    terms = stored(revealing_terms(docs, base))
    return base.select("_key", "kind", "start", "end").unionByName(term_spans(docs, terms))


def find(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (doc_id), counts of the base kinds, base_sha256 and spans, for every row of ``docs``.

    Null texts count as empty; rows without matches have an empty string of spans.
    """
    carry = carry or ["doc_id"]
    found = spans(docs)
    one = F.struct(_order().alias("o"), F.col("start"), F.col("end"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    lists = found.groupBy("_key").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], F.array_sort(F.collect_list(one)).alias("_all")
    )
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["s"]))
    lists = lists.select(
        "_key", *[f"n_{k}" for k in KINDS], text(F.filter("_all", lambda x: x["o"] <= len(KINDS))).alias("_base"), text("_all").alias("spans")
    )
    rows = docs.select(*carry, row_key().alias("_key")).join(lists, "_key", "left")
    return rows.select(
        *carry, *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every base match replaced by its kind in angle brackets, revealing terms by <TERM> or nothing.

    Overlapping spans are one span of the first one's kind.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    body = names[docs.columns.index("text")]
    plain = docs.toDF(*names).withColumn("doc_id", F.col(names[docs.columns.index("doc_id")])).withColumn("text", F.col(body))
    line = W.partitionBy("_key").orderBy("start", _order(), F.desc("end"))
    found = spans(plain.select("doc_id", "text")).withColumn("_reach", F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1)))
    # A span that begins inside an earlier one only lengthens it.
    begins = F.coalesce(F.col("start") >= F.col("_reach"), F.lit(True))
    found = found.withColumn("_group", F.sum(begins.cast("int")).over(line))
    merged = found.groupBy("_key", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", _order())).alias("kind"))
    merged = merged.withColumn("_from", F.coalesce(F.lag("end").over(W.partitionBy("_key").orderBy("start")), F.lit(0)))
    cuts = merged.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "_from", "kind"))).alias("_cuts"))
    shown = lambda k: F.when(k == "removed", "").when(k == "generalised", "<TERM>").otherwise(F.concat(F.lit("<"), F.upper(k), F.lit(">")))
    parts = F.transform("_cuts", lambda c: F.concat(F.substring(F.col("text"), (c["_from"] + 1).cast("int"), (c["start"] - c["_from"]).cast("int")), shown(c["kind"])))
    last = F.substring(F.col("text"), (F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.length("text"))
    joined = plain.withColumn("_key", row_key()).join(cuts, "_key", "left")
    clean = joined.withColumn(body, F.when(F.col("_cuts").isNull(), F.col(body)).otherwise(F.concat(F.array_join(parts, ""), last)))
    return clean.select(*names).toDF(*docs.columns)
