"""Pattern queries ``predicate(subject, object)`` over triples.

Atoms are joined on their shared variables. Only the first atom is printed, one row per
binding, so variables that neither the first atom nor a later atom needs are summed away
into a multiplicity before each join. Atoms that share nothing only scale the multiplicity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from knotwork.operators.loop import keep_first

# The atom pattern and the variable names of the query language.
ATOM = re.compile(r'^(\w[\w ]*?)\s*\(\s*(?:"([^"]*)"|(\w+))\s*,\s*(?:"([^"]*)"|(\w+))\s*\)$')
VARIABLES = {"X", "Y", "Z", "_"}
EMPTY_QUERY = "Empty query."
BAD_SYNTAX = 'Invalid syntax. Use: predicate(subject, object) — e.g., regulates("FINMA", X)'


@dataclass(frozen=True)
class Term:
    text: str
    quoted: bool

    @property
    def variable(self) -> bool:
        return not self.quoted and self.text.upper() in VARIABLES


@dataclass(frozen=True)
class Atom:
    predicate: str
    subject: Term
    object: Term


def read_atoms(text: str) -> tuple[list[Atom], str | None]:
    """Atoms of a query text and an error text, if any."""
    if not text.strip():
        return [], EMPTY_QUERY
    pieces = [p.strip() for p in re.split(r",(?![^()]*\))", text.strip())]
    atoms = []
    for piece in filter(None, pieces):
        m = ATOM.match(piece)
        if not m:
            return [], BAD_SYNTAX
        predicate, s_quoted, s_word, o_quoted, o_word = m.groups()
        subject = Term(s_quoted, True) if s_quoted is not None else Term(s_word, False)
        obj = Term(o_quoted, True) if o_quoted is not None else Term(o_word, False)
        atoms.append(Atom(predicate.strip(), subject, obj))
    return atoms, None


def _matching(triples: DataFrame, atom: Atom) -> DataFrame:
    rows = triples.filter(F.col("predicate") == atom.predicate)
    for term, column in ((atom.subject, "subject"), (atom.object, "object")):
        if not term.variable:
            rows = rows.filter(F.lower(column) == term.text.lower())
    return rows


def query_single(triples: DataFrame, atom: Atom) -> DataFrame:
    """Matches of one atom, one row per (subject, object, derived) with the first confidence."""
    rows = _matching(triples, atom)
    return keep_first(rows, ["subject", "object", "derived"], ["ord"]).select(
        "subject", "predicate", "object", "derived", "confidence"
    )


def _atom_variables(atom: Atom) -> list[str]:
    return list(dict.fromkeys(t.text for t in (atom.subject, atom.object) if t.variable))


def _numbers(atoms: list[Atom]) -> dict[str, int]:
    """Variables by number: X and x are two variables, but column names know no case."""
    return {name: i for i, name in enumerate(dict.fromkeys(v for atom in atoms for v in _atom_variables(atom)))}


def _relation(triples: DataFrame, atom: Atom, equal: bool, spelled: bool, number: dict[str, int]) -> DataFrame:
    """Bindings of one atom: ``v_<number>`` lower-case keys, ``s_<number>`` spellings, ``n`` rows.

    An atom p(V, V) asks for equal parts only if V was bound before; else V takes the object.
    """
    rows = _matching(triples, atom)
    if equal:
        rows = rows.filter(F.lower("subject") == F.lower("object"))
    values = {}
    if atom.subject.variable:
        values[number[atom.subject.text]] = F.col("subject")
    if atom.object.variable and not equal:
        values[number[atom.object.text]] = F.col("object")
    columns = {f"v_{name}": F.lower(value) for name, value in values.items()}
    if spelled:
        columns |= {f"s_{name}": value for name, value in values.items()}
    return rows.select(*[value.alias(name) for name, value in columns.items()], F.lit(1).cast("bigint").alias("n"))


def _sum(rows: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _connected(parts: list) -> list[list]:
    """Parts grouped by shared variables; each part after the first of a group meets an earlier one."""
    groups, rest = [], list(parts)
    while rest:
        group = [rest.pop(0)]
        seen = set(group[0][0])
        while True:
            nxt = next((p for p in rest if seen & p[0]), None)
            if nxt is None:
                break
            rest.remove(nxt)
            group.append(nxt)
            seen |= nxt[0]
        groups.append(group)
    return groups


def _join_group(group: list, printed: set[int]) -> DataFrame:
    """Join the relations of a group; variables that nothing needs any more are summed away first."""
    current, bound = None, set()
    for i, (names, relation) in enumerate(group):
        later = {v for part in group[i + 1:] for v in part[0]}
        spelled = [f"s_{v}" for v in sorted(printed)]
        needed = spelled + [f"v_{v}" for v in sorted(names) if v in later or v in bound]
        relation = _sum(relation, [c for c in relation.columns if c in needed])
        if current is None:
            current = relation
        else:
            keys = [f"v_{v}" for v in sorted(names & bound)]
            current = current.join(relation.withColumnRenamed("n", "m"), keys)
            current = current.withColumn("n", F.col("n") * F.col("m")).drop("m")
        bound |= names
        keep = spelled + [f"v_{v}" for v in sorted(later & bound)]
        current = _sum(current, [c for c in current.columns if c in keep])
    return current


def bindings(triples: DataFrame, atoms: list[Atom]) -> DataFrame:
    """Distinct spellings of the first atom's variables with their multiplicity ``n``."""
    parts, bound, number = [], set(), _numbers(atoms)
    for i, atom in enumerate(atoms):
        names = {number[t.text] for t in (atom.subject, atom.object) if t.variable}
        same = atom.subject.variable and atom.object.variable and atom.subject.text == atom.object.text
        parts.append((names, _relation(triples, atom, same and number[atom.subject.text] in bound, i == 0, number)))
        bound |= names
    groups = _connected(parts)
    current = _join_group(groups[0], parts[0][0])
    for group in groups[1:]:
        total = _sum(_join_group(group, set()), [])
        current = current.withColumn("n", F.col("n") * total.scalar())
    return current.filter(F.col("n") > 0)


def query_join(triples: DataFrame, atoms: list[Atom], expand: bool = True) -> DataFrame:
    """Rows of the first atom, one per binding of all atoms.

    With ``expand=False`` each distinct row comes once with the column ``bindings``.
    """
    first = atoms[0]
    found, number = bindings(triples, atoms), _numbers(atoms)

    def printed(term: Term):
        if term.variable:
            return F.col(f"s_{number[term.text]}")
        return F.lit(term.text if term.quoted else "")

    rows = found.select(printed(first.subject).alias("subject"), printed(first.object).alias("object"), F.col("n").alias("bindings"))
    rows = rows.filter((F.col("subject") != "") & (F.col("object") != ""))
    known = keep_first(
        triples.filter(F.col("predicate") == first.predicate).select("subject", "object", "derived", "confidence", "ord"),
        ["subject", "object"], ["ord"],
    ).drop("ord")
    rows = rows.join(known, ["subject", "object"], "left").select(
        "subject", F.lit(first.predicate).alias("predicate"), "object",
        F.coalesce("derived", F.lit(False)).alias("derived"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "bindings",
    )
    return repeat_rows(rows, "bindings") if expand else rows


def repeat_rows(rows: DataFrame, count: str) -> DataFrame:
    """Each row ``count`` times, in two steps so that no array grows with the count."""
    step = 1000
    blocks = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / step).cast("bigint"))))
    size = F.least(F.lit(step).cast("bigint"), F.col(count) - F.col("_b") * step)
    return blocks.withColumn("_r", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).drop("_b", "_r", count)


def run_query(triples: DataFrame, text: str) -> tuple[DataFrame | None, str | None]:
    """Result rows, or None and the error text."""
    atoms, error = read_atoms(text)
    if error:
        return None, error
    return (query_single(triples, atoms[0]) if len(atoms) == 1 else query_join(triples, atoms)), None
