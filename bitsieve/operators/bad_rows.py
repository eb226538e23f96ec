"""Separate text rows that fail to parse, with the reason, while loading the rest.

From a :class:`RowSchema` one anchored pattern for a whole row is generated. A row
that it matches is loaded at once. Only rows that fail it go through patterns for
ever longer parts of the schema (the row's outline, its quoting, then field by
field); the first of them that doesn't match names what is broken.

Everything is built-in expressions, so the rows never leave the JVM. Loops in the
patterns are possessive, so a very long row can't exhaust the matcher's stack.
Nesting and ring numbers aren't regular: two counting guards follow the pattern.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the line notation.
ORGANIC_ATOMS = "Cl Br B C N O P S F I b c n o p s".split()
BRACKET_SYMBOLS = "Cl Si Se Br Li Na K Mg Ca Zn Fe Cu Pd Pt se H B C N O F P S I b c n o p s".split()
BOND = r"[-=#:/\\]"
RING = r"(?:[0-9]|%[0-9]{2})"
BRACKET_ATOM = rf"\[[0-9]{{0,3}}(?:{'|'.join(BRACKET_SYMBOLS)})@{{0,2}}(?:H[0-9]?)?(?:\+\+|--|[+-][0-9]?)?(?::[0-9]+)?\]"
ATOM = rf"(?:{'|'.join(ORGANIC_ATOMS)}|{BRACKET_ATOM})"
UNIT = rf"{ATOM}(?:{BOND}?{RING})*+"
SMILES = rf"{UNIT}(?:\)|\.{UNIT}|\(?{BOND}?{UNIT})*+"


def nesting_holds(smi: Column) -> Column:
    """Parentheses are balanced and every ``.`` stands outside of them."""
    marks = F.regexp_replace(smi, r"[^().]", "")
    broken = F.lit(-1)
    depth = F.aggregate(
        F.split(marks, "(?!^)"),
        F.lit(0),
        lambda d, m: F.when(d < 0, broken)
        .when(m == "(", d + 1)
        .when(m == ")", d - 1)
        .when((m == ".") & (d > 0), broken)
        .otherwise(d),
    )
    return (marks == "") | (depth == 0)


def rings_close(smi: Column) -> Column:
    """Every ring number that opens is closed by its next use, on another atom.

    ``%01`` and ``1`` are the same number.
    """
    s = F.regexp_replace(smi, r"\[[^\]]*\]", "A")
    s = F.regexp_replace(s, r"(?<!%)(?<!%[0-9])([0-9])", "{0$1}")
    s = F.regexp_replace(s, r"%([0-9]{2})", "{$1}")
    s = F.regexp_replace(s, "|".join(ORGANIC_ATOMS), "A")
    s = F.regexp_replace(s, r"[^A{}0-9]", "")
    labels = F.array_distinct(F.regexp_extract_all(s, F.lit(r"(\{[0-9]{2}\})"), F.lit(1)))

    def closes(label: Column) -> Column:
        own = F.regexp_replace(F.replace(s, label, F.lit("#")), r"\{[0-9]{2}\}", "")
        return own.rlike(r"^A*+(?:#A++#A*+)*+$")

    return (F.size(labels) == 0) | F.forall(labels, closes)


@dataclass(frozen=True)
class Field:
    """A column of a row: its pattern, and guards for what no pattern can say."""

    name: str
    pattern: str
    guards: tuple = ()


@dataclass(frozen=True)
class RowSchema:
    """``first [|extension|] [second]``, split at every single space.

    ``reasons`` lists, in the order in which they apply, the field to test
    beside the fixed outline reasons ``empty``, ``columns`` and ``quoting``.
    """

    first: Field
    second: Field
    reasons: tuple[str, ...] = field(default=())

    def whole_row(self) -> str:
        one, two = (rf'(?:"{f.pattern}"|{f.pattern})' for f in (self.first, self.second))
        return rf"^{one}(?: \|[^| ]*+\|)?(?: {two})?$"

    #: The row's outline: how many fields there may be.
    OUTLINE = r"^[^ ]++(?: \|[^ ]*+)?+(?: [^ |][^ ]*+)?$|^[^ ]++ \|[^ ]*+ [^ ]++$"
    #: Outline and quoting.
    QUOTING = r'^(?:"[^"| ]*+"|[^"| ]++)(?: \|[^| ]*+\|)?+(?: (?:"[^"| ]*+"|[^"| ]++))?$'

    def prefixes(self) -> list[tuple[str, str]]:
        """(reason, pattern of the part of the row up to there), in order."""
        any_first = r'(?:"[^"| ]*+"|[^"| ]++)'
        by_field = {
            self.second.name: rf'^{any_first}(?: \|[^| ]*+\|)?+(?: (?:"{self.second.pattern}"|{self.second.pattern}))?$',
            self.first.name: rf'^(?:"{self.first.pattern}"|{self.first.pattern})(?: |$)',
        }
        return [("columns", self.OUTLINE), ("quoting", self.QUOTING), *((r, by_field[r]) for r in self.reasons)]


SMI_LINE = RowSchema(
    first=Field("smiles", SMILES, (nesting_holds, rings_close)),
    second=Field("idx", r"[A-Za-z0-9_.:-]{1,40}"),
    reasons=("idx", "smiles"),
)


def stripped(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\A[ \t\r\n]++|[ \t\r\n]++\z", "")


def parse_rows(df: DataFrame, raw: str, schema: RowSchema, keep: list[str], line_no: str) -> DataFrame:
    """``keep..., smi, extension, idx, reason`` of every row; ``reason`` is null for loaded rows.

    Defined results: a null or blank row has the reason ``empty``; a missing
    second field is replaced by ``line_no`` as text; rows with a reason have null
    fields; rows equal in ``keep`` and ``raw`` are parsed alike, so taking them
    once is left to the caller; columns outside ``keep`` are not read.
    """
    row = F.col("__row")
    line = stripped(F.col(raw))
    # A newline inside a row is an ordinary character, so it is one that no field admits.
    base = df.select(*keep, F.coalesce(line, F.lit("")).alias("__row"))
    unquote = lambda c: F.regexp_replace(c, '^"|"$', "")
    first = unquote(F.element_at(F.split(row, " "), 1))
    guards = F.lit(True)
    for guard in schema.first.guards:
        guards = guards & guard(first)
    matched = row.rlike(f"(?s){schema.whole_row().removesuffix('$')}\\z") & guards
    reason = F.when(row == "", "empty")
    for name, pattern in schema.prefixes():
        body = pattern.replace("$|^", r"\z|^").removesuffix("$").replace("(?: |$)", r"(?: |\z)")
        body = body + r"\z" if pattern.endswith("$") else body
        fails = ~row.rlike(body)
        if name == schema.first.name:
            fails = fails | ~guards
        reason = reason.when(fails, name)
    out = base.withColumn("reason", F.when(matched, None).otherwise(reason.otherwise("row")))
    fields = F.split(row, " ")
    has_extension = F.coalesce(F.try_element_at(fields, F.lit(2)).startswith("|"), F.lit(False))
    second = F.try_element_at(fields, F.when(has_extension, 3).otherwise(2))
    good = F.col("reason").isNull()
    return out.select(
        *keep,
        F.when(good, first).alias("smi"),
        F.when(good & has_extension, F.element_at(fields, 2)).alias("extension"),
        F.when(good, F.coalesce(unquote(second), F.col(line_no).cast("string"))).alias("idx"),
        "reason",
    )
