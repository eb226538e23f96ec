"""Columns computed by the graph kernel, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bitsieve.config import FingerprintConfig
from bitsieve.functions import graphs as G

ATOM = T.StructType().add("n", "integer").add("symbol", "string").add("isotope", "integer").add("charge", "integer").add("aromatic", "boolean").add("h", "integer")
BOND = T.StructType().add("a", "integer").add("b", "integer").add("order", "integer")
CHANGED_BOND = T.StructType().add("a", "integer").add("b", "integer").add("order_before", "integer").add("order_after", "integer")
GRAPH = T.StructType().add("atoms", T.ArrayType(ATOM)).add("bonds", T.ArrayType(BOND))
CONDENSED = T.StructType().add("atoms", T.ArrayType(ATOM)).add("bonds", T.ArrayType(CHANGED_BOND))
PARSED = (
    T.StructType().add("error", "string").add("components", T.ArrayType(
        T.StructType().add("signature", "binary").add("smiles", "string").add("fingerprint", T.ArrayType(T.IntegerType())).add("organic", "boolean").add("structure", GRAPH).add("fast_mapping", T.ArrayType(T.IntegerType()))
    ))
)


def from_row(value) -> G.Graph | None:
    """A graph from a struct value as Arrow hands it over."""
    if value is None or value["atoms"] is None:
        return None
    whole = lambda x: None if x is None or x != x else int(x)
    atoms = tuple(G.Atom(int(a["n"]), a["symbol"], whole(a["isotope"]), int(a["charge"] or 0), bool(a["aromatic"]), whole(a["h"])) for a in value["atoms"])
    bonds = []
    for b in value["bonds"] if value["bonds"] is not None else ():
        orders = (b["order"],) if "order" in b else (b["order_before"], b["order_after"])
        bonds.append((int(b["a"]), int(b["b"]), *(int(o) for o in orders)))
    return G.Graph(atoms, tuple(bonds))


def to_row(g: G.Graph) -> dict:
    name = ("a", "b", "order") if not g.bonds or len(g.bonds[0]) == 3 else ("a", "b", "order_before", "order_after")
    return {"atoms": [a._asdict() for a in g.atoms], "bonds": [dict(zip(name, b, strict=True)) for b in g.bonds]}


def _rows(series: pd.DataFrame) -> list[dict]:
    return series.to_dict("records")


def _few(column: pa.Array, n: int = 64) -> Iterator[list]:
    """The values of an Arrow column as Python objects, some at a time: a batch of nested graphs takes a hundred times its size as objects."""
    for at in range(0, len(column), n):
        yield column.slice(at, n).to_pylist()


def contains_graph(target: str, query: str) -> Column:
    """Subgraph test of two graph columns, null structures never match."""

    @F.pandas_udf(T.BooleanType())
    def test(t: pd.DataFrame, q: pd.DataFrame) -> pd.Series:
        out, known = [], {}
        for x, y in zip(_rows(t), _rows(q), strict=True):
            a, b = from_row(x), from_row(y)
            if (a, b) not in known:
                known[a, b] = bool(a and b and G.contains(a, b))
            out.append(known[a, b])
        return pd.Series(out)

    return test(F.col(target), F.col(query))


def _bits(g: G.Graph, config: FingerprintConfig) -> list[int]:
    return G.fingerprint(g, min_radius=config.min_radius, max_radius=config.max_radius, length=config.length, active_bits=config.number_active_bits, bit_pairs=config.number_bit_pairs)


_COMPONENT = PARSED["components"].dataType.elementType
REACTION = (
    T.StructType().add("error", "string").add("centre", "string").add("cgrsmiles", "string").add("fingerprint", T.ArrayType(T.IntegerType())).add("structure", CONDENSED)
    .add("components", T.ArrayType(T.StructType(_COMPONENT.fields).add("is_product", "boolean")))
)


def _component(g: G.Graph, config: FingerprintConfig) -> dict:
    name, order = G.canonical_smiles(g)
    return {"signature": G.text_signature(name), "smiles": name, "fingerprint": _bits(g, config), "organic": G.is_organic(g), "structure": to_row(g), "fast_mapping": order}


def parsed(smiles: str | Column, config: FingerprintConfig = FingerprintConfig()) -> Column:
    """``error`` or the components of a molecule with their signature, text, fingerprint and class."""

    @F.pandas_udf(PARSED)
    def parse(s: pd.Series) -> pd.DataFrame:
        rows = []
        for text in s:
            try:
                parts = []
                whole, stereo = G.read_stereo(text or "")
                for g in G.components(whole):
                    marks = G.stereo_text(g, stereo) if stereo.turns or stereo.slants else ""
                    part = _component(G.normal(g), config)
                    parts.append(part | {"signature": G.text_signature(part["smiles"], marks)} if marks else part)
                rows.append((None, parts))
            except G.GraphError as e:
                rows.append((str(e), None))
        return pd.DataFrame(rows, columns=["error", "components"])

    return parse(F.col(smiles) if isinstance(smiles, str) else smiles)


def parsed_reaction(text: str, config: FingerprintConfig = FingerprintConfig()) -> Column:
    """``error``, or the centre, the condensed graph and the components of a reaction with their roles.

    Atoms keep the map numbers of the line; those without one are numbered apart, so that sides only share mapped atoms.
    """

    def read(line: str) -> dict:
        left, right = ([G.normal(g) for g in G.apart(side)] for side in G.read_reaction(line or ""))
        cgr = G.condensed(G.united(left), G.united([G.renumbered(g, {a.n: a.n + (10**6 if a.n > 10**5 else 0) for a in g.atoms}) for g in right])) if left and right else None
        parts = [_component(g, config) | {"is_product": side} for side, graphs in ((False, left), (True, right)) for g in graphs]
        out = {"error": None, "centre": G.centre(cgr), "components": parts, "cgrsmiles": None, "fingerprint": None, "structure": None}
        if cgr:
            bonds = [dict(zip(("a", "b", "order_before", "order_after"), k, strict=True)) for k in cgr.bonds]
            out |= {"cgrsmiles": G.canonical_smiles(cgr)[0], "fingerprint": _bits(cgr, config), "structure": {"atoms": [a._asdict() for a in cgr.atoms], "bonds": bonds}}
        return out

    @F.pandas_udf(REACTION)
    def parse(s: pd.Series) -> pd.DataFrame:
        rows = []
        for line in s:
            try:
                rows.append(read(line))
            except G.GraphError as e:
                rows.append(dict.fromkeys(REACTION.names) | {"error": str(e)})
        return pd.DataFrame(rows, columns=REACTION.names)

    return parse(F.col(text))


def centre_fingerprint(structure: str, config: FingerprintConfig = FingerprintConfig(max_radius=4)) -> Column:
    """Bits of the fragments of a condensed graph's reaction centre, of 1 to 4 atoms; null without a centre."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def bits(s: pd.DataFrame) -> pd.Series:
        return pd.Series([_bits(g, config) if (g := G.centre_graph(from_row(x))) else None for x in _rows(s)], dtype=object)

    return bits(F.col(structure))


def graph_fingerprint(structure: str, config: FingerprintConfig = FingerprintConfig()) -> Column:
    """Sorted bits of the linear fragments of a stored graph."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def bits(s: pd.DataFrame) -> pd.Series:
        return pd.Series([_bits(g, config) if (g := from_row(x)) else None for x in _rows(s)])

    return bits(F.col(structure))


def canonical_text(structure: str) -> Column:
    """Canonical line notation of a stored graph, plain or condensed."""

    @F.pandas_udf(T.StringType())
    def text(s: pd.DataFrame) -> pd.Series:
        return pd.Series([G.canonical_smiles(g)[0] if (g := from_row(x)) else None for x in _rows(s)])

    return text(F.col(structure))


def centre_text(structure: str) -> Column:
    """Reaction centre of a condensed graph; null without changed bonds."""

    @F.pandas_udf(T.StringType())
    def text(s: pd.DataFrame) -> pd.Series:
        return pd.Series([G.centre(from_row(x)) for x in _rows(s)])

    return text(F.col(structure))


def united_graph(parts: str) -> Column:
    """One graph of an array of ``struct<structure, mapping>``, each renumbered by its mapping first."""

    @F.pandas_udf(GRAPH)
    def unite(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            graphs = []
            for p in x if x is not None else ():
                g = from_row(p["structure"])
                if g:
                    m = p["mapping"] if p["mapping"] is not None else ()
                    graphs.append(G.renumbered(g, {int(k["from"]): int(k["to"]) for k in m}))
            whole = to_row(G.united(graphs)) if graphs else {"atoms": None, "bonds": None}
            rows.append((whole["atoms"], whole["bonds"]))
        return pd.DataFrame(rows, columns=["atoms", "bonds"])

    return unite(F.col(parts))


def sides(substances: str) -> Column:
    """The two sides of a reaction as graphs: an array of ``struct<is_product, mapping, parts>``, parts being ``struct<structure, mapping>``,
    renumbered part by part and substance by substance, then united by role. Structures that are missing are left out."""
    kind = T.StructType().add("reactants", GRAPH).add("products", GRAPH)
    numbers = lambda m: {int(k["from"]): int(k["to"]) for k in (m if m is not None else ())}

    def united(some: list) -> list[dict]:
        out = []
        for rows in some:
            graphs: dict[bool, list[G.Graph]] = {False: [], True: []}
            for r in rows if rows is not None else ():
                parts = [(from_row(p["structure"]), p["mapping"]) for p in (r["parts"] if r["parts"] is not None else ())]
                whole = G.united([G.renumbered(g, numbers(m)) for g, m in parts if g])
                graphs[bool(r["is_product"])].append(G.renumbered(whole, numbers(r["mapping"])))
            out.append({name: to_row(G.united(graphs[k])) for k, name in enumerate(kind.names)})
        return out

    @F.arrow_udf(kind)
    def by_role(s: pa.Array) -> pa.Array:
        arrow = to_arrow_type(kind)
        return pa.concat_arrays([pa.array([], arrow), *(pa.array(united(some), arrow) for some in _few(s))])

    return by_role(F.col(substances))


def condensed_graph(reactants: str, products: str) -> Column:
    """Both sides laid over each other; null atoms where that can't be done."""

    @F.pandas_udf(CONDENSED)
    def compose(r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x, y in zip(_rows(r), _rows(p), strict=True):
            a, b = from_row(x), from_row(y)
            c = G.condensed(a, b) if a and b else None
            bonds = c and [dict(zip(("a", "b", "order_before", "order_after"), k, strict=True)) for k in c.bonds]
            rows.append(([q._asdict() for q in c.atoms], bonds) if c else (None, None))
        return pd.DataFrame(rows, columns=["atoms", "bonds"])

    return compose(F.col(reactants), F.col(products))


def reaction_key(substances: str) -> Column:
    """Text of the condensed graph of an array of ``struct<is_product, mapping, parts>``, parts being ``struct<structure, mapping>``.

    Parts are renumbered and united to substances, substances to the two sides. Null where a structure is missing, a
    mapping gives two atoms one number, or the sides can't be laid over each other.
    """

    def remapped(g: G.Graph, mapping) -> G.Graph:
        h = G.renumbered(g, {int(k["from"]): int(k["to"]) for k in (mapping if mapping is not None else ())})
        if len({a.n for a in h.atoms}) < len(h.atoms):
            raise G.GraphError("two atoms get one number")
        return h

    def whole(rows) -> str | None:
        sides: dict[bool, list[G.Graph]] = {False: [], True: []}
        for r in rows:
            parts = [(from_row(p["structure"]), p["mapping"]) for p in (r["parts"] if r["parts"] is not None else ())]
            if not parts or any(g is None for g, _ in parts):
                return None
            sides[bool(r["is_product"])].append(remapped(G.united([remapped(g, m) for g, m in parts]), r["mapping"]))
        return G.condensed_key(G.united(sides[False]), G.united(sides[True]))

    def text(rows) -> str | None:
        try:
            return whole(rows)
        except G.GraphError:
            return None

    @F.arrow_udf(T.StringType())
    def key(s: pa.Array) -> pa.Array:
        return pa.array([text(rows) for some in _few(s) for rows in some], pa.string())

    return key(F.col(substances))
