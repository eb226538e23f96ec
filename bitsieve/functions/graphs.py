"""Molecular graphs: reading line notation, canonical order, fragments, subgraphs, condensed graphs.

A graph here is a list of atoms ``(n, symbol, isotope, charge, aromatic, h)`` and a list of bonds
``(a, b, order)`` (order 4: aromatic); a condensed graph has bonds ``(a, b, before, after)``, 0 for none. These
are plain functions on tuples; the columns built from them are in :mod:`bitsieve.functions.graph_columns`.

Identity: before a canonical text is made, hydrogens that aren't written are filled in from valences, and Kekulé rings of
five or six atoms with six electrons are made aromatic, ring after ring (:func:`normal`); larger rings are taken as they are
written. Graphs and texts hold no stereo marks, but a signature does: :func:`read_stereo` keeps the marks of a
line, and :func:`signature` digests them with the text, so mirror images and cis-trans pairs stay apart. Marks that
can't be told apart from symmetry by classes of atoms are an error, never a silent merge.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from typing import NamedTuple

# Usual valences of the atoms written without brackets.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
#: Elements of organic molecules.
ORGANIC = frozenset("B C N O Si P S Se F Cl Br I".split())
ORDERS = {"-": 1, "=": 2, "#": 3, ":": 4, "/": 1, "\\": 1}
AROMATIC = 4

TOKEN = re.compile(
    r"(?P<bracket>\[(?P<isotope>\d{1,3})?(?P<symbol>[A-Z][a-z]?|[a-z][a-z]?)(?P<turn>@{0,2})(?P<h>H\d?)?(?P<charge>\+\+|--|[+-]\d?)?(?P<number>:\d+)?\])"
    r"|(?P<dynamic>\[(?P<before>[-=#:.])>(?P<after>[-=#:.])\])"
    r"|(?P<atom>Cl|Br|[BCNOPSFI]|[bcnops])|(?P<ring>\d|%\d\d)|(?P<bond>[-=#:/\\])|(?P<open>\()|(?P<close>\))|(?P<dot>\.)"
)


class GraphError(ValueError):
    """The text is no graph, or its atoms have impossible valences."""


class Atom(NamedTuple):
    n: int
    symbol: str
    isotope: int | None
    charge: int
    aromatic: bool
    h: int | None


class Graph(NamedTuple):
    atoms: tuple[Atom, ...]
    bonds: tuple[tuple, ...]
    #: Numbers that were written as map numbers.
    mapped: frozenset = frozenset()

    def neighbours(self) -> dict[int, dict[int, tuple]]:
        out: dict[int, dict[int, tuple]] = {a.n: {} for a in self.atoms}
        for a, b, *order in self.bonds:
            out[a][b] = out[b][a] = tuple(order)
        return out


class Stereo(NamedTuple):
    """Marks of a line: ``turns`` by atom (``@`` or ``@@``, the neighbours in the order they are written, 0 for a
    hydrogen), and ``slants`` by bond (first atom, second atom, ``/`` or ``\\``)."""

    turns: dict[int, tuple[str, list[int]]]
    slants: list[tuple[int, int, str]]


def read_smiles(text: str, *, dynamic: bool = False) -> Graph:
    """The graph of a line notation; with ``dynamic`` its bonds are pairs and ``[a>b]`` marks a change."""
    return read_stereo(text, dynamic=dynamic)[0]


def read_stereo(text: str, *, dynamic: bool = False) -> tuple[Graph, Stereo]:
    """The graph of a line notation and its stereo marks."""
    atoms: list[Atom] = []
    bonds: dict[tuple[int, int], tuple] = {}
    rings: dict[int, tuple[int, tuple | None]] = {}
    branches: list[int] = []
    implied: set[int] = set()
    last, bond, at = 0, None, 0
    turns: dict[int, tuple[str, list]] = {}
    slants: list[tuple[int, int, str]] = []
    slant, opened = "", {}

    def link(a: int, b: int, order: tuple | None) -> None:
        if a == b or (min(a, b), max(a, b)) in bonds:
            raise GraphError(f"bond {a}-{b} repeated")
        if order is None:
            both = atoms[a - 1].aromatic and atoms[b - 1].aromatic
            order = (AROMATIC, AROMATIC) if both else (1, 1)
        bonds[min(a, b), max(a, b)] = order

    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise GraphError(f"unexpected text at {at}")
        at = m.end()
        if m["atom"] or m["bracket"]:
            symbol = m["atom"] or m["symbol"]
            aromatic = symbol[0].islower()
            charge = m["charge"] or ""
            sign = -1 if charge[:1] == "-" else 1
            value = sign * (2 if len(charge) == 2 and charge[1] in "+-" else int(charge[1:] or 1)) if charge else 0
            n = len(atoms) + 1
            number = int(m["number"][1:]) if m["number"] else 0
            h = None if m["atom"] else (int(m["h"][1:] or 1) if m["h"] else 0)
            atoms.append(Atom(n, symbol.capitalize(), int(m["isotope"]) if m["isotope"] else None, value, aromatic, h))
            if m["atom"]:
                implied.add(n)
            if number:
                if -number in rings:
                    raise GraphError(f"map number {number} used twice")
                rings[-number] = (n, None)
            if last:
                link(last, n, bond)
                if slant:
                    slants.append((last, n, slant))
                if last in turns:
                    turns[last][1].append(n)
            if m["bracket"] and m["turn"]:
                turns[n] = m["turn"], [last] * bool(last) + [0] * (h or 0)
            last, bond, slant = n, None, ""
        elif m["ring"]:
            label = int(m["ring"].lstrip("%"))
            if not last:
                raise GraphError("ring number before any atom")
            if label in rings:
                other, order = rings.pop(label)
                if order and bond and order != bond:
                    raise GraphError(f"ring {label} has two bond orders")
                link(other, last, bond or order)
                mark, place = opened.pop(label)
                if mark or slant:
                    slants.append((other, last, mark) if mark else (last, other, slant))
                if other in turns:
                    turns[other][1][place] = last
                if last in turns:
                    turns[last][1].append(other)
            else:
                rings[label] = (last, bond)
                opened[label] = slant, len(turns[last][1]) if last in turns else 0
                if last in turns:
                    turns[last][1].append(-1)
            bond, slant = None, ""
        elif m["bond"]:
            bond = (ORDERS[m["bond"]],) * 2
            slant = m["bond"] if m["bond"] in "/\\" else ""
        elif m["dynamic"]:
            if not dynamic:
                raise GraphError("dynamic bond in a plain graph")
            bond = tuple(0 if m[k] == "." else ORDERS[m[k]] for k in ("before", "after"))
        elif m["open"]:
            branches.append(last)
        elif m["close"]:
            if not branches:
                raise GraphError("branch closed twice")
            last, bond = branches.pop(), None
        else:
            if branches or bond:
                raise GraphError("component ends in a branch or bond")
            last = 0
    if not atoms or branches or bond or any(k >= 0 for k in rings):
        raise GraphError("open branch, ring or bond")
    numbers = {v[0]: -k for k, v in rings.items()}
    if numbers:  # mapped: atoms take their numbers, the others follow
        free = max(numbers.values())
        name = {}
        for a in atoms:
            if a.n in numbers:
                name[a.n] = numbers[a.n]
            else:
                free += 1
                name[a.n] = free
        if len(set(name.values())) < len(name):
            raise GraphError("map number used twice")
        atoms = [a._replace(n=name[a.n]) for a in atoms]
        bonds = {(name[a], name[b]): o for (a, b), o in bonds.items()}
        turns = {name[n]: (t, [name.get(k, 0) for k in ks]) for n, (t, ks) in turns.items()}
        slants = [(name[a], name[b], k) for a, b, k in slants]
        implied = {name[n] for n in implied}
    if not dynamic:
        _check_valences(atoms, bonds, implied)
    return Graph(tuple(atoms), tuple((a, b, *(o if dynamic else o[:1])) for (a, b), o in bonds.items()), frozenset(numbers.values())), Stereo(turns, slants)


def _check_valences(atoms: list[Atom], bonds: dict, implied: set[int]) -> None:
    total: Counter = Counter()
    for (a, b), order in bonds.items():
        for n in (a, b):
            total[n] += 1 if order[0] == AROMATIC else order[0]
    for a in atoms:
        if a.n in implied and total[a.n] > max(VALENCES[a.symbol]):
            raise GraphError(f"valence of atom {a.n}")


def components(g: Graph) -> list[Graph]:
    near, left, out = g.neighbours(), [a.n for a in g.atoms], []
    seen: set[int] = set()
    for n in left:
        if n in seen:
            continue
        part, queue = {n}, [n]
        while queue:
            for m in near[queue.pop()]:
                if m not in part:
                    part.add(m)
                    queue.append(m)
        seen |= part
        out.append(Graph(tuple(a for a in g.atoms if a.n in part), tuple(b for b in g.bonds if b[0] in part)))
    return out


def is_organic(g: Graph) -> bool:
    return sum(a.charge for a in g.atoms) == 0 and all(a.symbol in ORGANIC for a in g.atoms)


def _label(a: Atom) -> tuple:
    return a.symbol, a.isotope or 0, a.charge, a.aromatic, -1 if a.h is None else a.h


def implied(symbol: str, aromatic: bool, charge: int, bonds: int) -> int:
    """Hydrogens of an atom that is written without brackets; ``bonds`` adds up its orders, an aromatic one as 1."""
    if symbol not in VALENCES or charge:
        return 0
    used = bonds + (1 if aromatic and symbol in ("B", "C", "N", "P") else 0)
    return next((v - used for v in VALENCES[symbol][: 1 if aromatic else None] if v >= used), 0)


def normal(g: Graph) -> Graph:
    """The graph with all hydrogens counted and its Kekulé rings of five or six atoms made aromatic.

    A ring is made aromatic if its atoms give six electrons: one each at a double bond in the ring or in an aromatic ring, two from a N, O, S, P or Se without
    one, none from a carbon with a double bond to O, N or S outside. Fused rings follow one another until nothing changes.
    Condensed graphs are returned as they are.
    """
    if any(len(b) > 3 for b in g.bonds):
        return g
    near = g.neighbours()
    sums = {a.n: sum(1 if o[0] == AROMATIC else o[0] for o in near[a.n].values()) for a in g.atoms}
    atom = {a.n: a._replace(h=implied(a.symbol, a.aromatic, a.charge, sums[a.n]) if a.h is None else a.h) for a in g.atoms}
    order = {(min(a, b), max(a, b)): o for a, b, o in g.bonds}
    bond = lambda a, b: order[min(a, b), max(a, b)]
    double = {n: [m for m in near[n] if bond(n, m) == 2] for n in near}
    pending = [r for r in _small_rings(near) if not all(atom[n].aromatic for n in r)] if any(double.values()) else []
    changed = True
    while changed and pending:
        changed = False
        for ring in pending:
            members, electrons = set(ring), 0
            for n in ring:
                a = atom[n]
                if a.aromatic:
                    lone = a.symbol in ("O", "S", "Se") or (a.symbol in ("N", "P") and (a.h or len(near[n]) > 2) and not a.charge)
                    electrons += 2 if lone else 1
                elif any(m in members for m in double[n]):
                    electrons += 1
                elif not double[n] and a.symbol in ("N", "O", "S", "P", "Se") and a.charge <= 0:
                    electrons += 2
                elif double[n] and a.symbol == "C" and all(atom[m].symbol in ("O", "N", "S") for m in double[n]):
                    electrons += 0
                else:
                    electrons = -99
            if electrons == 6:
                for n, m in zip(ring, (*ring[1:], ring[0]), strict=True):
                    order[min(n, m), max(n, m)] = AROMATIC
                    atom[n] = atom[n]._replace(aromatic=True)
                    double[n] = [k for k in double[n] if k not in members]
                changed = True
        pending = [r for r in pending if not all(bond(n, m) == AROMATIC for n, m in zip(r, (*r[1:], r[0]), strict=True))]
    return g._replace(atoms=tuple(atom[a.n] for a in g.atoms), bonds=tuple((a, b, order[min(a, b), max(a, b)]) for a, b, _ in g.bonds))


def _small_rings(near: dict[int, dict]) -> list[tuple[int, ...]]:
    """Rings of five and six atoms, each once."""
    out = []
    for n in near:
        paths = [(n,)]
        for size in range(2, 7):
            paths = [(*p, m) for p in paths for m in near[p[-1]] if m > n and m not in p]
            if size >= 5:
                out += [p for p in paths if n in near[p[-1]] and p[1] < p[-1]]
    return out


def _refined(near: dict[int, dict], c: dict[int, int]) -> dict[int, int]:
    """Classes divided by their neighbours' classes until nothing changes; numbers follow from content only."""
    count = len(set(c.values()))
    while True:
        key = {n: (c[n], sorted((c[m], o) for m, o in near[n].items())) for n in c}
        rank = {k: i for i, k in enumerate(sorted({(a, tuple(b)) for a, b in key.values()}))}
        new = {n: rank[a, tuple(b)] for n, (a, b) in key.items()}
        if len(rank) == count:
            return new
        c, count = new, len(rank)


class _Found(Exception):
    """An automorphism was found: what is left below ``level`` is an image of what is known."""

    def __init__(self, level: int):
        self.level = level


def _discrete(near: dict[int, dict], c: dict[int, int]) -> dict[int, int]:
    """A numbering of a connected graph that follows from its refined classes ``c`` and bonds only.

    Ties are broken one atom at a time; of all numberings met, the one with the least description counts. Branches whose
    description differs early are dropped, and so are those that a found automorphism maps to one already known.
    """
    edges = [(n, m, o) for n in near for m, o in near[n].items() if n < m]
    label = dict(c)

    def described(c: dict[int, int]) -> tuple:
        at = sorted((c[n], label[n]) for n in c)
        return tuple(at), tuple(sorted((c[n], c[m], o) if c[n] <= c[m] else (c[m], c[n], o) for n, m, o in edges))

    best: list = []  # description, numbering, path
    autos: list[dict[int, int]] = []

    def orbits(fixed: tuple[int, ...]) -> dict[int, int]:
        root = {n: n for n in c}

        def top(n: int) -> int:
            while root[n] != n:
                root[n] = n = root[root[n]]
            return n

        for g in autos:
            if all(g[f] == f for f in fixed):
                for n, m in g.items():
                    root[top(n)] = top(m)
        return {n: top(n) for n in c}

    def search(c: dict[int, int], path: tuple[int, ...]) -> None:
        members: dict[int, list[int]] = {}
        for n, k in c.items():
            members.setdefault(k, []).append(n)
        tied = min(((len(v), k) for k, v in members.items() if len(v) > 1), default=None)
        if tied is None:
            d = described(c)
            if not best or d < best[0]:
                best[:] = d, c, path
            elif d == best[0]:
                back = {k: n for n, k in best[1].items()}
                autos.append({back[k]: n for n, k in c.items()})
                raise _Found(next((i for i, (a, b) in enumerate(zip(path, best[2], strict=False)) if a != b), 0))
            return
        chosen: dict = {}
        for n in members[tied[1]]:
            # Atoms at the end of equal bonds of one atom can be exchanged: one of them will do.
            end = next(iter(near[n].items())) if len(near[n]) == 1 else n
            chosen.setdefault(end, n)
        kids = {}
        for n in chosen.values():
            kids[n] = _refined(near, {m: 2 * k + (m != n) for m, k in c.items()})
        shape = {n: described(k) for n, k in kids.items()} if len(kids) > 1 else dict.fromkeys(kids)
        least = min(shape.values()) if len(kids) > 1 else None
        tried: list[int] = []
        for n in kids:
            if shape[n] != least:
                continue
            if tried:
                of = orbits(path)
                if of[n] in {of[m] for m in tried}:
                    continue
            try:
                search(kids[n], (*path, n))
            except _Found as found:
                if found.level < len(path):
                    raise
            tried.append(n)

    try:
        search(c, ())
    except RecursionError:
        raise GraphError("too many equal parts") from None
    return best[1]


def canonical_order(g: Graph) -> list[int]:
    """Atom numbers in an order that doesn't depend on the numbering, component after component."""
    return canonical_smiles(g)[1]


def _classes(g: Graph) -> dict[int, int]:
    label = {a.n: _label(a) for a in g.atoms}
    rank = {k: i for i, k in enumerate(sorted(set(label.values())))}
    return {n: rank[k] for n, k in label.items()}


def canonical_smiles(g: Graph) -> tuple[str, list[int]]:
    """A line notation and the atoms in the order in which it names them; components in the order of their texts."""
    parts = sorted((_component_text(c) for c in components(normal(g))), key=lambda p: p[0])
    return ".".join(p[0] for p in parts), [n for p in parts for n in p[1]]


def _component_text(g: Graph) -> tuple[str, list[int]]:
    near = g.neighbours()
    rank = _discrete(near, _refined(near, _classes(g)))
    atom = {a.n: a for a in g.atoms}
    sums = {n: sum(1 if o[0] == AROMATIC else o[0] for o in near[n].values()) for n in near}
    text = {1: "", 2: "=", 3: "#", 4: "", 0: "."}

    def bond(a: int, b: int) -> str:
        o = near[a][b]
        both = atom[a].aromatic and atom[b].aromatic
        if len(o) == 1 or o[0] == o[1]:
            return "-" if both and o[0] == 1 else ":" if not both and o[0] == 4 else text[o[0]]
        return f"[{'.-=#:'[o[0]]}>{'.-=#:'[o[1]]}]"

    root = min(rank, key=rank.get)
    order: list[int] = []
    children: dict[int, list[int]] = {}
    stack, seen = [(root, 0)], set()
    while stack:  # depth first, without recursion
        n, up = stack.pop()
        if n in seen:
            continue
        seen.add(n)
        order.append(n)
        children.setdefault(n, [])
        if up:
            children[up].append(n)
        stack.extend((m, n) for m in sorted(near[n], key=rank.get, reverse=True) if m not in seen)
    tree = {(n, c) for n, cs in children.items() for c in cs}
    place = {n: i for i, n in enumerate(order)}
    closures: dict[int, list[tuple[int, int]]] = {n: [] for n in near}
    label = 0
    for n in order:
        for m in sorted(near[n], key=place.get):
            if place[m] > place[n] and (n, m) not in tree:
                label += 1
                closures[n].append((label, m))
                closures[m].append((label, n))
    todo: list = [("", root)]
    out = []
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        lead, n = item
        out.append(lead + _atom_text(atom[n], sums[n]) + "".join((bond(n, m) if place[n] < place[m] else "") + (str(k) if k < 10 else f"%{k:02d}" if k < 100 else f"%({k})") for k, m in closures[n]))
        kids = children[n]
        for i, c in reversed(list(enumerate(kids))):
            if i < len(kids) - 1:
                todo += [")", (bond(n, c), c), "("]
            else:
                todo.append((bond(n, c), c))
    return "".join(out), order


def _atom_text(a: Atom, bonds: int) -> str:
    symbol = a.symbol.lower() if a.aromatic else a.symbol
    if a.h in (None, implied(a.symbol, a.aromatic, a.charge, bonds)) and not a.isotope and not a.charge and a.symbol in VALENCES:
        return symbol
    h = "" if not a.h else "H" if a.h == 1 else f"H{a.h}"
    charge = "" if not a.charge else ("+" if a.charge > 0 else "-") + (str(abs(a.charge)) if abs(a.charge) > 1 else "")
    return f"[{a.isotope or ''}{symbol}{h}{charge}]"


def signature(g: Graph, stereo: Stereo | None = None) -> bytes:
    """Digest of the canonical text, and of the stereo marks of the graph's atoms where there are any; 64 bytes."""
    return text_signature(canonical_smiles(g)[0], stereo_text(g, stereo) if stereo else "")


def text_signature(text: str, marks: str = "") -> bytes:
    return hashlib.sha512(f"{text} {marks}".strip().encode()).digest()


def stereo_text(g: Graph, stereo: Stereo) -> str:
    """The stereo marks as text that doesn't depend on the numbering; empty without any that matters.

    Marks are put into the classes of atoms: a centre whose neighbours are all of unlike classes turns left or right by the order of these,
    the ends of a double bond lie on one side or on two by their unlike neighbours. Classes are divided by what is known
    and the rest is looked at again. A mark whose neighbours stay alike means nothing where these are exchangeable ends; elsewhere it
    is an error.
    """
    h = normal(g)
    near = h.neighbours()
    turns = {n: v for n, v in stereo.turns.items() if n in near}
    slants: dict[int, list[tuple[int, str]]] = {}
    for a, b, k in stereo.slants:
        if a in near:
            slants.setdefault(a, []).append((b, k))
            slants.setdefault(b, []).append((a, "/" if k == "\\" else "\\"))
    doubles = [(a, b) for a, b, *_ in g.bonds if a in slants and b in slants and dict(((min(x, y), max(x, y)), o) for x, y, o in g.bonds)[min(a, b), max(a, b)] == 2]
    if not turns and not doubles:
        return ""
    c = _refined(near, _classes(h))
    done: dict = {}
    while True:
        found = {}
        for n, (mark, around) in turns.items():
            key = [-1 if m == 0 else c[m] for m in around]
            if len(around) >= 3 and len(set(key)) == len(key):
                swaps = sum(key[i] > key[j] for i in range(len(key)) for j in range(i + 1, len(key)))
                found[n] = "@" if (mark == "@") == (swaps % 2 == 0) else "@@"
        for a, b in doubles:
            sides = []
            for n, other in ((a, b), (b, a)):
                rest = [m for m in near[n] if m != other]
                if len({c[m] for m in rest}) < len(rest):
                    break
                first = max(rest, key=c.get)
                marked, k = slants[n][0]
                sides.append((k == "/") == (marked == first))
            if len(sides) == 2:
                found[min(a, b), max(a, b)] = "same" if sides[0] == sides[1] else "across"
        if found.keys() <= done.keys():
            break
        done = found
        key = {n: (c[n], done.get(n, ""), tuple(sorted(v for k, v in done.items() if isinstance(k, tuple) and n in k))) for n in c}
        rank = {k: i for i, k in enumerate(sorted(set(key.values())))}
        c = _refined(near, {n: rank[k] for n, k in key.items()})
    ends = lambda ms: len({(next(iter(near[m])), h_kind[m]) for m in ms}) < len(ms) and all(len(near[m]) == 1 for m in ms)
    h_kind = {a.n: _label(a) for a in h.atoms}
    for n, (_, around) in turns.items():
        alike = [m for m in around if m and sum(c[m] == c[k] for k in around if k) > 1]
        if n not in done and len(around) >= 3 and not ends(alike) and around.count(0) < 2:
            raise GraphError(f"turn of atom {n} can't be told apart from symmetry")
    for a, b in doubles:
        if (min(a, b), max(a, b)) not in done:
            rests = [[m for m in near[n] if m != other] for n, other in ((a, b), (b, a))]
            if not any(len(r) > 1 and len({c[m] for m in r}) == 1 and ends(r) for r in rests):
                raise GraphError(f"sides of bond {a}-{b} can't be told apart from symmetry")
    marks = sorted(str((c[k], v) if isinstance(k, int) else (*sorted((c[k[0]], c[k[1]])), v)) for k, v in done.items())
    return ";".join(marks)


_CODES: dict[tuple, int] = {}
_NAMES: list[tuple] = []
_WORDS: dict[tuple, dict[tuple, list[list[int]]]] = {}


def _code(name: tuple) -> int:
    if name not in _CODES:
        _CODES[name] = len(_NAMES)
        _NAMES.append(name)
    return _CODES[name]


def fingerprint(g: Graph, *, min_radius: int = 1, max_radius: int = 6, length: int = 2048, active_bits: int = 2, bit_pairs: int = 4) -> list[int]:
    """Sorted bits of the linear fragments of ``min_radius``..``max_radius`` atoms.

    A fragment reads the same from both ends; its k-th occurrence (up to ``bit_pairs``) sets ``active_bits``
    bits of its own. Atom labels hold neither degree nor hydrogens, so the bits of a subgraph are a subset.
    """
    at = {a.n: i for i, a in enumerate(g.atoms)}
    code = [_code((a.symbol, a.charge, a.isotope or 0)) for a in g.atoms]
    near: list[list[tuple[int, int, int]]] = [[] for _ in g.atoms]
    for a, b, *order in g.bonds:
        i, j, o = at[a], at[b], _code(tuple(order))
        near[i].append((j, 1 << j, o))
        near[j].append((i, 1 << i, o))
    found: dict[tuple, int] = {}
    paths = [(i, i, 1 << i, (k,)) for i, k in enumerate(code)]
    for size in range(1, max_radius + 1):
        if size >= min_radius:
            for first, last, _, word in paths:
                if first < last or size == 1:
                    back = word[::-1]
                    if back < word:
                        word = back
                    found[word] = found.get(word, 0) + 1
        if size < max_radius:
            paths = [(first, j, mask | one, (*word, o, code[j])) for first, last, mask, word in paths for j, one, o in near[last] if not mask & one]
    known = _WORDS.setdefault((length, active_bits, bit_pairs), {})
    if len(known) > 300_000:
        known.clear()
    bits: set[int] = set()
    for word, times in found.items():
        if word not in known:
            name = tuple(_NAMES[k] for k in word)
            name = min(name, name[::-1])
            digests = [hashlib.md5(repr((name, k)).encode()).digest() for k in range(bit_pairs)]
            known[word] = [[int.from_bytes(d[4 * i : 4 * i + 4], "big") % length for i in range(active_bits)] for d in digests]
        for k in known[word][:times]:
            bits.update(k)
    return sorted(bits)


def contains(target: Graph, query: Graph) -> bool:
    """``query`` is a subgraph: atoms by element, charge and isotope, bonds by order; hydrogens are free.

    Backtracking over the query's atoms, rare ones first and each next to one already placed; exact,
    without a bound on the steps.
    """
    if len(query.atoms) > len(target.atoms) or len(query.bonds) > len(target.bonds):
        return False
    t_near, q_near = target.neighbours(), query.neighbours()
    kind = lambda a: (a.symbol, a.charge, a.isotope or 0)
    of_kind: dict[tuple, list[int]] = {}
    for a in target.atoms:
        of_kind.setdefault(kind(a), []).append(a.n)
    q_kind = {a.n: kind(a) for a in query.atoms}
    if Counter(q_kind.values()) - Counter({k: len(v) for k, v in of_kind.items()}):
        return False
    t_kind = {n: k for k, v in of_kind.items() for n in v}
    order: list[int] = []
    while len(order) < len(q_kind):
        beside = [n for n in q_kind if n not in order and any(m in order for m in q_near[n])]
        order.append(min(beside or [n for n in q_kind if n not in order], key=lambda n: (len(of_kind[q_kind[n]]), -len(q_near[n]))))
    placed: dict[int, int] = {}
    taken: set[int] = set()
    choices = [iter(of_kind[q_kind[order[0]]])] if order else []
    if not order:
        return True
    while choices:
        n = order[len(choices) - 1]
        if n in placed:
            taken.discard(placed.pop(n))
        for m in choices[-1]:
            if m in taken or t_kind[m] != q_kind[n] or len(t_near[m]) < len(q_near[n]):
                continue
            if all(t_near[m].get(placed[k]) == o for k, o in q_near[n].items() if k in placed):
                placed[n] = m
                taken.add(m)
                break
        else:
            choices.pop()
            continue
        if len(choices) == len(order):
            return True
        after = order[len(choices)]
        beside = next((placed[k] for k in q_near[after] if k in placed), None)
        choices.append(iter(t_near[beside] if beside is not None else of_kind[q_kind[after]]))
    return False


def united(graphs: list[Graph]) -> Graph:
    """Union of graphs whose atom numbers are disjoint; else the later ones are renumbered."""
    atoms: list[Atom] = []
    bonds: list[tuple] = []
    used: set[int] = set()
    for g in graphs:
        shift = max(used, default=0) if used & {a.n for a in g.atoms} else 0
        atoms += [a._replace(n=a.n + shift) for a in g.atoms]
        bonds += [(a + shift, b + shift, *o) for a, b, *o in g.bonds]
        used |= {a.n + shift for a in g.atoms}
    return Graph(tuple(atoms), tuple(bonds))


def renumbered(g: Graph, mapping: dict[int, int]) -> Graph:
    name = lambda n: mapping.get(n, n)
    return Graph(tuple(a._replace(n=name(a.n)) for a in g.atoms), tuple((name(a), name(b), *o) for a, b, *o in g.bonds))


def condensed(before: Graph, after: Graph) -> Graph | None:
    """Both sides laid over each other by atom number; None if they share no atom or an element changes."""
    left, right = ({a.n: a for a in g.atoms} for g in (before, after))
    shared = set(left) & set(right)
    if not shared or any(left[n].symbol != right[n].symbol for n in shared):
        return None
    one, two = ({(min(a, b), max(a, b)): o for a, b, o in g.bonds} for g in (before, after))
    bonds = tuple((a, b, one.get((a, b), 0), two.get((a, b), 0)) for a, b in sorted({*one, *two}))
    return Graph(tuple(right.get(n) or left[n] for n in sorted({*left, *right})), bonds)


def condensed_key(before: Graph, after: Graph) -> str | None:
    """Text that two reactions share if their condensed graphs are equal; None if the sides can't be laid over each other.

    Atoms count by element, isotope and the charges of both sides, as hydrogens and aromatic marks follow from bonds. The
    components' texts are sorted, so equal components don't have to be told apart.
    """
    cgr = condensed(before, after)
    if cgr is None:
        return None
    left, right = ({a.n: a for a in g.atoms} for g in (before, after))
    charge = {n: (left.get(n, a).charge, a.charge) for n, a in ((a.n, right.get(a.n, a)) for a in cgr.atoms)}
    atoms = tuple(Atom(a.n, a.symbol if len({*charge[a.n]}) == 1 else f"{a.symbol}{charge[a.n][0]:+d}>", a.isotope, a.charge, False, None) for a in cgr.atoms)
    return ".".join(sorted(canonical_smiles(c)[0] for c in components(Graph(atoms, cgr.bonds))))


def centre_graph(cgr: Graph | None) -> Graph | None:
    """The subgraph of atoms at changed bonds, with these bonds; None without any."""
    changed = {n for a, b, x, y in cgr.bonds if x != y for n in (a, b)} if cgr else set()
    if not changed:
        return None
    atoms = tuple(a._replace(h=None, charge=0) for a in cgr.atoms if a.n in changed)
    return Graph(atoms, tuple(b for b in cgr.bonds if b[2] != b[3]))


def centre(cgr: Graph | None) -> str | None:
    """Canonical text of the reaction centre; None without any."""
    g = centre_graph(cgr)
    return canonical_smiles(g)[0] if g else None


def apart(graphs: list[Graph]) -> list[Graph]:
    """Graphs of one side with atom numbers of their own: mapped atoms keep theirs, others and repeated ones are numbered from 10^5 on."""
    used: set[int] = set()
    free, out = 10**5, []
    for g in graphs:
        name = {}
        for a in g.atoms:
            if a.n in g.mapped and a.n not in used:
                name[a.n] = a.n
            else:
                free += 1
                name[a.n] = free
            used.add(name[a.n])
        out.append(renumbered(g, name))
    return out


def read_reaction(text: str) -> tuple[list[Graph], list[Graph]]:
    """Reactants and products of ``a.b>agents>c``; every dot-separated part must be one connected graph."""
    sides = text.split(">")
    if len(sides) != 3:
        raise GraphError("a reaction has two arrows")
    read = tuple([read_smiles(part) for part in side.split(".") if part] for side in (sides[0], sides[2]))
    if any(len(components(g)) > 1 for side in read for g in side):
        raise GraphError("a part of a reaction isn't connected")
    return read
