"""The row loader against a hand-written character-by-character reader."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitsieve.operators.bad_rows import SMI_LINE, parse_rows

ATOMS = sorted("Cl Br B C N O P S F I b c n o p s".split(), key=len, reverse=True)
BRACKET = re.compile(r"\[\d{0,3}(H|B|C|N|O|F|Si|P|S|Cl|Se|Br|I|Li|Na|K|Mg|Ca|Zn|Fe|Cu|Pd|Pt|b|c|n|o|p|s|se)@?@?(H\d?)?(\+\+|--|[+-]\d?)?(:\d+)?\]", re.A)


def smiles_ok(s):
    i, prev, before_bond, depth, atom, open_rings = 0, "", "", 0, 0, {}
    while i < len(s):
        c = s[i]
        if c == "[":
            m = BRACKET.match(s, i)
            if not m:
                return False
            i, prev, atom = m.end(), "atom", atom + 1
            continue
        a = next((a for a in ATOMS if s.startswith(a, i)), None)
        if a:
            i, prev, atom = i + len(a), "atom", atom + 1
            continue
        if c in "0123456789%":
            if c == "%":
                label = s[i + 1 : i + 3]
                if not re.fullmatch("[0-9]{2}", label):
                    return False
                i += 3
            else:
                label = c
                i += 1
            if not (prev in ("atom", "ring") or prev == "bond" and before_bond in ("atom", "ring")):
                return False
            n = int(label)
            if n in open_rings:
                if open_rings.pop(n) == atom:
                    return False
            else:
                open_rings[n] = atom
            prev = "ring"
            continue
        if c in "-=#:/\\":
            if prev not in ("atom", "ring", "(", ")"):
                return False
            before_bond, prev = prev, "bond"
        elif c == "(":
            if prev not in ("atom", "ring", ")"):
                return False
            prev, depth = "(", depth + 1
        elif c == ")":
            if prev not in ("atom", "ring", ")") or depth == 0:
                return False
            prev, depth = ")", depth - 1
        elif c == ".":
            if prev not in ("atom", "ring", ")") or depth:
                return False
            prev = "."
        else:
            return False
        i += 1
        if prev == "bond" and i == len(s):
            return False
    return bool(s) and s[0] not in "-=#:/\\().%0123456789" and prev in ("atom", "ring", ")") and not open_rings and depth == 0


def unquoted(f):
    if '"' in f:
        if len(f) >= 2 and f[0] == f[-1] == '"' and f.count('"') == 2:
            return f[1:-1]
        return None
    return f


def expected(raw):
    line = (raw or "").strip(" \t\r\n")
    if not line:
        return "empty"
    fields = line.split(" ")
    cx = len(fields) > 1 and fields[1].startswith("|")
    if "" in fields or len(fields) > 2 + cx:
        return "columns"
    others = [f for i, f in enumerate(fields) if not (cx and i == 1)]
    if cx and (not fields[1].endswith("|") or fields[1].count("|") != 2):
        return "quoting"
    if any("|" in f or unquoted(f) is None for f in others):
        return "quoting"
    smi, idx = unquoted(others[0]), unquoted(others[1]) if len(others) > 1 else None
    if idx is not None and not re.fullmatch(r"[A-Za-z0-9_.:-]{1,40}", idx):
        return "idx"
    return None if smiles_ok(smi) else "smiles"


LINES = [
    None, "", " \t\r\n", "CCO", " CCO\tx", "CCO  x", "CCO a b", "CCO |a| b", "CCO |a| b c", "CCO |a", "CCO |", "CCO ||", "CCO |a|b| x", "CCO |a b| x",
    "|x| CCO", '"CCO" x', '"CCO x', '"CC"O" x', '"" x', 'CCO ""', 'CCO "x"', "CCO x|", "CCO x,y", "CCO " + "x" * 40, "CCO " + "x" * 41, "C1CC1", "C1CC",
    "C11", "C1C1", "C12C1C2", "C%12CC%12", "C%1C", "C%12CC%1", "C=1CC=1", "C1CC%01", "C(=1CC1)", "C(1)C1", "C(C)1CC1", "(C)C", "C(C", "C)C", "C((C))", "C()C", "C(C).O",
    "C(C.O)", "C..O", ".C", "C.", "C=", "=C", "C==C", "C(=C)C", "C(C)(C)C", "C(C=)C", "[NH4+]", "[Na+].[Cl-]", "[13CH3:1]C", "[C@@H](N)C", "[Xx]", "[C@@@]", "[C++]", "[C+++]",
    "[C--2]", "[]", "[", "C]", "[CH12]", "[se]1cccc1", "c1ccccc1", "C" * 30000, "(" * 5000, "C(" * 3000 + "C" + ")" * 3000, "CC\nO", "CCO\x0bx", "C١", "CCO xé", "C1C11CC1",
    "C1CC1C1CC1", "C/C=C\\C", "C.1C", "CCO \t x", "H", "[H][H]", "[CH]", "[HH]", "[2H+]", "Clc1ccccc1Br", "CCO x", "[C:12]", "[C:]", "[0123C]",
]


def run(spark, lines):
    df = spark.createDataFrame([(1, i, t, "x") for i, t in enumerate(lines)], "file_no int, line_no long, raw string, reason string")
    return {r.line_no: r for r in parse_rows(df, "raw", SMI_LINE, ["file_no", "line_no"], "line_no").collect()}


def test_hand_made_lines(spark):
    got = run(spark, LINES)
    assert {t: got[i].reason for i, t in enumerate(LINES)} == {t: expected(t) for t in LINES}
    assert (got[3].smi, got[3].idx, got[3].extension) == ("CCO", "3", None)
    assert (got[7].smi, got[7].extension, got[7].idx) == ("CCO", "|a|", "b")
    assert all(r.smi is None and r.idx is None for r in got.values() if r.reason)


def test_empty_table(spark):
    assert run(spark, []) == {}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="CcN1%2()[]=.|\" Hx+", max_size=12), min_size=60, max_size=60))
def test_random_lines(spark, lines):
    got = run(spark, lines)
    assert [(t, got[i].reason) for i, t in enumerate(lines)] == [(t, expected(t)) for t in lines]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_given_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/upload_smi.parquet")
    got = {(r.file_no, r.line_no): r.reason for r in parse_rows(df, "raw", SMI_LINE, ["file_no", "line_no"], "line_no").collect()}
    want = {(r.file_no, r.line_no): expected(r.raw) for r in df.collect()}
    assert got == want
