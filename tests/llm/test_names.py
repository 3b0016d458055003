import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import names

FIRMS = [
    ["Vixgepjin Pharma Holdings AG", "VIXGEPJIN PHARMA HLDGS AG", "Vixgepjin P.H. AG", "VIXGEPJNI PHARM HLDG AG -OLD", "vixgepjin pharma", "The Vixgepjin Pharma Holdings Company", "Víxgepjin Pharma Holdings A.G.", "Vixgepjin Pharma Holdings AG (NQX: VIX)"],
    ["Vixgepjin Dairy Ltd.", "VixgepjinDairy Limited", "Dairy Vixgepjin Ltd.", "VIXGEPJIN DAIYR LTD-ADR", "Vixgepjin-Dairy Ltd. f/k/a Oldname Partners"],
    ["Robert Vusjivyit & Sons Robotics S.A.", "BOB VUSJIVYIT & SONS ROBOTICS", "R. Vusjivyit and Sons Robotics SA", "Vusjivyit, Robert & Sons Robotics S.A.", "ROBERT VUSJIVYIT SONS ROBOTI", "VusjivyitRobotics S.A."],
    ["Zelda Vusjivyit & Sons Timber Corp."],
    ["Gizrardes Refining Plc", "GIZRARDES  REFINING PLC (DE)"],
    ["Gizrazdel Refining Holdings Plc"],
    ["Orrinvale Combined Utilities, Inc.", "ORRINVALE COMBINED UTIL INC"],
]


def osa(a, b):
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, most):
    assert names.distance(a, b, most) == min(osa(a, b), most + 1)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=3, max_size=12), st.lists(st.tuples(st.sampled_from("idr"), st.integers(0, 12), st.sampled_from("abcd")), max_size=2))
def test_pigeonhole_finds_every_pair(a, edits):
    b = a
    for kind, at, ch in edits:
        at = min(at, len(b))
        b = b[:at] + ch + b[at:] if kind == "i" else b[:at] + b[at + 1 :] if kind == "d" else b[:at] + ch + b[at + 1 :]
    if b:
        longer, shorter = sorted((a, b), key=len, reverse=True)
        assert set(names._index_keys(shorter, 2)) & set(names._probe_keys(longer, 2))


PAIRS = [("Enron Corp", "Enrom Corporation"), ("Apple Inc", "Aple Inc"), ("Microsoft Corp", "Micorsoft Corp"), ("Luby's Inc", "Lubbys Inc"), ("Robert Smith", "Bob Smith"), ("Smith, Robert", "Smith Robert"), ("Jonathon Doe", "Jonathan Doe"), ("General Motors", "Genral Motors"), ("Kestrel Lanterns Inc", "Kestrel Lanterms")]


def test_names_outside_the_vocabulary_and_of_persons(spark):
    named = names.organisations(spark.createDataFrame([(n,) for p in PAIRS for n in p], "name string"))
    org = {r.name: r.org for r in named.collect()}
    assert all(org[a] == org[b] for a, b in PAIRS) and org["Smith, Robert"] == org["Bob Smith"]
    assert len(set(org.values())) == len(PAIRS) - 1


def generated(firms, seed):
    """``{spelling: firm}`` of firms whose lines of business stand in no list."""
    rng = random.Random(seed)
    syllables = ["dra", "vek", "mol", "tun", "sil", "gor", "pax", "ren", "bul", "hef", "cor", "yam"]
    lines = ["lanterns", "sprockets", "saddlery", "ballast", "orchards", "gaskets", "umbrellas", "kites"]
    out = {}
    roots = set()
    while len(roots) < firms:
        roots.add("".join(rng.sample(syllables, 3)).title())
    for n, root in enumerate(sorted(roots)):
        for line in rng.sample(lines, 2):  # two firms of one founding name
            legal = rng.choice(["Inc", "Corp", "Ltd"])
            firm = (root, line)
            slip = lambda w: (k := rng.randrange(1, len(w) - 2)) and w[:k] + w[k + 1] + w[k] + w[k + 2 :]
            for spelled in (f"{root} {line.title()} {legal}", f"{root.upper()} {line.upper()}", f"{slip(root)} {line.title()} {legal}.", f"{root} {slip(line)} {legal}", f"The {root} {line.title()}, {legal} (NQX: ABC)", f"{line.title()} {root} {legal}" if n % 2 else f"{root}-{line.title()} {legal}"):
                out.setdefault(spelled, firm)
    return out


def test_recall_and_precision_on_lines_of_no_list(spark):
    made = generated(60, 4)
    named = names.organisations(spark.createDataFrame([(n,) for n in made], "name string"))
    got = {(r.name_a, r.name_b) for r in names.spelling_pairs(named).collect()}
    want = {(a, b) for a in made for b in made if a < b and made[a] == made[b]}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_learned_lines(spark):
    df = spark.createDataFrame([(n,) for n in generated(60, 4)], "name string")
    assert set(names.learned_lines(df)) - set(names.LINES) == {"lanterns", "sprockets", "saddlery", "ballast", "orchards", "gaskets", "umbrellas", "kites"}


@pytest.mark.parametrize("name,line", [("X Bcast Sys Ag", "broadcasting"), ("Qqq Drlg Labs Inc", "drilling"), ("Qqq Ntwks Mfg", "networks"), ("Qqq Hoes Plc", "homes"), ("Qqq Enregy", "energy"), ("Qqqq Solar", "solar")])
def test_lines(name, line):
    assert names.parse_name(name).line == line


def test_firms(spark):
    rows = [(n, 1) for firm in FIRMS for n in firm] + [(None, 1), ("", 1), ("UNKNOWN", 1), ("  ", 1), (FIRMS[0][0], 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "name string, org int").repartition(3)
    named = names.organisations(df)
    assert named.count() == len({n for n, _ in rows} - {None, "", "UNKNOWN", "  "})
    got = {(r.name_a, r.name_b) for r in names.spelling_pairs(named).collect()}
    assert got == {tuple(sorted(p)) for firm in FIRMS for p in itertools.combinations(firm, 2)}


def test_empty(spark):
    assert names.organisations(spark.createDataFrame([], "name string")).count() == 0


def test_names_without_a_known_line(spark):
    firms = [["Kestrel Holdings Inc", "Kestrel Holdings", "KESTREL HLDGS INC"], ["Kestrel Widgets Inc", "Kestrel Widgets", "KESTERL WIDGETS"], ["Kestrel Gadgets"], ["Pelmoor Ltd", "Pelmoor"], ["Pelmoor Dairy Ltd"]]
    df = spark.createDataFrame([(n,) for firm in firms for n in firm], "name string")
    got = {(r.name_a, r.name_b) for r in names.spelling_pairs(names.organisations(df)).collect()}
    assert got == {tuple(sorted(p)) for firm in firms for p in itertools.combinations(firm, 2)}


def test_exchanges_across_segments_are_candidates():
    assert set(names._index_keys("boktanrod", 2)) & set(names._probe_keys("botkanrxd", 2))
    rng = random.Random(1)
    for _ in range(20_000):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 12)))
        at = rng.randrange(len(a) - 1)
        b = a[:at] + a[at + 1] + a[at] + a[at + 2 :]
        at, ch = rng.randrange(len(b) - 1), rng.choice("abcdefgh")
        b = [b[:at] + ch + b[at:], b[:at] + b[at + 1 :], b[:at] + ch + b[at + 1 :], b[:at] + b[at + 1] + b[at] + b[at + 2 :]][rng.randrange(4)]
        if names.distance(a, b, 2) <= 2:
            longer, shorter = sorted((a, b), key=len, reverse=True)
            assert set(names._index_keys(shorter, 2)) & set(names._probe_keys(longer, 2)), (a, b)
