import random

import pytest

from tessella.llm.components import connected_components
from tessella.llm.common import Workspace
from tessella.llm import neardup
from tessella.llm.neardup import least_matches, near_duplicates, shingle_set, without_near_duplicates

SCHEMA = "doc_id long, text string, lang string, label long, n long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 1, "k") for i, t in rows], SCHEMA)


def brute(rows):
    """Components by all pairs, on word tuples."""
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}


def test_matches_all_pairs(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [[r.choice(words) for _ in range(r.choice((3, 8, 60, 150)))] for _ in range(40)]
    rows = []
    for k in range(240):
        text = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 4, 9, 20))):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((k, " ".join(text)))
    assert result(frame(spark, rows)) == brute(rows)


def test_chain_of_near_copies_and_a_hot_group(spark):
    """Links go along a chain although its ends aren't alike; a group of edits of one text stays exact."""
    r = random.Random(9)
    words = [f"v{k}" for k in range(1000)]
    text = [r.choice(words) for _ in range(200)]
    rows = []
    for k in range(30):
        text = list(text)
        text[k * 6] = f"step{k}"
        rows.append((k, " ".join(text)))
    core = [r.choice(words) for _ in range(120)]
    for k in range(30, 130):
        edited = list(core)
        for at in r.sample(range(120), r.choice((1, 2, 3, 4, 5, 6, 8))):
            edited[at] = f"e{r.randrange(40)}"
        rows.append((k, " ".join(edited)))
    assert result(frame(spark, rows)) == brute(rows)


def test_defined_cases(spark):
    long_text = " ".join(f"word{k % 977}x{k % 13}" for k in range(60_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (1, "A b c"), (3, "a B c"), (4, "a b d"), (10, long_text), (11, long_text + " tail"), (-2, "ä ö ü ß é"), (-1, "ä ö ü ß é")]
    assert result(frame(spark, rows)) == brute(rows)
    got = near_duplicates(frame(spark, [(None, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six")])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (2, 2, True), (2, 2, True)]
    assert near_duplicates(frame(spark, [])).count() == 0
    assert near_duplicates(frame(spark, [])).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def by_rows(rows):
    """(id, text) rows that stay, by all pairs of rows, whatever their ids."""
    numbered = [(n, t) for n, (_, t) in enumerate(rows)]
    groups: dict = {}
    for n, (size, root, _) in brute(numbered).items():
        groups.setdefault(root, []).append(n)
    return sorted((rows[min(g, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))] for g in groups.values()), key=repr)


def some_rows(ids):
    r = random.Random(5)
    words = [f"q{k}" for k in range(200)]
    base = [[r.choice(words) for _ in range(r.choice((2, 30, 60)))] for _ in range(25)]
    rows = []
    for _ in range(150):
        text = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 9))):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((ids(r), r.choice((" ".join(text), " ".join(text), None, ""))))
    return rows + rows[:10]


def test_repeated_and_null_ids_lose_no_row(spark):
    """A row is judged by its own text: another row with its id may be a copy, and equal rows become one."""
    unique, copied = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(3, copied), (7, unique), (7, copied), (9, "t u v w x y"), (9, "t u v w x y"), (None, copied), (None, "only here and nowhere else at all"), (8, None), (8, None)]
    kept = without_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == by_rows(rows)
    rows = some_rows(lambda r: r.choice((None, *range(60))))
    assert sorted(((r.doc_id, r.text) for r in without_near_duplicates(frame(spark, rows)).collect()), key=repr) == by_rows(rows)
    # each row of the operator itself is placed by its own text too, as far as it has an id
    known = [(n, i, t) for n, (i, t) in enumerate(rows) if i is not None]
    place = brute([(n, t) for n, _, t in known])
    least: dict = {}
    for n, i, _ in known:
        least[place[n][1]] = min(i, least.get(place[n][1], i))
    want = [(i, place[n][0], least[place[n][1]], i == least[place[n][1]]) for n, i, _ in known]
    got = [tuple(r) for r in near_duplicates(frame(spark, rows)).collect()]
    assert sorted(g for g in got if g[0] is not None) == sorted(want) and sum(g[0] is None for g in got) == sum(i is None for i, _ in rows)


def test_ids_of_other_types(spark):
    rows = some_rows(lambda r, k=iter(range(1_000)): next(k))[:150]
    names = spark.createDataFrame([(f"n{i:03d}", t) for i, t in rows], "doc_id string, text string")
    want = {f"n{i:03d}": (s, f"n{c:03d}", k) for i, (s, c, k) in brute(rows).items()}
    assert {r.doc_id: tuple(r)[1:] for r in near_duplicates(names).collect()} == want
    assert {r.doc_id for r in without_near_duplicates(names).collect()} == {i for i, w in want.items() if w[2]}
    small = spark.createDataFrame(rows, "doc_id int, text string")
    assert near_duplicates(small).schema["component_id"].dataType.simpleString() == "int" and result(small) == brute(rows)


def test_crowded_shingles_are_dealt_out(spark, monkeypatch):
    """One passage in most documents, around it what makes some of them near copies that share no head."""
    monkeypatch.setattr(neardup, "CROWD", 7)
    r = random.Random(6)
    words, passage = [f"p{k}" for k in range(3_000)], " ".join(f"shared{k}" for k in range(40))
    base = [[r.choice(words) for _ in range(r.choice((10, 14, 20, 40)))] for _ in range(40)]
    rows = []
    for k in range(260):
        text = list(r.choice(base))
        for _ in range(r.choice((0, 1, 2, 3))):
            text[r.randrange(len(text))] = r.choice(words)
        at = r.randrange(len(text))
        rows.append((k, " ".join([*text[:at], passage, *text[at:]])))
    assert result(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1), (1, 2), (2, 3)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)] + [(99, k) for k in range(1, 5)]])
def test_components(spark, edges):
    ws = Workspace(spark, "test")
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long"), ws, "c").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_shingles_and_limits():
    assert len(shingle_set(b"a b c d")) == 1 and len(shingle_set(b"")) == 0 and len(shingle_set(None)) == 0
    assert len(shingle_set(b"a b c d e f")) == 2 and len(shingle_set(b"a a a a a a a a")) == 1
    limits = least_matches(0.75)
    assert [n for n, _ in limits] == [32, 64, 128, 200] and all(m < 0.75 * n for n, m in limits)
