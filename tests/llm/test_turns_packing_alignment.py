"""Conversation repair, packing and alignment against plain versions."""

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import alignment, packing, turns

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
CONVERSATIONS = "conv_id long, turn long, role string, text string"

# -- conversation repair ----------------------------------------------------------------------------


def plain_repair(rows):
    """Every edit of every row by exhaustion over states, whole audits and texts kept."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, counts = set(), [], Counter()
    for _, role, text in rows:
        s = text.strip(" \t\n\v\f\r")
        fault = "blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for (q, cost), (audit, said) in list(out.items()):
                for c in "ua":
                    if (q, c) in step:
                        new = audit + "I", [*said, f"{names[c]}:"]
                        at = step[q, c], cost + 2
                        if at not in out or new[0] < out[at][0]:
                            out[at] = new
        return out

    states = {("", 0): ("", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(q, cost, audit, said, new=new):
            if (q, cost) not in new or audit < new[q, cost][0]:
                new[q, cost] = audit, said

        for (q, cost), (audit, said) in inserted(states).items():
            offer(q, cost + 3, audit + "D", said)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role and (q, role[0]) in step:
                    offer(step[q, role[0]], cost + more, audit + "K", [*said, f"{role}:{text}"])
                for c in "ua":
                    if (q, c) in step:
                        offer(step[q, c], cost + 2 + more, audit + "R", [*said, f"{names[c]}:{text}"])
        low = min(c for _, c in new)
        states = {k: v for k, v in new.items() if k[1] <= low + 12}
    (cost, audit), said = min(((c, a), s) for (q, c), (a, s) in inserted(states).items() if q in ("", "a"))
    turns_ = [t for t, _, _ in rows if t is not None]
    gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), said


def talk(rnd, n):
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why? ", "One. Two", "Yes."]
    return [(rnd.choice([None, *range(n)]) if rnd.random() < 0.1 else i, rnd.choices(["user", "assistant", "system", "tool", "", "usher"], [8, 8, 3, 1, 1, 1])[0], rnd.choice(texts) if rnd.random() < 0.6 else f"Turn {rnd.randrange(99)}.") for i in range(n)]


def test_repair_is_that_of_exhaustion(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT", 5)
    monkeypatch.setattr(turns, "BATCH_TURNS", 23)
    rnd = random.Random(11)
    talks = {i: talk(rnd, rnd.choice([1, 2, 3, 5, 8, 13, 40])) for i in range(70)}
    rows = [(i, *t) for i, x in talks.items() for t in x]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("cost", F.lit("x")).withColumn("first", F.lit(1))
    # the sizes of batches are those of the workers: run the same stream here too
    found = {r[0]: tuple(r)[1:] for r in turns.repair(df).collect()}
    want = {i: plain_repair(x) for i, x in talks.items()}
    assert found == {i: x[:-1] for i, x in want.items()}
    after = defaultdict(list)
    for r in turns.repaired_turns(df).orderBy("conv_id", "place").collect():
        after[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {i: x[-1] for i, x in want.items() if x[-1]} == dict(after)


@pytest.mark.parametrize(("segment", "batch"), [(1, 3), (3, 7), (5, 1000), (64, 8192)])
def test_cuts_of_long_conversations_change_nothing(monkeypatch, segment, batch):
    import pyarrow as pa

    monkeypatch.setattr(turns, "SEGMENT", segment)
    monkeypatch.setattr(turns, "BATCH_TURNS", batch)
    rnd = random.Random(segment)
    talks = {i: talk(rnd, n) for i, n in enumerate([120, 1, 30, 2, 64, 65])}
    columns = [[], [], [], [], [], []]
    for i, x in talks.items():
        seen = set()
        for t, role, text in sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            for c, v in zip(columns, (i, True, t, role, text, (role, text) not in seen), strict=True):
                c.append(v)
            seen.add((role, text))
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    table = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list("abcdef"))
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("sha", pa.string())])
    found = {r["conv_id"]: tuple(r.values())[1:] for b in turns._repair(schema)([table.slice(0, 77), table.slice(77)]) for r in b.to_pylist()}
    assert found == {i: plain_repair(x)[:-1] for i, x in talks.items()}


def test_repair_of_odd_tables(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (3, 1, "user", "a."), (3, 1, "user", "a."), (3, 1, "assistant", "b."), (4, None, "user", "x" * 300_000 + "."), (4, None, "assistant", "y.")]
    found = {r["conv_id"]: r for r in turns.repair(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert found[None]["audit"] == "DKI" and found[None]["blank"] == 1 and found[None]["gaps"] == 0
    # of one turn, rows come by role: assistant, user, user again
    assert (found[3]["audit"], found[3]["duplicate"], found[3]["cost"]) == ("IKKDI", 1, 7)
    assert found[4]["audit"] == "IKKI"  # of null turns too
    assert turns.repair(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    gone = turns.repair(spark.createDataFrame([(5, 1, "user", "a.", False)], CONVERSATIONS + ", present boolean")).first()
    assert tuple(gone) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in ((None, None, None), (0, "user", "A. b? c!"), (1, "assistant", "d."))]
    want = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = ("user" if fault == 4 else r or " "), ("" if fault == 1 else (x or " ").translate({ord(k): None for k in ".!?"}) if fault == 2 else x or " ")
        want += [(c, t, r, x, fault != 0)] * (2 if fault == 3 else 1)
    got = [tuple(r) for r in turns.damaged(spark.createDataFrame(rows, CONVERSATIONS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# -- packing ----------------------------------------------------------------------------------------


def lengths(kind, rnd):
    return {
        "uniform": [rnd.randint(1, 64) for _ in range(3000)], "thirds": [rnd.randint(17, 24) for _ in range(900)], "small": [rnd.randint(1, 7) for _ in range(500)],
        "one": [9], "none": [], "full": [64] * 50 + [63] * 9 + [1] * 4, "hot": [33] * 700 + [31] * 300 + [rnd.randint(1, 60) for _ in range(50)],
    }[kind]


@pytest.mark.parametrize("kind", ["uniform", "thirds", "small", "one", "none", "full", "hot"])
def test_plans_place_every_piece_once(kind):
    own = lengths(kind, random.Random(4))
    rows, n = packing.plan(dict(Counter(own)), 64)
    held, ranks = defaultdict(list), defaultdict(list)
    for length, first, last, each, sequence, offset in rows.tolist():
        for r in range(first, last):
            ranks[length].append(r)
            held[sequence + (r - first) // each].append((offset + (r - first) % each * length, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(c)) for x, c in Counter(own).items()}
    assert sorted(held) == list(range(n))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    fit = packing._Fit(64)
    for x, c in sorted(Counter(own).items(), reverse=True):
        fit.place(x, 0, c)
    assert -(-sum(own) // 64) <= n <= 1.02 * fit.next + 1


TEXTS = ["", None, "A word. Another, word!", "Ünïcode é é 'tis don't <|endoftext|> İSTANBUL ΣΑΣ", "日本語 テキスト　x\x1cy\x85z\xa0w", "tab\t\r\n\x0b\x0cend $$$ a.b,c...", "😀😀 a😀 ≠ x", "word " * 900, "A word. Another, word!"]


def test_packing_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(i, x, "t") for i, x in enumerate(TEXTS)] + [(3, TEXTS[3], "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    got = packing.pack(df, WORDS, 64).collect()
    want = Counter()
    for i, x, _ in rows:
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 64)):
            own = ids[at : at + 64]
            want[i, p, at, len(own), zlib.crc32(packing.packed(own))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_chunks_are_encoded_like_whole_texts():
    known, rnd = packing._Ids(WORDS), random.Random(1)
    alphabet = [*"aàÉzZ ß'. ,;!?\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​̸́=<>123İΣσ日本😀-_()$", "'s", "n't", "<|endoftext|>", "Word", "  "]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
        chunks = packing._CHUNK.findall(text) if packing._SEPARATORS.search(text) else text.split()
        found = known.look_up(set(chunks))
        assert b"".join(found[x] for x in chunks) == packing.packed(known.tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


# -- alignment --------------------------------------------------------------------------------------

ODD = [*TEXTS, "a", "  two  spaces\n\n x", "▁ under", "<s> <|endoftext|> </s>.", "it's a. b,\nc", "\x00 z", "a\xa0b", "trailing. ", "x.\n", "a .b", "x\r\ny", "ab\n c", "\nFirst. line\nSecond"]


def plain_alignment(pair, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, tokens compared one by one."""
    out, links, total = [], [], Counter()
    for text in texts:
        own, groups = Counter(), []
        a = pair.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        raw = f" {text}".encode()
        if not text or b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            out.append((0, 0, 0, 0, ""))
            links.append(own)
            continue
        spans = []
        for ids, tokens in ((a, pair.a_bytes), (b, pair.b_bytes)):
            ends = list(itertools.accumulate(len(tokens[i]) for i in ids))
            spans.append(list(zip(ids, [0, *ends], ends, strict=False)))
        start = 0
        for end in sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]}):
            groups.append("|".join(",".join(str(i) for i, lo, hi in s if start <= lo and hi <= end) for s in spans))
            start = end
        at = 0
        for i, lo, hi in spans[0]:
            while spans[1][at][2] <= lo:
                at += 1
            k = at
            while k < len(spans[1]) and spans[1][k][1] < hi:
                own[i, spans[1][k][0]] += 1
                k += 1
        out.append((len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
        total += own
    top = defaultdict(int)
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    best = [sum(n for p, n in own.items() if total[p] == top[p[1]]) for own in links]
    return [(*o[:4], x, sum(n * total[p] for p, n in own.items()), o[4]) for o, x, own in zip(out, best, links, strict=True)], total


@pytest.mark.parametrize("docs_in_a_unit", [4096, 3])
def test_alignment_is_that_of_bytes(spark, monkeypatch, docs_in_a_unit):
    monkeypatch.setattr(alignment, "UNIT_DOCS", docs_in_a_unit)
    pair = alignment.Pair(BYTES, PIECES)
    assert pair.cut is not None
    want, total = plain_alignment(pair, ODD)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("count", F.lit(1)).withColumn("links", F.lit("x")).repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, BYTES, PIECES).collect()}
    assert got == dict(enumerate(want))
    assert {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(df, BYTES, PIECES).collect()} == dict(total)
    assert alignment.align(df.limit(0), BYTES, PIECES).count() == 0


def test_pieces_are_encoded_like_whole_texts():
    pair, rnd = alignment.Pair(BYTES, PIECES), random.Random(2)
    alphabet = [*"aàÉzZ ß'. ,;!?\n\t\r\x0b\x1c\x85\xa0​̸=<>12İΣ日😀-_()$▁", "'s", "n't", "<s>", "Word", "  ", ". ", ".\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30)))
        a, b = pair.encode(pair.pieces(f" {text}"))
        assert [i for x in a for i in x] == pair.a.encode(f" {text}", add_special_tokens=False).ids, repr(text)
        assert [i for x in b for i in x] == pair.b.encode(text), repr(text)


def test_components_are_found_along_long_chains():
    import numpy as np

    rnd = random.Random(3)
    n = 5000
    edges = [(i, i + 1) for i in range(n - 1) if i % 997] + [(rnd.randrange(50), rnd.randrange(50)) for _ in range(40)]
    rnd.shuffle(edges)
    u, v = (np.array(x) for x in zip(*edges, strict=True))
    found = alignment.components(u, v, n)
    assert all(found[a] == found[b] for a, b in edges) and all(found[x] <= x and found[found[x]] == found[x] for x in range(n))
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert len(set(found.tolist())) == sum(parent[x] == x for x in range(n))


# -- earlier operators that died or hung ------------------------------------------------------------


def test_tiny_classes_do_not_kill_the_driver():
    from tessella.llm.quality import dictionary

    for n in range(1, 41):
        assert dictionary([b"a"] * n) == b"a" * n
    assert dictionary([]) == b""
    rich = [" ".join(f"w{i * j % 977}" for j in range(300)).encode() for i in range(50)]
    assert dictionary(rich)[:4] == b"\x37\xa4\x30\xec"


def test_schemas_and_patterns_take_linear_time():
    import time

    from tessella.llm.chat import fits

    schema, value = {"properties": {"a": {"anyOf": [{"$ref": "#"}, {"$ref": "#"}]}}}, {}
    for _ in range(40):
        value = {"a": value}
    began = time.perf_counter()
    assert fits(value, schema)
    assert not fits("a" * 60 + "!", {"pattern": "^(a+)+$"}) and fits("a" * 60, {"pattern": "^(a+)+$"})
    assert time.perf_counter() - began < 1
    for pattern in ("(?=a)a", "(a)\\1", "("):
        with pytest.raises(ValueError):
            fits("aa", {"pattern": pattern})
    assert fits("é9", {"pattern": "^[\\u00e0-\\u00ff]\\d$"}) and not fits("ab\n", {"pattern": "b$"})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
def test_conversations_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.execute(turns.ORACLE)
    names = [c[0] for c in want.description]
    got = turns.repair(turns.damaged(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
