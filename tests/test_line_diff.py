"""Edit scripts against a full table of distances, hunks, and provenance along chains."""

import random

import pytest

from lexstrata.operators import line_diff
from lexstrata.operators.line_diff import aligned


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("traced", [1 << 25, 16, 0])
def test_alignments_are_longest(monkeypatch, traced):
    monkeypatch.setattr(line_diff, "TRACED_BITS", traced)
    rng = random.Random(traced)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_long_versions_align_quickly():
    rng = random.Random(1)
    a = [rng.randrange(5000) for _ in range(20_000)]
    b = a[:5000] + a[9000:] + [rng.randrange(5000) for _ in range(3000)]
    assert len(aligned(a, b)) >= 16_000


TEXTS = [("one\ntwo\nthree", "one\n2\nthree\nfour"), ("a\nb\nc\na\nb\nb\na", "c\nb\na\nb\na\nc"), ("", None), (None, "x\n"), ("same\nsame", "same"), ("", "\n"), ("k", "k"), ("x", "y")]


def frames(spark, pairs):
    rows = lambda side: spark.createDataFrame([(i, p[side], "c") for i, p in enumerate(pairs) if p[side] is not None] + [(None, "zz", "c")], "k long, t string, line string")
    return rows(0), rows(1)


def test_scripts_give_both_texts_and_are_shortest(spark):
    rng = random.Random(3)
    many = [tuple("\n".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 9))) for _ in range(2)) for _ in range(60)]
    pairs = TEXTS + many
    script = line_diff.edit_script(*frames(spark, pairs), "k", "t")
    rows = script.collect()
    assert {r.k for r in rows} == {i for i, (a, b) in enumerate(pairs) if a != b}
    for k in {r.k for r in rows}:
        a, b = pairs[k]
        own = sorted((r for r in rows if r.k == k), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        for sides, no, text in (("=-", "old_no", a), ("=+", "new_no", b)):
            part = [r for r in own if r.op in sides]
            assert [r.line for r in part] == ([] if text is None else text.split("\n")) and [r[no] for r in part] == list(range(1, len(part) + 1))
        if a is not None and b is not None:
            assert sum(r.op == "=" for r in own) == longest(a.split("\n"), b.split("\n"))
    back = {r.k: (r.old, r.new) for r in line_diff.replayed(script, "k").collect()}
    assert back == {i: p for i, p in enumerate(pairs) if p[0] != p[1]}


def test_removed_lines_stand_before_added_ones(spark):
    rows = line_diff.edit_script(*frames(spark, TEXTS[:1]), "k", "t").orderBy("place").collect()
    assert [(r.op, r.old_no, r.new_no, r.line) for r in rows] == [("=", 1, 1, "one"), ("-", 2, None, "two"), ("+", None, 2, "2"), ("=", 3, 3, "three"), ("+", None, 4, "four")]


def test_hunks(spark):
    old = "\n".join(str(i) for i in range(1, 21))
    new = old.replace("2\n3", "2\nx\n3", 1).replace("\n9\n", "\n").replace("20", "y")
    pairs = [(old, new), (None, "a\nb"), ("a", None)]
    got = {(r.k, r.hunk): (r.header, r.body) for r in line_diff.hunks(line_diff.edit_script(*frames(spark, pairs), "k", "t"), "k").collect()}
    assert got[0, 1] == ("@@ -1,12 +1,12 @@", " 1\n 2\n+x\n 3\n 4\n 5\n 6\n 7\n 8\n-9\n 10\n 11\n 12")
    assert got[0, 2] == ("@@ -17,4 +17,4 @@", " 17\n 18\n 19\n-20\n+y")
    assert got[1, 1] == ("@@ -0,0 +1,2 @@", "+a\n+b") and got[2, 1] == ("@@ -1 +0,0 @@", "-a") and len(got) == 4
    narrow = {r.header for r in line_diff.hunks(line_diff.edit_script(*frames(spark, pairs[:1]), "k", "t"), "k", context=0).collect()}
    assert narrow == {"@@ -2,0 +3 @@", "@@ -9 +9,0 @@", "@@ -20 +20 @@"}


def test_hunks_turn_old_into_new(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(30):
        a = [str(rng.randrange(6)) for _ in range(40)]
        b = list(a)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(3)] = [str(rng.randrange(9)) for _ in range(rng.randrange(3))]
        pairs.append(("\n".join(a), "\n".join(b)))
    got = {}
    for r in line_diff.hunks(line_diff.edit_script(*frames(spark, pairs), "k", "t"), "k").collect():
        got.setdefault(r.k, []).append(r)
    for k, (a, b) in enumerate(pairs):
        lines, shift = a.split("\n"), 0
        for h in sorted(got.get(k, []), key=lambda r: r.hunk):
            start, _, n = h.header.split(" ")[1][1:].partition(",")
            n = int(n) if n else 1
            at = int(start) - (1 if n else 0) + shift
            body = h.body.split("\n")
            assert lines[at : at + n] == [x[1:] for x in body if x[0] != "+"]
            fresh = [x[1:] for x in body if x[0] != "-"]
            lines[at : at + n] = fresh
            shift += len(fresh) - n
        assert "\n".join(lines) == b


def test_provenance_of_moves_and_reverts(spark):
    chain = ["a\nb\nc", "a\nc", "c\na\nd", "a\nb\nc", "a\nb\nc"]
    rows = [(1, v, t) for v, t in enumerate(chain, 1)] + [(2, 5, "x\ny"), (2, 9, None), (2, 11, "y"), (3, 1, ""), (None, 1, "z"), (4, 1, "a"), (4, 2, None)]
    got = line_diff.provenance(spark.createDataFrame(rows, "k long, v int, t string"), "k", "t", "v").collect()
    found = {k: [(r.origin, r.line) for r in sorted(got, key=lambda r: r.line_no) if r.k == k] for k in {r.k for r in got}}
    assert found[2] == [(11, "y")] and found[3] == [(1, "")] and set(found) == {1, 2, 3}
    assert [x[1] for x in found[1]] == ["a", "b", "c"] and found[1][1][0] == 4 and sorted(x[0] for x in found[1]) in ([1, 4, 4], [3, 4, 4])


def test_provenance_against_a_fold_by_hand(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for k in range(25):
        text, origins = [], []
        for v in range(1, rng.randrange(2, 8)):
            new = [x for x in text if rng.random() < 0.8]
            if rng.random() < 0.4:
                new = new[len(new) // 2 :] + new[: len(new) // 2]
            for _ in range(rng.randrange(4)):
                new.insert(rng.randrange(len(new) + 1), str(rng.randrange(12)))
            if rng.random() < 0.2 and rows and rows[-1][0] == k:
                new = rows[-1][2].split("\n")
            new = new or ["e"]
            kept = dict((j, i) for i, j in aligned([hash(x) for x in text], [hash(x) for x in new]))
            assert len(kept) == longest(text, new)
            origins = [origins[kept[j]] if j in kept else v for j in range(len(new))]
            text = new
            rows.append((k, v, "\n".join(new)))
        expected[k] = list(zip(origins, text))
    rng.shuffle(rows)
    got = line_diff.provenance(spark.createDataFrame(rows, "k long, v int, t string"), "k", "t", "v").collect()
    assert {k: [(r.origin, r.line) for r in sorted((r for r in got if r.k == k), key=lambda r: r.line_no)] for k in expected} == expected
