"""Small tables, brute force and exact round trips for the training-data operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def make(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with internal ones."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    sources = sources or ["s"] * n
    return spark.createDataFrame([(i, t, None, s, None, 1.0, "x", "y") for i, t, s in zip(ids, texts, sources)], DOCS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies on both sides of the threshold, short, empty, null, long texts."""
    r = random.Random(7)
    texts = []
    for k in range(12):
        base = prose(k, 120).split()
        texts.append(" ".join(base))
        for _ in range(4):
            other = list(base)
            for _ in range(r.randrange(1, 9)):
                other[r.randrange(len(other))] = f"new{r.randrange(99)}"
            texts.append(" ".join(other))
    texts += ["", None, "  \n ", "one two", "One TWO", "a b c d e", "a b c d e", "a b c d f", prose(99, 6000), prose(99, 6000), "tab\tand\x0bline\nbreaks here now"]
    texts += [texts[0]] * 5
    return texts


# exact dedup


def test_exact_dedup_matches_brute_force(spark, corpus):
    from lexstrata.llm.exact_dedup import exact_dedup

    got = {r.doc_id: r for r in exact_dedup(make(spark, corpus), capacity=4, most_depth=6).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(corpus):
        groups[t or ""].append(i)
    assert len(got) == len(corpus)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_tells_colliding_keys_apart(spark):
    from lexstrata.llm.exact_dedup import _keyed, build_index, directory_of, exact_dedup

    weak = lambda text: F.sha2(F.substring(text, 1, 1).cast("binary"), 256)
    docs = make(spark, ["ab", "ac", "ab", "b", "ac", "ab"])
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs, key=weak).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {0: (5, 3, sha("ab")), 1: (4, 2, sha("ac")), 2: (5, 3, sha("ab")), 3: (3, 1, sha("b")), 4: (4, 2, sha("ac")), 5: (5, 3, sha("ab"))}
    directory, depth = directory_of(_keyed(docs, "doc_id", "text", weak).select("key").distinct())
    index = build_index(docs, directory, depth, key=weak)
    assert sorted((r.chain, r.chain_length) for r in index.collect()) == [(1, 1), (1, 2), (2, 2)]


def test_exact_dedup_is_routed_by_its_directory(spark):
    """Many buckets: each holds one key range, at most its capacity, and joins name it."""
    from lexstrata.llm.exact_dedup import _prefix, _keyed, directory_of, exact_dedup, sha256_key

    texts = [f"text {k % 700}" for k in range(1000)]
    docs = make(spark, texts)
    directory, depth = directory_of(_keyed(docs, "doc_id", "text", sha256_key).select("key").distinct(), capacity=16)
    slots = {r.prefix: r.bucket for r in directory.collect()}
    assert sorted(slots) == list(range(2**depth)) and len(set(slots.values())) > 40
    result = exact_dedup(docs, capacity=16)
    rows = result.withColumn("prefix", _prefix(F.col("text_sha256"), depth)).collect()
    sizes = Counter()
    for r in rows:
        assert slots[r.prefix] == r.bucket
    for bucket, _ in {(r.bucket, r.text_sha256) for r in rows}:
        sizes[bucket] += 1
    assert max(sizes.values()) <= 16
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bucket#") > 4 and all("bucket#" in line for line in plan.splitlines() if "Join" in line and "prefix#" not in line)


def test_exact_dedup_edges(spark):
    from lexstrata.llm.exact_dedup import exact_dedup, keep_first_of_copies

    assert exact_dedup(make(spark, [])).count() == 0
    rows = exact_dedup(make(spark, ["a", "a", None, ""], [None, 3, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in rows) == [("3", "3", True), ("None", "3", False), ("None", "None", True), ("None", "None", True)]
    again = keep_first_of_copies(make(spark, ["a", "b", "a", "c", "c", None], [1, 1, 2, None, None, None]))
    assert sorted((str(r.doc_id), r.text) for r in again.filter("text is not null").collect()) == [("1", "b"), ("2", "a"), ("None", "c"), ("None", "c")]
    kept = keep_first_of_copies(make(spark, ["a", "a", "b"]))
    assert kept.columns == make(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_directory_covers_all_prefixes():
    from lexstrata.llm.exact_dedup import grow_directory

    counts = {0: 90, 1: 1, 7: 30}
    buckets = grow_directory(counts, capacity=10, max_depth=3)
    assert [(lo, hi) for _, _, lo, hi in buckets] == [(0, 0), (1, 1), (2, 3), (4, 5), (6, 6), (7, 7)]
    assert grow_directory({}, 10, 4) == [(0, 0, 0, 15)]


# near dedup


def brute_components(texts, percent):
    sets = []
    for t in texts:
        words = WORD.findall(lower(t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_matches_brute_force(spark, corpus, percent):
    from lexstrata.llm.near_dedup import near_components

    sizes, components = brute_components(corpus, percent)
    got = {r.doc_id: r for r in near_components(make(spark, corpus), percent).collect()}
    assert [got[i].n_shingles for i in range(len(corpus))] == sizes
    assert [got[i].component_id for i in range(len(corpus))] == components
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_dedup_chain_through_a_large_group(spark):
    """Neighbours of a chain are linked, its ends are not; the first member links few."""
    from lexstrata.llm.near_dedup import near_components

    base = prose(3, 200).split()
    texts = []
    for k in range(40):
        other = list(base)
        for j in range(k):
            other[5 * j] = f"x{j}"
        texts.append(" ".join(other))
    sizes, components = brute_components(texts, 85)
    got = {r.doc_id: r.component_id for r in near_components(make(spark, texts), 85).collect()}
    assert [got[i] for i in range(40)] == components


def test_near_dedup_blocks_of_a_mixed_bucket(spark, monkeypatch):
    """Edited copies on both sides of the threshold, in buckets that go through blocks."""
    from lexstrata.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    r = random.Random(17)
    base = prose(5, 150).split()
    texts = []
    for k in range(90):
        other = list(base)
        for _ in range(r.randrange(1, 7)):
            other[r.randrange(len(other))] = f"e{k}x{r.randrange(9)}"
        texts.append(" ".join(other))
    _, components = brute_components(texts, 85)
    got = {x.doc_id: x.component_id for x in near_dedup.near_components(make(spark, texts), 85).collect()}
    assert [got[i] for i in range(90)] == components and len(set(components)) > 3


def test_near_dedup_pivot_rounds_of_a_large_bucket(spark, monkeypatch):
    """Several groups share band keys by a common part; rounds of pivots join each group."""
    from lexstrata.llm import near_dedup

    turns = []
    links = near_dedup._pivot_links
    monkeypatch.setattr(near_dedup, "_pivot_links", lambda large, turn, *rest: turns.append(turn) or links(large, turn, *rest))
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 3)
    r = random.Random(23)
    common = prose(6, 160).split()
    texts = []
    for g in range(5):
        own = [f"g{g}x{k}" for k in range(28)]
        for k in range(16):
            other = common + own
            other[r.randrange(len(other))] = f"e{g}x{k}"
            texts.append(" ".join(other))
    r.shuffle(texts)
    _, components = brute_components(texts, 85)
    got = {x.doc_id: x.component_id for x in near_dedup.near_components(make(spark, texts), 85).collect()}
    assert [got[i] for i in range(len(texts))] == components and len(set(components)) == 5 and turns


def test_near_dedup_edges(spark):
    from lexstrata.llm.near_dedup import keep_first_of_group, near_components

    assert near_components(make(spark, [])).count() == 0
    rows = near_components(make(spark, ["a b", "a b", None], [None, 4, 5])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("4", "4", True), ("5", "5", True), ("None", "None", True)]
    assert keep_first_of_group(make(spark, ["a b", "a b", None])).count() == 2


def test_near_dedup_keeps_the_links_of_repeated_ids(spark):
    """Two texts of equal length under one id, each with a near copy of its own."""
    from lexstrata.llm.near_dedup import near_components

    a, b = prose(1, 200), prose(2, 200)
    texts, ids = [a, b, a, b + " more", b, prose(3, 200), a], [1, 1, 2, 3, 1, 4, None]
    docs = make(spark, texts, ids)
    clash = docs.withColumns({c: F.lit("x") for c in ("node", "id", "text_hash", "set_hash", "component", "bucket", "n_shingles", "first_id")})
    for frame in (docs, docs.repartition(5), clash):
        got = [(r.doc_id, r.component_id, r.kept) for r in near_components(frame, 85).collect()]
        assert sorted(got, key=str) == sorted([(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True), (None, None, True)], key=str)


def test_near_dedup_of_very_long_texts(spark):
    from lexstrata.llm.near_dedup import near_components

    long = prose(4, 60_000)
    got = {r.doc_id: r.component_id for r in near_components(make(spark, [long, long + " end", long[: len(long) // 2]]), 85).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_odd_sketch_limit_keeps_pairs_at_the_threshold():
    from lexstrata.llm.near_dedup import SKETCH_WORDS, Signer, bands_for, sketch_limit

    r = np.random.default_rng(5)
    signer = Signer(bands_for(0.85))
    limit = sketch_limit(0.85, signer.samples, 64 * SKETCH_WORDS)
    for _ in range(30):
        x = r.integers(0, 1 << 63, 400, dtype=np.uint64)
        y = np.concatenate([x[:368], r.integers(0, 1 << 63, 32, dtype=np.uint64)])  # Jaccard 368 / 432 = 0.852
        a, b = signer.sign(np.unique(x))[1], signer.sign(np.unique(y))[1]
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= limit
        far = signer.sign(np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64)))[1]
        assert np.bitwise_count((a ^ far).view(np.uint64)).sum() > limit


def test_components_of_paths_and_stars(spark):
    from lexstrata.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100}


# mixing


def flat(own):
    """All units of a level in the order of their slots, those of nested levels in their places."""
    out = [x for p in own.phases for t in range(p.ranges) for x in p.scheduled(t)]
    if own.nested:
        inner = sorted(flat(own.nested), key=lambda x: x[2])
        at = {u: rest for n, u, *rest in out if n == own.group}
        assert sorted(at) == list(range(len(inner)))
        out = [x for x in out if x[0] != own.group] + [(n, u, *at[i]) for i, (n, u, *_) in enumerate(inner)]
    return sorted(out, key=lambda x: x[2])


WEIGHTS = [
    {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 0.9995, "b": 0.0005}, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"a": 7, "b": Fraction(5, 3), "c": 0.21}, {"a": 1234567, "b": 7654321}, {"a": 0.3333333, "b": 0.6666667},
    {"a": math.pi, "b": math.e}, {f"s{i}": 3.0**-i for i in range(9)}, {f"s{i}": 1 for i in range(40)}, {"big": 1, **{f"t{i}": 1e-4 * (1 + i) for i in range(6)}},
]


@pytest.mark.parametrize("weights", WEIGHTS)
@pytest.mark.parametrize("slots", [16, 256, 1 << 16])
def test_units_stay_within_one_block_of_the_target(weights, slots):
    """Exact shares of the weights themselves, slot by slot, until the first source runs out."""
    from lexstrata.llm.mixing import level, whole_weights

    whole = whole_weights(weights)
    exact = {n: Fraction(w, sum(whole.values())) for n, w in whole.items()}
    given = {n: Fraction(w).limit_denominator(10**9) for n, w in weights.items()}
    assert all(abs(exact[n] - w / sum(given.values())) < Fraction(1, 10**8) for n, w in given.items())
    r = random.Random(slots)
    units = {n: r.randrange(1, 1500) for n in weights}
    own = level(whole, units, slots)
    rows, seen, whole_order = flat(own), Counter(), True
    assert len({x[2] for x in rows}) == len(rows) == sum(units.values())
    for i, (name, unit, slot, release, deadline) in enumerate(rows):
        assert release <= slot < deadline and unit == seen[name]
        seen[name] += 1
        whole_order = whole_order and all(seen[n] < units[n] for n in units)
        if whole_order:
            assert slot == i and all(abs(seen[n] - w * (slot + 1)) < 2 * own.depth for n, w in exact.items())
    assert seen == units


def test_shares_of_those_left_follow_their_weights():
    from lexstrata.llm.mixing import level

    own = level({"a": 4, "b": 1, "c": 3}, {"a": 400, "b": 2000, "c": 6000}, 64)
    order = [x[0] for x in flat(own)]
    assert len(own.phases) > 1
    rest = order[len(order) - 1 - order[::-1].index("a") + 200 :]
    for at in range(400, 4000, 100):
        assert abs(rest[:at].count("c") - 0.75 * at) < 4


def test_ranges_are_scheduled_side_by_side():
    """A range comes out alike whatever was scheduled before it."""
    from lexstrata.llm.mixing import level

    own = level({"a": 5, "b": 3, "c": 1}, {"a": 900, "b": 700, "c": 90}, 64)
    phase = own.phases[0]
    late = list(phase.scheduled(phase.ranges - 1))
    assert late == [x for x in flat(own) if (phase.first_range + phase.ranges - 1) * 64 <= x[2] < (phase.first_range + phase.ranges) * 64]


def test_weights_of_any_kind():
    from lexstrata.llm.mixing import MOST_PARTS, exact_weight, whole_weights

    assert [exact_weight(w) for w in (None, 0.0, -1.0, math.nan, math.inf, 0.1, 1 / 3)] == [0, 0, 0, 0, 0, Fraction(1, 10), Fraction(1, 3)]
    assert whole_weights({"a": 0.5, "b": 0.25, "c": None}) == {"a": 2, "b": 1} and whole_weights({"a": 0}) == {}
    many = whole_weights({f"s{i}": Fraction(1, p) for i, p in enumerate(range(10**6 + 1, 10**6 + 60, 2))})
    assert abs(sum(many.values()) - MOST_PARTS) < 100


def test_mixing_of_twenty_thousand_sources(spark):
    from lexstrata.llm.mixing import mix_sources

    r = random.Random(3)
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 20_000).cast("string").alias("source"))
    got = mix_sources(rows, {str(i): r.randrange(1, 10**9) for i in range(20_000)}, block_size=8)
    assert got.count() == 60_000 and got.select("doc_id").distinct().count() == 60_000
    assert got.filter("slot < release or slot >= deadline").count() == 0


def test_mixing_places_every_row_once(spark):
    from lexstrata.llm.mixing import mix_sources, mixed_documents

    r = random.Random(2)
    sources = [r.choice(["a"] * 6 + ["b"] * 3 + [None, "zero", "unknown"]) for _ in range(500)]
    docs = make(spark, ["t"] * 500, sources=sources).withColumns({"slot": F.lit("s"), "place": F.lit(None)})
    weights = {"a": 0.5, "b": 0.25, None: 0.25, "zero": 0.0}
    rows = mix_sources(docs, weights, block_size=4, least_shard=50).collect()
    assert sorted(x.doc_id for x in rows) == list(range(500))
    by_slot = defaultdict(set)
    for x in rows:
        assert x.release <= x.slot < x.deadline and x.block == x.source_row // 4 and x.place == x.source_row % 2
        by_slot[x.slot].add((x.source, x.source_row // 2))
    assert all(len(v) == 1 for v in by_slot.values())
    for name in set(sources):
        assert sorted(x.source_row for x in rows if x.source == name) == list(range(sources.count(name)))
    last = max(x.slot for x in rows if x.source in ("a", "b", None))
    assert min(x.slot for x in rows if x.source in ("zero", "unknown")) > last
    mixed = mixed_documents(docs, weights, block_size=4)
    assert mixed.columns == docs.columns and mixed.count() == 500
    assert mix_sources(make(spark, [])).count() == 0
    twice = mix_sources(make(spark, ["t"] * 3, [None, None, 5], ["a", "a", None]))
    assert sorted((str(x.doc_id), x.source) for x in twice.collect() if x.source) == [("None", "a"), ("None", "a")] and twice.count() == 3


# packing and token output


class PlainTokenizer:
    """The tokenizer file as its own library reads it, without any option."""

    def __init__(self):
        from tokenizers import Tokenizer

        from lexstrata.llm.tokens import default_tokenizer

        self.own = Tokenizer.from_file(default_tokenizer())

    def encode(self, texts):
        return [np.array(self.own.encode(t, add_special_tokens=False).ids, dtype="<u4") for t in texts]


@pytest.fixture(scope="module")
def tokenizer():
    return PlainTokenizer()


def test_ids_are_those_of_the_plain_tokenizer(tokenizer, corpus):
    from lexstrata.llm.tokens import BatchTokenizer, default_tokenizer

    odd = ["", " ", "  a  b\n\n c\t d e \n", "I'm 's  'll　x", "a\x85b​c", "é à́ ñ 12 3.5 !!?", "x" * 300, "日本語 текст"]
    special = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y<|endoftext", "<|endoftext |>", "ｘ<|endoftext|>" * 50]
    texts = odd + special + [t for t in corpus if t]
    expected = [a.tolist() for a in tokenizer.encode(texts)]
    fast, slow = BatchTokenizer(default_tokenizer()), BatchTokenizer(default_tokenizer(), fast=False)
    assert fast.rank_encoder is not None and expected[len(odd)] == [50256]
    assert [a.tolist() for a in fast.encode(texts)] == expected
    assert [a.tolist() for a in slow.encode(texts)] == expected


def test_packed_ids_of_texts_that_hold_special_tokens(spark, tokenizer):
    import zlib

    from lexstrata.llm.packing import pack

    texts = ["one <|endoftext|> two", "<|endoftext|>", "three"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.ids_crc32 for r in pack(docs).collect()}
    assert got == {i: zlib.crc32(np.append(tokenizer.encode([t])[0], np.uint32(2)).astype("<u4").tobytes()) for i, t in enumerate(texts)}


def check_pieces(rows, texts, tokenizer, sequence):
    ids = {i: [*tokenizer.encode([t or ""])[0].tolist(), 2] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r[sequence]].append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(pieces):
            part = np.array(ids[i][at : at + r.length], dtype="<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(part)) and (k == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids[i]) and (len(ids[i]) > 1024 or len(pieces) == 1)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces])
        assert [r.offset for r in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    return sum(map(len, ids.values())), len(by_sequence)


def test_packing_is_gapless_and_close_to_the_bound(spark, corpus, tokenizer):
    from lexstrata.llm.packing import pack

    tokens, n = check_pieces(pack(make(spark, corpus), least_shard=7).collect(), corpus, tokenizer, "sequence_id")
    assert n <= math.ceil(tokens / 1024) + 1
    assert pack(make(spark, [])).count() == 0


def best_fit_decreasing_count(histogram, limit):
    """Sequences of plain best-fit-decreasing, equal pieces and equal rooms together."""
    rooms, n = Counter(), 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = [r for r in rooms if r >= length]
            if fits:
                room = min(fits)
                used = min(left, rooms[room])
                rooms[room] -= used
                rooms += Counter()
            else:
                per = min(left, limit // length)
                used, room = left // per, limit - (per - 1) * length
                n += used
                left -= used * (per - 1)
            rooms[room - length] += used
            left -= used
    return n


@pytest.mark.parametrize("times", [1, 100, 10_000])
@pytest.mark.parametrize("shape", ["flat", "long tail", "large"])
def test_plan_is_no_worse_than_best_fit_decreasing(shape, times):
    """All 1024 lengths occur; the plan uses each piece once and is made in seconds."""
    import time

    from lexstrata.llm.packing import plan_rows, plan_sequences, solve_covering

    r = random.Random(1)
    draw = {"flat": lambda: r.randrange(1, 1025), "long tail": lambda: min(1024, max(1, int(r.lognormvariate(5.3, 1)))), "large": lambda: r.randrange(400, 1025)}[shape]
    histogram = {k: n * times for k, n in Counter(draw() for _ in range(100_000)).items()}
    began = time.time()
    plan = plan_sequences(histogram, 1024)
    assert time.time() - began < 60
    used = Counter()
    for items, x in plan:
        assert sum(k * n for k, n in items.items()) <= 1024
        for k, n in items.items():
            used[k] += n * x
    assert used == histogram
    sequences = sum(x for _, x in plan)
    assert sequences <= best_fit_decreasing_count(histogram, 1024)
    solution, bound = solve_covering(histogram, 1024)
    assert len(solution) <= len(histogram) and bound <= sum(x for _, x in solution) <= sequences
    cover = Counter()
    for items, x in solution:
        for k, n in items.items():
            cover[k] += n * x
    assert all(cover[k] == pytest.approx(n, rel=1e-9) for k, n in histogram.items())
    spans = defaultdict(list)
    for length, lo, hi, *_ in plan_rows(plan):
        spans[length].append((lo, hi))
    for length, parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_covering_raises_the_weight_of_lengths_that_fit_badly():
    """Pieces above half the limit each need a sequence: the volume bound is half of that,
    the weights find the whole."""
    from lexstrata.llm.packing import fill_rest, plan_sequences, solve_covering

    solution, bound = solve_covering({600: 1000, 300: 10}, 1024, phases=40)
    assert sum(x for _, x in solution) == 1000 and bound > 950
    assert sum(n for _, n in plan_sequences({600: 1000, 300: 10}, 1024)) == 1000
    assert plan_sequences({}, 1024) == []
    assert fill_rest({700: 10**12, 300: 10**12}, 1024) == [({700: 1, 300: 1}, 10**12)]


def test_token_output_round_trip(spark, corpus, tokenizer):
    from lexstrata.llm.token_output import token_output

    rows = token_output(make(spark, corpus)).collect()
    check_pieces(rows, corpus, tokenizer, "sequence_id")
    assert all(r.positions_reset for r in rows)
    assert token_output(make(spark, [])).count() == 0


def test_best_fit_takes_the_least_room():
    from lexstrata.llm.token_output import best_fit_decreasing

    r = random.Random(9)
    lengths = [r.randrange(1, 101) for _ in range(400)]
    rooms, expected = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [room for room in rooms if room >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[i])
        else:
            rooms.append(100 - lengths[i])
    got = best_fit_decreasing(lengths, 100)
    assert sorted(x for g in got for x in g) == list(range(400))
    assert sorted(100 - sum(lengths[i] for i in g) for g in got) == sorted(rooms)


def test_token_pieces_of_white_space_need_no_way_back():
    """White space up to the end of a text is one piece, however long; a pattern that backs up over it overflows."""
    from lexstrata.llm import tokens

    encoder = tokens.tokenizer_at(tokens.default_tokenizer())
    text = "a" + " " * 1_100_000
    assert encoder.rank_encoder.decode(encoder.encode([text])[0].tolist()) == text
    plain = tokens.BatchTokenizer(tokens.default_tokenizer(), fast=False)
    texts = ["it's we've I'd  x", " \n\n y", "a  ", "\u3000\u3000b 12\u0663 !?  \t", "'S 'll'll"]
    assert [e.tolist() for e in encoder.encode(texts)] == [e.tolist() for e in plain.encode(texts)]


# quality


def test_quality_base_columns(spark, corpus):
    from lexstrata.llm.quality import quality_rules

    texts = corpus + ["x y\nx y\n\n \nx y", "# $ a|b <c>", "p q r s t u p q r s t u p q r s t", "é ü ß 日本"]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(make(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words)) and not (r.kept and r.base_failed)
    empty = labels.limit(0)
    assert quality_rules(make(spark, []), empty).count() == 0
    assert [r.kept for r in quality_rules(make(spark, [prose(1, 50), None]), empty).orderBy("doc_id").collect()] == [True, False]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_quality_ratio_rejects_bad_texts_at_each_size(spark, size):
    from lexstrata.llm.quality import quality_rules

    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").select("quality", "base_failed", "kept").collect()
    bad = [r.kept for r in judged if r.quality == 0]
    good = [r.kept for r in judged if r.quality == 1 and not r.base_failed]
    assert sum(bad) < 0.05 * len(bad) and sum(good) > 0.97 * len(good)


def test_quality_learns_from_every_trusted_text(spark):
    """One text in 30,000 has words of its own; a sample of the labels would mostly miss it."""
    from lexstrata.llm.quality import exact_quantile, fit_ratio, gram_buckets, raw_words, word_hashes

    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('plain words of a text number ', id % 50, CASE WHEN id % 10000 = 77 THEN ' seldom' ELSE '' END) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality").union(docs.limit(5).selectExpr("doc_id", "1"))
    ratio, threshold = fit_ratio(docs, labels)
    assert abs(ratio[gram_buckets(word_hashes(raw_words("seldom")))[0]]) < 1e-9 and np.isfinite(threshold)
    values = spark.range(2000).selectExpr("CASE WHEN id < 30 THEN -5.0D ELSE pow(id % 997, 3) / 7 END AS r")
    for share in (0.0, 0.01, 0.0157, 0.5, 1.0):
        assert exact_quantile(values, share) == pytest.approx(values.selectExpr(f"percentile(r, {share}D) AS q").first().q, rel=1e-12)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_quality_tells_trusted_texts_without_moving_them(spark, tmp_path, monkeypatch, bits):
    """Work tables hold no trusted texts but the few of doubtful ids, and with bitmaps that are
    nearly full the counts are still those of a join."""
    import os

    from lexstrata.llm import common, quality

    monkeypatch.setattr(common, "FILTER_BITS", bits)
    monkeypatch.setattr(common, "work_path", lambda spark, name: f"{tmp_path}/{name}")
    docs = spark.range(40_000).selectExpr("nullif(id, 7) AS doc_id", "concat('text ', sha2(cast(id % 39000 AS string), 512)) AS text")
    labels = docs.selectExpr("doc_id", "cast(coalesce(doc_id, 0) % 3 = 0 AS int) AS quality").union(spark.sql("SELECT NULL, 1 UNION ALL SELECT -1, 1 UNION ALL SELECT 3, 1"))
    ratio, _ = quality.fit_ratio(docs, labels)
    target, raw = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, text in docs.collect():
        grams = np.bincount(quality.gram_buckets(quality.word_hashes(quality.raw_words(text))), minlength=quality.BUCKETS)
        raw += grams
        target += grams if i is not None and i % 3 == 0 else 0
    assert np.array_equal(ratio, quality.log_ratio(target, raw))
    moved = sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(f"{tmp_path}/trusted") for f in files)
    assert bits < 1 << 20 or moved < 40_000  # the trusted texts alone have 1.8 MB


# toxicity


def test_toxicity_learns_and_leaves_clean_texts(spark):
    from lexstrata.llm.toxicity import score_toxicity

    r = random.Random(11)
    texts, marks = [], []
    for i in range(400):
        words = prose(1000 + i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(["zorg", "blarf", "vexinous" + r.choice("abcd")])
        texts.append(" ".join(words) + ".")
        marks.append((i, 1, int(toxic)))
    texts += ["", None]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = score_toxicity(make(spark, texts), labels).collect()
    assert len(got) == 402
    for row in got:
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3)
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
    held = [(row.predicted, row.doc_id % 5 == 0) for row in got if row.held_out and row.doc_id < 400]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert not any(row.predicted for row in got if row.doc_id >= 400)
    nothing = score_toxicity(make(spark, texts[:3]), labels.limit(0)).collect()
    assert [row.score for row in nothing] == [0.0] * 3


def test_grammar_tells_kinds_apart():
    from lexstrata.llm.transducers import clause_grammar

    g = clause_grammar()
    assert g.run("OIO|") == "OpO|" and g.run("NOI|I|")[2] == "n" and g.run("NOI|I|")[4] == "p"
    assert g.run("ROI|I|")[2] == "q" and g.run("GI|") == "Gg|" and g.run("GT|") == "Gt|" and g.run("T|") == "O|"
    assert g.run("IG|") == "gG|" and g.run("IOOOG|") == "pOOOG|" and g.run("I|G|") == "p|G|" and g.run("TOG|") == "tOG|"
    assert g.run("NTG|") == "NnG|" and g.run("RTG|") == "RqG|"


def brute_features(text, paths, kinds):
    """Every path of every word, and every rule by its definition, word by word."""
    from lexstrata.llm import toxicity as t

    names = t._function_words()
    totals, worst, strongest = dict.fromkeys(kinds, 0.0), 0.0, 0.0
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        read = []
        for w in words:
            accepting = [x for p, x in paths.items() if (w.startswith(p[:-1]) and len(w) > len(p) - 1 if p.endswith("*") else w == p)]
            read.append(("I", max(accepting)) if accepting else (names.get(w, "O"), 2.0))
        total = 0.0
        for i, (symbol, weight) in enumerate(read):
            if symbol not in "IT":
                continue
            near = lambda kind, places: any(0 <= j < len(read) and read[j][0] == kind for j in places)
            aimed = near("G", range(i - 3, i)) or near("G", range(i + 1, i + 4))
            if near("R", range(i)):
                kind = "q"
            elif near("N", range(i - 3, i)):
                kind = "n"
            elif symbol == "I":
                kind = "g" if aimed else "p"
            elif aimed:
                kind = "t"
            else:
                continue
            totals[kind] += weight
            total += weight
            strongest = max(strongest, weight)
        worst = max(worst, total)
    return [1.0, *(math.log1p(totals[k]) for k in kinds), math.log1p(worst), math.log1p(sum(totals.values()) - strongest)]


def test_score_equals_brute_force_over_all_paths():
    from lexstrata.llm.toxicity import KINDS, PRIOR, Scorer

    r = random.Random(13)
    paths = {"zorg": 3.0, "zorg*": 2.5, "zorgen*": 4.0, "blar*": 2.75, "blarf": 2.6, "schlagen": 3.5, "not*": 5.0}
    scorer = Scorer(paths, PRIOR)
    words = "zorg zorgs zorgen zorgend zorgenfrei blar blarf blarfy not nothing you your said kill schlagen töten ü fine day . ! ; \n".split(" ")
    for _ in range(400):
        text = " ".join(r.choice(words) for _ in range(r.randrange(25)))
        expected = brute_features(text, paths, KINDS)
        assert scorer.features(text) == pytest.approx(expected)
        z = sum(a * b for a, b in zip(PRIOR, expected))
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
    assert scorer.score(None) == scorer.score("") == scorer.score("fine day")


@pytest.mark.parametrize("size", ["sf0.1"])
def test_toxicity_on_held_out_labels(spark, size):
    from lexstrata.llm.toxicity import score_toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    judged = score_toxicity(docs, labels).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hits = sum(r.predicted and r.toxic == 1 for r in judged)
    print("recall", hits / sum(r.toxic == 1 for r in judged), "precision", hits / sum(r.predicted for r in judged))
    assert hits >= 0.93 * sum(r.toxic == 1 for r in judged) and hits >= 0.94 * sum(r.predicted for r in judged)


# language model


def test_language_model_base_and_probability(spark):
    from lexstrata.llm import language_model as lm

    r = random.Random(21)
    words = {"a": [f"Aa{k}" for k in range(30)], "b": [f"bb{k}" for k in range(30)]}
    texts = [" ".join(r.choice(words["ab"[i % 2]]) for _ in range(40)) for i in range(120)] + ["", None, "Unknown things", "aa1 zz aa1"]
    got = {row.doc_id: row for row in lm.score_texts(make(spark, texts), head_size=25).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    tokens = [[*WORD.findall(lower(t or "")), None] for t in texts]
    counts = Counter(w for i, ts in enumerate(tokens) if not held[i] for w in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in enumerate(tokens):
        row = got[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[i], len(ts), sum(counts[w] > 0 for w in ts), n)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), abs=1e-6)
        assert row.score < 0
    assert sum(got[i].score for i in range(120) if held[i]) > sum(got[i].base_score for i in range(120) if held[i])
    assert lm.score_texts(make(spark, [])).count() == 0


def small_model(seed=3, head=40):
    """A vocabulary with random weights everywhere."""
    from lexstrata.llm import maxent

    r = np.random.default_rng(seed)
    words = {f"w{k}{'abcde'[k % 5]}": 500 // (k + 1) + 1 for k in range(head)}
    v = maxent.Vocabulary(words, {0: (7, 3), 5: (2, 2)}, 10, sum(words.values()) + 19, head + 6)
    model = maxent.Model(v, r.normal(size=(v.buckets, maxent.CLASSES)).astype(np.float32), r.normal(size=v.cells).astype(np.float32))
    return v, model


@pytest.mark.parametrize("head", [0, 1, 2, 40, 3000])
def test_probabilities_over_a_vocabulary_sum_to_one(head):
    """Over all leaves after the same words; inside a rest leaf, over its words and one unknown."""
    from lexstrata.llm import maxent

    v, model = small_model(head=head)
    context = [b"x1", b"w0a", b"w3d"]
    for words in ([], context[:1], context):
        tokens = maxent.Tokens(v, [words])
        keys = [np.repeat(k[-1:], v.end + 1) for k in tokens.keys]
        tokens.keys, tokens.leaf = keys, np.arange(v.end + 1)
        assert (10 ** model.log_probability(tokens)).sum() == pytest.approx(1, abs=1e-4)
    assert 10 ** v.log_rest[0] == pytest.approx(7 + 0.1 * 3 + 0.1) and 10 ** v.log_rest[1] == pytest.approx(0.1)
    assert all(v.first[i + 1] - v.first[i] <= 24 for i in range(v.end))


def test_tokens_keep_texts_apart():
    """Leaves and context keys of a bundle are those of each text alone."""
    from lexstrata.llm import maxent

    v, _ = small_model()
    texts = [[b"w0a", b"new", b"w1b", b"w0a"], [], [b"w2c"], [b"new", b"other"]]
    together, parts = maxent.Tokens(v, texts), [maxent.Tokens(v, [t]) for t in texts]
    assert together.leaf.tolist() == [x for p in parts for x in p.leaf.tolist()]
    for f in range(maxent.FEATURES):
        assert together.keys[f].tolist() == [x for p in parts for x in p.keys[f].tolist()]
    assert together.outside == [b"new", b"new", b"other"] and together.outside_text.tolist() == [0, 3, 3]


def test_descent_makes_no_tables_on_the_way():
    """A step is that of the plain formula, and nothing of the size of the table of cells is made for it."""
    import tracemalloc

    from lexstrata.llm import maxent

    v, model = small_model()
    model.cells = np.zeros(maxent.MOST_CELLS, np.float32)
    descent = maxent.Descent(maxent.Model(v, model.rows, model.cells))
    tokens = maxent.Tokens(v, [[b"w0a", b"w1b", b"w2c", b"new", b"w30a"]] * 2)
    tracemalloc.start()
    descent.step(tokens)
    assert tracemalloc.get_traced_memory()[1] < model.cells.nbytes / 4
    tracemalloc.stop()
    assert not descent.row_sums.any() and not descent.cell_sums.any()

    r = np.random.default_rng(4)
    w, q, g = (r.normal(size=(1237, 32)).astype(np.float32) for _ in range(3))
    q *= q
    squares = q + g * g
    stepped = w - g * np.float32(maxent.RATE) / np.sqrt(squares + np.float32(1))
    maxent._descend(w, q, g.reshape(-1))
    assert np.array_equal(w, stepped) and np.array_equal(q, squares) and not g.any()


def test_a_short_step_visits_only_the_weights_it_meets(monkeypatch):
    """What is left of a bundle behind its full step: the weights of a whole walk, without the walk."""
    from lexstrata.llm import maxent

    v, model = small_model()
    tokens = maxent.Tokens(v, [[b"w0a", b"w1b", b"w2c", b"new", b"w30a"]] * 2)
    walked, plain = [], maxent._descend
    monkeypatch.setattr(maxent, "_descend", lambda w, q, g: (walked.append(w.size), plain(w, q, g)))
    short = maxent.Descent(model)
    short.step(tokens)
    assert max(walked) < min(model.rows.size, model.cells.size) / 10
    monkeypatch.setattr(maxent, "SHORT_TOKENS", 0)
    whole = maxent.Descent(model)
    whole.step(tokens)
    for name in ("rows", "cells"):
        assert np.array_equal(getattr(short.model, name), getattr(whole.model, name)) and not np.array_equal(getattr(short.model, name), getattr(model, name))
    assert np.array_equal(short.row_squares, whole.row_squares) and np.array_equal(short.cell_squares, whole.cell_squares)
    assert not short.row_sums.any() and not short.cell_sums.any()


ODD_TEXTS = ["", None, " ", "\t a\x0bB \x0c\r\n", "É\u00a0x\u2028Y\x85z", "a\x1cb\x1f \0 c", "x", None, "  Ab  aB  AB ", "w " * 3000]


@pytest.mark.parametrize("part_bytes", [1, 7, 100, 1 << 23])
def test_words_in_arrow_are_those_of_a_text(monkeypatch, part_bytes):
    import pyarrow as pa

    from lexstrata.llm import common

    monkeypatch.setattr(common, "PART_BYTES", part_bytes)
    texts = pa.array(["before", *ODD_TEXTS, "behind"])[1:-1]
    got = []
    for part in common.text_parts(texts):
        words, sizes = common.split_words(part)
        assert len(sizes) == len(part) and sizes.sum() == len(words)
        ends = np.cumsum(sizes)
        got += [[w.encode() for w in words[e - n : e].to_pylist()] for n, e in zip(sizes.tolist(), ends.tolist())]
    assert got == [common.words_of(t) for t in ODD_TEXTS]
    assert not list(common.text_parts(texts[:0])) and common.split_words(texts[:0])[1].size == 0


def test_bundles_hold_whole_texts_over_batches_and_parts(monkeypatch):
    """Each bundle ends with the text that fills it, wherever batches and parts end."""
    import pyarrow as pa

    from lexstrata.llm import common, maxent
    from lexstrata.llm import language_model as lm

    v, _ = small_model()
    monkeypatch.setattr(common, "PART_BYTES", 50)
    monkeypatch.setattr(lm, "STEP_TOKENS", 12)
    r = random.Random(5)
    texts = [*ODD_TEXTS, *(" ".join(f"w{k}{'abcde'[k % 5]}" for k in r.choices(range(60), k=r.randrange(9))) for _ in range(60))]
    expected, held = [], []
    for text in texts:
        held.append(common.words_of(text))
        if sum(len(t) + 1 for t in held) >= 12:
            expected.append(maxent.Tokens(v, held))
            held = []
    expected += [maxent.Tokens(v, held)] if held else []
    got = list(lm._bundles(v, iter([pa.array(texts[:3]), pa.array([], pa.string()), pa.array(texts[3:30]), pa.array(texts[30:])])))
    assert len(got) == len(expected) > 10 and not list(lm._bundles(v, iter([])))
    for a, b in zip(got, expected):
        assert a.leaf.tolist() == b.leaf.tolist() and a.sizes.tolist() == b.sizes.tolist() and a.outside == b.outside
        assert a.outside_text.tolist() == b.outside_text.tolist() and all(np.array_equal(x, y) for x, y in zip(a.keys, b.keys))


def test_counts_of_words_add_up():
    import pyarrow as pa

    from lexstrata.llm import language_model as lm

    parts = [pa.RecordBatch.from_struct_array(pa.array(words, pa.string()).value_counts()) for words in (["a", "b", "a"], [], ["b", "é"])]
    (once,) = lm._summed(parts)
    twice = lm._summed([once, *parts])
    assert {r["word"]: r["n"] for b in twice for r in b.to_pylist()} == {"a": 4, "b": 4, "é": 2}
    assert once.schema.names == ["word", "n"] and not sum(b.num_rows for b in lm._summed(parts[1:2]))


def test_descent_follows_the_gradient_of_both_factors():
    """Numerical derivatives of the summed log loss, by a class row and by a decision cell."""
    from lexstrata.llm import maxent

    v, model = small_model()
    model.rows *= np.float32(0.1)
    model.cells *= np.float32(0.1)
    tokens = maxent.Tokens(v, [[b"w0a", b"w1b", b"w2c", b"new", b"w30a"]] * 2)
    descent = maxent.Descent(model)
    descent.step(tokens)
    loss = lambda m: -np.log(10) * m.log_probability(tokens).sum()
    assert loss(descent.model) < loss(model)
    for kind in ("rows", "cells"):
        moved = np.abs(getattr(descent.model, kind) - getattr(model, kind)).ravel()
        at = int(moved.argmax())
        slope = []
        for eps in (0.01, -0.01):
            other = maxent.Model(v, model.rows.copy(), model.cells.copy())
            getattr(other, kind).ravel()[at] += eps
            slope.append(loss(other))
        g = (slope[0] - slope[1]) / 0.02
        change = (getattr(descent.model, kind) - getattr(model, kind)).ravel()[at]
        assert change == pytest.approx(-maxent.RATE * g / math.sqrt(g * g + 1), rel=0.05)


def test_context_tells_words_of_a_class_apart(spark):
    """All words share an ending, hence a class; the word before gives the next."""
    from lexstrata.llm import language_model as lm

    r = random.Random(8)
    texts = []
    for _ in range(1500):
        at = r.randrange(200)
        texts.append(" ".join(f"n{(at + 7 * k) % 200}xy" for k in range(40)))
    held = [(row.score, row.base_score) for row in lm.score_texts(make(spark, texts)).collect() if row.held_out]
    assert sum(s for s, _ in held) > 0.8 * sum(b for _, b in held)


def test_tables_grow_with_the_training_tokens():
    from lexstrata.llm import maxent

    small, big = (maxent.Vocabulary({"a": 5}, {}, 1, n, 2) for n in (10**6, 10**9))
    assert big.buckets > small.buckets and big.cells > small.cells


def test_language_model_edges(spark):
    """Null and repeated ids, a text longer than a bundle, clashing columns, no training text."""
    from lexstrata.llm import language_model as lm
    from lexstrata.llm import maxent

    long_text = " ".join(f"v{k % 5000}" for k in range(3 * maxent.STEP_TOKENS))
    docs = make(spark, ["a b", "a b", None, long_text, "a b", ""], [1, 1, None, 2, None, 3])
    got = lm.score_texts(docs.withColumns({"n": F.lit("x"), "words": F.lit(0)}), head_size=100).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 3), ("1", 3), ("2", 3 * maxent.STEP_TOKENS + 1), ("3", 1), ("None", 1), ("None", 3)]
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and all(r.score < 0 for r in got)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = lm.score_texts(make(spark, ["a b"], [held])).collect()
    assert (row.held_out, row.n_known, row.train_tokens) == (True, 0, 0) and row.score < 0


# WARC


WARC_PAGES = [(1, "http://a/1", "<p>é" * 400, "z"), (2, "http://a/2", "<p>x", "z"), (3, None, "<p>é" * 400, "z"), (4, "http://a/4", None, "z"), (5, "http://a/5", "<p>x", "z"), (6, "u", "WARC/1.0\r\n\r\n" * 300, "z")]


def warc_pages(spark):
    return spark.createDataFrame(WARC_PAGES, "page_id long, url string, html string, n string")


def test_warc_round_trip(spark):
    from lexstrata.llm import warc

    pages = warc_pages(spark)
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 3), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    for k, _, html, _ in WARC_PAGES:
        body = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    big = "y" * 1500
    odd = spark.createDataFrame([(None, None, big), (7, None, big), (7, None, big), (None, None, "q" * 1000), (8, None, "z" * 40_000_000)], "page_id long, url string, html string")
    rows = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in warc.archive_round_trip(odd).collect())
    assert rows == [("7", "response", "None", 1500)] * 2 + [("8", "response", "None", 40_000_000), ("None", "response", "None", 1000), ("None", "revisit", "7", 1500)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_reads_of_one_archive_do_not_share_predicates(spark, tmp_path, compression):
    from lexstrata.llm import warc

    path = str(tmp_path / "archive")
    warc.write_warc(warc.capture_records(warc_pages(spark)), path, compression=compression, rollBytes="200")
    read = warc.read_warc(spark, path)
    assert read.filter("record_type = 'revisit'").select("record_id").collect()[0][0] == "<urn:page:1>"
    assert read.filter("target_uri in ('http://a/2', 'u')").count() == 2 and read.count() == 6
    revisits, responses = (warc.read_warc(spark, path, where={"record_type": [t]}) for t in ("revisit", "response"))
    assert revisits.count() == 1 and responses.count() == 5 and read.count() == 6
    assert revisits.unionByName(responses).count() == 6 and revisits.union(read).count() == 7
    assert read.filter("record_type = 'revisit'").unionByName(read).count() == 7
    assert read.alias("a").join(read.alias("b"), "record_id").count() == 6
    assert revisits.alias("a").join(read.alias("b"), F.col("a.refers_to") == F.col("b.record_id")).count() == 1
    assert warc.read_warc(spark, path, ["record_id"], {"target_uri": None, "record_type": ["response", "revisit"]}).count() == 5
    heads = warc.read_warc(spark, path, ["record_id", "content_length", "offset", "archive"])
    assert sorted(r.content_length for r in heads.collect())[0] == 0 and heads.select("archive").distinct().count() > 1
    with pytest.raises(Exception, match="not header columns"):
        warc.read_warc(spark, path, where={"payload": None}).count()


def test_warc_skips_members_by_their_lengths():
    """A skipped block of our own members is neither read nor inflated; foreign members are."""
    import gzip
    import io

    from lexstrata.llm import warc

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

        def size(self):
            return len(self.getbuffer())

    noise = [np.random.default_rng(k).bytes(300_000) for k in range(4)]
    records = [warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": str(k)}, noise[k]) for k in range(4)]
    for pack, skips in ((warc.gzip_member, True), (gzip.compress, False)):
        raw = Counted(b"".join(map(pack, records)))
        assert gzip.decompress(raw.getvalue()) == b"".join(records)
        stream = warc._Inflated(raw)
        found = []
        for at, fields, length in warc.walk(stream, "x"):
            found.append((at, fields["warc-record-id"], stream.read(length) if fields["warc-record-id"] == "2" else None))
        assert found == [(sum(map(len, records[:k])), str(k), noise[2] if k == 2 else None) for k in range(4)]
        assert (raw.taken < 0.6 * raw.size()) == skips
    whole = b"".join(map(warc.gzip_member, records))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.walk(warc._Inflated(Counted(whole[:-200_000])), "x"))


def test_warc_reports_damage(spark, tmp_path):
    from lexstrata.llm import warc

    (tmp_path / "cut.warc").write_bytes(warc.record_bytes({"WARC-Type": "response"}, b"x" * 50)[:-30])
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, str(tmp_path)).collect()


# URL filters


def test_url_filters_as_of_fetch_time(spark):
    from lexstrata.llm.url_filters import judge_captures

    captures = spark.createDataFrame(
        [(1, "http://x.a.com/p/q?z", "2024-01-05"), (2, "http://x.a.com/p/q?z", "2024-03-05"), (3, "https://b.org:8080/", "2024-02-01"), (4, None, "2024-02-01"), (5, "http://c.net/", None), (6, "HTTP://B.org/deep/er/path", "2023-12-31")],
        "page_id int, url string, at string",
    ).select("page_id", "url", F.col("at").cast("timestamp").alias("fetched_at"))
    events = spark.createDataFrame(
        [("m", "domain", "a.com", "add", "2024-01-01"), ("m", "domain", "a.com", "remove", "2024-02-01"), ("n", "prefix", "x.a.com/p", "add", "2024-03-01"), ("h", "host", "b.org", "add", "2023-06-01"), ("h", "host", "b.org", "add", "2023-07-01"), ("u", "url", "http://c.net/", "add", "2020-01-01"), ("m", "host", None, "add", "2020-01-01"), ("m", "host", "b.org", "bogus", "2020-01-01"), ("t", "host", "b.org", "remove", "2024-01-01"), ("t", "host", "b.org", "add", "2024-01-01")],
        "list string, kind string, pattern string, action string, at string",
    ).withColumn("at", F.col("at").cast("timestamp"))
    got = {r.page_id: (r.lists, r.n_entries, r.kept) for r in judge_captures(captures, events).collect()}
    assert got == {1: ("m", 1, False), 2: ("n", 1, False), 3: ("h,t", 2, False), 4: ("", 0, True), 5: ("", 0, True), 6: ("h", 1, False)}
    assert judge_captures(captures.limit(0), events).count() == 0
    assert judge_captures(captures, events.limit(0)).filter("kept").count() == 6


def test_hosts_of_odd_urls(spark):
    from lexstrata.llm.url_filters import host_of, judge_captures

    urls = {"http://user:pw@Evil.example/": "evil.example", "http://user@evil.example:80/x@y": "evil.example", "https://evil.example./": "evil.example", "http://[::1]:8080/": "[::1]", "http://a@b@evil.example": "evil.example", "nothing": "", "http://x.org?a@b": "x.org"}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_of(F.col("url")).alias("host")).collect()
    assert {r.url: r.host for r in rows} == urls
    captures = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(0, None, "y", 2)], "page_id int, url string, list string, bucket int").withColumn("fetched_at", F.lit("2024-01-05").cast("timestamp"))
    events = spark.createDataFrame([("m", "host", "evil.example", "add", "2024-01-01")], "list string, kind string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    judged = judge_captures(captures, events).collect()
    assert len(judged) == len(urls) + 1 and sum(not r.kept for r in judged) == 4


# pipeline


def test_pipeline_stages_keep_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
            assert n * 0.5 < out.count() <= n
            docs = out
        else:
            assert out.select("doc_id").distinct().count() == docs.count()


def test_pipeline_matches_brute_force(spark, corpus, tokenizer, tmp_path):
    """run() over a small folder against the stages worked out one by one in Python."""
    import corpus_pipeline
    from lexstrata.llm.toxicity import score_toxicity

    r = random.Random(31)
    texts = list(corpus)
    toxic = []
    for k in range(60):
        words = prose(500 + k, 40).split()
        for _ in range(3):
            words[r.randrange(40)] = r.choice(["zorg", "blarf"])
        toxic.append(len(texts))
        texts.append(" ".join(words))
    docs = make(spark, texts, sources=[r.choice(["a", "b", None]) for _ in texts])
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    rejected = {x.doc_id for x in score_toxicity(docs, labels).filter("predicted = 1").collect()}
    assert rejected == set(toxic)
    last = {}
    for i, t in enumerate(texts):
        if i not in rejected:
            last[t or ""] = i
    left = sorted(last.values())
    _, components = brute_components([texts[i] for i in left], 80)
    kept = [i for k, i in enumerate(left) if components[k] == k]

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({x.doc_id for x in rows}) == kept
    renumbered = [type("Piece", (), {**x.asDict(), "doc_id": kept.index(x.doc_id), "__getitem__": lambda self, key: getattr(self, key)})() for x in rows]
    check_pieces(renumbered, [texts[i] for i in kept], tokenizer, "sequence_id")


def test_packed_sequences_follow_the_mixing_weights(spark, tmp_path):
    """run()'s own rows: the first part of the sequences holds the sources by weight."""
    import corpus_pipeline

    r = random.Random(3)
    texts = [prose(9000 + i, 30 + r.randrange(60), 3000) for i in range(900)]
    sources = ["a"] * 450 + ["b"] * 450
    make(spark, texts, sources=[sources[i] for i in range(900)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({x.doc_id for x in rows}) == 900
    first = sorted({x.sequence_id for x in rows})
    early = set(first[: len(first) // 3])
    taken = Counter(sources[x.doc_id] for x in rows if x.sequence_id in early)
    assert 0.7 < taken["a"] / taken["b"] < 1.4  # by id alone, the first third would hold "a" only


def test_mixing_stage_orders_its_rows(spark, tmp_path):
    import corpus_pipeline
    from lexstrata.llm.mixing import mix_sources

    docs = make(spark, ["t"] * 300, sources=["a"] * 200 + ["b"] * 70 + [None] * 30)
    corpus_pipeline.mixing(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    slots = {x.doc_id: (x.slot, x.place) for x in mix_sources(docs).collect()}
    # Files are numbered by range, and each is sorted.
    seen = spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")).collect()
    order = [x.doc_id for x in sorted(seen, key=lambda x: (x.f, x.m))]
    assert order == sorted(slots, key=slots.get)


def test_toxicity_scores_do_not_depend_on_partitions(spark):
    """Copies with ids in both folds, read in different orders and partitions."""
    from lexstrata.llm.toxicity import score_toxicity

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores = []
    for frame in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(11)):
        scores.append({r.doc_id: r.score for r in score_toxicity(frame, labels).collect()})
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 2


def test_archive_paths_are_those_of_sparks_file_system(spark):
    from lexstrata.llm.warc import filesystem, shared_uri

    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        assert shared_uri(spark, "/shared/x").startswith("file:/")
        conf.set("fs.viewfs.mounttable.mnt.link./in", "file:///tmp")
        conf.set("fs.defaultFS", "viewfs://mnt/")
        assert shared_uri(spark, "/in/archives") == "viewfs://mnt/in/archives"
        assert shared_uri(spark, "file:///in/archives").startswith("file:/")
        conf.set("fs.s3a.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
        assert filesystem("file:/tmp/x")[1] == "/tmp/x"
    finally:
        conf.set("fs.defaultFS", before)
