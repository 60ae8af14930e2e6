"""SimHash, repeated passages and surplus lines against brute force."""

import collections
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import graph, near_lines, near_sets, passages, simhash


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def random_texts(seed, n, words=80):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(words)) for _ in range(4)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("qrstuv")
        out.append(" ".join(w))
    return out


def plain_fingerprint(text, words):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if x]
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("held", [simhash.HELD, 2])
def test_simhash_equals_brute_force(spark, frame, held):
    texts = random_texts(5, 120) + ["", None, "One", "one", "ÉA b c d", "x " * 3000]
    got = sorted(map(tuple, simhash.near_duplicates(frame(list(enumerate(texts))), held=held).collect()))
    fps = [plain_fingerprint(t, 3) for t in texts]
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    assert got == [(i, f"{fps[i]:016x}", r) for i, r in enumerate(roots(len(fps), linked))]
    assert len({r[2] for r in got}) < len(texts)


def test_links_of_random_fingerprints(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(6):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(f)
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    for held in (simhash.HELD, 3):
        found = simhash.links(df, held).collect()
        number = {f: i for i, f in enumerate(signed)}
        assert all(bin(fps[number[r["a"]]] ^ fps[number[r["b"]]]).count("1") <= 3 for r in found)
        assert roots(len(fps), [(number[r["a"]], number[r["b"]]) for r in found]) == want


def test_simhash_edges(spark, frame):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (1, None), (2, "")]
    got = sorted(map(tuple, simhash.near_duplicates(frame(rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (1, 1), (2, 1)], key=str)
    kept = simhash.keep_one(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, 3, 3, 1], key=str)
    assert simhash.near_duplicates(frame([])).count() == 0


def test_components_of_a_long_path(spark):
    df = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {(r["node"], r["root"]) for r in graph.components(df).collect()} == {(i, 0) for i in range(1, 301)}


def plain_shingles(text, words):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [near_sets.BLOCK, 4])
def test_near_sets_equal_brute_force(spark, frame, block):
    rng = random.Random(block)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.choice([60, 200]))] for _ in range(8)]
    texts = ["", None, "One two", "one TWO", "one", "a b c d e", "a b c d e f"]
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
        texts.append(" ".join(w[rng.choice([0, 0, 3, 20]) :]))
    sets = [plain_shingles(t, 5) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = [i for i, r in enumerate(roots(len(sets), linked)) if i == r]
    df = frame(list(enumerate(texts)) + [(None, texts[-1]), (0, "")])
    out = near_sets.keep_one(df, block=block)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([*want, None, 0], key=str)
    # Links that a fingerprint within 3 bits does not show.
    far = [p for p in linked if bin(plain_fingerprint(texts[p[0]], 5) ^ plain_fingerprint(texts[p[1]], 5)).count("1") > 3]
    assert len(far) > 20 and len(want) < len(texts)
    assert near_sets.keep_one(frame([])).count() == 0


def test_near_sets_find_candidates_by_fingerprint(spark, frame):
    """Without any shared shingle key, the links among texts that reach each other by 3 bits are all there."""
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randint(0, 900)}" for _ in range(rng.choice([300, 1500]))]
        texts += [" ".join(w), " ".join([*w[:9], "other", *w[10:]]), " ".join(w[: len(w) * 3 // 5])]
    prints = [plain_fingerprint(t, 5) for t in texts]
    sets = [plain_shingles(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    reach = roots(len(texts), [(i, j) for i, j in pairs if bin(prints[i] ^ prints[j]).count("1") <= 3])
    linked = [(i, j) for i, j in pairs if reach[i] == reach[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    rows = near_sets._with_sets(frame(list(enumerate(texts))).selectExpr("struct(doc_id) as row", "text"), 5).collect()
    number = {r["sig"]: r["row"]["doc_id"] for r in rows}
    assert [r["fp"] % (1 << 64) for r in sorted(rows, key=lambda r: r["row"]["doc_id"])] == prints
    df = spark.createDataFrame([(r["text"], r["sig"], r["fp"], []) for r in rows], "text string, sig bigint, fp bigint, keys array<bigint>")
    found = [(number[r["a"]], number[r["b"]]) for r in near_sets.links(df).collect()]
    assert linked and roots(len(texts), found) == roots(len(texts), linked)


@pytest.mark.parametrize("meet", [1, 3, near_sets.MEET])
def test_near_sets_meet_in_pairs_or_groups(spark, meet):
    rng = random.Random(meet)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.choice([40, 90, 200]))] for _ in range(6)]
    texts = []
    for _ in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
        texts.append(" ".join(w[rng.choice([0, 0, 3, 9]) :]))
    sets = [plain_shingles(t, 5) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    rows = near_sets._with_sets(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 5).localCheckpoint()
    number = {}
    for r in rows.orderBy("id").collect():
        number.setdefault(r["sig"], r["id"])
    found = [(number[r["a"]], number[r["b"]]) for r in near_sets.links(rows, meet=meet).collect()]
    same = [(i, min(j for j in range(i + 1) if sets[j] == sets[i])) for i in range(len(sets))]
    assert roots(len(texts), found + same) == roots(len(texts), linked)


def test_near_sets_move_no_chain_of_texts(spark, frame, monkeypatch):
    """Texts that share half with the next one each are compared in pairs, not all with all."""
    texts = [" ".join(f"w{i + k // 60}x{k % 60}" for k in range(120)) for i in range(60)]
    moved, verified = [], near_sets._verified

    def counted(rows, words):
        moved.append(rows.count())
        return verified(rows, words)

    monkeypatch.setattr(near_sets, "_verified", counted)
    assert near_sets.keep_one(frame(list(enumerate(texts))), block=4).count() == len(texts)
    assert sum(moved) <= 2 * len(texts)


def plain_passages(docs, length):
    at = collections.defaultdict(set)
    for d, t in docs:
        w = (t or "").split()
        for s in range(len(w) - length + 1):
            at[tuple(w[s : s + length])].add((d, s))
    repeated, surplus = collections.defaultdict(set), collections.defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for d, s in places:
                repeated[d].update(range(s, s + length))
                if (d, s) != min(places):
                    surplus[d].update(range(s, s + length))
    return repeated, surplus


@pytest.mark.parametrize("length,gram", [(8, 4), (6, 6), (12, 3)])
def test_passages_equal_brute_force(spark, frame, length, gram):
    rng = random.Random(length)
    shared = [[rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(length - 1, 3 * length))] for _ in range(8)]
    docs = []
    for d in range(70):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(shared)[rng.randint(0, 3) :] if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(rng.randint(1, 9))]
        docs.append((d, " ".join(words)))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, None), (103, ""), (104, "z " * (2 * length)), (105, docs[3][1] + "\n" + docs[4][1])]
    got = passages.repeated_passages(frame(docs + [docs[5]]), length, gram).collect()
    repeated, surplus = plain_passages(docs, length)
    assert {r["doc_id"] for r in got} == set(repeated)
    for r in got:
        for column, want in (("repeated", repeated), ("surplus", surplus)):
            ranges = [(s["a"], s["b"]) for s in r[column]]
            assert {x for a, b in ranges for x in range(a, b)} == want[r["doc_id"]], (r["doc_id"], column)
            assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_passages_edges(spark, frame):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (7, text), (7, text)]
    assert passages.repeated_passages(frame(rows)).count() == 0
    assert passages.repeated_passages(frame([])).count() == 0
    got = passages.repeated_passages(frame([(7, "a " + text), (9, text + " b")])).orderBy("doc_id").collect()
    assert [(r["doc_id"], [tuple(s) for s in r["repeated"]], len(r["surplus"])) for r in got] == [(7, [(1, 61)], 0), (9, [(0, 60)], 1)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, edits):
    b = list(s)
    for _ in range(edits):
        i = rng.randrange(len(b) + 1)
        kind = rng.randint(0, 2)
        if kind == 0 or i == len(b):
            b.insert(i, rng.choice("abé"))
        elif kind == 1:
            b.pop(i)
        else:
            b[i] = rng.choice("abé")
    return "".join(b)


@pytest.mark.parametrize("threshold", [0, 1, 2, 4])
def test_edit_distance_in_the_band(threshold):
    rng = random.Random(threshold)
    pairs = [("", ""), ("a", ""), ("", "ab")]
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        pairs.append((a, changed(rng, a, rng.randint(0, 6))))
    assert near_lines.within(pairs, threshold).tolist() == [distance(a, b) <= threshold for a, b in pairs]


@pytest.mark.parametrize("threshold,block", [(1, 512), (2, 512), (2, 6)])
def test_surplus_lines_equal_brute_force(spark, frame, threshold, block):
    rng = random.Random(block)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 40))) for _ in range(10)]
    docs = [(d, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randint(1, 6)))) for d in range(90)]
    docs += [(200, None), (201, ""), (202, "short\nshort"), (203, base[0] + "\n\n" + base[0])]
    got = {(r["doc_id"], r["line_no"], r["exact"]) for r in near_lines.surplus_lines(frame(docs), threshold, 18, block).collect()}
    want, seen = set(), []
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if len(line) < 18:
                continue
            if line in seen:
                want.add((d, n, True))
                continue
            if any(abs(len(line) - len(o)) <= threshold and distance(line, o) <= threshold for o in seen):
                want.add((d, n, False))
            seen.append(line)
    assert got == want and {x for *_, x in want} == {True, False}


@pytest.mark.parametrize("block", [near_lines.BLOCK, 6])
def test_line_classes_equal_brute_force(spark, frame, block):
    rng = random.Random(block)
    limits = {20: 2, 40: 5, 64: 5, 120: 8, 240: 12, 400: 15}
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (19, 20, 21, 30, 41, 42, 66, 119, 125, 238, 244, 410)]
    lines = [(d, n, changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4, 5, 6, 9, 13]))) for d in range(60) for n in range(3)]
    lines += [(90, 0, "menu"), (90, 1, "menu"), (90, 2, " "), (90, 3, " "), (91, 0, "}"), (92, 0, "}")]
    docs = [(d, "\n".join(x for e, _, x in lines if e == d)) for d in sorted({d for d, *_ in lines})]
    lines = [x for x in lines if x[2].strip()]
    texts = list(dict.fromkeys(x for *_, x in lines))

    def near(a, b):
        short = min(len(a), len(b))
        most = max((t for n, t in limits.items() if n <= short), default=-1)
        return abs(len(a) - len(b)) <= most and distance(a, b) <= most

    linked = [(i, j) for i in range(len(texts)) for j in range(i) if near(texts[i], texts[j])]
    places = collections.defaultdict(list)
    for d, n, x in lines:
        places[x].append((d, n))
    degree = collections.Counter(x for p in linked for x in p)
    later = {i for i, _ in linked}
    want = set()
    for i, root in enumerate(roots(len(texts), linked)):
        own = places[texts[i]]
        for at in own:
            exact = at != own[0]
            want.add((*at, *places[texts[root]][0], len(own) - 1, degree[i], exact or i in later, exact))
    got = [tuple(r) for r in near_lines.line_classes(frame(docs), block=block, exact_chars=1).collect()]
    assert len(got) == len(lines) and set(got) == want
    assert {(r["doc_id"], r["line_no"], r["exact"]) for r in near_lines.surplus_lines(frame(docs), exact_chars=1).collect()} == {
        (w[0], w[1], w[7]) for w in want if w[6]
    }
    assert near_lines.line_classes(frame([])).count() == 0


def test_changed_words_go(spark, frame):
    long = "The meeting of the board was held on Monday in the large hall of the town, and every member spoke."
    rows = [(1, long), (2, long.replace("Monday", "Friday") + "\nown words")]
    assert {r["doc_id"]: r["text"] for r in near_lines.drop_lines(frame(rows)).collect()} == {1: long, 2: "own words"}


def test_short_copies_go(spark, frame):
    long = "The meeting of the board was held on Monday in the large hall of the town, and every member spoke."
    rows = [(1, long + "\nmenu"), (2, long.replace("Monday", "Friday") + "\nown words\nmenu"), (3, "menu")]
    out = near_lines.drop_lines(frame(rows), exact_chars=1).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: rows[0][1], 2: "own words"}


def test_drop_lines(spark, frame):
    a, b = "the first long line of all", "another line that is long"
    rows = [(1, f"{a}\n{b}"), (2, f"{a}!\nkept line of the second text"), (3, b), (4, None), (None, a), (5, ""), (6, "x\nx")]
    df = frame(rows).withColumn("n_chars", F.length("text"))
    out = near_lines.drop_lines(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {
        1: (f"{a}\n{b}", 52), 2: ("kept line of the second text", 28), 4: (None, None), None: (a, 26), 5: ("", 0), 6: ("x\nx", 3)
    }
    assert near_lines.surplus_lines(frame([])).count() == 0


def test_rows_of_one_id_lose_their_own_lines_only(spark, frame):
    rows = [(0, "a first line of some length"), (1, "top\na first line of some length"), (1, "head\na line that nothing else has")]
    rows += [(2, "the last words of all texts"), (2, "a first line of some length")]
    out = near_lines.drop_lines(frame(rows), exact_chars=1)
    want = [(0, rows[0][1]), (1, "top"), (1, rows[2][1]), (2, rows[3][1])]
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(want)


def test_passages_of_one_id_with_different_texts(spark, frame):
    """Ids that come with a short, a long and another long text; the long ones share a passage with other ids."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(70)]
    own = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [(1, ["short"]), (1, own(30) + shared), (1, own(80)), (2, shared + own(20)), (3, own(90)), (1, ["short"])]
    rows = [(i, " ".join(t)) for i, t in texts]
    got = {r["doc_id"]: [tuple(x) for x in r["repeated"]] for r in passages.repeated_passages(frame(rows)).collect()}
    assert got == {1: [(30, 100)], 2: [(0, 70)]}


def test_line_stage_removes_its_texts_and_filters(spark, frame):
    """What is read only while lines are compared goes; the result can be read twice after that."""
    base = "a line of words that is long enough to be compared with others "
    df = frame([(i, f"{base}{i}\nother {i} line number of a document {i}") for i in range(20)])
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    out = near_lines.surplus_lines(df)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"line-places", "first-lines", "near-lines"}
    assert out.count() == out.count() >= 19


def test_line_passes_have_each_key_once():
    limits = near_lines.LIMITS
    counts = [(7, 90), (20, 5), (21, 4), (22, 3), (30, 100), (41, 2), (500, 1)]
    found = near_lines.passes(counts, limits, 30)
    assert [p[:2] for p in found] == [(20, 22), (22, 23), *[(30, 31)] * 10, (41, 501)]
    assert max(p.keys for p in found) <= 30
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert sum(p.own(keys).astype(int) for p in found if p.low == 30).tolist() == [1] * 1000


def test_lines_meet_in_passes(spark, frame, monkeypatch):
    """Many passes with small filters find what one finds, and their rows are gone when the next begins."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (21, 21, 39, 41, 125)]
    df = frame([(d, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 1, 2, 5])) for _ in range(4))) for d in range(40)])
    want = sorted(map(tuple, near_lines.line_classes(df).collect()))
    folder, seen, keyed = spark.conf.get("spark.checkpoint.dir"), [], near_lines._keyed
    before = set(os.listdir(folder))

    def counted(*args):
        seen.append({name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before})
        return keyed(*args)

    monkeypatch.setattr(near_lines, "PASS_KEYS", 150)
    monkeypatch.setattr(near_lines, "_keyed", counted)
    assert sorted(map(tuple, near_lines.line_classes(df).collect())) == want
    assert len(seen) > 4 and set.union(*seen) == {"line-places", "first-lines", "first-texts", "near-lines"}


def test_shingles_of_one_set_are_not_shuffled(spark):
    one, two, three, four, both = (xxhash.xxh64_intdigest(str(i)) >> 1 for i in range(5))
    rows = [(1, [both, one]), (2, [two, both]), (3, [three, four]), (3, [three, four])]
    sets = near_sets._sets(spark.createDataFrame(rows, "sig bigint, keys array<bigint>"))
    for parts in (1, 3):
        got = [tuple(r) for part in range(parts) for r in near_sets._shared_keys(sets, part, parts, 1 << 12).collect()]
        assert sorted(got) == [(both, 1, 2, 0, bytes(64)), (both, 2, 2, 1, bytes(64))]


def test_near_sets_in_passes(spark, frame, monkeypatch):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(80)] for _ in range(5)]
    texts = [" ".join([f"v{rng.randint(0, 9)}" if rng.random() < 0.02 else x for x in rng.choice(base)]) for _ in range(60)]
    df = frame(list(enumerate(texts)))
    want = sorted(r["doc_id"] for r in near_sets.keep_one(df).collect())
    passes, met = [], near_sets._shared_keys
    monkeypatch.setattr(near_sets, "PASS_KEYS", 300)
    monkeypatch.setattr(near_sets, "_shared_keys", lambda *args: passes.append(args[1]) or met(*args))
    assert sorted(r["doc_id"] for r in near_sets.keep_one(df).collect()) == want and len(want) < 60
    assert len(passes) > 2


def test_drop_lines_leaves_only_its_surplus(spark, frame):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    near_lines.drop_lines(frame([(i, f"a line of words that is long enough {i}\nmenu") for i in range(9)]), exact_chars=1)
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before} == {"surplus-lines"}


def test_sketches_are_never_further_apart_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 40, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 1 << 63, n // 2).astype(np.uint64) << np.uint64(1)])
        wide, narrow = [near_sets.sketch(x) for x in (a, b)], [near_sets.folded(near_sets.sketch(x)) for x in (a, b)]
        assert near_sets._apart(*wide) <= len(np.setxor1d(a, b)) and near_sets._apart(*narrow) <= near_sets._apart(*wide)
        assert near_sets._apart(wide[0], narrow[0]) == 0 and {len(x) for x in narrow} == {near_sets.COUNTERS // 2}


def test_sets_of_a_common_shingle_move_no_texts(spark, frame, monkeypatch):
    """Texts with one passage in common, more than meet in one task, are told apart without their texts."""
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(12))
    texts = [" ".join([shared, *(f"w{rng.randint(0, 10**9)}" for _ in range(100))]) for _ in range(90)]
    moved, verified = [], near_sets._verified
    monkeypatch.setattr(near_sets, "_common", lambda *_: near_sets.NO_COMMON)
    monkeypatch.setattr(near_sets, "_verified", lambda rows, words: moved.append(rows.count()) or verified(rows, words))
    assert near_sets.keep_one(frame(list(enumerate(texts))), block=4).count() == len(texts)
    assert sum(moved) <= len(texts)


def test_long_sets_are_told_apart_without_their_texts(spark, frame, monkeypatch):
    rng = random.Random(7)
    shared = " ".join(f"s{i}" for i in range(12))
    texts = [" ".join([shared, *(f"w{rng.randint(0, 10**9)}" for _ in range(6000))]) for _ in range(12)]
    texts.append(texts[0].replace(" s5 ", " other "))
    moved, verified = [], near_sets._verified
    monkeypatch.setattr(near_sets, "_common", lambda *_: near_sets.NO_COMMON)
    monkeypatch.setattr(near_sets, "_same_fingerprint", lambda rows, held: rows.sparkSession.createDataFrame([], "a bigint, b bigint"))
    monkeypatch.setattr(near_sets, "_verified", lambda rows, words: moved.append(rows.count()) or verified(rows, words))
    assert near_sets.keep_one(frame(list(enumerate(texts)))).count() == len(texts) - 1
    assert sum(moved) == 2
