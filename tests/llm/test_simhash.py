"""Operator 6 against brute force."""

import random

import numpy as np
import pytest
import xxhash

from recollect.llm import components, simhash as S


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " ", "one", "one two", "One TWO three", "É Ü a b c d", "a b c d e f " * 30, "x\x1cy z\x0bw q r"])
def test_fingerprint(text):
    assert S.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_golay_code_is_perfect():
    assert np.bincount(S.golay_index()).tolist() == [2048] * 4096


def test_no_pair_within_three_bits_is_missed():
    rng = random.Random(1)
    a = [rng.getrandbits(64) for _ in range(1500)]
    b = [x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for x in a]
    signed = lambda x: np.array(x, np.uint64).view(np.int64)
    keys, places = S.keys_of(signed(a), True)
    points, owners = S.keys_of(signed(b), False)
    probes = [set() for _ in a]
    for k, p in zip(keys.tolist(), places.tolist(), strict=True):
        probes[p].add(k)
    assert all(any(k in probes[p] for k in points[owners == p].tolist()) for p in range(len(a)))


def closure(prints):
    groups = {x: x for x in prints}

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    items = sorted(prints)
    for i, x in enumerate(items):
        for y in items[i + 1 :]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3:
                a, b = root(x), root(y)
                groups[max(a, b)] = min(a, b)
    return {x: root(x) for x in prints}


@pytest.mark.parametrize("crowded", [1000, 2])
def test_links(spark, crowded):
    rng = random.Random(2)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for _ in range(25)}
    prints = [x - (1 << 64) if x >> 63 else x for x in prints] + [0]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = {(r.a, r.b) for r in S.links(df, crowded).collect()}
    want = {(min(x, y), max(x, y)) for x in prints for y in prints if x != y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3}
    assert found == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 103), (103, 102), (7, 7)] + [(200, 201 + k) for k in range(30)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for _ in range(60):
        for a, b in edges:
            m = min(groups.get(a, a), groups.get(b, b))
            groups[a] = groups[b] = m
    assert found == {n: r for n, r in groups.items() if n != r}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_removal(spark, odd, odd_rows, clashing, nothing):
    rows = S.grouped(odd, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(odd_rows)
    signed = {r.fingerprint for r in rows}
    roots = closure(signed)
    least = {}
    for r in rows:
        assert r.fingerprint & (1 << 64) - 1 == plain_fingerprint(r.text or "")
        if r.doc_id is not None:
            least[roots[r.fingerprint]] = min(least.get(roots[r.fingerprint], r.doc_id), r.doc_id)
    assert all(r.component_id == least[roots[r.fingerprint]] for r in rows)
    assert S.grouped(nothing).count() == 0


def near_groups(rows):
    """The least id of each group of (id, text) whose five-word shingles are similar, by comparing all pairs; None stands last."""
    words = [tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").split()) for _, t in rows]
    grams = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in words]
    groups = list(range(len(rows)))

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if words[x] == words[y] or (words[x] and words[y] and len(grams[x] & grams[y]) >= 0.8 * len(grams[x] | grams[y]) - 1e-9):
                a, b = root(x), root(y)
                groups[max(a, b)] = min(a, b)
    least = {}
    for x, (d, _) in enumerate(rows):
        least.setdefault(root(x), []).append(d)
    return sorted((min((d for d in ids if d is not None), default=None) for ids in least.values()), key=str)


def test_removal_on_odd_rows(spark, odd, odd_rows, clashing, nothing):
    want = near_groups([(d, t) for d, t, *_ in odd_rows])
    for df in (odd, clashing):
        kept = S.deduplicated(df)
        assert kept.columns == df.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == want
    assert S.deduplicated(nothing).count() == 0


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for _ in range(40):
        base = text(rng.randrange(60, 300))
        rows.append(base)
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randrange(1, 1 + len(w) // 45)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(w)
    crowd = text(150)
    rows += [[*crowd[: k + 20], f"x{k}", *crowd[k + 21 :]] for k in range(80)]  # very many near copies of each other
    mixed = text(40)
    rows += [rng.sample(mixed, len(mixed)) for _ in range(30)]  # the same words, and so the same fingerprints, in other orders
    rows += [rows[-1][:], [*rows[-1][:-1], "last"], text(3), text(3), []]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept, want = {r.doc_id for r in S.deduplicated(df).collect()}, set(near_groups(rows))
    assert want <= kept and len(kept - want) <= 0.03 * len(rows)
    removed = len(rows) - len(want)
    assert removed > 100 and len(rows) - len(kept) >= 0.95 * removed


def test_bounds_of_sizes_and_parities_hold():
    rng = np.random.default_rng(5)
    for n in (1, 6, 40, 250):
        for _ in range(60):
            a = set(rng.integers(0, 2**63, n).tolist())
            b = set(rng.permutation(list(a))[: rng.integers(1, n + 1)].tolist()) | set(rng.integers(0, 2**63, rng.integers(0, n + 1)).tolist())
            p, q = (np.array(S.parities(np.array(sorted(x), np.uint64)), np.int64).view(np.uint64) for x in (a, b))
            differing = sum(int(x).bit_count() for x in p ^ q)
            assert differing <= len(a ^ b) and differing % 2 == len(a ^ b) % 2
            likeness = len(a & b) / len(a | b)
            assert len(a ^ b) <= (len(a) + len(b)) * (1 - likeness) / (1 + likeness) + 1e-9
            assert min(len(a), len(b)) >= likeness * max(len(a), len(b)) - 1e-9
    assert S.parities(np.arange(S.PARITY_SIZE + 1, dtype=np.uint64)) is None


@pytest.mark.parametrize("text", ["", "one", "a b c d", "a b c d e", "a b c d e f " * 30])
def test_majority_is_the_fingerprint(text):
    assert S.majority(S.shingle_hashes(S.words_of(text))) == S.fingerprint(text, S.SHINGLE)


def test_a_family_of_like_texts_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(12)
    base, compared, plain = [f"b{k}" for k in range(120)], [], S.verified
    rows = []
    for k in range(700):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):  # of one changed word each: 0.84, of two each: 0.7, of three: 0.59
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        rows.append((k, " ".join(w)))

    def counted(pairs, sets, similarity):
        compared.append(pairs.count())
        return plain(pairs, sets, similarity)

    monkeypatch.setattr(S, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept, want = {r.doc_id for r in S.deduplicated(df).collect()}, set(near_groups(rows))
    grams = [frozenset(tuple(t.split()[i : i + 5]) for i in range(116)) for _, t in rows]
    links = sum(len(grams[x] & grams[y]) >= 0.8 * len(grams[x] | grams[y]) for x in range(len(rows)) for y in range(x))
    assert kept == want and sum(compared) <= 2 * links, (sum(compared), links)


def test_one_of_equal_rows_stays(spark):
    rows = [(None, "a b c d", 1), (None, "a b c d", 2), (3, "x y z w", 1), (3, "x y z w", 1), (3, "quite another text here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int")
    kept = [sorted(map(str, S.deduplicated(df.repartition(n)).collect())) for n in (1, 3)]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_no_link_is_left_out(spark):
    """Pairs just above the threshold, short and long: fingerprints of words found some of them only."""
    rng, rows = random.Random(21), []
    for n in (6, 12, 30, 94, 240, 300, 700, 2500):
        for _ in range(12):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other, grams = list(base), {tuple(base[i : i + 5]) for i in range(n - 4)}
            for _ in range(n):  # change words, or lengthen the text, as long as it stays similar
                w = [*other, f"w{rng.randrange(10**6)}"] if rng.random() < 0.3 else [f"w{rng.randrange(10**6)}" if k == rng.randrange(n) else x for k, x in enumerate(other)]
                mine = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
                other = w if len(grams & mine) >= 0.8 * len(grams | mine) else other
            rows += [base, other]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    kept = {r.doc_id for r in S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == set(near_groups(rows))


def test_prefixes_and_segments_miss_no_similar_set():
    rng = np.random.default_rng(9)
    for n in (1, 2, 5, 9, 255, 257, 300, 512, 515, 640, 1300, 5000):
        for _ in range(25):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            gone = rng.permutation(len(a))[: int(len(a) * 0.1 * rng.random() * 2)]
            b = np.unique(np.concatenate([np.delete(a, gone), rng.integers(0, 2**64, int(n * 0.2 * rng.random()), np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if shared < 0.8 * (len(a) + len(b) - shared):
                continue
            x, y = (list(S.segments_of(h, 0.8)) for h in (a, b))
            met = [(p, q) for p in x for q in y if len(np.intersect1d(p[2], q[2]))]
            alike = [(p, q) for p, q in met if min(p[0], q[0]) >= 0.8 * max(p[0], q[0]) - 1e-6]
            differing = lambda p, q: sum((int(u) ^ int(v)).bit_count() for u, v in zip(np.array(p[1]).view(np.uint64), np.array(q[1]).view(np.uint64), strict=True))
            assert any(p[1] is None or q[1] is None or differing(p, q) * 1.8 <= (p[0] + q[0]) * 0.2 + 1e-6 for p, q in alike), (n, len(a), len(b))


def test_sketches_are_written_once(spark, monkeypatch):
    """Hashes of prefixes stay in one written table, and no sketch goes with each key of a text."""
    made, kept = {}, S.written

    def noted(df, name):
        made[name] = {f.name: f.dataType.simpleString() for f in df.schema}
        return kept(df, name)

    monkeypatch.setattr(S, "written", noted)
    texts = [" ".join(f"w{(12 * k + i) % 360}" for i in range(40)) for k in range(30)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:5])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.deduplicated(docs).select("doc_id").collect()) == list(range(30))
    assert [n for n, columns in made.items() if "segments" in columns] == ["fingerprints"]
    assert set(made["points"]) == {"key", "node"}
    assert not any(kind.startswith("array") for kind in made["bridging"].values())
