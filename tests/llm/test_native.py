"""Operators 4, 8 and 9: SQL on the small tables, brute force on odd rows."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from recollect.llm import decontaminate as D
from recollect.llm import oracles, pii, queries, secret_scan
from tests.test_oracles import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, small).toArrow()) == rows(db.sql(queries.ORACLE_SQL[name]).to_arrow_table())


ASSIGN = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_secrets(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_pii(t):
    count = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(count(m)) <= 19 and luhn(count(m))]
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(count(m)) <= 15]
    return [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(found)]


def noise(seed):
    rng = random.Random(seed)
    parts = [
        "token", "Secret", "API_KEY", "apikey", "passwd", "password", "=", ":", " = ", '"', "'", " ", "abc", "abcdef", "AKIA", "AKIA" + "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "0f" * 20, "é", "日", "\U0001f600",
        "a@b.c", "me.you+x@mail-1.example.com", "@", ".", "..", "_x", "1.2.3.4", "256.1.1.1", "01.002.0003.4", "4111 1111 1111 1111", "4111111111111112", "-", "+1 (555) 123-4567", "+49", "+", "5", "(", ")", "\n", "kſ",
    ]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(60)))


def test_base_spans_of_noise(spark):
    texts = [noise(k) for k in range(600)] + ["1" * 5000, "a." * 4000 + "@b.c", "a@b" + ".c" * 5000, "1 " * 5000, "+1" + " " * 5000, "password" * 1000, "f" * 23 + "g" + "f" * 24, "_" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    s = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(df, F.lit("o"), F.col("doc_id"))).collect()}
    p = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    sha = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    for k, t in enumerate(texts):
        assert s[k].base_sha256 == sha(base_secrets(t)), t
        assert p[k].base_sha256 == sha(base_pii(t)), t
        assert s[k].n_assign == sum(x.startswith("assign") for x in base_secrets(t))


def test_owners_tell_examples_from_credentials(spark):
    copied, own = "deadbeef01234567deadbeef01234567", "0123456789abcdef0123456789abcdff"
    rows_ = [(k, f"key {copied} end", f"o{k}") for k in range(4)] + [(9, f"token = {own}", "o1"), (10, f"token = {own}", "o1")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(df, F.col("source"), F.col("doc_id"))).collect()}
    assert out[0].spans == "hex:4:36,copied:4:36" and out[9].spans == "assign:0:40,hex:8:40,live:8:40"
    found = secret_scan.scan(df, F.col("source"), F.col("doc_id")).filter("doc_id = 9").first().findings
    assert {(f.owners, f.repositories) for f in found} == {(1, 2)}


def test_owners_and_repositories_decide(spark):
    value = lambda k: f"{k}f1e2d3c4b5a69788" * 2
    rows_ = [(10 + k, value(1), f"o{k % 2}") for k in range(5)]  # two owners, five repositories: copied
    rows_ += [(20 + k, value(2), f"o{k % 2}") for k in range(4)]  # two owners, four repositories: neither
    rows_ += [(30 + k, value(3), "o1") for k in range(9)]  # one owner, nine repositories: live
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    out = {r.doc_id: (r.n_copied, r.n_live) for r in secret_scan.digest(secret_scan.scan(df, F.col("source"), F.col("doc_id"))).collect()}
    assert out[10] == (1, 0) and out[20] == (0, 0) and out[30] == (0, 1)


def test_many_matches_of_one_text(spark):
    rng = random.Random(4)
    t = "".join(f"{'w' * rng.randrange(40)} é{rng.randrange(10**6)}@b{k % 7}.cc token={'k' * rng.randrange(4, 9)}{k} " for k in range(40_000))
    df = spark.createDataFrame([(0, t)], "doc_id long, text string")
    s = secret_scan.digest(secret_scan.scan(df, F.lit("o"), F.col("doc_id"))).first()
    p = pii.digest(pii.find(df)).first()
    sha = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert len(t) > 1_500_000 and p.n_email == 40_000
    assert s.base_sha256 == sha(base_secrets(t)) and p.base_sha256 == sha(base_pii(t))
    clean = pii.sanitise(df).first().text
    assert clean == EMAIL.sub("[email]", t)


def test_odd_rows(spark, odd, clashing, nothing):
    for df in (odd, clashing):
        assert secret_scan.scan(df, F.col("source"), F.col("doc_id")).count() == odd.count()
        assert pii.find(df).count() == odd.count()
        clean = pii.sanitise(df)
        assert clean.columns == df.columns and clean.count() == odd.count()
        assert {r.text for r in clean.collect()} == {r.text for r in df.collect()}  # nothing to sanitise
        items = df.select(F.col("doc_id").alias("item_id"), "text")
        assert D.decontaminated(df, items.limit(0)).count() == odd.count()
    assert secret_scan.scan(nothing, F.col("source"), F.col("doc_id")).count() == 0
    assert pii.find(nothing).count() == 0 and pii.sanitise(nothing).count() == 0
    assert D.contained(nothing, nothing.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_entities_of_odd_rows(spark, odd_rows, clashing):
    told = clashing.withColumn("text", F.when(F.coalesce("doc_id", F.lit(1)) % 2 == 1, F.concat(F.lit("x@y.zz "), "text", F.lit(" +49 123 456 789"))).otherwise(F.col("text")))
    clean = pii.sanitise(told)
    assert clean.columns == told.columns and clean.count() == len(odd_rows)
    for r in clean.collect():
        assert r.text is None or ("@" not in r.text and "+49" not in r.text)
    found = pii.find(told, keep=["doc_id", "text", "row"])
    assert found.columns == ["doc_id", "text", "row", "findings"]
    assert all((len(r.findings) >= 2) == ("@" in (r.text or "")) for r in found.collect())


def terms_of(texts, rows=2, share=0.8):
    """Told words of each text, by counting every pair."""
    lower = [{m.lower() for m in re.findall(r"[^\W\d_]+", t)} for t in texts]
    held, rest = [], []
    for t in texts:
        held.append({m[0].lower() for m in EMAIL.finditer(t)})
        rest.append({m.lower() for m in re.findall(r"[^\W\d_]+", EMAIL.sub(lambda m: " " * len(m[0]), t))})
    out = [set() for _ in texts]
    for e in set().union(*held):
        mine = [k for k, h in enumerate(held) if e in h]
        for w in set().union(*(rest[k] for k in mine)):
            both, n = sum(w in rest[k] for k in mine), sum(w in one for one in lower)
            own = math.log(len(texts) / len(mine))
            if both >= rows and own > 0 and round(math.log(len(texts) * both / (n * len(mine))) / own, 9) >= share:
                for k in mine:
                    out[k] |= {w} & rest[k]
    return out


def test_terms_against_counting_every_pair(spark):
    rng = random.Random(11)
    names, plain = [f"n{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for k in range(40)], [f"w{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    texts = []
    for k in range(150):
        w = [rng.choice(plain) for _ in range(rng.randrange(3, 25))]
        for who in rng.sample(range(40), rng.choice([0, 0, 1, 1, 2])):
            w.insert(rng.randrange(len(w)), f"{who}@mail.example")
            if rng.random() < 0.8:
                w.insert(rng.randrange(len(w)), names[who].title())
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = terms_of(texts)
    assert sum(map(len, want)) > 20
    for r in pii.find(df).collect():
        found = [f for f in r.findings if f.kind == pii.TERM]
        assert {r.text[f.start : f.end].lower() for f in found} == want[r.doc_id]
        assert len(found) == sum(m.group().lower() in want[r.doc_id] for m in re.finditer(r"[^\W\d_]+", EMAIL.sub(lambda m: " " * len(m[0]), r.text)))


def test_terms_are_generalised(spark):
    filler = [(100 + k, f"nothing zoo here but the usual words number {k}") for k in range(60)]
    told = [(k, f"Ask Zoltanovich or Bo now: zed@mail.example about the bill {k}. Far away from it stands Zoltanovich" + " again" * 30) for k in range(2)]
    df = spark.createDataFrame(told + filler, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    # "zo" begins a word that sixty rows have; no word but the name begins so further on.  A name of two letters is a term as well.
    assert "Zoltanovich" not in clean[0] and clean[0].count("zo*") == 2 and "[email]" in clean[0] and "zed@" not in clean[0]
    assert "Bo" not in clean[0] and " the " in clean[0]
    assert clean[100] == dict(filler)[100]
    once = spark.createDataFrame(told[:1] + filler, "doc_id long, text string")
    assert "Zoltanovich" in pii.sanitise(once).filter("doc_id = 0").first().text  # one row is no evidence


def contains(doc, item):
    words = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    d, i = words(doc), words(item)
    k = min(5, len(i))
    grams = lambda w: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return k > 0 and len(grams(d) & grams(i)) >= 0.8 * len(grams(i)) - 1e-9


def test_short_items_inside_documents(spark):
    docs = spark.createDataFrame([(1, "Well, the answer: forty-two."), (2, "answer forty two"), (3, "answer forty"), (4, "two forty answer")], "doc_id long, text string")
    items = spark.createDataFrame([(0, "answer forty two")], "item_id long, text string")
    assert sorted(r.doc_id for r in D.contained(docs, items).collect()) == [1, 2]


def test_containment_misses_nothing(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split())
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rng.randrange(1, 60))) for k in range(40)] + [(90, None), (91, ""), (92, "... !!"), (5, "same id")]
    docs = []
    for k in range(120):
        body = text(rng.randrange(0, 200)).split()
        piece = rng.choice(items)[1] or ""
        w = piece.split()
        for _ in range(rng.randrange(0, 4)):
            if w:
                w[rng.randrange(len(w))] = word()
        at = rng.randrange(len(body) + 1)
        docs.append((k, " ".join(body[:at] + [" | ".join(w).upper()] + body[at:])))
    docs += [(500, None), (501, ""), docs[3], docs[3]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in D.contained(d, i).collect())
    assert found == sorted((a, b) for a, x in docs for b, y in items if contains(x, y))
    kept = D.decontaminated(d, i).collect()
    assert sorted(r.doc_id for r in kept) == sorted(a for a, x in docs if not any(contains(x, y) for _, y in items))


def test_oracle_patterns_are_the_contracts():
    assert oracles.EMAIL.replace("\\\\", "\\") == EMAIL.pattern and oracles.CARD == CARD.pattern
