"""Decontamination, divergence audit and whitening against brute force, on the smallest driver table and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from brindle.llm import divergence, positions, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def duck(**tables):
    c = duckdb.connect()
    for name, path in tables.items():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return c


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 11


def brute_hits(docs, items, n=10):
    windows = set()
    for item, text in items:
        w = tuple(WORD.findall(low(text)))
        k = min(n, len(w))
        windows |= {(str(item) if item is not None else "null", w[i : i + k]) for i in range(len(w) - k + 1) if k}
    out = []
    for doc, text in docs:
        w, hit, found = tuple(WORD.findall(low(text))), set(), set()
        for item, run in windows:
            for i in range(len(w) - len(run) + 1):
                if w[i : i + len(run)] == run:
                    hit |= set(range(i, i + len(run)))
                    found.add(item)
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def found_hits(spark, docs, items, n=10):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, term long")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, tid long")
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in positions.contaminated(d, b, n).collect())


def test_decontamination_by_sql(spark):
    c = duck(documents=f"{SF}/documents.parquet", benchmark=f"{SF}/benchmark.parquet")
    got = sorted(tuple(r) for r in positions.op11_decontamination(spark, SF).collect())
    assert got == sorted(c.sql(positions.ORACLE).fetchall())
    assert any(r[2] for r in got)


def test_decontamination_by_brute_force(spark):
    """Few words, so that runs repeat, overlap and share their rarest terms; odd rows on both sides."""
    r = random.Random(4)
    say = lambda n: " ".join(r.choice("a b c D é ß 1 漢 x-y q_z".split()) for _ in range(n))
    items = [(i, say(r.choice([3, 9, 10, 11, 14]))) for i in range(12)]
    items += [(1, items[0][1]), (2, items[2][1].upper()), (None, items[3][1]), (7, None), (8, ""), (9, " ,;"), (10, "one"), (11, "two words"), (12, "zzz " * 12), (13, "never seen anywhere " * 5)]
    docs = [(i, " ; ".join([say(r.randint(0, 30)), r.choice(items)[1] or "", say(r.randint(0, 10)), r.choice(items)[1] or ""])) for i in range(60)]
    docs += [(None, items[4][1]), (3, items[5][1] + " " + items[5][1]), (3, items[5][1] + " " + items[5][1]), (4, None), (5, ""), (6, "\n\t"), (7, "zzz " * 3000), (8, "two   Words"), (9, "x" * 20000), (10, "ONE")]
    assert found_hits(spark, docs, items) == brute_hits(docs, items)
    assert found_hits(spark, docs, items, 3) == brute_hits(docs, items, 3)


def test_decontamination_of_copies(spark):
    """A passage that most documents and items share: found once, owned by all."""
    passage = " ".join(f"w{i}" for i in range(25))
    items = [(i, passage if i % 3 else passage + f" end{i}") for i in range(40)]
    docs = [(i % 50, f"start{i} {passage} w3 w4") for i in range(200)] + [(900, "nothing of it")]
    assert found_hits(spark, docs, items) == brute_hits(docs, items)


def test_decontamination_without_rows(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert positions.contaminated(docs.limit(0), none).count() == 0
    got = positions.contaminated(docs, none).collect()
    assert len(got) == docs.count() and all(r.n_hit == 0 and r["items"] == [] for r in got)


def test_decontamination_sorts_ids_as_text(spark):
    items = [(i, "the same ten words are in all of these items") for i in (2, 10, 1)]
    got = positions.contaminated(spark.createDataFrame([(1, items[0][1])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).first()
    assert got["items"] == ["1", "10", "2"] and hashlib.sha256(b"1,10,2").hexdigest() and got.n_hit == 10


def test_positions_of_all_terms(spark, docs):
    """An index of every word finds what one of the runs' words finds."""
    some = spark.read.parquet(f"{SF}/benchmark.parquet")
    classes = positions.item_classes(some)
    from pyspark.sql import functions as F

    small = positions.build(docs, classes.select(F.explode("words").alias("term")))
    whole = positions.build(docs)
    assert whole.postings.count() == docs.select(F.sum(F.size(positions.words(F.col("text"))))).first()[0] >= small.postings.count()
    found = []
    for index in (small, whole):
        runs = positions.cut_runs(classes, index)
        rows = positions.phrases(index, runs.runs).join(index.rows, "row").join(runs.owners, "run")
        found.append(Counter(tuple(r) for r in rows.groupBy("doc_id", "start", "class").count().collect()))
    assert found[0] == found[1] and found[0]


def test_near(spark):
    """Proximity: all words of a run within a span, in any order."""
    r = random.Random(9)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(40)]
    items = [(1, "a b c"), (2, "h g h"), (3, "d")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    classes = positions.item_classes(b)
    index = positions.build(d)
    runs = positions.cut_runs(classes, index, 3)
    for span in (3, 5):
        rows = positions.near(index, runs.runs, span).join(runs.owners, "run").join(classes, "class").join(index.rows, "row").collect()
        got = defaultdict(set)
        for x in rows:
            got[x.doc_id, x["ids"][0]].add(x.start)
        for doc, text in docs:
            w = text.split()
            for item, run in items:
                want = {s + 1 for s in range(len(w)) if set(run.split()) <= set(w[s : s + span])}
                mine = got.get((doc, str(item)), set())
                assert mine <= want and bool(mine) == bool(want)


# 12


def brute_audit(rows, least, top):
    """Every term of every pair, zeros written out, in whole numbers."""
    rows = [(lang or "", source or "", [w for w in LETTERS.findall(low(text))]) for text, lang, source in rows]
    df, total, counts = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in rows:
        df[lang].update(set(w))
        counts[lang, source].update(w)
    out = []
    for lang in {x[0] for x in rows}:
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        groups = {s: counts[lang, s] for l, s in {(x[0], x[1]) for x in rows} if l == lang}
        for s, c in groups.items():
            total[lang].update({t: c[t] for t in kept})
        share = lambda c, n, v=v: 1 + 10**9 * (c + 5) // (n + 5 * v)
        p = {s: {t: share(c[t], sum(c[x] for x in kept)) for t in kept} for s, c in groups.items()}
        q = {t: share(total[lang][t], sum(total[lang].values())) for t in kept}
        for s in groups:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o.decode(), -x, i) for i, (x, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t.decode(), -x, i) for i, (x, t) in enumerate(terms, 1)]
    return sorted(out)


def test_divergence_by_sql(spark):
    c = duck(documents=f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in divergence.op12_divergence(spark, SF).collect())
    assert got == sorted(c.sql(divergence.ORACLE).fetchall()) and {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("least,top", [(3, 4), (1, 50), (200, 5)])
def test_divergence_by_brute_force(spark, least, top):
    """Null and empty names, groups without terms, ties, repeated rows, a group of half of all rows."""
    r = random.Random(8)
    terms = ["a", "B", "b", "é", "É", "z1z", "漢", "x'y", "ab"] + [f"t{c}" for c in "abcdefghijklmnop"]
    rows = [(" ".join(r.choices(terms, k=r.randint(0, 20))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s1", "s1", "s2", "S3", None, "é"])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("123 !", "de", "digits"), ("only here", "fr", "s1"), ("x" * 20000, "en", "s2"), (rows[0])] * 2
    df = spark.createDataFrame([(i % 7, *x, i, "k") for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, g long, term string")
    assert sorted(tuple(x) for x in divergence.audit(df, least, top).collect()) == brute_audit(rows, least, top)


def test_divergence_share_is_exact(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(c := r.randrange(10 ** r.randint(1, 17)), c + r.randrange(10 ** r.randint(1, 17)), r.randint(1, 10**6)) for _ in range(200)] + [(0, 0, 1), (0, 0, 0)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [x[0] for x in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) if v else None for c, n, v in rows]


def test_divergence_without_rows(spark, docs):
    assert divergence.audit(docs.limit(0)).count() == 0


# 13


def brute_whitening(x, k=8):
    """Covariance by its definition, eigenvectors of it."""
    x = np.floor(x.astype(np.float64) * 1024) + 100000
    c = x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    order = np.argsort(-e)[:k]
    return c @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def whitened(df):
    out, rest = defaultdict(dict), {}
    for r in whitening.whiten(df).collect():
        out[r.vec_id][r.component] = r.whitened
        rest[r.vec_id, r.component] = (r.n, r.deviation, r.explained, r.identity_error)
    return out, rest


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_by_brute_force(spark, parts):
    """Also with more partitions than one merge takes, and partitions of fewer rows than dimensions."""
    r = np.random.default_rng(2)
    x = (r.normal(size=(500, 12)) @ np.diag(np.arange(12, 0, -1)) @ r.normal(size=(12, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n int").repartition(parts)
    got, rest = whitened(df)
    want, explained = brute_whitening(x)
    y = np.array([[got[i][k + 1] for k in range(8)] for i in range(500)])
    y *= np.sign((y * want).sum(0))
    assert np.allclose(y, want, atol=1e-9)
    whole = [[int(a) for a in row] for row in np.floor(x.astype(np.float64) * 1024) + 100000]
    sums = [sum(c) for c in zip(*whole)]
    for i in range(500):
        n, deviation, e, error = rest[i, 1 + i % 8]
        assert n == 500 and int(deviation) == sum((500 * a - s) ** 2 for a, s in zip(whole[i], sums))
        assert abs(e / explained[i % 8] - 1) < 1e-9 and error < 1e-9


def test_whitening_of_the_driver_table(spark):
    rows = whitening.op13_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want, explained = brute_whitening(np.array([r.embedding for r in table], np.float32))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == 8 * len(table)
    for k in range(8):
        mine = np.array([got[r.vec_id, k + 1].whitened for r in table])
        assert np.allclose(mine * np.sign(mine @ want[:, k]), want[:, k], atol=1e-8) and abs(got[0, k + 1].explained / explained[k] - 1) < 1e-9


def test_whitening_of_odd_rows(spark):
    """Null, empty, non-finite and wide vectors; repeated and null ids; two lengths; rows of rank one; huge entries."""
    r = np.random.default_rng(6)
    x, y = r.normal(size=(40, 5)), r.normal(size=(1, 3)) * np.arange(1, 21)[:, None]
    rows = [(i // 2, v.tolist()) for i, v in enumerate(x)] + [(100 + i, v.tolist()) for i, v in enumerate(y)]
    rows += [(None, x[0].tolist()), (900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan")] * 5), (904, [float("inf")] + [0.0] * 4), (905, [1.0]), (905, [1.0]), (906, [2.5, 1e300]), (907, [0.5, 0.25])]
    df = spark.createDataFrame([(*x, 1, "v") for x in rows], "vec_id long, embedding array<double>, length int, w string")
    got = Counter((r.vec_id, r.component) for r in whitening.whiten(df).collect())
    assert all(got[i, k] == 2 for i in range(20) for k in range(1, 6)) and got[None, 1] == 1 and got[0, 6] == 0
    assert got[100, 1] == 1 and got[906, 1] == 1 and got[906, 2] == 0
    assert not any(i is not None and 900 <= i < 906 for i, _ in got)  # nothing varies among vectors of one entry
    errors = {r.component: r.identity_error for r in whitening.whiten(df.where("vec_id < 20")).collect()}
    assert max(errors.values()) < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 905")).count() == 0


def test_whitening_sums_are_exact(spark):
    """Entries past 32 bits, whose squares no double holds."""
    x = [[2.0**40 + i * 0.5, -(2.0**41) + i * 3.0, float(i % 3)] for i in range(7)]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    whole = [[int(np.floor(a * 1024)) + 100000 for a in v] for v in x]
    sums = [sum(c) for c in zip(*whole)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df).where("component = 1").collect()}
    assert got == {i: sum((7 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(whole)}


def test_only_documents_with_a_pattern_are_looked_at(spark):
    """Of the postings, other terms of a run are looked for in documents that have its two rarest ones; all blocks of 64 are met."""
    from pyspark.sql import functions as F

    item = [f"w{i}" for i in range(10)]
    hit = {0, 63, 64, 127, 128, 199}
    docs = spark.createDataFrame([(i, " ".join(item if i in hit else item[::-1])) for i in range(200)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    assert {r.doc_id: (r.n_hit, r["items"]) for r in positions.contaminated(docs, items).collect()} == {i: (10, ["a"]) if i in hit else (0, []) for i in range(200)}
    classes = positions.item_classes(items)
    index = positions.build(docs, classes.select(F.explode("words").alias("term")))
    found = positions.phrases(index, positions.cut_runs(classes, index).runs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "mask" in plan
