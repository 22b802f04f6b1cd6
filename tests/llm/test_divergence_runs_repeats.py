"""Source divergence, periodic runs and removal of long repeats against plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weft.llm import recompression, repetition_runs, source_divergence
from weft.llm.word_hash import mix

# divergence


def plain_audit(rows, shown=200):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, times, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text.translate(lower))
        held[lang].update(set(terms))
        times[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= 3]

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(times[lang, s]) for s in sources}
        q = shares(sum((times[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if times[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, shown)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_its_definition(spark):
    rng = random.Random(11)
    words = ["Ab", "ab", "ÄB", "äb", "x1y", "cd_e", "Straße", "日本", "a", "b", "c", "naïve", "Z"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30), weights=range(1, 14))), rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "é", "Z", None, ""])) for _ in range(150)]
    rows += [(None, "en", "only empty"), ("", "fr", "s1"), ("one two", "fr", "s2"), (None, None, None)]
    rows += [("ab c, a" + chr(0) + "b", "en", "copies")] * 40
    docs = spark.createDataFrame([(t, l, s, 1) for t, l, s in rows], "text string, lang string, source string, n int")
    found = told(source_divergence.audit(spark, docs))
    assert found == plain_audit(rows) and len(found) > 100
    assert told(source_divergence.audit(spark, docs.repartition(7), shown=2)) == plain_audit(rows, 2)


def test_joint_cells_hold_every_term_once(spark):
    rows = [("a a b", "en", "x"), ("a b b", "en", "y"), ("c", "en", "z"), ("a b c", "en", "z"), ("c c", "en", "x"), ("d", "en", "y")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    counts = {s: Counter(w for t, _, o in rows if o == s for w in t.split()) for s in "xyz"}
    kept_terms = ["a", "b", "c"]
    import pyspark.sql.functions as F

    counted = source_divergence.count_terms(docs)
    kept = counted.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"), F.sum("docs").alias("d")).filter("d >= 3")
    groups = spark.createDataFrame([("en", s, 3) for s in "xyz"], "lang string, source string, v bigint")
    cells = {(r["x"], r["y"], r["a"], r["b"]): r["times"] for r in source_divergence.joint_cells(kept, groups, 3).collect()}
    want = Counter((x, y, counts[x][t], counts[y][t]) for x, y in ("xy", "xz", "yz") for t in kept_terms)
    assert cells == dict(want)


def test_audit_of_no_rows_and_of_no_kept_terms(spark):
    schema = "text string, lang string, source string"
    assert told(source_divergence.audit(spark, spark.createDataFrame([], schema))) == []
    found = told(source_divergence.audit(spark, spark.createDataFrame([("a", "en", "x"), ("b", "en", "y")], schema)))
    assert found == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_of_counts_beyond_64_bits_are_exact(spark):
    import pyspark.sql.functions as F

    count, n, v = 3_000_000_000_000_007, 9_000_000_000_000_011, 1_000_003
    found = spark.range(1).select(source_divergence.share(F.lit(count), F.lit(n), F.lit(v)).alias("p")).first()["p"]
    assert found == 1 + 10**9 * (count + 1) // (n + v)


def test_terms_of_a_long_text_are_cut_at_their_ends(monkeypatch):
    text = ("Abc déf  ghi" * 50).encode()
    want = source_divergence.terms_of(text)
    monkeypatch.setattr(source_divergence, "PIECE", 7)
    assert source_divergence.terms_of(text) == want


def test_terms_are_brought_together_once(spark):
    from pyspark.sql import functions as F

    rows = [("Ab ab \xe9a c-d", "en", s) for s in "xyz"] + [("rare", "en", "x"), (None, None, None)]
    counted = source_divergence.count_terms(spark.createDataFrame(rows, "text string, lang string, source string"))
    spread = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    assert spread._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    assert {(r["lang"], bytes(r["term"]), r["n"]) for r in spread.collect()} == {("en", b"ab", 6), ("en", "\xe9a".encode(), 3), ("en", b"c", 3), ("en", b"d", 3), ("en", b"rare", 1)}


# runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            own = words[s : s + length]
            if length >= max(6, 4 * q) and not any(all(own[k] == own[k + r] for k in range(length - r)) for r in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_texts(rng):
    texts = []
    for _ in range(rng.randint(1, 5)):
        n = rng.randint(0, 60)
        words = [rng.randint(0, rng.choice([0, 1, 1, 2, 3, 8])) for _ in range(n)]
        if rng.random() < 0.5 and n:
            unit = words[: rng.randint(1, min(n, 6))]
            words = words[: rng.randint(0, n)] + unit * rng.randint(2, 12) + unit[: rng.randint(0, len(unit))] + words[: rng.randint(0, n)]
            if rng.random() < 0.3:
                words = words * rng.randint(1, 6)
        texts.append(words)
    return texts


def test_runs_equal_their_definition():
    rng = random.Random(12)
    for _ in range(400):
        texts = random_texts(rng)
        doc, start, length, period = repetition_runs.runs(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts], np.int64))
        got = [[] for _ in texts]
        for d, s, n, q in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
            got[d].append((s, n, q))
        assert got == [plain_runs(t) for t in texts]


def test_smaller_half_keeps_refinement_near_linear():
    """A position is handled about log n times, however periodic the text."""

    def handled(words):
        state, n, more = repetition_runs.Refinement(words, np.array([len(words)])), 0, True
        while more:
            n += len(state.small) + len(state.dead)
            state.squares()
            more = state.refine()
        return n

    rng = np.random.default_rng(0)
    fibonacci = [np.array([0]), np.array([0, 1])]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(np.concatenate([fibonacci[-1], fibonacci[-2]]))
    for words in (np.tile(rng.integers(0, 500, 1000), 20), fibonacci[-1], rng.integers(0, 2, 20_000), np.zeros(20_000, np.int64)):
        assert handled(words) <= 3 * len(words) * np.log2(len(words))


def plain_detection(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_detection_of_rows_with_nulls_copies_and_odd_spaces(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))) for k in range(150)]
    rows += [(None, "x " * 40), (3, None), (4, ""), (5, " \t\x0b\n "), (6, "a b " * 9), (7, "é\tü\n" * 12 + "é"), (7, "é\tü\n" * 12 + "é")]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id bigint, text string, n_runs string")
    found = sorted((tuple(r) for r in repetition_runs.detect(docs, plant=True).collect()), key=str)
    want = sorted((plain_detection(*r) for r in rows), key=str)
    assert found == want and sum(bool(r[1]) for r in want) > 20
    assert repetition_runs.detect(docs.limit(0)).collect() == []


def test_runs_without_planting_leave_texts_as_they_are(spark):
    at = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    docs = spark.createDataFrame([(at, " ".join(map(str, range(60))))], "doc_id bigint, text string")
    assert repetition_runs.detect(docs).first()["n_runs"] == 0


# long repeats


def plain_dedup(rows, window=35):
    texts = [(t or "").encode().split() for _, t in rows]
    times = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = {k for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_its_definition(spark, seed):
    rng = random.Random(seed)
    pool = [str(k) for k in range(3000)]
    bases = [[rng.choice(pool[:size]) for _ in range(rng.randint(34, 150))] for size in (1, 2, 3, 3000, 3000, 3000)]
    rows = []
    for k in range(90):
        words = []
        for _ in range(rng.randint(0, 4)):
            base = rng.choice(bases)
            at = rng.randint(0, len(base))
            words += base[at : at + rng.randint(20, 90)] + [rng.choice(pool) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice([k, k, k, 7, None]), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1, None), (2, ""), (3, "x " * 200), (4, "x " * 200), (5, "a b " * 60), (6, " ".join(pool[:34])), (8, " ".join(pool[:34])), (9, "Ä " + " ".join(pool[100:140])), (10, " ".join(pool[100:140]))]
    docs = spark.createDataFrame([(d, t, "own") for d, t in rows], "doc_id bigint, text string, key string")
    found = sorted((tuple(r) for r in recompression.dedup(spark, docs).collect()), key=str)
    want = plain_dedup(rows)
    assert found == want and sum(r[2] for r in want) > 1000
    assert sorted((tuple(r) for r in recompression.dedup(spark, docs.repartition(5)).collect()), key=str) == want


def test_removal_of_no_rows(spark):
    assert recompression.dedup(spark, spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_equal_windows_have_equal_anchors_whatever_stands_around():
    rng = np.random.default_rng(7)
    for _ in range(200):
        inner = rng.integers(0, rng.choice([1, 2, 5, 10_000]), int(rng.integers(35, 90))).astype(np.uint64)
        sides = [rng.integers(0, 5, int(rng.integers(0, 50))).astype(np.uint64) for _ in range(4)]
        texts = [np.concatenate([sides[0], inner, sides[1]]), np.concatenate([sides[2], inner, sides[3]])]
        text, first, n, name = recompression.blocks(np.concatenate(texts), np.array([len(t) for t in texts]))
        anchors = [{}, {}]
        for t, f, k, a in zip(text.tolist(), first.tolist(), n.tolist(), name.tolist()):
            anchors[t].update({w: a for w in range(f, f + k)})
        for t, words in enumerate(texts):
            assert sorted(anchors[t]) == list(range(max(0, len(words) - 34)))
        for w in range(len(inner) - 34):
            assert anchors[0][len(sides[0]) + w] == anchors[1][len(sides[2]) + w]


def test_rounds_shorten_a_text_and_cover_it():
    rng = np.random.default_rng(3)
    name = mix(rng.integers(0, 50, 5000).astype(np.uint64))
    edge = np.zeros(len(name), bool)
    edge[[0, -1]] = True
    sizes = []
    for symbols, first, last in recompression.rounds(name, edge, 3):
        sizes.append(len(symbols))
        assert first[0] == 0 and last[-1] == len(name) - 1 and (np.diff(first) >= 0).all() and (np.diff(last) >= 0).all() and (first[1:] <= last[:-1] + 1).all()
    assert all(b < 0.85 * a for a, b in zip(sizes, sizes[1:]))
