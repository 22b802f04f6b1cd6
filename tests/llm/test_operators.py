"""The ten operators on small tables with everything odd in them, against brute force."""

import base64
import collections
import contextlib
import hashlib
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import block_naming, brown_lm, cross_polytope, html_blocks, jaccard_rtree, nearest_toxic, pareto_mix, repair_store, slack_packing, tokens, warc_store
from weft.llm.storage import Scratch
from weft.llm.word_hash import quick_words, words

P = pytest.importorskip("public_tokenizers")
rng = random.Random(7)
VOCABULARY = [f"{a}{b}" for a in "ka lo mi nu re sa ti vo".split() for b in "na be do ri su te".split()]
BASE = [" ".join(rng.choice(VOCABULARY) for _ in range(n)) for n in (3, 5, 40, 90, 160, 200)]


def edited(text, n):
    w = text.split()
    for k in range(n):
        w[(k * 37) % len(w)] = f"new{k}"
    return " ".join(w)


LONG = " ".join(f"{rng.choice(VOCABULARY)}{k % 97}" for k in range(30_000))
TEXTS = [None, "", " \t\n", "one", "ONE", "Zwei\x1cDrei  vier\n\nfünf ", *BASE, BASE[3], BASE[3], edited(BASE[3], 1), edited(BASE[4], 1), edited(BASE[4], 30), BASE[4].upper(), LONG, LONG, LONG + " tail", "😀 <|endoftext|> \0 x", "é " * 50]
DOCS = [(k, t, None if k % 5 == 0 else "ab"[k % 2], "x", k, None, 1.5) for k, t in enumerate(TEXTS)]
DOCS += [(None, "a null id", "a", None, None, None, None), (3, "one", None, "x", 1, None, 0.5), (3, "one", None, "x", 1, None, 0.5)]
#: Extra columns have the names that operators use inside.
SCHEMA = "doc_id bigint, text string, source string, name string, n bigint, part int, size double"
NONE = "doc_id bigint, text string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(5)


def key(*values):
    return tuple((v is not None, v if v is not None else 0) for v in values)


def test_exact_dedup(spark, docs):
    found = block_naming.exact_classes(spark, docs, block_bytes=64).collect()
    groups = collections.defaultdict(list)
    for d, t, *_ in DOCS:
        groups[t or ""].append(d)
    want = sorted((key(d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]))) for d, t, *_ in DOCS)
    assert sorted(key(r.doc_id, r.keep_id, r.group_size) for r in found) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)
    assert block_naming.exact_classes(spark, spark.createDataFrame([], NONE)).count() == 0


def test_mix(spark, docs):
    found = pareto_mix.mix(spark, docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(key(r.doc_id, r.size) for r in found) == sorted(key(d, size(t)) for d, t, *_ in DOCS)
    assert {r.source_size for r in found} == {sum(size(t) for _, t, s, *_ in DOCS if s == x) for x in {r[2] for r in DOCS}}
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    assert sorted(map(str, found)) == sorted(map(str, pareto_mix.mix(spark, docs.repartition(2)).collect()))
    assert pareto_mix.mix(spark, spark.createDataFrame([], NONE)).count() == 0


def test_mix_comes_near_its_targets(spark):
    r = random.Random(1)
    rows = [(k, "w " * r.randint(1, 60), f"s{min(k % 7, 3)}") for k in range(3000)]
    found = pareto_mix.mix(spark, spark.createDataFrame(rows, NONE)).collect()
    taken, target = collections.Counter(), {}
    for x in found:
        taken[x.source_size] += x.taken
        target[x.source_size] = x.target
    assert abs(sum(target.values()) - sum(x.size for x in found)) < 1e-6
    # the last document closes the gap
    assert all(abs(taken[s] - t) <= 2 for s, t in target.items())
    assert all(t <= 3 * s + 1e-9 for s, t in target.items())


def test_mix_includes_by_pareto_odds(spark):
    """Rows are drawn as often as their own probabilities say, which differ; and as a slow Pareto sample of them says."""
    rows = [(k, "w " * (5 if k % 5 else 80), "ab"[k % 2]) for k in range(6000)] + [(7000 + k, t, "c") for k, t in enumerate([None, "", " "])]
    # weights 5 and 2: a has its words and more, b two sevenths of all
    sizes = spark.createDataFrame([(i, s, len((t or "").split()), 0) for i, t, s in rows], "doc_id bigint, source string, size bigint, v bigint")
    scratch = Scratch(spark, "test")
    chances = {x.doc_id: x for x in pareto_mix.inclusion(scratch, sizes, scratch.keep(pareto_mix.source_targets(sizes), "targets")).collect()}
    assert all(0 <= x.p < 1 for x in chances.values())
    found = {x.doc_id: x for x in pareto_mix.mix(spark, spark.createDataFrame(rows, NONE)).collect()}
    assert all(found[7000 + k].taken == 0 and found[7000 + k].source_size == 0 for k in range(3))
    for source in (0, 1):
        odds = set()
        for remainder in (0, 1):
            some = [k for k in range(6000) if k % 2 == source and (k % 5 > 0) == remainder]
            p = {round(chances[k].p, 9) for k in some}
            assert len(p) == 1
            odds |= p
            p, n = p.pop(), len(some)
            hit = sum(found[k].copies - chances[k].whole for k in some)
            assert abs(hit - n * p) < 4 * (n * p * (1 - p)) ** 0.5 + 1
        # short documents are drawn more often than long ones
        assert len(odds) == 2 and chances[1 if source else 2].p > chances[5 if source else 0].p
        # expected words are those that are due
        own = [x for k, x in chances.items() if k < 6000 and k % 2 == source]
        assert abs(sum(x.p * x.size for x in own) - own[0].due) < 1e-6 * own[0].due
        # the same ranks by hand
        u = {x.doc_id: (int(__import__("hashlib").md5(f"{x.doc_id}:{pareto_mix.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for x in own}
        left, last = own[0].due, False
        for x in sorted(own, key=lambda x: (u[x.doc_id] / (1 - u[x.doc_id])) / (x.p / (1 - x.p))):
            last = last or x.size > left
            if not last:
                left -= x.size
                assert found[x.doc_id].copies == x.whole + 1
        assert sum(found[x.doc_id].taken for x in own) - x.target <= left + 80


def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k, (d, _) in enumerate(rows):
        groups[root(k)].append(d)
    least = lambda k: min((d for d in groups[root(k)] if d is not None), default=None)
    return sorted(key(d, len(sets[k]), least(k)) for k, (d, _) in enumerate(rows))


def test_jaccard(spark, docs):
    found = jaccard_rtree.link(spark, docs).collect()
    assert sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components([(d, t) for d, t, *_ in DOCS])
    assert jaccard_rtree.link(spark, spark.createDataFrame([], NONE)).count() == 0


def test_jaccard_with_hot_groups(spark, monkeypatch):
    """Near copies by the dozen, a passage in every document, chains, and trees dealt out."""
    monkeypatch.setattr(jaccard_rtree, "OFTEN", 4)
    monkeypatch.setattr(jaccard_rtree, "LIMIT", 8)
    r, passage = random.Random(3), " ".join(VOCABULARY[:12])
    base = [" ".join(r.choice(VOCABULARY) + str(r.randint(0, 9)) for _ in range(80)) for _ in range(6)]
    texts = [edited(base[k % 6], k % 5) + " " + passage for k in range(60)] + [passage + " " + " ".join(r.choice(VOCABULARY) for _ in range(2 + k)) for k in range(20)]
    chain = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split() * 3
    texts += [" ".join(f"{w}{n}" for n, w in enumerate(chain[k : k + 60])) for k in range(0, 18, 3)] + [" ".join(f"{w}{n + k}" for n, w in enumerate(chain[k : k + 60])) for k in range(0, 18, 3)]
    rows = list(enumerate(texts))
    found = jaccard_rtree.link(spark, spark.createDataFrame([(d, t, None) for d, t in rows], NONE).repartition(4)).collect()
    assert sorted(key(x.doc_id, x.n_shingles, x.component_id) for x in found) == brute_components(rows)


def near_sets(g, n, groups):
    """Sets around a few centres, so that some link, some nearly do and some share a little."""
    centres = [np.sort(g.choice(2**60, 80, replace=False).astype(np.uint64)) for _ in range(groups)]
    out = []
    for k in range(n):
        own = centres[k % groups].copy()
        change = g.choice(80, int(g.integers(0, 22)), replace=False)
        own[change] = g.choice(2**60, len(change), replace=False).astype(np.uint64)
        out.append(np.unique(own))
    return out


def test_spanning_links_and_tree_pairs_against_brute_force():
    g = np.random.default_rng(8)
    for turn in range(6):
        sets = near_sets(g, 70, 3 + turn)
        labels = np.arange(70) if turn % 2 else g.integers(0, 40, 70)
        sizes = np.array([len(s) for s in sets])
        links = {(a, b) for a in range(70) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}

        def classes(edges):
            parent = {int(x): int(x) for x in labels}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in edges:
                parent[root(int(labels[a]))] = root(int(labels[b]))
            return [root(int(x)) for x in labels], len({root(x) for x in parent})

        found = jaccard_rtree.spanning_links(labels, sets)
        assert all((max(a, b), min(a, b)) in links for a, b in found)
        whole, n = classes(links)
        mine, m = classes(found)
        assert n == m and len({*zip(whole, mine)}) == n
        # one link for each two components that it joins
        assert len(found) == len(set(labels.tolist())) - n
        pairs, rows = jaccard_rtree.tree_pairs(labels, sizes, [jaccard_rtree.fine_point(s) for s in sets])
        apart = {(a, b) for a, b in links if labels[a] != labels[b]}
        assert {x for pair in apart for x in pair} <= set(rows.tolist())
        assert pairs.shape[1] <= len(rows) and (not pairs.shape[1] or apart <= {(max(p), min(p)) for p in pairs.T.tolist()})


def test_small_trees_searched_at_once_as_one_by_one(monkeypatch):
    g = np.random.default_rng(8)
    tables, want = [], set()
    for key in range(60):
        n = int(g.integers(1, 100))
        base = [g.integers(0, 2**63, int(g.choice([6, 40, 300, 1200])), dtype=np.uint64) for _ in range(4)]
        sets = [np.unique(np.r_[base[k % 4][: int(len(base[k % 4]) * g.uniform(0.75, 1))], g.integers(0, 2**63, 3, dtype=np.uint64)]) for k in range(n)]
        labels, names, sizes = g.integers(0, 2 + key % 7, n), g.permutation(1000)[:n] - 500, np.array([len(s) for s in sets])
        fine = [jaccard_rtree.fine_point(s) for s in sets]
        tables.append(pa.RecordBatch.from_pydict({"key": np.full(n, key), "deal": np.full(n, -key), "label": labels, "name": names, "n": sizes, "point": [p.tobytes() for p in fine]}))
        pairs, rows = jaccard_rtree.tree_pairs(labels, sizes, fine)
        want |= {(key, -key, *sorted((int(names[a]), int(names[b])))) for a, b in pairs.T} or {(key, -key, int(names[k]), None) for k in rows}
    assert {x[3] is None for x in want} == {True, False}
    # none of them is walked row by row
    monkeypatch.setattr(jaccard_rtree, "tree_pairs", None)
    found = [tuple(x.values()) for batch in jaccard_rtree._searched(iter(tables)) for x in batch.to_pylist()]
    assert len(found) == len(set(found)) and set(found) == want


def test_quick_words():
    g = np.random.default_rng(4)
    bits = [b" ", b"\t", b"\r", b"a", b"A", b"b", b"\x00", b"\x1f", b"\x85", "\xe9".encode(), b"Eightlet", b"eightletnine", b"x" * 300]
    texts = [None if g.random() < 0.2 else b"".join(bits[k] for k in g.integers(0, len(bits), g.integers(0, 30))) for _ in range(500)]
    hashes, n = quick_words(pa.array([b"zz q", *texts], pa.binary()).slice(1))
    cut = [re.findall(rb"[^\x20\x09-\x0d]+", (t or b"").lower()) for t in texts]
    assert n.tolist() == [len(c) for c in cut]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip((w for c in cut for w in c), hashes.tolist()))
    assert len(set(seen.values())) == len(seen) > 500
    assert len(quick_words(pa.array([None, b""], pa.binary()))[0]) == 0


def test_names_of_different_sets_that_met_once():
    sets = [np.array([1, 2, 3], np.uint64), np.array([1, 2, 4], np.uint64)]
    before = jaccard_rtree._names(sets)
    after = jaccard_rtree._names(sets, before[:1, 0])
    assert after[0, 0] != before[0, 0] and (after[1] == before[1]).all() and after[0, 1] == before[0, 1]


def test_masks_lose_nothing(spark):
    numbers = spark.range(5000).selectExpr("xxhash64(id) as x")
    mask = jaccard_rtree.Bits.of(numbers, "x")
    own = np.array([r.x for r in numbers.collect()], np.int64)
    assert mask.has(own).all() and mask.has(np.random.default_rng(1).integers(-(2**63), 2**63, 5000)).mean() < 0.2


def test_jaccard_links_hold_components_together(spark):
    rows = [(k, edited(BASE[4], k % 4) if k < 12 else BASE[k % 6], None) for k in range(20)] + [(50, None, None), (51, BASE[4], None)]
    table = spark.createDataFrame(rows, NONE)
    found = {x.doc_id: x for x in jaccard_rtree.link(spark, table).collect()}
    parent = {d: d for d in found}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for x in jaccard_rtree.links(spark, table).collect():
        assert x.class_a < x.class_b and found[x.class_a].class_id == x.class_a
        parent[root(x.class_a)] = root(x.class_b)
    for x in found.values():
        parent[root(x.doc_id)] = root(x.class_id)
    groups = collections.defaultdict(list)
    for d in found:
        groups[root(d)].append(d)
    assert {d: min(own) for own in groups.values() for d in own} == {d: x.component_id for d, x in found.items()}


def test_rtree_bound_loses_nothing():
    g = np.random.default_rng(5)
    sizes = g.integers(5, 400, 300)
    sets = [np.sort(g.choice(2**62, n, replace=False).astype(np.uint64) * np.uint64(4)) for n in sizes]
    for k in range(0, 300, 3):
        sets[k] = np.sort(np.r_[sets[k - 1][: int(0.93 * len(sets[k - 1]))], sets[k][:2]])
    sizes = np.array([len(s) for s in sets])
    points = np.stack([jaccard_rtree.folded(jaccard_rtree.fine_point(s), jaccard_rtree.GROUPS) for s in sets])
    assert jaccard_rtree.bound(jaccard_rtree.fine_point(sets[2]), jaccard_rtree.fine_point(sets[3])) >= len(np.intersect1d(sets[2], sets[3]))
    tree = jaccard_rtree.RTree(points, sizes)
    for k in range(300):
        near = set(tree.search(points[k], int(sizes[k])).tolist())
        for j in range(300):
            both = len(np.intersect1d(sets[k], sets[j]))
            assert 100 * both < 80 * (sizes[k] + sizes[j] - both) or j in near


def test_word_hashes():
    texts = [None, "", " a\tB\x0bc ", "ß A\x1cb", "A" * 5000]
    hashes, n = words(pa.array(texts))
    assert n.tolist() == [0, 0, 3, 2, 1]
    split = [w for t in texts for w in (t or "").encode().lower().split()]
    table = collections.defaultdict(set)
    for w, h in zip(split, hashes.tolist()):
        table[w].add(h)
    assert all(len(h) == 1 for h in table.values()) and len({min(h) for h in table.values()}) == len(table)
    sliced, per = words(pa.array(texts).slice(2, 2))
    assert sliced.tolist() == hashes.tolist()[:5] and per.tolist() == [3, 2]


def test_many_blocks_are_read_by_word(monkeypatch):
    """Where bounds leave most blocks, a search asks for a range of postings a word, not one a word and block."""
    g = np.random.default_rng(5)
    n, width = 6400, 40
    dense = np.where(g.random((n, width)) < 0.07, g.random((n, width)), 0)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    rows, cols = np.nonzero(dense)
    index = nearest_toxic.BlockMaxIndex(rows, cols, dense[rows, cols], np.arange(n), np.zeros(n, int), width)
    q = np.full(width, width**-0.5)
    asked = []
    monkeypatch.setattr(nearest_toxic, "ragged", lambda starts, size, real=nearest_toxic.ragged: (asked.append(len(starts)), real(starts, size))[1])
    cosines, places = index.search(np.arange(width), q, 9)
    true = np.round(dense.astype(np.float32) @ q, 12)
    want = np.lexsort((np.arange(n), -true))[:9]
    assert index.ids[places].tolist() == want.tolist() and np.allclose(cosines, true[want], atol=1e-9)
    assert index.scored > index.n_blocks // 2 and sum(asked[1:]) <= 8 * width + 2 * width


ENCODERS = [(tokens.WordEncoder, "word_bpe_49k.json"), (tokens.SpacedEncoder, "byte_bpe_50k.json")]


def test_spaced_words_are_looked_up_once(monkeypatch):
    """A word costs one look a portion, however often its texts have it."""
    enc, texts = tokens.SpacedEncoder(P.path("byte_bpe_50k.json")), ["ka lomi, don't\nka\n" * 50, "", "lomi, ka  x\n\n", "ka <|endoftext|> \0\1 ka", " ka ka\t" * 9]
    looked = []
    monkeypatch.setattr(enc, "_learn", lambda words, learn=enc._learn: learn(looked.extend(words) or looked))
    ids = [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)]
    assert ids == [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert looked and len(looked) == len(set(looked)) < 20


def test_words_of_pieces_are_looked_up_once(monkeypatch):
    """The vocabulary that drops white space: a word costs one look a portion, too."""
    enc, texts = tokens.WordEncoder(P.path("word_bpe_49k.json")), ["ka lomi, don't\nka\n" * 50, "", "lomi, KA  x\n\n", "ka <|endoftext|> ka", " ka ka\t" * 9]
    looked = []
    monkeypatch.setattr(enc, "_learn", lambda words, learn=enc._learn: learn(looked.extend(words) or looked))
    ids = [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)]
    assert ids == [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert looked and len(looked) == len(set(looked)) < 20


class Recorded:
    """A tokenizer that notes the texts given to it."""

    def __init__(self, tokenizer, given):
        self.tokenizer, self.given = tokenizer, given

    def encode_batch_fast(self, texts, **more):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **more)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


@pytest.mark.parametrize(("kind", "name"), ENCODERS)
def test_marks_behind_a_word_cost_no_encoding_of_it(kind, name):
    """Whatever stands behind a word, the library gets its letters once."""
    enc, given = kind(P.path(name)), []
    texts = ["lomi, lomi### lomi!? lomi### lömi%% lomi", "x lomi... lömi&&&", "a lomi*)"]
    want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for own in {"tokenizer", "plain"} & set(vars(enc)):
        setattr(enc, own, Recorded(getattr(enc, own), given))
    found = [np.frombuffer(x, "<u4").tolist() for t in texts for x in enc.ids([t])]
    assert found == want
    # the first word of a text has no space before it, which counts to one of the vocabularies
    assert " ".join(given).count("lömi") == 1 and " ".join(given).count("lomi") == 1 + enc.SPACED


@pytest.mark.parametrize(("kind", "name"), ENCODERS)
def test_words_make_room_for_others(kind, name, monkeypatch):
    """Ids stay right when words are dropped, and words too long to keep are dropped with their texts."""
    monkeypatch.setattr(tokens, "KEPT_WORDS", 60)
    monkeypatch.setattr(tokens, "FIRST_WORDS", 20)
    enc, g = kind(P.path(name)), random.Random(3)
    words = ["".join(g.choices("aeklmoö", k=g.randint(1, 6))) + g.choice(["", "", ",", "##", "7"]) for _ in range(200)] + ["ka" * 40, "Lo" * 50 + "!!", "x1" * 30, "ЖЯ", "日本,"]
    for _ in range(60):
        texts = [" ".join(g.choices(words, k=g.randint(0, 9))).replace("##", "##" + g.choice(["", "\n"])) for _ in range(3)]
        ids, ends = enc.coded(texts, 0)
        want = [[*x.ids, 0] for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == sum(want, []) and np.diff(ends, prepend=0).tolist() == list(map(len, want))
        assert max(map(len, enc.kept)) <= tokens.LONGEST_KEPT and len(enc.kept) < 200 and list(enc.kept.values()) == list(range(len(enc.kept)))


@pytest.mark.parametrize(("kind", "name"), [(tokens.WordEncoder, "word_bpe_49k.json"), (tokens.SpacedEncoder, "byte_bpe_50k.json")])
def test_token_ids(kind, name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path(name))
    odd = ["  two  spaces ", "\n\nx\n\ny", "tab\tx", "don't 's", "İstanbul ΣΑΣ. é́x", "nb\xa0sp \xa0x", "a \n b", "x.\ny...", "1,2 3.4 a1b2", "\0\1x y", "é . ́x", "a b \x85c"]
    texts = [t or "" for _, t, *_ in DOCS] + odd
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(kind, P.path(name)).ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("kind", "name"), [(tokens.WordEncoder, "word_bpe_49k.json"), (tokens.SpacedEncoder, "byte_bpe_50k.json")])
def test_token_ids_of_random_texts(kind, name):
    """Added tokens, odd white space, marks and emoji, in any order."""
    from tokenizers import Tokenizer

    g = random.Random(6)
    pieces = ["a", "b", "The", "don't", "'s", "x1", "12", ".", ",", "...", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "é", "e\u0301", "\u0301", "İ", "ß", "Σ", "日本", "א", "😀", "👩‍💻", "\ufe0f", "\0", "\1"]
    plain = Tokenizer.from_file(P.path(name))
    texts = ["a\n\n<|endoftext|>b", "a  <|endoftext|>", *("".join(g.choices(pieces, k=g.randint(0, 14))) for _ in range(8000))]
    mine = tokens.encoder(kind, P.path(name)).ids(texts)
    assert [t for t, m, w in zip(texts, mine, plain.encode_batch(texts, add_special_tokens=False)) if np.frombuffer(m, "<u4").tolist() != w.ids] == []


def encoded(name, text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_shards(spark, docs):
    path = P.path("byte_bpe_50k.json")
    shards = Scratch(spark, "t").keep(repair_store.encode_shards(docs, path, shard_ids=5000), "shards")
    found = sorted(repair_store.read_documents(shards).collect(), key=lambda r: r.start)
    rows, at = sorted(((d, t or "") for d, t, *_ in DOCS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 0
    assert len(found) == len(rows)
    for r, (d, t) in zip(found, rows):
        ids = encoded("byte_bpe_50k.json", t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for s in shards.collect():
        whole = [repair_store.decode_document(s.asDict(), k) for k in range(len(s.doc_ids))]
        assert [len(x) for x in whole] == s.n_tokens
    assert repair_store.read_documents(repair_store.encode_shards(spark.createDataFrame([], NONE), path)).count() == 0


def test_repair_shortens_and_restores():
    g = np.random.default_rng(2)
    for symbols in (3, 70_000):
        n = g.integers(0, 400, 30)
        ids = np.repeat(g.integers(0, symbols, n.sum() // 5 + 1), 5)[: n.sum()].astype(np.uint32)
        rules, ends, body, start = repair_store.compress(ids, np.cumsum(n), symbols)
        table = repair_store.expansions(rules, ends, symbols)
        assert (repair_store._gather(body, symbols, *table) == ids).all() and len(body) < len(ids)
        # it ends when no pair pays for its rule
        inside = np.setdiff1d(np.arange(len(body) - 1), start[1:] - 1)
        pairs = collections.Counter(zip(body[inside].tolist(), body[inside + 1].tolist()))
        assert max(pairs.values()) < repair_store.LEAST_COUNT[2 if symbols < 0x10000 else 4] and symbols + len(rules) < 0x10000 or symbols > 0xFFFF
        for k in range(30):
            assert (repair_store._gather(body[start[k] : start[k + 1]], symbols, *table) == ids[n[:k].sum() : n[: k + 1].sum()]).all()


def test_packing(spark, docs):
    found = slack_packing.pack(spark, docs, P.path("word_bpe_49k.json")).collect()
    want = collections.Counter()
    for d, t, *_ in DOCS:
        ids = encoded("word_bpe_49k.json", t)
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[d, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert slack_packing.pack(spark, spark.createDataFrame([], NONE), P.path("word_bpe_49k.json")).count() == 0


def test_pieces_end_at_the_capacity(spark):
    """Documents whose ids, with the end id, fill pieces just so, or by one more or less."""
    sizes = [0, 6, 7, 8, 15, 16, 40]
    docs = spark.createDataFrame([(k, "a " * k) for k in sizes], "doc_id long, text string")
    found = sorted(slack_packing.pack(spark, docs, P.path("word_bpe_49k.json"), 8).collect(), key=lambda r: (r.doc_id, r.piece))
    want = []
    for k in sizes:
        ids = encoded("word_bpe_49k.json", "a " * k)
        want += [(k, a // 8, a, len(ids[a : a + 8]), zlib.crc32(ids[a : a + 8].tobytes())) for a in range(0, k + 1, 8)]
    assert [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found] == want


def test_fullest_is_fullest():
    r = random.Random(4)
    for _ in range(60):
        counts = {r.randint(1, 20): r.randint(1, 3) for _ in range(5)}
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        room = r.randint(1, 50)
        chosen = slack_packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in chosen.items())


def test_warc(spark, tmp_path):
    big, bigger = "x" * 1000, "<p>ä\r\n\r\nWARC/1.1\r\n" + "y" * 5000
    rows = [(k, f"http://h/{k}", h, "s", 1) for k, h in enumerate([None, "", "", "small", "small", big, big, big, bigger, bigger])]
    rows += [(20, None, big, None, None), (21, "http://h/" + "p" * 20_000, bigger, None, None), (21, "u", "other", None, None), (22, "a\r\nb", "z", None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, n int")
    recs = warc_store.records(pages)
    archive = warc_store.write_archive(Scratch(spark, "t"), recs)
    assert archive[0].count() == len({(h or "") for _, _, h, *_ in rows})
    import hashlib

    last = collections.defaultdict(int)
    for k, _, h, *_ in rows:
        last[h or ""] = max(last[h or ""], k)
    want = collections.Counter()
    for k, _, h, *_ in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and last[h or ""] != k
        want[k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None] += 1
    records = warc_store.read_archive(*archive)
    assert collections.Counter(map(tuple, warc_store.parse_records(records).collect())) == want
    for form in ("gzip", "none"):
        warc_store.write_warc(records, f"file://{tmp_path}/{form}", form)
        back = warc_store.read_warc(spark, f"file://{tmp_path}/{form}")
        assert collections.Counter(map(tuple, warc_store.parse_records(back).collect())) == want
    from pyspark.sql import functions as F

    broken = archive[0].withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    with pytest.raises(Exception, match="payload without its digest"):
        warc_store.read_archive(broken, archive[1]).collect()
    with pytest.raises(Exception, match="no payload of digest"):
        warc_store.read_archive(archive[0].limit(0), archive[1]).collect()
    assert warc_store.parse_records(warc_store.read_archive(*warc_store.write_archive(Scratch(spark, "t"), warc_store.records(pages.limit(0))))).count() == 0


@contextlib.contextmanager
def _settings(spark, **values):
    """Settings of the session for a while."""
    names = {"threshold": "spark.sql.autoBroadcastJoinThreshold", "coalesce": "spark.sql.adaptive.coalescePartitions.enabled"}
    before = {names[k]: spark.conf.get(names[k]) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_warc_shuffles_payloads_once(spark):
    r = random.Random(3)
    texts = [base64.b64encode(r.randbytes(15_000)).decode() for _ in range(150)]
    pages = spark.createDataFrame([(k, "u", texts[k % 150]) for k in range(160)], "page_id bigint, url string, html string")
    with _settings(spark, threshold="-1"):
        before = _shuffled(spark)
        archive = warc_store.write_archive(Scratch(spark, "t"), warc_store.records(pages), warc_store.contents(pages))
        got = warc_store.parse_records(warc_store.read_archive(*archive)).collect()
        moved = _shuffled(spark) - before
    assert {r.page_id: r.refers_to for r in got} == {k: k + 150 if k < 10 else None for k in range(160)}
    assert moved < 1.5 * sum(map(len, texts))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weft_")]


def test_warc_deals_a_popular_payload(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(warc_store, "MANY", 50)
    htmls = [None] * 600 + ["small"] * 51 + ["other"] * 50 + ["z" * 2000] * 60 + [f"page {k}" for k in range(40)]
    # the last ones are one row many times, so that their headers are equal too
    rows = [(k, "u", h) for k, h in enumerate(htmls)] + [(5000, "u", "copy")] * 300
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    with _settings(spark, threshold="-1", coalesce="false"):
        archive = warc_store.write_archive(Scratch(spark, "t"), warc_store.records(pages), warc_store.contents(pages))
        records = warc_store.read_archive(*archive)
        parsed = warc_store.parse_records(records)
        got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in parsed.collect())
        dealt = [parsed.filter(which).groupBy(F.spark_partition_id()).count().count() for which in ("payload_bytes = 0", "page_id = 5000")]
        with pytest.raises(Exception, match="no payload of digest"):
            warc_store.read_archive(archive[0].filter("octet_length(payload) > 0"), archive[1]).collect()
    last = max(k for k, h in enumerate(htmls) if h and len(h) == 2000)
    sizes = [(k, len(h or "")) for k, _, h in rows]
    assert got == collections.Counter((k, n, *(("revisit", last) if n == 2000 and k != last else ("response", None))) for k, n in sizes)
    assert min(dealt) > 1


def test_neighbours(spark):
    g = np.random.default_rng(1)
    good = {k: g.normal(size=24) for k in range(0, 600)}
    good[700] = good[50] * 3
    for k in range(701, 720):
        good[k] = good[100]
    good[720], good[721], good[750] = np.ones(24) * 1e-200, np.ones(24) * 1e200, np.ones(7)
    rows = [(k, [float(x) for x in v], "l", 1) for k, v in good.items()]
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    rows += [(800 + 50 * k, v, None, None) for k, v in enumerate(bad)] + [(None, [1.0] * 24, "l", 1), rows[100], rows[0]]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, query string, score int").repartition(3)
    found = collections.defaultdict(list)
    for r in cross_polytope.search(spark, vectors, vectors.filter("vec_id % 50 = 0")).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    unit = {k: v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for k, v in good.items()}
    for q in [k for k in good if k % 50 == 0]:
        best = sorted((-float(unit[q] @ unit[k]), k) for k in good if k != q and len(good[k]) == len(good[q]))[:5]
        own = sorted(found.pop(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and q not in [v for _, v, _ in own]
        assert all(abs(s - float(unit[q] @ unit[v])) < 1e-12 for _, v, s in own)
        hits, total = hits + len({v for _, v, _ in own} & {k for _, k in best}), total + len(best)
    assert not found and hits >= 0.9 * total
    assert cross_polytope.search(spark, vectors.limit(0), vectors.limit(0)).count() == 0


def test_neighbours_of_a_table_that_grew(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "PROBES", 2)
    monkeypatch.setattr(cross_polytope, "STEADY", 250, raising=False)
    x = np.random.default_rng(5).standard_normal((8000, 32))
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    found = collections.defaultdict(set)
    for r in cross_polytope.search(spark, table, table.filter("vec_id % 200 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(unit[::200] @ unit.T), 1)[:, 1:6]
    hits = sum(len(found[200 * q] & set(near[q].tolist())) for q in range(40))
    assert hits >= 0.9 * 200


def toxic_rows(n=900):
    r = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        w = [r.choice(VOCABULARY) for _ in range(30)]
        if k % 6 == 0:
            for _ in range(3):
                w.insert(r.randint(0, 30), r.choice(["Zut!", "fie,", "bah"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 6 == 0), "x"))
    return rows, labels


def test_toxicity(spark, docs):
    from pyspark.sql import functions as F

    rows, labels = toxic_rows()
    # 900 and 901 repeat a text, 902 an id with its text
    rows += [(900, rows[12][1]), (901, rows[13][1]), (902, rows[14][1]), (902, rows[14][1])]
    odd = [(None, None), (2000, ""), (2001, LONG)]
    table = spark.createDataFrame([*rows, *odd], "doc_id bigint, text string").withColumn("toxic", F.lit("clash")).withColumn("held_out", F.lit(7)).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1, "x"), (1, None, "x"), (5000, 1, "x"), (902, 0, "x")], "doc_id bigint, toxic int, text string")
    model = nearest_toxic.fit(spark, table, marks)
    every = nearest_toxic.scored(spark, table, model).collect()
    found = {x.doc_id: x for x in every}
    assert len(every) == 907 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in every)
    assert len({x.score for x in every if x.doc_id == 902}) == 1 and found[900].score == found[12].score
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(900))
    assert all(found[k].predicted == (k % 6 == 0) for k in range(900)) and found[2000].predicted == 0
    # nearly every text meets neighbours, and the toxic ones are told by what they share
    assert all(found[k].evidence for k in range(900)) and all(e.toxic for k in range(0, 900, 6) for e in found[k].evidence)
    # labels of the held-out fold change nothing
    other = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = nearest_toxic.fit(spark, table, other)
    assert (again.hashes == model.hashes).all() and (again.index.labels == model.index.labels).all() and (again.weights == model.weights).all()
    empty = nearest_toxic.fit(spark, table.limit(0), marks.limit(0))
    assert nearest_toxic.scored(spark, docs, empty).filter("predicted = 1").count() == 0
    assert nearest_toxic.scored(spark, docs.limit(0), model).count() == 0


def test_toxicity_scores_against_brute_force(spark):
    """Weights, cosines, votes and the curve computed anew with dictionaries from the texts."""
    import math

    rows, labels = toxic_rows(240)
    rows += [(k, t) for k, t in enumerate(TEXTS[5:12], 1000)]
    table, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, x string")
    model = nearest_toxic.fit(spark, table, marks, k=7)
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if w]
    label = {k: y for k, y, _ in labels if zlib.crc32(str(k).encode()) % 5}
    places, df = collections.defaultdict(dict), collections.Counter()
    for k, t in rows:
        df.update(set(split(t)))
    for k, t in rows:
        if k in label:
            w = split(t)
            for a, b, c in zip([None, *w], w, [*w[1:], None]):
                places[b].setdefault((a, c), []).append(label[k])
    n = {w: len(p) for w, p in places.items()}
    one = {w: sum(min(x) for x in p.values()) for w, p in places.items()}
    base = math.log((sum(one.values()) + 0.5) / (sum(n.values()) - sum(one.values()) + 0.5))
    weight = {w: (math.log((len(rows) + 1) / (df[w] + 1)) + 1) * (0.1 + max(0, math.log((one[w] + 0.5) / (n[w] - one[w] + 0.5)) - base - 2 * math.sqrt(1 / (one[w] + 0.5) + 1 / (n[w] - one[w] + 0.5)))) for w in n}
    mine = {int(h): w for h, w in zip(model.hashes, model.weights)}
    hashed = {w: int(words(pa.array([w.encode()], pa.binary()))[0][0]) for w in n}
    assert set(hashed.values()) == set(mine)
    assert max(abs(mine[hashed[w]] - weight[w]) for w in n) < 1e-9

    def vector(t):
        raw = {w: (1 + math.log(c)) * mine[hashed[w]] for w, c in collections.Counter(split(t)).items() if w in n}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        return {w: x / norm for w, x in raw.items()}

    vectors = {k: vector(t) for k, t in rows}
    for r in nearest_toxic.scored(spark, table, model).collect():
        v = vectors[r.doc_id]
        near = sorted((-round(sum(x * vectors[k].get(w, 0) for w, x in v.items()), 9), k) for k in label)
        near = [(-c, k) for c, k in near if c < 0][:7]
        if not near:
            assert abs(r.score - model.prior) < 1e-12
            continue
        vote = sum(label[k] / (0.1 + 1 - c) for c, k in near) / sum(1 / (0.1 + 1 - c) for c, k in near)
        want = 1 / (1 + math.exp(-(model.slope * math.log((vote + 0.02) / (1.02 - vote)) + model.shift)))
        assert abs(r.score - want) < 1e-6 and [e.doc_id for e in r.evidence] == [k for _, k in near[:3]]


def test_toxicity_is_the_same_however_rows_are_dealt(spark):
    rows, labels = toxic_rows(400)
    table, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, x string")
    found = []
    for dealt in (table.coalesce(1), table.repartition(3), table.repartition(7, "text").sortWithinPartitions("text")):
        model = nearest_toxic.fit(spark, dealt, marks)
        found.append((dict(zip(model.hashes.tolist(), model.weights.tolist())), sorted(tuple(r) for r in nearest_toxic.scored(spark, dealt, model).drop("evidence").collect())))
    assert found[0] == found[1] == found[2]


def test_an_example_with_many_copies_is_judged_by_k_others():
    g = np.random.default_rng(4)
    own = {k: g.choice(40, 6, replace=False) for k in range(100)}
    rows = np.concatenate([np.full(6, k) for k in own] + [np.full(6, k) for k in range(100, 150)])
    word = np.concatenate([own[k] for k in own] + [own[0]] * 50)
    index = nearest_toxic.BlockMaxIndex(rows, word, np.full(len(word), 6**-0.5, np.float32), np.arange(150), np.arange(150) % 2, 40)
    cosines, places = index.search(np.sort(own[0]), np.full(6, 6**-0.5), 10, but=0)
    want = sorted((-round(len(set(own[0]) & set(own[k])) / 6, 6), k) for k in range(1, 100))[:10]
    assert [(-round(c, 6), index.ids[p]) for c, p in zip(cosines.tolist(), places.tolist())] == want


def test_block_max_search_is_exact():
    g = np.random.default_rng(3)
    n, width = 500, 40
    dense = np.zeros((n, width))
    for k in range(n):
        # two kinds without a word in common
        dense[k, g.choice(width // 2, 6, replace=False) + k % 2 * (width // 2)] = g.random(6)
    dense[17] = dense[23]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    # weights are kept in 32 bits
    dense = dense.astype(np.float32).astype(float)
    ids = g.permutation(n)
    rows, cols = np.nonzero(dense)
    index = pickle.loads(pickle.dumps(nearest_toxic.BlockMaxIndex(rows, cols, dense[rows, cols], ids, np.zeros(n, int), width)))
    for q in dense[:60]:
        brute = sorted((-round(float(c), 12), int(d)) for c, d in zip(dense @ q, ids))
        want = [(-c, d) for c, d in brute if c < 0][:9]
        at = np.flatnonzero(q)
        cosines, places = index.search(at, q[at], 9)
        assert index.ids[places].tolist() == [d for _, d in want] and np.allclose(cosines, [c for c, _ in want], atol=1e-7)
    # alike vectors share blocks, so blocks of the other kind aren't read
    assert index.scored < 60 * index.n_blocks
    assert len(nearest_toxic.alike_order(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0)) == 0


def test_html():
    page = """<html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <nav><ul><li><a href=/a>One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice">We use cookies, many of them indeed.</div>
    <article><h1>A &amp; B</h1><p>First&nbsp;part, <b>bold <a href="x">link</a></b>,
    of   some words.<!-- <p>no</p> --><p>Second.<div class="comments"><p>Nice one said a reader here today.</p></div><p>Third &lt;x&gt;</article>
    <aside>More things to read elsewhere on this site.</aside><form>Your mail <input> <button>Go</button></form><footer>&copy; someone, all rights reserved</footer></body>"""
    assert html_blocks.main_text(page) == "A & B\nFirst part, bold link, of some words.\nSecond.\nThird <x>"
    plain = "<body><div><a href=1>Home</a> <a href=2>News</a></div><div>" + "Many words stand here in a row. " * 8 + "</div><div>" + "And more of them follow after that. " * 8 + "</div>"
    assert html_blocks.main_text(plain).count("\n") == 1
    for odd in (None, "", "<", "<p", "text only <b", "<article><p>" + "a " * 100_000, "<!-- open", "<script>open", '<a href="x' * 2000):
        assert isinstance(html_blocks.main_text(odd), str)
    assert all(html_blocks.is_main(row[:-1]) == row[-1] for row in html_blocks.labelled_rows())


class Slow(__import__("html.parser").parser.HTMLParser):
    """Blocks of the first article of a well-formed page, without those in named or semantic other parts; by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.now = [], [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.found.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        if tag in html_blocks.BLOCK:
            self.cut()
        if tag not in html_blocks.VOID:
            self.stack.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in html_blocks.BLOCK:
            self.cut()
        while self.stack and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        names = [t for t, _ in self.stack]
        if "article" in names and not {"script", "style", "aside", "form", "footer", "nav"} & set(names) and not any(c in ("comments", "ad") for _, c in self.stack[names.index("article") :]):
            self.now.append(data)


def test_html_against_another_parser():
    r = random.Random(11)
    say = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    for k in range(60):
        inner = [f"<h1>{say(r.randint(1, 12))}</h1>"]
        for _ in range(r.randint(1, 12)):
            kind = r.randint(0, 8)
            text = say(r.choice([1, 2, 5, 20, 60, 150]))
            inner.append([f"<p>{text}</p>", f"<p>{text} <a href=x>{say(2)}</a> &amp; {say(9)}</p>", f"<p><b>{text}</b><br>{say(3)}</p>", f"<ul><li>{text}</li><li>{say(4)}</li></ul>", f"<div class=comments><p>{text}</p></div>", f"<div class='ad'>{text}</div>", f"<form>{text}</form>", f"<div id=social-history><p>{text}</p></div>", f"<blockquote>{text}</blockquote>"][kind])
        page = f"<html><body class='post-comments-enabled'><nav><a href=1>{say(1)}</a><a href=2>{say(2)}</a></nav><div class='ad'>{say(9)}</div><div class='post-comments-enabled'><article>{''.join(inner)}</article></div><script>var a='<p>no</p>'</script><footer>{say(9)}</footer></body></html>"
        slow = Slow()
        slow.feed(page)
        slow.close()
        assert html_blocks.main_text(page) == "\n".join(slow.found), k


ARTICLE = "<article><h1>A title of it</h1><p>Some words that stand here.</p><p>Two.</p></article>"


@pytest.mark.parametrize("page", [
    f'<div class="post-comments-enabled">{ARTICLE}</div>', f"<nav><button>Menu</nav>{ARTICLE}<button>x</button>", f"<select><option>{ARTICLE}", f"<noscript>{ARTICLE}", f"<svg>{ARTICLE}", f"<template>{ARTICLE}",
    f"<iframe src=x>{ARTICLE}", f"<noscript><p>Turn it on, this page needs it to be of use.</p></noscript>{ARTICLE}", f"{ARTICLE}<div class='comments'><p>{'Nice one said a reader. ' * 9}</p></div>", f"<aside><p>{'Other things. ' * 30}</p></aside>{ARTICLE}",
])
def test_html_keeps_an_article_whatever_is_around_it(page):
    assert html_blocks.main_text(page).replace("a\n", "") .endswith("A title of it\nSome words that stand here.\nTwo.")
    assert not re.search("reader|Other things|Turn it on", html_blocks.main_text(page))


def test_html_without_an_article_goes_by_words_and_links():
    words_ = lambda n: " ".join(["word"] * n)
    link = lambda n: f"<a href=x>{' '.join(['link'] * n)}</a>"
    page = f"<div>{link(2)}</div><div>{link(3)}</div><h1>{words_(8)}</h1><p>{words_(70)}</p><p>{words_(45)} {link(3)}</p><p>{words_(9)}</p><p>{words_(80)}</p><div>{link(4)} {words_(1)}</div><div>{link(2)}</div>"
    assert [len(x.split()) for x in html_blocks.main_text(page).split("\n")] == [8, 70, 48, 9, 80]
    used = set()

    def walk(node):
        if isinstance(node, tuple):
            used.add(html_blocks.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(html_blocks._tree())
    assert {"words", "links", "words_before", "links_before", "words_after", "links_after"} <= used


WORDS, REPLY = " ".join(f"wort{k}" for k in range(60)), " ".join(f"reply{k}" for k in range(40))
PAGE = f"<nav><a>x</a></nav><article><p>{WORDS}</p></article>"
NAMED = "reader-comments user-comments responses discussion disqus_thread js-comments c-comments cookie-law-info adsbygoogle entry-meta comments".split()


@pytest.mark.parametrize("page", [
    *(f"{PAGE}<div class='{c}'><p>{REPLY}</p></div>" for c in NAMED), *(f"<article><p>{WORDS}</p><div id={c}><p>{REPLY}</p></div></article>" for c in NAMED), *(f"<div><p>{WORDS}</p></div><div class={c}><p>{REPLY}</p></div>" for c in NAMED),
    f"<article><p>{WORDS}</p><div hidden><p>{REPLY}</p></div></article>", f"<article><p>{WORDS}</p><div style='color:red; display: none'><p>{REPLY}</p></div></article>",
    f"{PAGE}<section class=comments><article class=comment><p>{REPLY}</p></article></section>", f"{PAGE}<section class=comments><article><p>{REPLY}</p></article></section>",
    f"<form action=x><input type=hidden name=v>{PAGE}</form>", f"<form action=x><div><p>{WORDS}</p></div></form>", f"{PAGE}<form><p>{REPLY}</p><input><input><textarea></textarea></form>",
    f"<div class='site has-sidebar comments-open'>{PAGE}</div>", f"<div class='content-sidebar-wrap'>{PAGE}</div>", f"<div class='kit-widget kit-widget-theme-content'><p>{WORDS}</p></div>", f"<article class='post category-discussion'><p>{WORDS}</p></article>",
])
def test_html_of_common_shapes(page):
    assert html_blocks.main_text(page) == WORDS


def test_html_of_elements_never_closed_takes_time_in_proportion():
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        html_blocks.blocks("<div><p>x</section>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2


def test_html_frame(spark):
    rows = [(1, "u", None, 1), (2, None, "<article><p>é</p></article>", 2), (2, None, "<article><p>é</p></article>", 2), (None, "u", "", 3)]
    rows.append((5, "u", "<p>" + "many words " * 200_000, 4))
    found = html_blocks.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")).collect()
    assert sorted(key(r.page_id, r.n_chars) for r in found) == sorted([key(1, 0), key(2, 1), key(2, 1), key(None, 0), key(5, 11 * 200_000 - 1)])
    assert html_blocks.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_language_model(spark, docs):
    found = brown_lm.score_texts(spark, docs, classes=3, core_words=20, table_words=40).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    counts = collections.Counter()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    for d, t, *_ in DOCS:
        if not held(d):
            counts.update(tok(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((key(d), held(d), len(tok(t)), sum(counts[w] > 0 for w in tok(t)), n, round(float(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tok(t))), 4)) for d, t, *_ in DOCS)
    assert sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in found)
    assert brown_lm.score_texts(spark, spark.createDataFrame([], NONE)).count() == 0


def test_language_model_scores_against_a_plain_model(spark, docs):
    """The sum over tokens of the class's and the word's probability, with dictionaries and one pass from left to right."""
    from pyspark.sql import functions as F

    table = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    rows = {r.doc_id: r.text for r in table.collect()}
    training = table.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).select(F.col("text").cast("binary").alias("text"))
    _, lexicon = brown_lm.word_classes(spark, Scratch(spark, "t"), training, classes=3, core_words=20)
    known = {r.key: (r.n, r["class"]) for r in lexicon.collect()}
    hashed = lambda t: [int(h) for h in words(pa.array([(t or "").encode()], pa.binary()))[0].view(np.int64)]
    counted = collections.Counter(h for d, t in rows.items() if not held(d) for h in hashed(t))
    assert {h: n for h, (n, _) in known.items()} == counted
    of_class = collections.Counter()
    for n, c in known.values():
        of_class[c] += n
    END, NEW = 3, 4

    def steps(text):
        before = END
        for h in [*hashed(text), None]:
            now = END if h is None else known[h][1] if h in known else NEW
            yield before, now, h
            before = before if now == NEW else now

    moves = collections.Counter((b, c) for d, t in rows.items() if not held(d) for b, c, _ in steps(t))
    total = {b: sum(moves[b, c] + brown_lm.ALPHA for c in range(5)) for b in range(4)}
    for r in brown_lm.score_texts(spark, table, classes=3, core_words=20, table_words=30).collect():
        want = sum(np.log10((moves[b, c] + brown_lm.ALPHA) / total[b]) + (np.log10(known[h][0] / of_class[c]) if c < END else 0) for b, c, h in steps(rows[r.doc_id]))
        assert r.score == pytest.approx(want, abs=1e-6) and r.perplexity == pytest.approx(10 ** (-want / r.n_tokens))


def test_language_model_has_classes_for_all_words(spark, docs):
    few, all_ = ({x.doc_id: x for x in brown_lm.score_texts(spark, docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), classes=3, core_words=20, table_words=most).collect()} for most in (25, 10**6))
    assert few.keys() == all_.keys()
    for d, x in few.items():
        assert x[:5] == all_[d][:5] and (x.base_score, x.score) == pytest.approx((all_[d].base_score, all_[d].score), abs=1e-6)


def test_language_model_beats_single_words(spark):
    r = random.Random(2)
    kinds = [[f"{c}{k}" for k in range(30)] for c in "abc"]
    rows = [(d, " ".join(r.choice(kinds[(k + d) % 3]) for k in range(60)), None) for d in range(300)]
    found = [x for x in brown_lm.score_texts(spark, spark.createDataFrame(rows, NONE), classes=4, core_words=50).collect() if x.held_out]
    assert found and sum(x.score for x in found) > sum(x.base_score for x in found) + 0.2 * sum(x.n_tokens for x in found)


def test_exchange_finds_planted_classes():
    g = np.random.default_rng(8)
    n = 40
    rates = np.where((np.arange(n)[:, None] % 2) != (np.arange(n)[None] % 2), 30.0, 1.0)
    bigrams = np.zeros((n + 1, n + 1))
    bigrams[:n, :n] = g.poisson(rates)
    own = brown_lm.exchange(bigrams[np.ix_([*range(0, n, 2), *range(1, n, 2), n], [*range(0, n, 2), *range(1, n, 2), n])], 2)[:n]
    assert len(set(own[: n // 2])) == 1 and len(set(own[n // 2 :])) == 1 and own[0] != own[-1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    rows = []
    for k in range(400):
        w = [r.choice(VOCABULARY) + str(r.randint(0, 30)) for _ in range(60)]
        if k % 8 == 0:
            w[5], w[20], w[40] = "zut", "fie", "bah"
        rows.append((k, " ".join(w), "en", f"s{k % 3}", 1))
    rows += [(400 + k, rows[k + 1][1], "en", "s0", 1) for k in range(3)] + [(500, edited(rows[9][1], 1), "en", "s1", 1), (501, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, Scratch(spark, "t").keep(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before
        kept.append(collections.Counter(x.doc_id for x in docs.collect()))
    toxic = {k for k in range(400) if k % 8 == 0}
    assert not toxic & set(kept[0]) and set(kept[0]) == {x[0] for x in rows} - toxic
    assert {1, 2, 3} & set(kept[1]) == set() and {400, 401, 402} <= set(kept[1]) and len(kept[1]) == len(kept[0]) - 3
    assert 500 not in kept[2] and 9 in kept[2] and len(kept[2]) == len(kept[1]) - 1
    assert set(kept[3]) <= set(kept[2]) and max(kept[3].values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert collections.Counter(x.doc_id for x in packed.filter("piece = 0").collect()) == kept[3]


def test_pipeline_with_odd_tables(spark, tmp_path):
    """An empty table, empty labels, null and repeated ids, columns with names that stages use inside; against brute force."""
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, name bigint, size string, _sha string, label int, component_id bigint"
    odd = [(1, "a b c d e f g"), (1, "other words of the same id here"), (2, "other words of the same id here"), (None, None), (None, "a null id with words of its own"), (7, ""), (8, None), (8, None), (9, BASE[4]), (10, edited(BASE[4], 1))]
    for n, rows in enumerate(([], odd)):
        d = f"{tmp_path}/{n}"
        spark.createDataFrame([(k, t, None, "ab"[(k or 0) % 2], 1, k, "x", "x", 1, 1) for k, t in rows], schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = Scratch(spark, "t").keep(stage(spark, docs, d), name)
            kept.append(collections.Counter((x.doc_id, x.text) for x in docs.collect()))
        assert kept[0] == collections.Counter(rows)
        largest = {}
        for k, t in rows:
            largest[t or ""] = max(largest.get(t or "", -1), -1 if k is None else k)
        want = {(k, t or "") for k, t in rows if largest[t or ""] == (-1 if k is None else k)}
        assert {(k, t or "") for k, t in kept[1]} == want and all(v == 1 for v in kept[1].values())
        if rows:
            # rows by number, in the order in which one of a group stays
            inside = sorted(kept[1], key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).hexdigest()))
            groups = brute_components([(k, t) for k, (_, t) in enumerate(inside)])
            assert sorted(key(*x) for x in kept[2]) == sorted(key(*inside[d[1]]) for d, _, c in groups if d == c)
        assert set(kept[3]) <= set(kept[2])
        packed = corpus_pipeline.run(spark, d).collect()
        assert sum(x.piece == 0 for x in packed) == sum(kept[3].values())


def test_near_copies_are_told_by_row_where_ids_repeat(spark):
    import corpus_pipeline

    r = random.Random(8)
    texts = [" ".join(r.choices(VOCABULARY, k=60)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (0, texts[1] + " more"), (0, texts[2]), (2, texts[2] + " more"), (2, texts[3]), (3, texts[3] + " x"), (3, texts[3] + " y"), (None, texts[4]), (None, texts[4] + " z"), (4, texts[5]), (4, texts[5]), (5, ""), (6, None)]
    table = spark.createDataFrame([(k, t, "own") for k, t in rows], "doc_id bigint, text string, row string")
    # the texts that are near copies are those with one beginning
    groups = collections.defaultdict(list)
    for n, (k, t) in enumerate(rows):
        groups[t[:40] if t else n].append(((k is None, k or 0, hashlib.sha256((t or "").encode()).hexdigest()), k, t))
    want = sorted((key(*min(g)[1:]) for g in groups.values()))
    got = corpus_pipeline.drop_near_copies(spark, table.repartition(3), "")
    assert got.columns == table.columns
    assert sorted(key(x.doc_id, x.text) for x in got.collect()) == want


def test_exchange_only_gains():
    g = np.random.default_rng(6)
    bigrams = g.poisson(2.0, (25, 25)).astype(float)

    def likelihood(own):
        one = np.eye(5)[own]
        grid = one.T @ bigrams @ one
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(grid) - f(grid.sum(0)) - f(grid.sum(1))

    steps = [likelihood(brown_lm.exchange(bigrams, 4, passes)) for passes in range(5)]
    assert all(b >= a - 1e-9 for a, b in zip(steps, steps[1:])) and steps[-1] > steps[0]
