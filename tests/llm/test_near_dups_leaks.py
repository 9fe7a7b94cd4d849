import random

from kestrel.functions.tokens import tokenize
from kestrel.llm import leaks, near_dups


def _jaccard(a, b):
    x, y = set(zip(a, a[1:], a[2:])), set(zip(b, b[1:], b[2:]))
    return len(x & y) / len(x | y)


CHUNKS = "chunk_id bigint, text string, parent string, extra string"


def _chunks(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CHUNKS)


def test_join_equals_brute_force(spark):
    rng = random.Random(3)
    words = [a + b for a in "bcdfgh" for b in ("alpha", "eta", "iota", "omega")]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(36, 140))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 2)] = [rng.choice(words)] * rng.randint(0, 2)
            texts.append(" ".join(t))
    hot = " ".join(rng.choice(words) for _ in range(60))
    texts += [hot] * 30
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(5, texts[5], None), (900, "# in A:\n" + texts[0], "A"), (901, "# in B:\n" + texts[0], None), (902, None, None), (903, "", "p"), (904, "short text", None), (905, " ".join(words * 900), None)]
    got = {tuple(r) for r in near_dups.near_pairs(_chunks(spark, rows)).collect()}
    toks = {}
    for i, t, p in rows:
        if t and p and t.startswith("# in "):
            t = t[t.index("\n") + 1 :]
        k = tokenize(t or "")
        if len(k) >= 40:
            toks[i] = k
    ids = sorted(toks)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if toks[a] == toks[b] or _jaccard(toks[a], toks[b]) >= 0.7 - 1e-12}
    assert got == want and len(want) > 435
    links = near_dups.near_links(_chunks(spark, rows)).collect()
    assert {r.chunk_id for r in links} == {x for p in want for x in p}
    assert near_dups.near_pairs(_chunks(spark, rows).where("false")).count() == 0


def test_table_size_is_bounded():
    assert near_dups.table_bits(0) == near_dups.MIN_BITS and near_dups.table_bits(10**15) == near_dups.MAX_BITS
    import numpy as np

    row = np.zeros(1 << near_dups.BLOCK_BITS, np.uint8)
    row[[0, 5, 70_000, 131_071]] = [1, 255, 3, 9]
    at, n = near_dups._unpacked(near_dups._packed(row))
    assert at.tolist() == [0, 5, 70_000, 131_071] and n.tolist() == [1, 255, 3, 9]


def _verified(a, b, threshold=0.7):
    """What both rounds of verification make of a pair; the second is asked only where the first can't tell."""
    import pyarrow as pa

    def ask(x, y, exact):
        batch = pa.RecordBatch.from_pydict({"rep_a": [1], "rep_b": [2], "n_a": [len(a)], "n_b": [len(b)], "set_a": [x], "set_b": [y]})
        return [r["similarity"] for out in near_dups._verify([batch], threshold, exact) for r in out.to_pylist()]

    got = ask(near_dups.low_bits(a), near_dups.low_bits(b), False)
    return ask(a, b, True) if got == [None] else got


def test_pairs_at_the_threshold_are_kept_however_long():
    import numpy as np

    rng = np.random.default_rng(7)
    for n in (50, 4_000, 400_000):
        for _ in range(5):
            pool = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
            rng.shuffle(pool)
            need = int(near_dups.needed(np.array(n), np.array(n), 0.7))
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:need], pool[n : 2 * n - need]]))
            assert len(b) == n and len(_verified(a, b)) == 1
            assert near_dups.most_shared([near_dups.parts_of(a)], [near_dups.parts_of(b)])[0] >= need
            assert _verified(a, np.sort(np.concatenate([pool[: need - 1], pool[n : 2 * n - need + 1]]))) == []


def test_suffix_filter_bounds_the_overlap():
    import numpy as np

    rng = np.random.default_rng(8)
    rejected = 0
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 2**64, rng.integers(40, 3000), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: rng.integers(0, len(a))]]))
        most = near_dups.most_shared([near_dups.parts_of(a)], [near_dups.parts_of(b)])[0]
        assert most >= len(np.intersect1d(a, b))
        rejected += most < near_dups.needed(np.array(len(a)), np.array(len(b)), 0.7)
    assert rejected > 100


def test_tokens_of_bytes_are_the_tokens_of_the_pattern():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abzABZ019 _é.ß\U0001f600\n") for _ in range(rng.randrange(80))) for _ in range(2000)] + ["", "HTTPServerError fetchUserById user_id X", "a" * 3000]
    known = {}
    for t, h in zip(texts, near_dups.token_hashes(texts)):
        tokens = tokenize(t)
        assert len(tokens) == len(h)
        for w, x in zip(tokens, h.tolist()):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known) > 200


def test_coded_counters_keep_their_order():
    import numpy as np

    n = np.unique(np.concatenate([np.arange(200), np.logspace(2, 10, 500).astype(np.int64)]))
    c = near_dups.coded(n)
    assert (np.diff(c.astype(int)) >= 0).all() and (c[:65] == np.arange(65)).all() and c[n > 10**6].min() > c[n < 10**5].max()
    assert (np.abs(near_dups.decoded(c) / np.maximum(n, 1) - 1)[n > 0][c[n > 0] < 255] < 0.1).all()


def test_frequent_shingles_meet_in_blocks(spark):
    """Blocks of postings give the pairs of one large group, each once."""
    rng = random.Random(5)
    rows = [(i, rng.randint(40, 44), [7, 1000 + i % 9], [0, 1], [4, 1]) for i in range(90)]
    reps = spark.createDataFrame(rows, "rep bigint, n int, grams array<bigint>, places array<int>, blocks array<int>")
    one = reps.selectExpr("rep", "n", "grams", "places", "array(1, 1) AS blocks")
    got = sorted(tuple(r) for r in near_dups.met_pairs(reps, 0.7).collect())
    assert got == sorted(tuple(r) for r in near_dups.met_pairs(one, 0.7).collect()) and len(got) == len(set(got)) == 90 * 89 // 2


def test_leaks(spark):
    p = [f"word{i}" for i in range(40)]
    passage = " ".join(p)
    cases = spark.createDataFrame([(1, passage, "r", "test"), (2, passage, "r", "test"), (3, None, "r", "test"), (4, "too short", "r", "x"), (5, " ".join(f"other{i}" for i in range(20)), "s", "x")], "case_id bigint, passage string, repo string, split string")
    docs = [
        (1, "Before. " + " ".join(p[5:18]).upper() + " after"), (2, "x " + " ".join(p[5:17]) + " y"), (3, "> " + "\n> ".join(p[10:30])), (4, "<b>" + "</b>, <b>".join(p[3:20]) + "</b>"),
        (5, None), (6, ""), (7, "a b c"), (8, " ".join(["noise"] * 50_000 + p + ["noise"] * 1000)), (1, "Before. " + " ".join(p[5:18]).upper() + " after"),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, repo string")
    got = sorted(tuple(r) for r in leaks.leaked(df, cases).collect())
    assert got == [(c, d) for c in (1, 2) for d in (1, 3, 4, 8)]
    rep = {r.case_id: r.n_exact for r in leaks.leak_report(df, cases).collect()}
    assert rep == {1: 4, 2: 4}
    assert leaks.leaked(df.where("false"), cases).count() == 0 and leaks.leaked(df, cases.where("false")).count() == 0


def _edited(rng, words, vocabulary, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice(vocabulary)
        elif kind == 1:
            out.insert(k, rng.choice(vocabulary))
        else:
            del out[k]
    return out


def test_edited_passages_are_found(spark):
    """At least 0.9 of the documents that brute force finds similar to a whole passage; a plain lookup of equal windows would find no whole one."""
    import numpy as np

    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(3000)] + ["the", "of", "a", "to", "in"] * 300
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(45, 130))] for _ in range(60)]
    cases = spark.createDataFrame([(k, " ".join(p), "r", "s") for k, p in enumerate(passages)], "case_id bigint, passage string, repo string, split string")
    docs = []
    for n in range(240):
        lead, tail = ([rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] for _ in range(2))
        docs.append((n, lead + _edited(rng, passages[n % 60], vocabulary, 1 + n // 60) + tail))
    index = leaks.PassageIndex([([k], leaks.word_hashes(" ".join(p))) for k, p in enumerate(passages)])
    truth = {}
    for n, words in docs:
        h, p = np.array(leaks.word_hashes(" ".join(words)), dtype=np.uint64), n % 60
        size = len(passages[p])
        truth[n] = max(index.similarity(set(leaks.shingle_hashes(h[max(0, a) : a + size]).tolist()), p) for a in range(-9, len(h) - size + 10))
    want = {n for n, x in truth.items() if x >= leaks.SIMILARITY}
    got = {r.doc_id: r.similarity for r in leaks.matches(spark.createDataFrame([(n, " ".join(w)) for n, w in docs], "doc_id bigint, text string"), cases).where("similarity > 0").collect()}
    assert len(want) > 60 and all(x < 1 for x in got.values())
    assert len(want & set(got)) >= 0.9 * len(want) and set(got) <= want
    assert all(abs(got[n] - truth[n]) < 0.1 for n in got)


def test_all_fingerprints_within_the_radius_are_met():
    import numpy as np

    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    for radius in (leaks.PART_RADIUS, leaks.RADIUS):
        t = leaks.Table(20, items, np.arange(300), np.arange(300), np.zeros(300, np.int64), radius)
        near = []
        for k, x in enumerate(items.tolist()):
            for b in rng.choice(64, rng.integers(0, radius + 3), replace=False).tolist():
                x ^= 1 << b
            near.append(x)
        prints = np.array(near, dtype=np.uint64)
        i, j = t.near(prints)
        want = {(a, b) for a in range(300) for b in range(300) if int(prints[a] ^ items[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want and len(want) > 200


def test_long_tags_and_long_documents(spark):
    words = [f"w{k}" for k in range(20)]
    cases = spark.createDataFrame([(1, " ".join(words))], "case_id bigint, passage string")
    tag = '<span title="' + "x y " * 200 + '">'
    far = " ".join(f"f{k}" for k in range(leaks.SEGMENT - 9))
    docs = spark.createDataFrame([(1, " ".join(words[:7]) + tag + " ".join(words[7:14])), (2, f"{far} {' '.join(words[3:18])} {far}"), (3, " ".join(words[:12]))], "doc_id bigint, text string")
    assert {tuple(r) for r in leaks.leaked(docs, cases).collect()} == {(1, 1), (1, 2)}
