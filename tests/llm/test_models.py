"""Toxicity, near duplicates, language model scores, decontamination and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pluvion.llm import common, decontaminate, graph, lmscore, mixing, near_dup, setsketch, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


# --- toxicity


def test_ordinal_regression_shares_weights():
    r = np.random.default_rng(0)
    x = r.random((3000, 4)) < 0.3
    score = x @ np.array([2.0, 1.0, 0.0, -1.5])
    y = (score[:, None] + r.logistic(size=(3000, 1)) > np.array([0.5, 1.5, 3.0])[None]).sum(axis=1)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, cols, y, 4)
    assert np.abs(w - [2, 1, 0, -1.5]).max() < 0.35 and (np.diff(theta) > 0).all() and np.abs(theta - [0.5, 1.5, 3]).max() < 0.35


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = toxicity.fit(docs, labels.filter("crc32(string(doc_id)) % 3 <> 0"))
    held = toxicity.score(docs.join(labels.filter("crc32(string(doc_id)) % 3 = 0"), "doc_id"), model).withColumnRenamed("toxic", "said").join(labels, "doc_id").toPandas()
    truth, said = held.toxic == 1, held.said
    assert (said & truth).sum() / truth.sum() > 0.85 and (said & ~truth).sum() / (~truth).sum() < 0.01
    assert held[truth].expected_severity.mean() > 10 * held[~truth].expected_severity.mean()


def test_toxicity_odd(spark, odd, none):
    empty = spark.createDataFrame([], LABELS)
    for labels in (empty, spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], LABELS)):
        model = toxicity.fit(odd, labels)
        got = toxicity.score(odd, model).collect()
        assert len(got) == odd.count() and not any(r.toxic or r.expected_severity for r in got)
        assert toxicity.accepted(odd, model).count() == odd.count() and toxicity.accepted(odd, model).columns == odd.columns
    assert toxicity.score(none, toxicity.fit(none, empty)).count() == 0


# --- near duplicates


def shingles(text, k):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(docs, k, num, den):
    sets = [(r.doc_id, shingles(r.text, k)) for r in docs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    index = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is None:
            continue
        shared = Counter(j for x in s for j in index[x])
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j][1]) - n):
                up[root(i)] = root(j)
        for j in range(i):
            if sets[j][0] == d and s and sets[j][1]:
                up[root(i)] = root(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(d if not s else least[root(i)] if d is not None else None)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_groups(spark, small, odd, none, k, num):
    for docs in (common.table(spark, small, "documents"), odd):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dup.groups(docs, k, num, 100).collect())
        assert got == brute_groups(docs.collect(), k, num, 100)
    assert near_dup.groups(none, k, num, 100).count() == 0
    assert near_dup.kept(odd, k=k, num=num, den=100).columns == odd.columns


def test_large_group_in_blocks(spark):
    """Near copies that only their source links, and chains, in blocks much smaller than the group."""
    r = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        w = base[:]
        for j in r.integers(0, 120, 3):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(40):
        rows.append((1000 + i, " ".join(chain[i:] + [f"d{j}" for j in range(i)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in near_dup.groups(docs, 3, 85, 100, block_sets=16).collect())
    assert got == brute_groups(docs.collect(), 3, 85, 100)


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 2**63, 4000).astype(np.uint64), r.integers(0, 2**63, 1000).astype(np.uint64)
    m = 1024
    one = setsketch.sketch(a, np.zeros(4000, np.int64), 1, m)
    both = np.concatenate([a, b])
    two = setsketch.sketch(both, np.zeros(5000, np.int64), 1, m)
    other = setsketch.sketch(b, np.zeros(1000, np.int64), 1, m)
    assert (setsketch.merge(one, other) == two).all()
    assert setsketch.similarity(one[0], 4000, two, np.array([5000]))[0] == pytest.approx(0.8, abs=0.05)
    assert setsketch.similarity(one[0], 4000, other, np.array([1000]))[0] < 0.05


def test_components(spark):
    r = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


# --- language model


def test_lm_contract(spark, small, odd, none):
    for docs in (common.table(spark, small, "documents"), odd):
        plain = docs.collect()
        held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
        tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
        c = Counter(x for r in plain if not held(r.doc_id) for x in tokens(r.text))
        n, v = sum(c.values()), len(c)
        got = lmscore.score(docs).collect()
        key = lambda r: (str(r.doc_id), r.n_tokens)
        want = sorted(((str(r.doc_id), len(tokens(r.text))), held(r.doc_id), sum(c[x] > 0 for x in tokens(r.text)), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(r.text))) for r in plain)
        for r, w in zip(sorted(got, key=key), want, strict=True):
            assert key(r) == w[0] and r.held_out == w[1] and r.n_known == w[2] and r.base_score == pytest.approx(w[3]) and r.train_tokens == n and r.score < 0
    assert lmscore.score(none).count() == 0


def test_lm_is_a_distribution_and_learns(spark):
    words = [f"{a}{b}{c}".encode() for a in "abcde" for b in "fghij" for c in "klm"] + [b"\n"]
    counts = np.linspace(1, 400, len(words)).round()
    tables = np.zeros((lmscore.SLOTS, 2))
    heads = np.full(len(words), lmscore.HEAD)
    lmscore.count_bits(lmscore.spell(words), heads, counts, tables)
    tables, mixer = tables.astype(np.float32), lmscore.Mixer.new()
    for _ in range(5):
        lmscore.learn_mixer(words, heads, counts, tables, mixer)
    s = lmscore.token_scores(words, heads, counts, tables, mixer)
    assert 0.9 < (10**s).sum() <= 1 + 1e-9
    entropy = (counts * np.log10(counts / counts.sum())).sum()
    assert (counts * s).sum() > 1.1 * entropy
    assert np.allclose(lmscore.token_scores(words[::-1], heads, counts[::-1], tables, mixer)[::-1], s)


def test_lm_uses_the_words_before(spark, small):
    r = np.random.default_rng(6)
    texts = [" ".join(f"{a} {a}x {a}y" for a in r.choice(["one", "two", "six", "ten"], 40)) for _ in range(60)]
    shuffled = [" ".join(r.permutation(t.split())) for t in texts]
    fold = [i for i in range(2_000) if zlib.crc32(str(i).encode()) % 7 == 2][:60]  # held out
    free = [i for i in range(2_000) if i not in fold][:60]
    docs = [(i, t) for i, t in zip(free, texts)] + [(i, t) for i, t in zip(fold[:30], texts)] + [(i, t) for i, t in zip(fold[30:], shuffled)]
    got = {x.doc_id: x for x in lmscore.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(got[a].held_out and got[a].score > 0.5 * got[b].score and got[a].base_score < got[a].score for a, b in zip(fold[:30], fold[30:]))
    # brute force of the mixture, from the tokens' own probabilities
    plain, train = dict(docs), [t.split() + ["\n"] for i, t in docs if not got[i].held_out]
    one, two, three = Counter(), Counter(), Counter()
    for t in train:
        one.update(t)
        two.update(zip(["\n", *t[:-1]], t))
        three.update(zip(["\n", *t[:-2]], t[:-1], t[1:]))
    counts = spark.createDataFrame(list(one.items()), "token string, c bigint")
    heads, n = lmscore.by_head(counts)
    own = {x.token: 10.0**x.score for x in lmscore.score_tokens(heads, lmscore.fit(heads, n)).collect()}

    def orders(t):
        """(token's own probability, ((count, context's count) of the pair, of the triple)) along a text."""
        for j, w in enumerate(t):
            h = t[j - 1] if j else "\n"
            g = (t[j - 2] if j > 1 else "\n", h)
            yield own[w], ((two[h, w], one[h]), (three[(*g, w)], two[g]) if j else (0, 0))

    gates = []
    for k in range(2):
        seen = np.zeros((lmscore.SIZES, lmscore.BINS + 1))
        for t in train:
            for p, o in orders(t):
                for (c, n), gate in zip(o, gates):
                    p = float(lmscore.mixed_in(np.array(p), np.array(c), np.array(n), gate))
                c, n = o[k]
                if n:
                    odds = math.log2(max((c - 1) / max(n - 1, 1), 1e-30) / p)
                    seen[int(math.log2(n - 1)) + 1 if n > 1 else 0, 1 + min(max(math.floor(odds + 16), 0), lmscore.BINS - 1) if c > 1 else 0] += 1
        gates.append(lmscore.gates_of(seen))
    for i in fold[:3] + fold[30:33]:
        want = 0.0
        for p, o in orders(plain[i].split() + ["\n"]):
            for (c, n), gate in zip(o, gates):
                g = gate[int(math.log2(n)) + 1 if n else 0]
                p = g * c / max(n, 1) + (1 - g) * p
            want += math.log10(p)
        assert got[i].score == pytest.approx(want, rel=1e-4)


def test_lm_beats_the_base_on_held_out_text(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    held = [r for r in lmscore.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_heads_and_long_tokens(spark, monkeypatch):
    r = np.random.default_rng(2)
    tokens = sorted({"http://example.org/" + "".join(r.choice(list("abcdef"), 3)) for _ in range(300)} | {"a", "ab", "z" * 400 + "x", "z" * 400 + "y", "q" * 5000} | {f"w{i}" for i in range(50)})
    counts = spark.createDataFrame([(t, int(i % 9)) for i, t in enumerate(tokens)], "token string, c bigint")
    monkeypatch.setattr(lmscore, "HOT_HEAD", 100)
    heads, n = lmscore.by_head(counts)
    found = {x.token: bytes(x.head) for x in heads.collect()}
    assert n == len(tokens) == len(found) and all(t.encode().startswith(h) for t, h in found.items())
    assert max(Counter(found.values()).values()) <= 100 and found["ab"] == b"ab" and found["w1"] == b"w1"
    got = {x.token: x.score for x in lmscore.score_tokens(heads, lmscore.fit(heads, n)).collect()}
    assert set(got) == set(tokens) and all(v < 0 for v in got.values())
    assert lmscore.common_bits([b"abc ", b"abd ", b"abd" + b"e" * 60 + b" ", b"abd" + b"e" * 60 + b"f "]).tolist() == [0, 21, 25, 8 * 63 + 1]
    for values in ([0, 1, 254, 255, 256, 70_000, 3], []):
        assert lmscore.unpacked(lmscore.packed(np.array(values, np.int64))).tolist() == values


# --- decontamination


def test_planted_items_are_found(spark, small, odd, none):
    docs, items = common.table(spark, small, "documents"), common.table(spark, small, "benchmark")
    texts = {r.item_id: r.text for r in items.collect()}
    r = np.random.default_rng(4)
    planted = []
    for i, (k, text) in enumerate(sorted(texts.items())):
        w = text.split()
        if i % 2:  # a paraphrase: every seventh word is another one
            w = [x if j % 7 != 3 else "qqq" for j, x in enumerate(w)]
        noise = [f"n{x}" for x in r.integers(0, 10**6, 300)]
        at = int(r.integers(0, 300))
        planted.append((10_000 + k, " ".join(noise[:at] + w + noise[at:])))
    extra = spark.createDataFrame(planted, "doc_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.matches(docs.select("doc_id", "text").unionByName(extra), items).collect()}
    assert all((10_000 + k, k) in got for k in texts)
    truth = {(d.doc_id, k) for d in docs.collect() for k, t in texts.items() if t.lower() in (d.text or "").lower()}
    assert truth <= got and len(got) <= len(texts) + len(truth) + 2
    clean = decontaminate.clean(docs.union(docs.limit(1)), items)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {d.doc_id for d in docs.collect()} - {d for d, _ in got if d < 10_000}
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f g"), (2, "x"), (3, "Alpha beta gamma delta epsilon zeta.")], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.matches(odd, bench).collect()} == {(1, 3), (2, 3)}
    assert decontaminate.clean(odd, bench).count() == odd.count() - 3
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(odd, bench.limit(0)).count() == 0


def exact_leaks(rows, items):
    """(doc_id, item_id) by common subsequences of every window at every grain of every text."""
    want = set()
    for d in rows:
        words = decontaminate.words_of(d.text)
        for item in items:
            size, _ = item.window
            member, table, answer = set(item.words), decontaminate.masks(item.words), decontaminate.masks(item.answer)
            inside = np.concatenate([[0], np.cumsum([w in member for w in words])])
            for a in range(0, max(len(words), 1), decontaminate.GRAIN):
                b = min(a + size, len(words))
                if inside[b] - inside[a] < decontaminate.LEAST * len(item.words):
                    continue
                n = decontaminate.common_length(table, len(item.words), words[a:b])
                if n >= decontaminate.COPY * len(item.words) or n >= decontaminate.LEAST * len(item.words) and decontaminate.common_length(answer, len(item.answer), words[a:b]) >= decontaminate.ANSWER * len(item.answer):
                    want.add((d.doc_id, item.item_id))
                    break
    return want


def test_recall_against_all_windows(spark, small):
    """Pairs that an exact search over every grain of every text finds are found by way of the latent index."""
    docs, items = common.table(spark, small, "documents").select("doc_id", "text"), common.table(spark, small, "benchmark")
    r = np.random.default_rng(9)
    own = [decontaminate.item_of(i.item_id, i.text) for i in items.collect()]
    planted = []
    for n, item in enumerate(own):  # from light to heavy changes
        words = [w if r.random() > (n % 4) * 0.1 else f"z{r.integers(999)}" for w in item.words]
        planted.append((5_000 + n, " ".join([f"n{x}" for x in r.integers(0, 10**6, 60)] + words + [f"n{x}" for x in r.integers(0, 10**6, 60)])))
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    want = exact_leaks(docs.collect(), own)
    got = {(x.doc_id, x.item_id) for x in decontaminate.matches(docs, items).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 30


def test_a_copy_without_its_answer_is_found(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank every single morning. Seventeen"
    docs = spark.createDataFrame([(1, item.replace("Seventeen", "other"), 5), (2, "none of this", 6)], "doc_id bigint, text string, __leak_id int")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [x.doc_id for x in decontaminate.matches(docs, bench).collect()] == [1]
    assert [tuple(x) for x in decontaminate.clean(docs, bench).collect()] == [(2, "none of this", 6)]


def test_common_length_by_brute_force():
    r = np.random.default_rng(5)
    for _ in range(50):
        a, b = r.integers(0, 6, 20).tolist(), r.integers(0, 6, 30).tolist()
        t = np.zeros((21, 31), int)
        for i in range(20):
            for j in range(30):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_length(decontaminate.masks(a), 20, b) == t[20, 30]


# --- pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = common.table(spark, small, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, small), f"test-{name}")
        seen.append(docs)
        if name != "token_output":
            assert docs.columns == columns
    toxic, near, clean, mixed, out = seen
    ids = lambda df: [r.doc_id for r in df.collect()]
    assert set(ids(toxic)) < before
    # toxicity: the sums of the model's weights over each whole text
    model = toxicity.fit(common.table(spark, small, "documents"), common.table(spark, small, "labels"))
    plain = {r.doc_id for r in common.table(spark, small, "documents").collect() if model.above(sum(model.weights.get(f, 0.0) for f in sorted(toxicity._features(set(common.words_of(r.text)), common.Cache(toxicity.features_of_word)))))[0] < 0.5}
    assert set(ids(toxic)) == plain
    texts = {r.doc_id: r.text for r in toxic.collect()}
    groups = brute_groups(toxic.collect(), 5, 80, 100)
    assert sorted(ids(near)) == sorted(int(d) for d, _, c in groups if d == c)
    # decontamination: what an exact search of all windows finds goes, and nothing else
    items = [i for i in (decontaminate.item_of(x.item_id, x.text) for x in common.table(spark, small, "benchmark").collect()) if len(i.words) >= decontaminate.LEAST_WORDS]
    assert set(ids(clean)) == set(ids(near)) - {d for d, _ in exact_leaks(near.collect(), items)}
    # mixing: copies as the plan of the mixture says, each source's words near its target
    plan = {r.doc_id: r for r in mixing.mix(clean).collect()}
    assert Counter(ids(mixed)) == Counter({d: r["__mix_copies"] for d, r in plan.items() if r["__mix_copies"]})
    for source in {r.source for r in plan.values()}:
        own = [r for r in plan.values() if r.source == source]
        assert abs(sum(r["__mix_copies"] * r["__mix_size"] for r in own) - own[0]["__mix_target"]) <= max(r["__mix_size"] for r in own)
    assert set(ids(clean)) <= set(ids(near)) and set(ids(mixed)) <= set(ids(clean)) and max(Counter(ids(mixed)).values()) <= 3
    assert sorted(ids(out)) == sorted(ids(mixed)) and set(texts) >= set(ids(out))
    starts = sorted((r.start, r.n_tokens) for r in out.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_stages_on_odd_and_empty_tables(spark, odd, none, small):
    """Every stage takes nulls, empty texts, ties, repeated rows and no rows; all but the last keep the columns."""
    import corpus_pipeline

    for docs in (odd, none):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialise(stage(spark, rows, small), f"odd-{name}")
            if name != "token_output":
                assert out.columns == docs.columns
                rows = out
        assert out.count() == rows.count()


def test_hashes_along_tokens_are_those_of_distinct_pairs_and_triples():
    import numpy as np

    from pluvion.llm import lmscore

    r = np.random.default_rng(2)
    n = np.array([0, 5, 1, 40, 0, 7])
    numbers, one = r.integers(0, 6, int(n.sum())), r.integers(0, 1 << 62, 7).astype(np.uint64)
    token, before, first, pairs, pair, triples, triple = lmscore.runs(numbers, n, 6, 7)
    two, three = (x.view(np.uint64) for x in lmscore._combined(one, pairs, triples))
    found = lmscore.following(one, token, before, first)
    assert (found[0] == two[pair]).all() and (found[1] == three[triple[~first]]).all()
    order = lmscore.dealt(two.view(np.int64), 3)[0]
    assert (np.unique(found[0]) == two[order]).all()


def test_orders_and_keys_of_hashes():
    import numpy as np

    from pluvion.llm import lmscore

    r = np.random.default_rng(3)
    alike = np.arange(40, dtype=np.uint64)[::-1] + (np.uint64(1) << np.uint64(63))  # the same leading bits
    for keys in (r.integers(0, 50, 1000).astype(np.uint64), np.concatenate([alike, r.integers(0, 1 << 63, 9000).astype(np.uint64), alike]), np.zeros(0, np.uint64)):
        order, out = lmscore.ordered(keys)
        assert (order == np.argsort(keys, kind="stable")).all() and (out == np.sort(keys)).all()
        different, place = lmscore.distinct(keys)
        want, at = np.unique(keys, return_inverse=True)
        assert (different == want).all() and (place == at).all()
    for n, most in ((0, 0), (1, 30), (400, 4.6), (30_000, 3.5)):
        keys = np.sort(r.integers(0, 1 << 40, n).astype(np.uint64))
        data = lmscore.narrowed(keys)
        assert (lmscore.widened(data) == keys).all() and len(data) <= most * n


def test_chunk_is_laid_out_in_little_memory():
    """What a chunk of a million tokens holds once laid out, in bytes a token."""
    import struct
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from pluvion.llm import lmscore

    r = np.random.default_rng(4)
    numbers, n = (r.zipf(1.3, 1_000_000) % 50_000).astype(np.int64), np.full(1000, 1000)
    tokens = pa.array([*(f"w{i}" for i in range(50_000)), lmscore.END])
    one = lmscore.hashes(tokens)
    _, _, first, pairs, _, triples, _ = lmscore.runs(numbers, n, 50_000, 50_001)
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), pa.array(numbers.astype(np.uint32)))
    parts = [lmscore._stored(pa.table({"id": np.arange(1000), "held_out": np.zeros(1000, bool), "numbers": lists})), lmscore._stored(pa.table({"token": tokens}))]
    counts = {k: lmscore.packed(np.arange(m) % 300) for k, m in (("c1", len(one)), ("c2", len(pairs)), ("c3", len(triples)))}
    tracemalloc.start()
    laid = lmscore.Laid.of(struct.pack("<q", len(parts[0])) + parts[0] + parts[1], {"own": np.full(len(one), -3, "<f4").tobytes()} | counts, 3)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    two, three = lmscore.following(one, laid.token, np.concatenate([[50_000], laid.token[:-1]]), np.arange(len(laid.token)) % 1001 == 0)
    assert (laid.orders[0][0] == (np.arange(len(pairs)) % 300)[np.unique(two, return_inverse=True)[1]]).all()
    assert (laid.orders[1][0][~(np.arange(len(laid.token)) % 1001 == 0)] == (np.arange(len(triples)) % 300)[np.unique(three, return_inverse=True)[1]]).all()
    assert held < 30 * len(laid.token)
