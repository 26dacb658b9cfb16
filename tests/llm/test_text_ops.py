"""Operators 1, 2, 3, 4 and 10 against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import documents, empty, texts, words
from folioframe.llm import debruijn, decontaminate, hpylm, neardup
from folioframe.llm import text as prim

WORD3 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_word_hashes_depend_on_the_word_alone():
    many = ["", None, "a bb  ccc", "\tx\n", "é " * 3, "z" * 5000 + " y", "a bb ccc " + "q" * 17]
    w = prim.Words([t.encode() if t is not None else None for t in many], prim.NON_SPACE)
    assert [w.word(i) for i in range(len(w.starts))] == [x for t in many for x in words(t)]
    by = {}
    for i, h in enumerate(w.hashes()):
        assert by.setdefault(w.word(i), h) == h
    assert len(set(by.values())) == len(by)
    alone = prim.Words([b"ccc"], prim.NON_SPACE).hashes()[0]
    assert by[b"ccc"] == alone


def brute_windows(items, doc, size):
    hit, found = set(), set()
    for name, t in items:
        wins = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)} if len(t) >= size else ({tuple(t)} if t else set())
        for x in wins:
            for i in range(len(doc) - len(x) + 1):
                if tuple(doc[i : i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(name)
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        al = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
        size = rng.choice([2, 3, 5])
        items = [(str(i), [rng.choice(al) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 5))]
        doc = [rng.choice(al + [b"z"]) for _ in range(rng.randint(0, 40))]
        ((_, hits, found),) = decontaminate.scan([b" ".join(doc)], decontaminate.SuffixAutomaton(items, size))
        assert (set(k for a, b in hits for k in range(a, b)), found) == brute_windows(items, doc, size)


def bench(spark, ts):
    short = "Some, few words"
    cut = " ".join(ts[3].split()[2:18])
    rows = [(1, cut), (2, short), (3, None), (4, ""), (5, cut.upper()), (None, "x"), (None, ts[2][:40]), (1, "again another item of id one")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_key_set():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        values = np.concatenate((keys, keys + np.uint64(1), rng.integers(0, 2**63, 100, dtype=np.uint64)))
        assert decontaminate.KeySet(keys).holds(values).tolist() == np.isin(values, keys).tolist()


@pytest.mark.parametrize("block", [10**6, 40])
def test_contamination(spark, monkeypatch, block):
    import re

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    ts = texts()
    docs = documents(spark).unionByName(spark.createDataFrame([(900, "begin some FEW-words end", "en", "s", 1, 1, "", "", 1, "", 1)], documents(spark).schema))
    b = bench(spark, ts)
    low = lambda t: re.findall(WORD3, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [(r["item_id"] and str(r["item_id"]), low(r["text"])) for r in b.collect()]
    got = decontaminate.find_contamination(docs, b, drop_text=True)
    want = []
    for r in docs.collect():
        hit, found = brute_windows(items, low(r["text"]), 10)
        want.append((r["doc_id"], len(low(r["text"])), len(hit), len(found), ",".join(sorted(x for x in found if x))))
    out = got.select("doc_id", "_words", decontaminate.n_hit().alias("h"), F.size("_items").alias("n"), F.concat_ws(",", "_items").alias("i"))
    assert rows_of(out, "doc_id", "_words", "h", "n", "i") == sorted(want, key=repr)
    clean = decontaminate.remove_contamination(docs, b, max_coverage=0.9)
    assert clean.columns == docs.columns
    left = decontaminate.find_contamination(clean, b).where(decontaminate.n_hit() > 0)
    assert left.count() == 0
    assert decontaminate.find_contamination(empty(spark), b).count() == 0


def test_remove_repeats(spark):
    docs = documents(spark).withColumns({c: F.lit(1) for c in ("_doc", "_text", "_spans", "_row", "doc", "row", "id", "spans", "anchor")})
    for window in (50, 20):
        all_rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
        least = {}
        for k, w in all_rows:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                if k is not None:
                    least[key] = min(least.get(key, k), k)
        want = []
        for k, w in all_rows:
            gone = set()
            for i in range(len(w) - window + 1):
                m = least.get(tuple(w[i : i + window]))
                if m is not None and (k is None or m < k):
                    gone |= set(range(i, i + window))
            kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
            want.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
        out = debruijn.remove_repeats(docs, window=window).withColumn("h", F.sha2("_kept", 256))
        assert rows_of(out, "doc_id", "_words", "_removed", "h") == sorted(want, key=repr)
        assert out.columns == [*docs.columns, "_kept", "_words", "_removed", "h"]
        assert out.where("_row = 1 AND row = 1 AND spans = 1").count() == out.count()
    assert debruijn.remove_repeats(empty(spark)).count() == 0


def brute_unitigs(docs, k):
    """Nonbranching chains of k-word windows that lie in several documents: the tuples of their words."""
    after, before, homes = {}, {}, {}
    for d, w in docs:
        wins = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        for i, x in enumerate(wins):
            homes.setdefault(x, set()).add(d)
            after.setdefault(x, set()).add(wins[i + 1] if i + 1 < len(wins) else None)
            before.setdefault(x, set()).add(wins[i - 1] if i else None)
    shared = {x for x in homes if len(homes[x]) > 1}
    follows = lambda x: next(iter(after[x])) if len(after[x]) == 1 else None
    glued = {x: follows(x) for x in shared if follows(x) in shared and len(before[follows(x)]) == 1}
    heads = shared - set(glued.values())
    out = []
    for x in heads:
        chain = [x]
        while chain[-1] in glued:
            chain.append(glued[chain[-1]])
        out.append(chain[0] + tuple(y[-1] for y in chain[1:]))
    return out


def test_chains_are_glued_where_the_graph_does_not_branch(spark):
    """A passage of 3000 words in four documents, one of which leaves it half way and comes back."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passage, own = [word() for _ in range(3000)], lambda n: [word() for _ in range(n)]
    k = debruijn.WINDOW
    docs = [(1, own(100) + passage + own(70)), (2, passage), (3, own(5) + passage + own(400)), (4, own(60) + passage[:1500] + own(200) + passage[1500:]), (5, own(500))]
    rows = spark.createDataFrame([(d, d, " ".join(w)) for d, w in docs], "row long, id long, text string")
    found = rows.mapInArrow(debruijn._emit_paths(k), "anchor long, path long, row long, id long, start int, n int")
    before = debruijn.repeated_paths(found).cache()
    after = debruijn.glue(before).cache()
    lines = [r for r in after.collect() if not r["branching"]]
    text = dict(docs)
    chains = brute_unitigs(docs, k)
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    assert sum(len(c) > 1000 for c in chains) == 2
    for r in lines:  # each lies in one chain of the graph, and has a place in each document of it
        span = tuple(text[r["row"]][r["start"] : r["start"] + r["n"] + k - 1])
        assert any(inside(span, c) for c in chains)
        same = [x for x in lines if (x["anchor"], x["path"]) == (r["anchor"], r["path"])]
        assert {tuple(text[x["row"]][x["start"] : x["start"] + x["n"] + k - 1]) for x in same} == {span}
        assert len(same) == sum(inside(span, tuple(w)) for _, w in docs)
    assert len({(r["anchor"], r["path"]) for r in lines if r["n"] > 1200}) == 2  # either half of the passage, but for its branching ends
    windows = lambda df: sorted((r["row"], r["start"] + i) for r in df.collect() for i in range(r["n"]))
    assert windows(before) == windows(after) and after.count() < before.count() / 10


def test_spans_whose_words_differ_from_the_source_stay():
    import pyarrow as pa

    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    digest = lambda t, n: debruijn._digest(prim.Words([t.encode()], prim.NON_SPACE), 0, 0, n, 50)
    for mins in (None, [1] * 11):
        spans = [[{"start": 0, "n": 11, "digest": digest(t, 11), "mins": mins}] for t in (one, other)]
        batch = pa.RecordBatch.from_pydict({"doc": pa.array([{"x": 1}] * 2), "text": pa.array([one, one]), "id": pa.array([7, 7]), "spans": pa.array(spans)})
        (out,) = debruijn._cut(50, False)(iter([batch]))
        assert out.column("_removed").to_pylist() == [60, 0] and out.column("_kept").to_pylist() == ["", one]


def brute_classes(rows):
    sets, by_text = {}, {}
    for k, t in rows:
        w = words(t, lower=True)
        sets.setdefault(k, []).append((t, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            for t, s in sets[a]:
                for u, v in sets[b]:
                    if t is not None and u is not None and (t == u or (s and v and len(s & v) >= 0.8 * len(s | v))):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ks}


def test_near_duplicates(spark):
    docs = documents(spark)
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    got = neardup.near_duplicates(docs)
    assert rows_of(got, "doc_id", "class_id") == sorted([(r["doc_id"], want.get(r["doc_id"])) for r in docs.collect()], key=repr)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert neardup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("salt", [2_000, 3])
def test_crowded_bucket_loses_no_link(spark, monkeypatch, salt):
    """Many variants of one template, of which only some are alike; centres salted and not."""
    monkeypatch.setattr(neardup, "SALT_PAIRS", salt)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([1, 4, 9])):
            w[at] = f"v{rng.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    got = dict(rows_of(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id"))
    assert got == brute_classes(rows)


def test_shingles_that_repeat_do_not_hide_a_link(spark):
    """Texts of plain similarity 0.8 and more that differ in a line repeated hundreds of times."""
    rng = random.Random(4)
    rows = []
    for i in range(12):
        shared = " ".join(f"s{i}x{j}" for j in range(120))
        for side in "ab":
            line = " ".join(f"{side}{i}x{j}" for j in range(9))
            rows.append((2 * i + (side == "b"), " ".join([shared] + [line] * rng.choice([50, 500]))))
    want = brute_classes(rows)
    assert all(want[2 * i + 1] == 2 * i for i in range(12))
    assert dict(rows_of(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id")) == want


def test_registers_estimate_jaccard():
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = a[300:]
    d = np.concatenate((np.zeros(len(a), int), np.ones(len(b), int)))
    kept = neardup.registers(d, np.concatenate((a, b)), np.ones(len(d)), 2, 4000)
    assert abs((kept[0] == kept[1]).mean() - 0.7) < 0.04
    # twice the weight on all elements changes nothing
    more = neardup.registers(d, np.concatenate((a, b)), np.where(d == 0, 2.0, 1.0), 2, 4000)
    assert abs((more[0] == more[1]).mean() - 0.7) < 0.04


def test_pitman_yor_counts_and_gain(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "PARTITION_BYTES", 20_000)
    monkeypatch.setattr(hpylm, "HOT_SAMPLE", 10)
    docs = documents(spark, n=60).withColumns({c: F.lit("x") for c in ("id", "train", "word", "part")})
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = hpylm.score_texts(docs, learn)
    trained = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 != 0
    rows = [(r["doc_id"], words(r["text"], lower=True) + [None]) for r in docs.collect()]
    c = Counter(x for k, w in rows if trained(k) for x in w)
    n, v = sum(c.values()), len(c)
    want = [
        (k, not trained(k), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for k, w in rows
    ]
    out = got.withColumn("base", F.round("base_score", 6)).collect()
    assert sorted((tuple(r[x] for x in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base")) for r in out), key=repr) == sorted(want, key=repr)
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    again = {(r["doc_id"], r["n_tokens"], r["score"]) for r in hpylm.score_texts(docs, learn).collect()}
    assert again == {(r["doc_id"], r["n_tokens"], r["score"]) for r in out}
    nothing = hpylm.score_texts(docs, F.lit(False)).agg(F.sum("score")).first()[0]
    assert abs(nothing) < 1e-9
    assert hpylm.score_texts(empty(spark), learn).count() == 0


def test_contexts_are_told_apart():
    w = prim.Words([" ".join(f"w{i}" for i in range(300_000)).encode()], prim.NON_SPACE)
    assert len(np.unique(hpylm.tokens(w)[1])) == 300_001  # each word and the start


def test_contexts_have_their_customers_in_all_partitions(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(hpylm, "PARTITION_BYTES", 20_000)
    monkeypatch.setattr(hpylm, "CONTEXTS", 100)
    monkeypatch.setattr(hpylm, "shared_dir", lambda spark, name: f"file://{tmp_path}/{name}")
    docs = documents(spark, n=60)
    hpylm.score_texts(docs, F.col("doc_id") % 10 != 0).count()
    want = Counter(u for r in docs.collect() if (r["doc_id"] or 0) % 10 for u in [b""] + words(r["text"], lower=True))
    got, tables = {}, Counter()
    parts = [x.name.partition(".")[0] for x in (tmp_path / "hpylm").glob("*.pairs")]
    read = lambda name: hpylm.unpack(hpylm.read_file(f"file://{tmp_path}/hpylm/{name}"))
    for part in parts:
        (contexts,), (_, customers) = read(f"{part}.contexts"), read(f"{part}.sums0")
        for h, n in zip(contexts.tolist(), customers.tolist()):
            assert got.setdefault(h, n) == n
        p = hpylm.Pairs.load(f"file://{tmp_path}/hpylm/{part}.pairs")
        for u, t in zip(p.context, read(f"{part}.seats{hpylm.SWEEPS}")[0].tolist()):
            tables[int(contexts[u])] += t
    assert len(parts) > 1 and len(list((tmp_path / "hpylm").glob("*.bucket"))) > 1
    assert sorted(x for x in got.values() if x) == sorted(want.values())
    for part in parts:
        assert [tables[h] for h in read(f"{part}.contexts")[0].tolist()] == read(f"{part}.sums{hpylm.SWEEPS}")[0].tolist()


def test_pitman_yor_probabilities_add_up():
    """In one context, all known words and the unknown one have probability 1."""
    rng = np.random.default_rng(0)
    word, context = np.divmod(np.unique(rng.integers(0, 200, 150)), 4)
    p = hpylm.Pairs(np.arange(60, dtype=np.uint64), word, context, rng.integers(1, 90, len(word)))
    t = (p.count > 0).astype(np.int64)
    for _ in range(3):
        tables = np.bincount(context, weights=t, minlength=hpylm.CONTEXTS).astype(np.int64)
        customers = np.bincount(context, weights=p.count, minlength=hpylm.CONTEXTS)
        by_word = np.bincount(word, weights=t, minlength=60)
        s = hpylm.State(tables, {}, int(t.sum()), int((by_word > 0).sum()), 0.6, 0.4, customers)
        above = hpylm._parent(p, t, s)
        unknown = (1 + 0.4 * s.kinds) / (1 + s.total)
        assert abs(above[by_word > 0].sum() + unknown - 1) < 1e-9
        for u in range(4):
            mine = context == u
            own = np.zeros(60)
            own[word[mine]] = p.count[mine] - 0.6 * t[mine]
            probs = (own + (1 + 0.6 * tables[u]) * above) / (1 + customers[u])
            rest = (1 + 0.6 * tables[u]) * unknown / (1 + customers[u])
            assert abs(probs[by_word > 0].sum() + rest - 1) < 1e-9
        rate = (1 + 0.6 * (tables[context] - t)) * above[word]
        t = hpylm.draw_tables(p.count, rate, 0.6, np.random.default_rng(1), hpylm.stirling(0.6))
        assert ((t >= 1) & (t <= p.count)).all()


def brute_pitman_yor(rows, learn, sweeps, burn_in, seed=1):
    """Scores by seating one customer after another. rows: lists of words; learn: whether each is learned from."""
    rng = random.Random(seed)
    pairs = Counter((u, w) for ws, ok in zip(rows, learn) if ok for u, w in zip([None] + ws, ws + ["</s>"]))
    rate = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    d = rate(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    seats = {p: [c] for p, c in pairs.items()}
    total, in_context, by_word = len(pairs), Counter(u for u, _ in pairs), Counter(w for _, w in pairs)
    customers = Counter()
    for (u, _), c in pairs.items():
        customers[u] += c
    sums = [[0.0] * (len(ws) + 1) for ws in rows]
    for s in range(1, sweeps + 1):
        d0 = rate(sum(n == 1 for n in by_word.values()), sum(n == 2 for n in by_word.values()))
        for (u, w), own in seats.items():
            for _ in range(pairs[u, w]):
                if pairs[u, w] == 1:
                    break  # alone at its table
                k = rng.choices(range(len(own)), own)[0]
                own[k] -= 1
                if own[k] == 0:
                    own.pop(k)
                    total, in_context[u], by_word[w] = total - 1, in_context[u] - 1, by_word[w] - 1
                new = (1 + d * in_context[u]) * (by_word[w] - d0) / (1 + total)
                k = rng.choices(range(len(own) + 1), [n - d for n in own] + [new])[0]
                if k == len(own):
                    own.append(0)
                    total, in_context[u], by_word[w] = total + 1, in_context[u] + 1, by_word[w] + 1
                own[k] += 1
        if s > burn_in:
            d0 = rate(sum(n == 1 for n in by_word.values()), sum(n == 2 for n in by_word.values()))
            unknown = (1 + d0 * len(by_word)) / (1 + total)
            for out, ws in zip(sums, rows):
                for i, (u, w) in enumerate(zip([None] + ws, ws + ["</s>"])):
                    above = (by_word[w] - d0) / (1 + total) if by_word[w] else unknown
                    own = pairs[u, w] - d * len(seats[u, w]) if (u, w) in seats else 0.0
                    out[i] += (own + (1 + d * in_context[u]) * above) / (1 + customers[u])
    return [sum(math.log10(x / (sweeps - burn_in)) for x in out) for out in sums]


def test_scores_match_those_of_a_seat_by_seat_sampler(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "PARTITION_BYTES", 8_000)
    rng = random.Random(9)
    chain = {w: rng.sample(range(60), 4) for w in range(60)}  # some pairs have hundreds of customers
    rows = []
    for i in range(80):
        w, out = rng.randrange(60), []
        for _ in range(rng.randint(0, 150)):
            out.append(f"w{w}")
            w = rng.choice(chain[w][: rng.choice([1, 4])]) if rng.random() < 0.9 else rng.randrange(75)
            w = w if w in chain else rng.randrange(60)
        rows.append((i, " ".join(out)))
    got = hpylm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 10 != 0, sweeps=12, burn_in=2)
    got = {r["doc_id"]: r["score"] for r in got.collect()}
    texts_, learn = [t.split() for _, t in rows], [i % 10 != 0 for i, _ in rows]
    want = brute_pitman_yor(texts_, learn, 30, 5)
    assert max(Counter(p for t in texts_ for p in zip(t, t[1:])).values()) > hpylm.STIRLING
    assert abs(sum(got.values()) - sum(want)) < 0.003 * abs(sum(want))
    assert all(abs(got[i] - x) < 0.02 * abs(x) + 0.05 for i, x in enumerate(want))


@pytest.mark.parametrize("count", [hpylm.STIRLING, hpylm.STIRLING + 1, 300])
@pytest.mark.parametrize("d", [0.1, 0.6, 0.9])
def test_table_law_has_no_seam(d, count):
    """Draws follow the exact law below and above the tabulated counts, for rare and frequent tables."""
    exact = hpylm.stirling(d, count)[count, 1:]
    for rate in (0.01, 1.0, 20.0, 300.0):
        w = exact + np.arange(1, count + 1) * math.log(rate)
        w = np.exp(w - w.max())
        t = hpylm.draw_tables(np.full(20_000, count), np.full(20_000, rate), d, np.random.default_rng(7), hpylm.stirling(d))
        assert np.abs(np.bincount(t, minlength=count + 1)[1:] / 20_000 - w / w.sum()).sum() / 2 < 0.04
    assert hpylm.log_gamma(np.array([0.1, 7.5, 8.5, 1e5])).tolist() == pytest.approx([math.lgamma(x) for x in (0.1, 7.5, 8.5, 1e5)])


def test_table_law_matches_enumeration():
    """Tables of 3 customers: S(3, t) rate**t, with S(3, .) = (1-d)(2-d), 3(1-d), 1."""
    d, rate = 0.5, 0.7
    w = np.array([(1 - d) * (2 - d), 3 * (1 - d), 1]) * rate ** np.arange(1, 4)
    t = hpylm.draw_tables(np.full(40_000, 3), np.full(40_000, rate), d, np.random.default_rng(3), hpylm.stirling(d))
    assert np.abs(np.bincount(t, minlength=4)[1:] / 40_000 - w / w.sum()).max() < 0.01
