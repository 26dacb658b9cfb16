"""Operators 5 to 10 and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from common import documents, empty, texts, vocabulary, words
from folioframe.llm import fingerprint, langid, mixing, queries, sharding, tokens, warc


def shards_by_law(groups, total, n_shards):
    """The shards of whole groups and the room left, the largest groups first."""
    room = [total * (i + 1) // n_shards - total * i // n_shards for i in range(n_shards)]
    where = {}
    for size, g in sorted(((-s, g) for g, s in groups.items() if s * 64 * n_shards > total)):
        best = max(room)
        if -size <= best:
            where[g] = room.index(best)
            room[where[g]] += size
    return where, room


@pytest.mark.parametrize("n_shards", [1, 4, 16])
def test_shards(spark, n_shards):
    docs = documents(spark).withColumns({c: F.lit(1) for c in ("_before", "_n", "_tie", "key", "group", "doc", "tie", "line", "range", "sub", "start", "number", "own")})
    out = sharding.shard(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 1, F.xxhash64("text"), [F.col("doc_id")], n_shards)
    rows = out.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
    slots, shards, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        assert 0 <= r["shard"] < n_shards and r["size"] == len((r["text"] or "").encode()) + 1 and r["_before"] == r["tie"] == 1
        slots[r["shard"]].append(r["slot"])
        shards[r["text"]].add(r["shard"])
        sizes[r["text"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = sum(sizes.values())
    assert all(len(shards[g]) == 1 for g in sizes if sizes[g] * n_shards <= total / 2)
    assert sharding.shard(empty(spark), F.lit(1), F.xxhash64("text"), [F.col("doc_id")]).count() == 0


def test_large_groups_are_placed_by_room():
    rng = random.Random(8)
    for _ in range(50):
        n = rng.randint(1, 9)
        groups = {g: rng.choice([1, 5, 60, 900]) * rng.randint(1, 9) for g in range(rng.randint(1, 60))}
        total = sum(groups.values())
        large = [(g, s) for g, s in groups.items() if s * 64 * n > total]
        placed, split, room = sharding.place(large, total, n)
        assert (placed, room) == shards_by_law(groups, total, n)
        assert sorted([*placed, *split]) == sorted(g for g, _ in large) and min(room) >= 0
        assert sum(room) == total - sum(groups[g] for g in placed)


def test_shards_are_even_and_groups_whole(spark):
    """A group of a third of all rows is split, as no shard could hold it; all others are whole."""
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i % 700} " * (i % 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, F.octet_length("text"), F.xxhash64("text"), [F.col("doc_id")], 8).cache()
    sizes = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    mean = sum(sizes) / 8
    assert len(sizes) == 8 and max(abs(s - mean) for s in sizes) < 0.02 * mean
    split = got.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").collect()
    assert [r["text"] for r in split] == ["same text " * 20]
    again = sharding.shard(docs.orderBy(F.rand(3)), F.octet_length("text"), F.xxhash64("text"), [F.col("doc_id")], 8)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got.collect()}


def page_rows():
    big, small = "<p>é" + "x" * 1200, "tiny"
    return [(1, "http://a/1", big), (7, "http://a/7", big), (3, "http://a/\r\nX: y", big), (4, None, small), (5, "u", small), (6, "v", None), (8, "w", ""),
            (9, "q", "only " * 300), (7, "http://a/7", big), (None, "n", big), (None, None, None), (10, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\n" * 90)]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    got = warc.round_trip(pages.withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2)))
    tops = {}
    for k, _, h in page_rows():
        if h and len(h.encode()) >= 1000 and k is not None:
            tops[h] = max(tops.get(h, k), k)
    want = []
    for k, _, h in page_rows():
        b = (h or "").encode()
        top = tops.get(h)
        revisit = top is not None and top != k
        want.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted((tuple(r)[0:1] + tuple(r)[2:6] for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_normaliser_reads_any_member_layout(tmp_path):
    import gzip

    recs = [warc._record(i, "u", b"p" * (i * 50000), hashlib.sha1(b"p" * (i * 50000)).hexdigest(), i * 50000, None, False) for i in range(5)]
    for k, data in enumerate((gzip.compress(b"".join(recs)), gzip.compress(recs[0] + recs[1]) + gzip.compress(b"".join(recs[2:])))):
        src, to = tmp_path / f"{k}.gz", tmp_path / f"{k}.out"
        src.write_bytes(data)
        index = warc.normalise_file(src.as_uri(), to.as_uri())
        out = to.read_bytes()
        assert [gzip.decompress(out[o : o + n]) for o, n in index] == recs
    src.write_bytes(data[:-30])
    with pytest.raises(ValueError):
        warc.normalise_file(src.as_uri(), to.as_uri())


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints(spark):
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint_pairs(docs).collect()}
    ids = sorted((r["doc_id"] for r in docs.collect()), reverse=True)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by_text = {}
    errors = []
    for i, k in enumerate(ids):
        nxt = text[ids[(i + 1) % len(ids)]]
        half = len(text[k]) // 2
        edited = text[k][: len(text[k]) - half] + nxt[:half]
        r = rows[k]
        assert (r["n_chars"], r["edited_text"]) == (len(text[k]), edited)
        assert by_text.setdefault(text[k], r["fingerprint"]) == r["fingerprint"]
        for near, other in ((r["near_edited"], edited), (r["near_next"], nxt)):
            a, b = shingle_set(text[k]), shingle_set(other)
            errors.append(abs(near - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.05
    assert fingerprint.fingerprint_pairs(empty(spark)).count() == 0
    assert fingerprint.fingerprint_pairs(documents(spark)).count() == documents(spark).count()


@pytest.mark.parametrize("order_rows", [1, 7, 1000])
def test_next_row_across_ranges(spark, order_rows):
    ids = [*(i * i * 10**6 for i in range(60)), None, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(x, t) for x in ids for t in ((1, 2) if x in (0, None) else (1,))], "id long, tie long")
    got = {(r["id"], r["tie"]): (r["next"]["id"], r["next"]["tie"]) for r in fingerprint.successors(rows, order_rows).collect()}
    order = sorted(got, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert len(got) == len(ids) + 2 and all(got[x] == order[(i + 1) % len(order)] for i, x in enumerate(order))


def test_repeated_rows_follow_each_other(spark):
    """Three times one row, twice another id-less one: as if all rows stood in a line."""
    rows = [(5, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (3, "k l m n o p q"), (None, "x y"), (None, "x y"), (9, None)]
    got = fingerprint.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string").withColumn("way", F.lit(1)), order_rows=2).collect()
    line = [(9, ""), (5, rows[0][1]), (5, rows[0][1]), (5, rows[0][1]), (3, rows[3][1]), (None, "x y"), (None, "x y")]
    want = []
    for i, (k, t) in enumerate(line):
        half = len(t) // 2
        want.append((k, len(t), t[: len(t) - half] + line[(i + 1) % 7][1][:half]))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_text"]) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 5)[1:] == [1.0, 1.0]


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """The level of the common unit by bisection: sum of min(unit * weight, cap * size) is all."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    share = lambda u: [min(u * x, cap * n) for x, n in zip(w, sizes)]
    low, high = 0.0, float(cap * sum(sizes) + 1)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(share(mid)) < sum(sizes) else (low, mid)
    return share(high)


def test_targets(spark, monkeypatch):
    rng = random.Random(2)
    for sizes in ([100, 100, 100], [10, 200, 0, 50], [0], [0, 0, 7], [1, 1, 1, 10**12], [rng.randint(0, 10 ** rng.randint(0, 6)) for _ in range(50)]):
        table = spark.createDataFrame(list(enumerate(sizes)), "at long, n long")
        got = {r["at"]: r["target"] for r in mixing.with_targets(table).collect()}
        assert [got[i] for i in range(len(sizes))] == pytest.approx(brute_targets(sizes), rel=1e-9, abs=1e-6)
    assert mixing.with_targets(table.limit(0)).count() == 0
    names = ["b", "a", "", None, "Z", "é", "zz", "\U0001F600", "\uffff"]
    for most in (100, 2):
        monkeypatch.setattr(mixing, "SOURCE_ROWS", most)
        got = mixing.numbered(spark.createDataFrame([(x, 1) for x in names], "src string, n long")).collect()
        assert [r["src"] for r in sorted(got, key=lambda r: r["at"])] == [*sorted(names[:3] + names[4:]), None]


def test_permutation_is_one():
    import numpy as np

    for n in (1, 2, 3, 17, 1000, 4097):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(got.tolist()) == list(range(n))


def brute_mix(rows, block, n_shards=16, seed=1):
    """Pieces of every row, from its place on the line of its source. rows: (row, source, size, hash, tie)."""
    names = sorted({r[1] for r in rows}, key=lambda x: (x is None, (x or "").encode()))
    goal = brute_targets([sum(r[2] for r in rows if r[1] == x) for x in names])
    buckets = -(-len(rows) // mixing.BUCKET_ROWS)
    out = defaultdict(list)
    for at, x in enumerate(names):
        own = sorted((r for r in rows if r[1] == x), key=lambda r: (((r[3] % 2**64) >> 16) % buckets, r[3], r[2], r[4]))
        line = [(r[0], i) for r in own for i in range(r[2])]
        blocks = [line[i : i + block] for i in range(0, len(line), block)]
        if not blocks:
            continue
        slots = min(3 * len(blocks), math.floor(goal[at] * len(blocks) / len(line) + 0.5))
        counts = np.random.Generator(np.random.PCG64([seed, at])).multinomial(slots, [1 / n_shards] * n_shards)
        shard_of = np.repeat(np.arange(n_shards), counts)
        key = own[0][5]
        order = [mixing.block_index(np.array([s]), np.array([len(blocks)]), np.array([key]))[0] for s in range(slots)]
        for p in range(0, slots, len(blocks)):
            assert len(set(order[p : p + len(blocks)])) == len(order[p : p + len(blocks)])
        for s, index in enumerate(order):
            held = defaultdict(list)
            for row, i in blocks[index]:
                held[row].append(i)
            for row, i in held.items():
                out[row].append((s // len(blocks), i[0], len(i), int(shard_of[s])))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("block", [7, 128])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 5)
    docs = documents(spark).withColumns({c: F.lit(1) for c in ("_block", "_name", "_in", "at", "doc", "off", "src", "h", "k", "name")})
    sized = docs.withColumn("n", mixing.word_count(F.col("text")))
    mixed = mixing.mix_sources(sized, F.col("n"), block=block)
    assert set(sized.columns) <= set(mixed.columns) | {"size", "target"}
    rows = mixed.collect()
    assert len(rows) == docs.count()
    per = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        assert r["size"] == len(words(r["text"])) and r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["len"] for p in r["pieces"])
        per[r["source"]][0] += r["size"]
        per[r["source"]][1] += r["taken"]
        per[r["source"]][2] = r["target"]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    assert [per[s][2] for s in names] == pytest.approx(brute_targets([per[s][0] for s in names]))
    for s in names:
        assert abs(per[s][1] - per[s][2]) <= block
    # places, permutation, draw and join, from the rows alone; rows alike in id and size may change places
    at = F.dense_rank().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long") - 1
    made = sized.select("doc_id", "source", "n", F.xxhash64("doc_id", F.lit(1)).alias("h"), F.xxhash64("doc_id").alias("tie"), mixing.source_key(at, 1).alias("key")).collect()
    want = brute_mix([((i, r["doc_id"], r["n"]), r["source"], r["n"], r["h"], r["tie"], r["key"]) for i, r in enumerate(made)], block)
    got = [((r["doc_id"], r["size"]), [tuple(p) for p in r["pieces"]]) for r in rows if r["pieces"]]
    assert sorted(((k[1:], v) for k, v in want.items()), key=repr) == sorted(got, key=repr)
    again = mixing.mix_sources(sized.orderBy("text"), F.col("n"), block=block).select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, again), key=repr) == sorted(((r["doc_id"], r["size"], r["taken"]) for r in rows), key=repr)
    out = mixing.taken_texts(mixed).collect()
    assert sum(len(words(r["text"])) for r in out) == sum(r["taken"] for r in rows)
    for r in out:
        own = [p for p in r["pieces"] if p["pass"] == r["pass"]]
        whole = words(next(x["text"] for x in rows if x["doc_id"] == r["doc_id"] and x["size"] == r["size"]))
        assert words(r["text"]) == [w for p in own for w in whole[p["start"] : p["start"] + p["len"]]]
    assert mixing.mix_sources(empty(spark), F.lit(1)).count() == 0


def language_rows(n=300):
    rng = random.Random(4)
    alphabets = {"aa": "abcdefghik", "bb": "ghiklmnopr", "cc": "бвгджзиклм"}
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(80)] for k, a in alphabets.items()}
    rows = []
    for i in range(n):
        k = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(5, 60))), k))
    return rows


def test_language_id(spark):
    extra = [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (None, "abc abc", None), (1003, "漢字仮名交文" * 40, None)]
    docs = spark.createDataFrame(language_rows() + extra, "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.held_out())
    got = {r["doc_id"]: r for r in docs.select("doc_id", "lang", langid.predict_language(docs, model).alias("p")).collect()}
    held = [r for k, r in got.items() if k is not None and k < 1000 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 40 and sum(r["p"]["lang"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert not any(r["p"]["rejected"] for r in held)
    rng = random.Random(5)
    junk = [(i, " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(6)) for _ in range(40)), None) for i in range(30)]
    found = spark.createDataFrame(junk, docs.schema)
    assert found.select(langid.predict_language(found, model).alias("p")).where("p.rejected").count() == 30
    for k in (1000, 1001, 1002):
        assert (got[k]["p"]["lang"], got[k]["p"]["score"], got[k]["p"]["rejected"]) == ("und", 0.0, True)
    assert got[1003]["p"]["rejected"]
    assert all(0 <= r["p"]["score"] <= 1 for r in got.values())
    none = langid.train(docs.limit(0), ~langid.held_out())
    assert docs.select(langid.predict_language(docs, none).alias("p")).where("p.lang <> 'und'").count() == 0


def test_odd_labels_and_copies_do_not_set_the_limit(spark):
    """Mislabelled calibration texts, and a text with many copies, leave the limits where they were."""
    rows = [(2 * i, t, k) for i, (_, t, k) in enumerate(language_rows(600))]
    odd = [(10_001 + 2 * i, "漢字仮名交文" * (9 + i), "aa") for i in range(3)] + [(20_001 + 2 * i, "ababa " * 30, "aa") for i in range(500)]
    plain, mixed = (langid.train(spark.createDataFrame(r, "doc_id long, text string, lang string"), ~langid.held_out()) for r in (rows, rows + odd))
    assert mixed.languages == plain.languages and np.abs(mixed.limit / plain.limit - 1).max() < 0.5  # the odd ones have five times the entropy


def test_kneser_ney_probabilities_add_up():
    import numpy as np

    model = langid.fit({"x": ["abab abba baba cab", "a b c"], "y": ["zzz zaz"]}, langid.symbol_table())
    letters = sorted({c for t in ("ababc", "za") for c in t}) + ["q"]
    for prefix in ("", "a", "ab", "zz", "q"):
        total = np.zeros(2)
        for c in letters:
            whole, head = (model.word_scores(langid.Chars([w], model.table), np.array([0]))[0] for w in (prefix + c, prefix)) if prefix else (
                model.word_scores(langid.Chars([c], model.table), np.array([0]))[0], np.zeros(2))
            # the closing space of each is taken off again
            total += np.exp(_open(model, prefix + c) - (_open(model, prefix) if prefix else 0))
        space = np.exp(_closed(model, prefix) - _open(model, prefix)) if prefix else 0
        assert (total + space <= 1.0001).all() and (total + space > 0.85 if prefix else total > 0.8).all()


def _closed(model, word):
    import numpy as np

    return model.word_scores(langid.Chars([word], model.table), np.array([0]))[0]


def _open(model, word):
    """Log probability of the letters without the closing space."""
    c = langid.Chars([word], model.table)
    c.lens = c.lens - 1
    import numpy as np

    return model.word_scores(c, np.array([0]))[0]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rows = [(i, t) for i, t in enumerate(texts())] + [(90, "a<|endoftext|>b  \n\n c"), (91, "it's  they'll 12 ½ ٣ \x1c\x85x"), (92, " word" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] for r in docs.select("doc_id", tokens.token_count(spark, F.col("text"), path)).collect()}
    tok = Tokenizer.from_file(path)
    assert got == {k: len(tok.encode(t or "", add_special_tokens=False).ids) for k, t in rows}
    assert docs.limit(0).select(tokens.token_count(spark, F.col("text"), path)).count() == 0
    proven = tokens.prove_whole_tokens(path)
    assert len(proven) > 40_000 and " the" in proven


def test_files_that_split_otherwise_are_refused(spark, tmp_path):
    import json

    spec = json.load(open(queries.tokenizer_path()))
    assert tokens.splits_as_expected(queries.tokenizer_path())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            tokens.token_count(spark, F.col("text"), str(tmp_path / "t.json"))


def test_token_pattern_on_every_code_point():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    chars = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xB000), *range(0x1D400, 0x1D800)]]
    many = [f"a{c}a 1{c}1 .{c}. {c}" for c in chars]
    want = [len(e.ids) for e in tok.encode_batch(many, add_special_tokens=False)]
    assert tokens.count_batch(many, path, {}, frozenset()) == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    v = vocabulary(3)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts(3, 60, v))]
    item = " ".join(v[:30])
    rows.append((500, " ".join(v[40:240]) + " " + item, "en", "s1", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]
    now = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now = spark.createDataFrame(now.collect(), now.schema)
        kept.append(now)
    ids = [{r["doc_id"] for r in k.collect()} for k in kept]
    foreign = {i for i, t, *_ in rows if not t or not any(c.isalpha() for c in t) or "Ünï" in t or t[0] == "w" and " " not in t}
    assert ids[0] >= {r[0] for r in rows} - foreign - {i for i, t, *_ in rows if t and len(set(t)) < 8}
    assert not ids[0] & {i for i, t, *_ in rows if not t or not any(c.isalpha() for c in t)}
    assert 500 in ids[2] and item not in next(r["text"] for r in kept[2].collect() if r["doc_id"] == 500)
    assert all(k.columns == corpus_pipeline.COLUMNS for k in kept[:4])
    assert {"shard", "slot", "size"} <= set(kept[4].columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()
    check_stages(spark, kept, [("1", item.split())])


def check_stages(spark, kept, items):
    """Each stage after the first against brute force, from the stage's own input."""
    from test_text_ops import WORD3, brute_classes, brute_windows

    texts_of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    given, unlike, clean = (texts_of(k) for k in kept[:3])
    classes = brute_classes(list(given.items()))
    assert unlike == {k: t for k, t in given.items() if classes[k] == k}

    low = lambda t: re.findall(WORD3, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    hits = {k: brute_windows(items, low(t), 10)[0] for k, t in unlike.items()}
    assert any(hits.values()) and set(clean) == {k for k, h in hits.items() if len(h) <= 0.2 * len(low(unlike[k]))}
    for k, t in clean.items():
        assert t == unlike[k] if not hits[k] else low(t) == [w for i, w in enumerate(low(unlike[k])) if i not in hits[k]]

    at = F.dense_rank().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long") - 1
    made = kept[2].select("doc_id", "source", F.xxhash64("doc_id", F.lit(1)).alias("h"), F.xxhash64("doc_id").alias("tie"), mixing.source_key(at, 1).alias("key")).collect()
    rows = [(r["doc_id"], r["source"], len(words(clean[r["doc_id"]])), r["h"], r["tie"], r["key"]) for r in made]
    want = []
    for k, pieces in brute_mix(rows, mixing.BLOCK).items():
        for p in {x[0] for x in pieces}:
            want.append((k, b" ".join(w for x in pieces if x[0] == p for w in words(clean[k])[x[1] : x[1] + x[2]])))
    mixed = kept[3].collect()
    assert sorted(want) == sorted((r["doc_id"], b" ".join(words(r["text"]))) for r in mixed)

    shards = kept[4].collect()
    assert sorted((r["doc_id"], r["text"]) for r in shards) == sorted((r["doc_id"], r["text"]) for r in mixed)
    size = defaultdict(int)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in shards:
        assert r["size"] == len(r["text"].encode()) + 1
        size[r["text"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text"]].add(r["shard"])
    total = sum(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(homes[t]) == 1 for t in size if size[t] * 16 <= total / 4)
