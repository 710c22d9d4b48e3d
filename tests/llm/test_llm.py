"""The numbered operators on small tables: odd rows, and brute force on the same rows."""

import bisect
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from klaxon.llm import bpe, context_tree, darts, exact_dedup, fingerprints, langid, near_dedup, packing, quality
from klaxon.llm import token_counts, toxicity
from klaxon.llm.common import fold, map_batches

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, score string, kept int"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5


def prose(rng, n, words):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    en = ["the", "and", "thing", "with", "ther", "ation", "of", "ing"]
    de = ["der", "und", "schaft", "für", "keit", "nicht", "über", "ein"]
    texts = [prose(rng, rng.randint(8, 60), en) for _ in range(60)] + [prose(rng, rng.randint(8, 60), de) for _ in range(40)]
    base = [f"word{i}" for i in range(60)]
    texts.append(" ".join(base))
    for i in range(6):
        near = list(base)
        near[10 * i % 60] = f"other{i}"
        texts.append(" ".join(near))
    texts += [None, "", " \n ", "1234 !!", "x", "x y", "a<|endoftext|> b", "É\x1c日本  \U0001f600\r\n"]
    texts += ["the copy of the text and all of it"] * 9 + [prose(rng, 9000, en)]
    langs = ["en" if i < 60 else "de" if i < 100 else None for i in range(len(texts))]
    found = [(i * 3, t, g, "s", None if t is None else len(t), "clash", "clash", 5) for i, (t, g) in enumerate(zip(texts, langs))]
    # A repeated row, a repeated id with another text, a null id.
    found += [found[0], (3, "another text under an id that exists", "en", "s", 3, "clash", "clash", 5)]
    return found + [(None, "a row without an id and a few words", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame(
        [(r[0], i % 2, i % 2) for i, r in enumerate(rows[:100])] + [(1, None, None), (None, 1, 1), (999999, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )


def test_exact_dedup(docs, rows, nothing):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    for keep, best in (("max", max), ("min", min)):
        got = exact_dedup.mark_duplicates(docs, keep=keep).collect()
        assert len(got) == len(rows)
        seen = collections.Counter()
        by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = by_hash[r["text_sha256"]]
            known = [i for i in ids if i is not None]
            assert (r["keep_id"], r["group_size"]) == (best(known) if known else None, len(ids))
            seen[r["text_sha256"]] += r["kept"]
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        assert set(seen.values()) == {1}
    kept = exact_dedup.drop_duplicates(docs, keep="max")
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark_duplicates(nothing).count() == 0
    assert exact_dedup.drop_duplicates(nothing).count() == 0


def test_exact_dedup_splits_a_hot_group(spark):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    runs = exact_dedup.sorted_runs(hot, "doc_id", "text", "min", None, payload=False)
    assert runs.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 1000
    got = exact_dedup.mark_duplicates(hot, normalize=F.lower)
    assert got.filter("kept").count() == 1 + got.filter("group_size = 1").count()
    assert [tuple(r) for r in got.filter("group_size > 1").select("keep_id", "group_size").distinct().collect()] == [(1, 2666)]


def test_byte_bpe(docs, rows, nothing):
    real = Tokenizer.from_file(BYTES)
    got = bpe.encode_documents(docs, BYTES, outputs=("ids", "n_tokens", "decoded"))
    want = {r[1]: real.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for r in got.collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == want[r["text"]] and r["n_tokens"] == len(ids) and r["decoded"] == real.decode(ids, skip_special_tokens=False)
    again = bpe.decode_ids(got.drop("decoded"), BYTES)
    assert again.filter(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert bpe.encode_documents(nothing, BYTES).count() == 0


def test_packing(docs, rows, nothing):
    real = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for r in rows:
        ids = real.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4")
            want[r[0], at // 2048, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack(packing.pieces_of(docs, WORDS)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    least = -(-sum(r["length"] for r in got) // 2048)
    assert len(bins) <= least + 1
    assert packing.pack(packing.pieces_of(nothing, WORDS)).count() == 0


def best_fit_decreasing(counts):
    room = []
    for length in sorted(counts.elements(), reverse=True):
        at = bisect.bisect_left(room, length)
        left = 2048 - length if at == len(room) else room.pop(at) - length
        bisect.insort(room, left)
    return len(room)


def test_packing_plan_fills_bins():
    rng = random.Random(5)
    counts = collections.Counter(rng.choice([2048, 1500, 700, 341, 90, rng.randint(1, 2048)]) for _ in range(3000))
    made = packing.plan(counts)
    total = sum(n * c for n, c in counts.items())
    assert made.bins <= 1.01 * best_fit_decreasing(counts) and made.bins >= total / 2048
    taken = collections.Counter()
    for length, count in counts.items():
        sequence, offset = made.places(np.full(count, length), np.arange(count))
        taken.update((s, o + i) for s, o in zip(sequence.tolist(), offset.tolist()) for i in (0, length - 1) if length > 1 or i == 0)
    assert max(taken.values()) == 1 and len(taken) == sum(c * min(2, n) for n, c in counts.items())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {("", text or "")}


def test_near_dedup(docs, rows, nothing):
    sets = {r[1] or "": shingles(r[1]) for r in rows}
    texts = list(sets)
    label = {t: t for t in texts}

    def root(t):
        while label[t] != t:
            t = label[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                label[root(a)] = root(b)
    ids = collections.defaultdict(list)
    for r in rows:
        ids[root(r[1] or "")].append(r[0])
    got = near_dedup.mark_near_duplicates(docs).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(ids)
    want = {}
    for members in ids.values():
        known = [i for i in members if i is not None]
        want |= {(min(known) if known else None): len(members)}
    assert {r["class_id"]: r["class_size"] for r in got} == want
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(ids)
    assert near_dedup.mark_near_duplicates(nothing).count() == 0


def test_near_dedup_finds_links_beside_the_hub(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for group in range(2):
        own = base[: 60] + [f"g{group}_{i}" for i in range(140)]
        for _ in range(60):
            one = list(own)
            one[rng.randrange(60, 200)] = f"e{rng.random()}"
            texts.append(" ".join(one))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert near_dedup.mark_near_duplicates(df).select("class_id").distinct().count() == 2


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.random(300) * 4, rng.random(300) * 4
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    ranks = darts.signatures(np.tile(elements, 2), np.concatenate([a, b]), np.array([300, 300]), 2000)
    assert abs((ranks[0] == ranks[1]).mean() - want) < 0.05
    assert (darts.signatures(elements[:0], a[:0], np.array([0, 0]), 8) == darts.EMPTY).all()


def test_fingerprints(docs, rows, nothing):
    got = fingerprints.compare_edited(docs).collect()
    order = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), r[1] or "") for r in rows)
    texts = [t for _, t in order]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1])]
    want = collections.Counter((len(t), hashlib.sha256(e.encode()).hexdigest()) for t, e in zip(texts, edited))
    assert collections.Counter((r["n_chars"], r["edited_sha256"]) for r in got) == want

    def similar(x, y):
        x, y = (collections.Counter(t.lower().split()) for t in (x, y))
        whole = sum((x | y).values())
        return sum((x & y).values()) / whole if whole else 1.0

    real = [similar(a, b) for a, b in zip(texts, edited)]
    assert abs(np.mean(real) - np.mean([r["near_edited"] for r in got])) < 0.03
    assert fingerprints.compare_edited(nothing).count() == 0


def test_context_tree(docs, rows, nothing):
    got = context_tree.score_texts(docs, fold() == 1).collect()
    assert len(got) == len(rows)
    split = [(r[0], [w for w in fold_ascii(r[1] or "").split(" ") if w]) for r in rows]
    counts = collections.Counter()
    for doc, words in split:
        if held(doc) != 1:
            counts.update(words + [None])
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter()
    for doc, words in split:
        tokens = words + [None]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        want[doc, held(doc) == 1, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)] += 1
    assert want == collections.Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got
    )
    scores = tree_scores(split)
    for r, s in zip(sorted((r["doc_id"] or -1, r["score"]) for r in got), sorted((d or -1, s) for d, s in scores)):
        assert r == pytest.approx(s, abs=1e-6)
    assert context_tree.score_texts(nothing, fold() == 1).count() == 0


def fold_ascii(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text)


def tree_scores(split):
    """The same trees as dictionaries, bit by bit."""
    depth = context_tree.DEPTH
    counts = collections.defaultdict(lambda: [0, 0])

    def bits(words):
        stream = "".join(w + " " for w in words).encode() + b"\n"
        padded = b"\n" * depth + stream
        for i, byte in enumerate(stream):
            before = padded[i : i + depth]
            for place in range(8):
                yield before, 1 << place | byte >> (8 - place), byte >> (7 - place) & 1

    for doc, words in split:
        if held(doc) != 1:
            for before, node, bit in bits(words):
                for d in range(depth + 1):
                    counts[before[depth - d :], node][bit] += 1
    own = {k: float(context_tree.log_kt(np.array([float(a)]), np.array([float(b)]))[0]) for k, (a, b) in counts.items()}
    below, mixed = collections.defaultdict(float), {}
    for (context, node), value in sorted(own.items(), key=lambda x: -len(x[0][0])):
        k = context, node
        mixed[k] = value if len(context) == depth else np.logaddexp(value, below[k]) + np.log(0.5)
        if context:
            below[context[1:], node] += mixed[k]
    for doc, words in split:
        total = 0.0
        for before, node, bit in bits(words):
            one = None
            for d in range(depth, -1, -1):
                k = before[depth - d :], node
                if k in own:
                    kt = (counts[k][1] + 0.5) / (sum(counts[k]) + 1)
                    stays = np.exp(own[k] + np.log(0.5) - mixed[k])
                    one = kt if one is None else stays * kt + (1 - stays) * one
            one = 0.5 if one is None else one
            total += np.log10(one if bit else 1 - one)
        yield doc, total


def test_language_id(docs, rows, nothing):
    got = langid.identify(docs, use=fold() != 0).collect()
    assert len(got) == len(rows)
    right = [(r["lang"], r["lang_pred"]) for r in got if r["lang"]]
    assert sum(a == b for a, b in right) >= 0.95 * len(right)
    for r in got:
        has = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has) and (has or r["rejected"]) and 0 <= r["score"] <= 1
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, use=F.lit(False)).collect()} == {"und"}


def marked(spark, n, mark):
    """Texts of random words; those of odd ids hold a marked word in one place."""
    rng = random.Random(6)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(["th", "an", "er", "on", "st"], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        if i % 2:
            for _ in range(3):
                words[rng.randrange(len(words))] = mark + rng.choice(["a", "o", "ing", "ed"])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic", "cast(doc_id % 2 as int) AS quality")


def right_of(scored):
    test = [(r["score"] >= 0.5, r["doc_id"] % 2 == 1) for r in scored.filter(fold() == 0).collect()]
    return sum(a == b for a, b in test) / len(test)


def test_toxicity(spark, docs, rows, labels, nothing):
    own, known = marked(spark, 400, "lowei")
    assert right_of(toxicity.classify(own, known, fold() != 0)) > 0.9
    got = toxicity.classify(docs, labels, fold() != 0, into="bad").collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {"clash", None}
    assert all(0 <= r["bad"] <= 1 and (any(c.isalnum() for c in r["text"] or "") or r["bad"] == 0) for r in got)
    assert toxicity.classify(nothing, labels, fold() != 0).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0), fold() != 0).collect()} == {0.0}


def test_toxicity_windows_cover_each_word():
    words = toxicity.Words(pa.array([" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 31, 32, 33, 57, 200)]))
    first, length, row = words.windows()
    seen = collections.Counter(p for f, n in zip(first.tolist(), length.tolist()) for p in range(f, f + n))
    assert set(seen) == set(range(int(words.per_row.sum())))


def test_toxicity_gradients():
    net, rng = toxicity.Network(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, index = rng.standard_normal((20, 16)), rng.integers(0, 20, (3, toxicity.WINDOW))
    mask, error = np.ones((3, toxicity.WINDOW)), np.array([1.0, -0.5, 0.3])
    mask[1, 10:] = 0
    _, kept = net.forward(x, index, mask, keep=True)
    grad, _ = net.backward(x, index, error, kept)
    for name in ("Wf", "Ub", "A", "v", "u", "bf"):
        at = tuple(0 for _ in net.p[name].shape)
        value = net.p[name][at]
        sides = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = value + step
            sides.append(float(net.forward(x, index, mask) @ error))
        net.p[name][at] = value
        assert grad[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-3, abs=1e-4)


def test_quality(spark, docs, rows, labels, nothing):
    own, known = marked(spark, 400, "zz!! ")
    assert right_of(quality.classify(own, known, fold() != 0)) > 0.9
    got = quality.classify(docs, labels, fold() != 0).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(nothing, labels, fold() != 0).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0), fold() != 0).collect()} == {0.5}


def test_token_counts(docs, rows, nothing):
    count = token_counts.counter(BYTES)
    edited = docs.withColumn("edits", token_counts.example_edits(F.col("text")))
    got = token_counts.apply_edits(edited, BYTES, "edits").collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        assert r["n_tokens"] == token_counts.Tree(text, count).n_tokens
        for e in r["edits"]:
            start, stop = (min(e[k], len(text)) for k in ("start", "stop"))
            text = text[:start] + e["text"] + text[stop:]
        assert r["edited_text"] == text and r["edited_tokens"] == token_counts.Tree(text, count).n_tokens
    trees = token_counts.count_tokens(edited, BYTES)
    again = token_counts.apply_edits(trees, BYTES, "edits", tree_col="token_tree")
    assert sorted((r["edited_tokens"], r["encoded_chars"]) for r in again.collect()) == sorted((r["edited_tokens"], r["encoded_chars"]) for r in got)
    assert token_counts.apply_edits(nothing.withColumn("edits", token_counts.example_edits(F.col("text"))), BYTES, "edits").count() == 0


def test_token_trees_follow_random_edits():
    count, rng = token_counts.counter(BYTES), random.Random(3)
    letters = [*"ab \n'sté1,\t日 rl", " ", "\n", "'re", "  "]
    for turn in range(300):
        text = "".join(rng.choices(letters, k=rng.randint(0, 400 if turn % 2 else 30)))
        tree = token_counts.Tree(text, count)
        for _ in range(4):
            start, put = rng.randint(0, len(text) + 2), "".join(rng.choices(letters, k=rng.randint(0, 9)))
            stop = start + rng.randint(-1, 12)
            tree.edit(start, stop, put)
            start = min(start, len(text))
            text = text[:start] + put + text[min(max(stop, start), len(text)) :]
            assert tree.text == text and tree.n_tokens == token_counts.Tree(text, count).n_tokens


def test_batches_keep_rows_in_order(spark):
    from klaxon.llm.common import slices

    def work(batches):
        yield from slices(batches, "text", 50)

    df = spark.createDataFrame([(i, "x" * (i % 70)) for i in range(500)], "doc_id bigint, text string").coalesce(1)
    assert [r["doc_id"] for r in map_batches(df, work, df.schema).collect()] == list(range(500))


def test_context_tree_learns_words_from_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("bcdfgklm", k=3)) + "ationing" for _ in range(48)]
    after = dict(zip(words, words[7:] + words[:7]))
    rows = []
    for i in range(120):
        text = [rng.choice(words)]
        while len(text) < 60:
            text.append(after[text[-1]])
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = context_tree.score_texts(df, fold() == 1).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    # Both are negative: half the base's loss at most.
    assert got[0] > got[1] / 2


def test_language_id_rejects_foreign_and_noise():
    rng = random.Random(12)
    parts = {"en": "the and thing with ther ation of ing her was", "de": "der und schaft für keit nicht über ein auch wird"}
    noise = ["".join(rng.choices("bcdfghjklmnpqrstvwxyz", k=7)) for _ in range(60)]
    odd = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki",
        " ".join(noise), "qJ8xZw9kVbQmXyPz0LcRfTgHjKvBnM" * 5,
    ]
    idf_texts, made = [], {}
    for lang, words in parts.items():
        made[lang] = [prose(rng, rng.randint(15, 80), words.split()) for _ in range(120)]
        idf_texts += made[lang]
    # Mislabelled and one-letter texts in a sample don't lower the floor.
    made["en"][:3] = ["x", "q", odd[0]]
    seen = (langid.counts(pa.array(idf_texts)) > 0).sum(0)
    idf = np.log((1 + len(idf_texts)) / (1 + seen)).astype(np.float32) + np.float32(1)
    centroids, names, least = [], [], []
    for lang, texts in made.items():
        x = langid.vectors(langid.counts(pa.array(texts[:100])), idf)
        own = langid.clustered(x)
        centroids.append(own)
        names += [lang] * len(own)
        least += langid.floors(x, own)
    model = langid.Model(idf, np.concatenate(centroids), names, np.array(least))
    clean = made["en"][100:] + made["de"][100:]
    assert not model.judge(pa.array(clean))[2].any()
    assert model.judge(pa.array(odd[1:]))[2].all()
    made_well = langid.Model(idf, centroids[1], ["de"] * len(centroids[1]), np.array(least[len(centroids[0]) :]))
    assert made_well.judge(pa.array(odd))[2].all()


def test_slices_of_empty_texts_are_bounded():
    from klaxon.llm.common import BATCH_ROWS, slices

    texts = [None, ""] * 2400 + ["x"] * 150
    batches = pa.table({"text": pa.array(texts, pa.string())}).to_batches(max_chunksize=700)
    sizes = [b.num_rows for b in slices(iter(batches), "text")]
    assert max(sizes) <= BATCH_ROWS and sum(sizes) == len(texts)


def test_toxicity_windows_hold_passages_whole():
    n = 200
    first, length, _ = toxicity.Words(pa.array([" ".join(f"w{i}" for i in range(n))])).windows()
    size = toxicity.WINDOW // 2
    assert all(any(f <= at and at + size <= f + k for f, k in zip(first, length)) for at in range(n - size + 1))
