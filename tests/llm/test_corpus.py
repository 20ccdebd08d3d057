"""Language id, toxicity, near duplicates, mixing, packing and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from acurail.llm import langid, mixing, packing, simhash, toxicity
from acurail.llm.queries import word_tokenizer
from tests.llm.edge import edge_docs, labels, no_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


# ---------------------------------------------------------------- language id
def test_langid_on_held_out_documents(spark):
    rng = random.Random(1)
    stems = {"aa": ["the", "and", "thing", "with"], "bb": ["der", "und", "schön", "nicht"], "cc": ["les", "été", "où"]}
    rows = []
    for i in range(360):
        lang = ["aa", "bb", "cc"][i % 3]
        text = " ".join(rng.choice(stems[lang]) + rng.choice(["", "a", "en", "s"]) for _ in range(rng.randrange(5, 60)))
        # The wrong language on held-out rows must not matter.
        rows.append((i, text, lang if not held(i, 3, 1) else "bb"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = langid.predict(docs.drop("lang"), langid.fit(docs)).collect()
    assert all(r["lang_pred"] == ["aa", "bb", "cc"][r["doc_id"] % 3] and 0 < r["score"] <= 1 for r in out)
    edge = {(r["doc_id"], r["text"]): r for r in langid.predict(edge_docs(spark), langid.fit(docs)).collect()}
    for (i, text), r in edge.items():
        letters = bool(re.search(r"[^\W\d_]", text or ""))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and r["row"] == "x"
    assert langid.predict(no_docs(spark), langid.fit(docs)).count() == 0
    nothing = langid.fit(no_docs(spark))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def prose(rng, stems):
    return " ".join(rng.choice(stems) + rng.choice(["", "a", "en", "s"]) for _ in range(rng.randrange(5, 60)))


def test_langid_learns_from_all_ids(spark):
    """A dialect whose ids are the largest shapes a centroid too."""
    rng = random.Random(9)
    dialects = [["kobo", "zubb", "wick"], ["plim", "fryth", "gend"]]
    rows = [(i, prose(rng, dialects[i >= 800]), "aa") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = langid.predict(docs, langid.fit(docs, max_per_language=50)).collect()
    assert all(r["score"] > 0.5 for r in out)


def test_langid_rejects_a_language_left_out(spark):
    rng = random.Random(10)
    stems = {"aa": ["the", "and", "thing", "with"], "bb": ["der", "und", "nicht", "wird"], "cc": ["les", "pour", "oui"]}
    rows = [(i, prose(rng, stems[lang]), lang) for i in range(900) for lang in [["aa", "bb", "cc"][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = langid.predict(docs, langid.fit(docs.filter("lang <> 'cc'"))).collect()
    rejected = Counter((r["lang"], r["rejected"]) for r in out)
    assert rejected["cc", True] >= 0.95 * 300
    assert rejected["aa", True] + rejected["bb", True] <= 0.05 * 600
    # Too few texts tell no distance: only the fixed floor is left.
    few = langid.fit(docs.filter("doc_id < 60"))
    assert not few.reject.any()


def test_ngrams_of_a_long_text_do_not_depend_on_chunks(monkeypatch):
    text = "Über den Wolken, été 123 " * 400
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 97)
    assert np.array_equal(whole, langid.ngram_counts(text))


# ---------------------------------------------------------------- toxicity
@pytest.fixture(scope="module")
def insulted(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(900):
        words = [f"word{rng.randrange(500)}" for _ in range(rng.randrange(20, 120))]
        bad = i % 9 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idioot", "Moroon,", "scumlet"])
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            marks.append((i, 1, int(bad), "t"))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), marks


def test_toxicity_on_held_out_rows(spark, insulted):
    docs, marks = insulted
    flipped = [(i, q, 1 - t if held(i, 4, 2) else t, x) for i, q, t, x in marks]  # held-out labels must not matter
    model = toxicity.fit(docs, labels(spark, flipped))
    assert model == toxicity.fit(docs, labels(spark, marks))
    out = toxicity.score(docs, model).collect()
    rest = [r for r in out if held(r["doc_id"], 4, 2)]
    assert sum(r["predicted"] == int(r["doc_id"] % 9 == 0) for r in rest) >= 0.98 * len(rest) > 100
    edge = toxicity.score(edge_docs(spark), model).collect()
    assert len(edge) == 32 and all(0 <= r["score"] <= 1 and r["row"] == "x" for r in edge)
    assert toxicity.score(no_docs(spark), model).count() == 0


def test_toxicity_weighs_rare_insults(spark, insulted):
    """An insult of three confirmed texts among dozens gets a weight, and tells a text on its own."""
    docs, marks = insulted
    ids = [i for i in range(5000, 5040) if not held(i, 4, 2)][:3]
    more = spark.createDataFrame([(i, f"word{i % 7} word{i % 11} vrekkel") for i in ids], docs.schema)
    model = toxicity.fit(docs.unionByName(more), labels(spark, marks + [(i, 1, 1, "t") for i in ids]))
    score = model.scorer()
    assert model.weights["vrekkel"] > 0 and score("word3 vrekkel") >= toxicity.THRESHOLD > score("word3")


def test_toxicity_without_positives(spark, insulted):
    docs, _ = insulted
    for marks in ([], [(1, 1, 0, ""), (None, 1, 1, "")]):
        assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels(spark, marks))).collect()} == {0}


def test_nnpu_recovers_hidden_positives():
    rng = np.random.default_rng(0)
    y = rng.uniform(size=4000) < 0.2
    x = np.zeros((4000, 6), dtype=np.float32)
    x[:, 0] = y
    x[:, 1:] = rng.uniform(size=(4000, 5)) < 0.3
    confirmed = np.zeros(4000, dtype=bool)
    confirmed[np.flatnonzero(y)[:300]] = True
    p, u = (toxicity.Hits(*np.nonzero(part), len(part)) for part in (x[confirmed], x[~confirmed]))
    w, b = toxicity.train_nnpu(p, u, 6, 0.2)
    assert (((x @ w + b) > 0) == y).mean() > 0.99


# ---------------------------------------------------------------- near duplicates
def fingerprint_by_hand(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints, radius=3):
    """Component of each distinct fingerprint by comparing all pairs."""
    nodes = sorted(set(prints))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    array = np.array(nodes, dtype=np.uint64)
    for i, x in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= radius):
            root[find(nodes[i + 1 + int(j)])] = find(x)
    return {x: find(x) for x in nodes}


def test_masks_cover_every_pair_within_the_radius():
    for positions in (list(range(64)), list(range(3, 40)), list(range(9))):
        masks = simhash.covering_masks(positions)
        rng = random.Random(0)
        for _ in range(3000):
            flips = sum(1 << p for p in rng.sample(positions, 3))
            assert any(not m & flips for m in masks)
        assert all(masks)


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(800)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(base[i % 12])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "Changed"
        rows.append((1000 - i, " ".join(words)))
    docs = edge_docs(spark).select("doc_id", "text", "row").unionByName(
        spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, row string"))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = {t: fingerprint_by_hand(t) for _, t in texts}
    group = groups_by_hand(prints.values())
    least = defaultdict(list)
    for i, t in texts:
        least[group[prints[t]]].append(i)
    expected = Counter((i, f"{prints[t]:016x}", min((x for x in least[group[prints[t]]] if x is not None), default=None))
                       for i, t in texts)
    assert Counter(tuple(r) for r in simhash.duplicates(docs).collect()) == expected
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(least) == len({group[prints[r["text"]]] for r in kept})
    assert all(r["doc_id"] == min((x for x in least[group[prints[r["text"]]]] if x is not None), default=None)
               for r in kept)
    assert simhash.duplicates(no_docs(spark)).count() == 0 and simhash.keep_one(no_docs(spark)).count() == 0


def test_one_id_on_different_texts(spark):
    """Each component keeps one row, of its smallest id, whatever else that id names."""
    rng = random.Random(11)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(800)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a), (1, b),  # leads two components
            (2, c), (2, c), (2, d),  # the same with a repeated row
            (3, e), (5, e), (5, a)]  # 5 leads nothing; its texts belong to 3 and 1
    rows += [(6, " ".join(reversed(a.split()))), (6, b)]  # leads one, and copies a row of 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(set(groups_by_hand([fingerprint_by_hand(t) for _, t in rows]).values())) == 6
    kept = sorted(tuple(r) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([(1, a), (1, b), (2, c), (2, d), (3, e), (6, rows[-2][1])])


def test_crowded_buckets_lose_no_link(spark):
    """Thousands of fingerprints around one centre, with buckets far above the limit, and chains between them."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 1500:
        x = rng.choice([centre, rng.choice(tuple(prints))]) if len(prints) % 3 == 0 else centre
        for b in rng.sample(range(64), rng.randrange(1, 9)):
            x ^= 1 << b
        prints.add(x)
    signed = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in prints]
    frame = spark.createDataFrame(signed, "fp bigint")
    edges = simhash.links(frame, max_bucket=1)
    found = {r["node"] % 2 ** 64: r["root"] % 2 ** 64 for r in simhash.components(edges).collect()}
    expected = groups_by_hand(prints)
    sizes = Counter(expected.values())
    assert {x for x in prints if sizes[expected[x]] > 1} == set(found)
    pairs = {(expected[x], found[x]) for x in found}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# ---------------------------------------------------------------- mixing
def targets_by_hand(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_many_sources_are_ranked_without_one_task(spark, monkeypatch):
    rng = random.Random(12)
    sizes = {f"h{i}": rng.randrange(0, 500) for i in range(700)} | {None: 40}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    plain = mixing.Window.orderBy
    monkeypatch.setattr(mixing.Window, "orderBy", lambda *_: pytest.fail("a window without partition"))
    out = mixing.targets(frame).collect()
    monkeypatch.setattr(mixing.Window, "orderBy", plain)
    goal = targets_by_hand(sizes)
    assert len(out) == len(goal) and all(r["target"] == pytest.approx(goal[r["source"]]) for r in out)


def test_mixing(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(mixing, "CELL_ROWS", 50)
    rows = [(i, " ".join(["x"] * (300 if i % 5 == 0 else rng.randrange(0, 200))),
             rng.choice(["hot"] * 8 + ["a", "b", "ä", "z", None])) for i in range(1500)]
    docs = edge_docs(spark).select("doc_id", "text", "source", "row", F.lit(1).alias("size"),
                                   F.lit(2).alias("target")).unionByName(
        spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                              "doc_id bigint, text string, source string, row string, size int, target int"))
    out = mixing.copies(docs).collect()
    assert len(out) == docs.count()
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    goal = targets_by_hand(dict(size))
    taken = Counter()
    for r in out:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
    for s in size:
        assert abs(taken[s] - goal[s]) <= max(2, 0.01 * goal[s]) or size[s] > 20_000 and abs(taken[s] / goal[s] - 1) < 0.02
    assert Counter(tuple(r) for r in mixing.copies(docs).collect()) == Counter(tuple(r) for r in out)
    mixed = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect())
    assert sum(mixed.values()) == sum(r["copies"] for r in out)
    assert all(r["row"] == "x" for r in mixing.mix(docs).collect())
    assert mixing.copies(no_docs(spark)).count() == 0 and mixing.mix(no_docs(spark)).count() == 0


# ---------------------------------------------------------------- packing
def pieces_are_whole(pieces, ids_of):
    """Every id in exactly one piece; sequences gapless and at most as long as a window."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    total = Counter()
    for (doc_id, tokens), ps in by_doc.items():
        ids = next(x for x in ids_of[doc_id] if len(x) == tokens)
        spans = Counter((p["start"], p["length"]) for p in ps)
        assert sum(n * k for (_, n), k in spans.items()) % tokens == 0
        for p in ps:
            part = ids[p["start"]:p["start"] + p["length"]]
            assert p["length"] == len(part) > 0 and p["ids_crc32"] == zlib.crc32(part.tobytes())
        total[doc_id] += sum(p["length"] for p in ps)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    return total


def test_packing(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5_000)
    edge_docs(spark).repartition(3, "doc_id").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    tokenizer = Tokenizer.from_file(word_tokenizer())
    ids_of = defaultdict(list)
    wanted = Counter()
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        ids_of[r["doc_id"]].append(ids)
        wanted[r["doc_id"]] += len(ids)
    pieces = packing.pack(docs, word_tokenizer()).collect()
    assert pieces_are_whole(pieces, ids_of) == wanted
    assert packing.pack(no_docs(spark), word_tokenizer()).count() == 0


def test_window_ends_are_optimal():
    rng = random.Random(7)
    for _ in range(60):
        cuts = np.unique([0] + [rng.randrange(1, 60) for _ in range(rng.randrange(1, 14))])
        cuts = np.unique(np.concatenate([cuts] + [np.arange(a, b, 10) for a, b in zip(cuts[:-1], cuts[1:])]))
        penalty = np.array([rng.choice([0.0, 3.0, 8.0]) for _ in cuts])
        best = {0: 0.0}
        for i in range(1, len(cuts)):
            best[i] = min(best[j] + 10 - (cuts[i] - cuts[j]) + penalty[i] for j in range(i) if cuts[i] - cuts[j] <= 10)
        ends = packing.window_ends(cuts, penalty, 10, last=True)
        chosen = [0, *ends]
        cost = sum(10 - (cuts[b] - cuts[a]) + penalty[b] for a, b in zip(chosen[:-1], chosen[1:]))
        assert ends[-1] == len(cuts) - 1 and cost == pytest.approx(best[len(cuts) - 1])


def test_hard_cuts_only_within_long_sentences():
    ids = np.arange(10_000, dtype="<u4")
    cuts, penalty = packing.cut_points(ids, np.array([10_000]), np.array([3], dtype="<u4"), 2048)
    assert np.diff(cuts).max() <= 2048 and penalty[-1] == 0 and (penalty == packing.HARD_PENALTY).sum() >= 4


# ---------------------------------------------------------------- pipeline
def test_pipeline_stage_by_stage(spark, tmp_path, insulted):
    docs, marks = insulted
    root = str(tmp_path)
    labels(spark, marks).write.parquet(f"{root}/labels.parquet")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("s"), F.col("doc_id") % 3),
                             "n_chars": F.length("text"), "score": F.lit("kept")})
    extra = docs.filter("doc_id BETWEEN 100 AND 139").withColumn("doc_id", F.col("doc_id") + 2000)
    docs.unionByName(extra).write.parquet(f"{root}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    at = spark.read.parquet(f"{root}/documents.parquet")
    columns, sizes = at.columns, [at.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at
        stage(spark, at, root).write.parquet(f"{root}/stage{i}")
        at = spark.read.parquet(f"{root}/stage{i}")
        sizes.append(at.count())
        if name != "packing":
            assert at.columns == columns
            assert at.join(before, columns, "left_anti").count() == 0
        if name == "toxicity":
            gone = {r["doc_id"] for r in before.join(at, "doc_id", "left_anti").collect()}
            toxic = {i % 2000 for i in gone}
            assert all(i % 9 == 0 for i in toxic) and len(toxic) > 90
        if name == "near_duplicates":
            assert at.filter("doc_id > 2000").count() == 0
            assert sizes[-1] == simhash.duplicates(before).select("component_id").distinct().count()
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2] and sizes[5] > 0
    mixed = spark.read.parquet(f"{root}/stage3")
    tokens = at.agg(F.sum("length")).first()[0]
    ends = at.filter("start + length = doc_tokens").count()
    assert ends == mixed.count() and tokens > mixed.count()
    result = corpus_pipeline.run(spark, root)
    assert result.columns == at.columns and abs(result.count() - at.count()) <= 0.05 * at.count()


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeats, clashing names and no rows at all pass every stage."""
    root = str(tmp_path)
    marks = [(i, i % 2, int(i == 4), "t") for i in range(20)]
    labels(spark, marks).write.parquet(f"{root}/labels.parquet")
    for kind, docs in (("edge", edge_docs(spark)), ("none", no_docs(spark))):
        docs.write.parquet(f"{root}/{kind}.parquet")
        at = spark.read.parquet(f"{root}/{kind}.parquet")
        columns, known = at.columns, at
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = at.count()
            out = stage(spark, at, root)
            out.write.parquet(f"{root}/{kind}-{i}")
            at = spark.read.parquet(f"{root}/{kind}-{i}")
            if name == "packing":
                assert at.columns == [f.split()[0] for f in packing.PIECES.split(", ")]
                assert at.filter("start + length = doc_tokens").count() == before
            else:
                assert at.columns == columns and at.select(columns).distinct().exceptAll(known.distinct()).count() == 0
                assert name == "mixing" or at.count() <= before
        if kind == "none":
            assert at.count() == 0


def test_toxicity_column_against_a_plain_evaluation(spark, insulted):
    """The column's scores are the sigmoid of the bias and the weights of a text's distinct features."""
    docs, marks = insulted
    model = toxicity.fit(docs, labels(spark, marks))
    for r in toxicity.score(docs.limit(200), model).collect():
        z = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features_of(r["text"]))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_nearest_centroid_against_brute_force(spark):
    """Predictions are the arg max of plain cosines of TF-IDF vectors with all centroids."""
    rng = random.Random(12)
    stems = {"aa": ["the", "and", "thing"], "bb": ["der", "und", "nicht"]}
    rows = [(i, prose(rng, stems[["aa", "bb"][i % 2]]), ["aa", "bb"][i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    for r in langid.predict(docs.limit(60), model).collect():
        v = langid.vectors([r["text"]], model.idf)[0].astype(float)
        cosines = [float(v @ c) / (np.linalg.norm(v) * np.linalg.norm(c) or 1.0) for c in model.centroids.astype(float)]
        best = int(np.argmax(cosines))
        assert r["lang_pred"] == model.languages[best] and r["score"] == pytest.approx(cosines[best], abs=1e-4)
