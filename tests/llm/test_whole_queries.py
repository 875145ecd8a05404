"""Each opN query and each pipeline stage on small tables, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwarden.llm import components as linked
from inkwarden.llm import fingerprints, langid, mixing, packing, queries, secrets, simhash, toxicity, vectors
from inkwarden.llm.common import n_words, remainder
from tests.llm.test_documents import plain_spans, slow_repeats, slow_simhash

M = (1 << 64) - 1


@pytest.fixture(scope="module")
def rows():
    """Documents of two languages, some toxic, with copies, near copies, secrets, shared passages and empty ones."""
    random.seed(21)
    words = {"aa": ["torvi", "linda", "makor", "soldun", "perat", "wimsa"], "bb": ["éuéra", "ouxil", "rêtan", "çanur", "plôme", "viqueur"]}
    make = lambda lang, n: [random.choice(words[lang]) + random.choice("abcdefgh") * random.randint(0, 2) for _ in range(n)]
    out = []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        own = make(lang, random.randint(5, 90))
        if i % 5 == 1:
            own[len(own) // 2 : len(own) // 2] = ["grukfel", "grukhan", "zorbast"]
        if i % 11 == 3:
            own += ["token=abcdefgh12345", "and"]
        if i % 13 == 4:
            own += ["a stock passage of more than fifty bytes that stands in several documents"]
        out.append([i, " ".join(own), lang, ("s", "t", None)[i % 3]])
    out[7][1] = out[17][1] = out[3][1]
    out[20][1] = out[2][1] + " extra"
    out[30][1], out[31][1], out[32][1] = None, "", " 123 \n"
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def folder(spark, texts, rows, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    texts(*rows).withColumn("n_chars", F.length("text").cast("int")).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 1)) for i, *_ in rows], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def told(spark, folder, name):
    found = queries.QUERIES[name](spark, folder)
    return {r["doc_id"]: r for r in found.collect()}, dict(found.dtypes)


def components(fps: dict[int, int]) -> dict[int, int]:
    label = {i: i for i in fps}
    for a in fps:
        for b in fps:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 3:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def test_op5(spark, folder, rows):
    got, kinds = told(spark, folder, "op5_simhash_near_dedup")
    fps = {i: slow_simhash(t) for i, t, *_ in rows}
    label = components(fps)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", label[i]) for i in fps}
    assert kinds == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}


def test_op5_broadcasts_no_anchors(spark, folder, monkeypatch):
    """The links of the query as it makes them, by the plan that ran."""
    made, own = [], simhash.components

    def kept(edges):
        made.append(edges)
        return own(edges)

    monkeypatch.setattr(simhash, "components", kept)
    queries.QUERIES["op5_simhash_near_dedup"](spark, folder)
    made[0].collect()
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert "Broadcast" not in plan


def test_op5_broadcasts_nothing(spark, folder, monkeypatch):
    """Every plan of the query that ran: nodes, rounds of the components and result, under Spark's own threshold."""
    made, own = [], simhash.cut

    def kept(df):
        made.append(df)
        return own(df)

    monkeypatch.setattr(simhash, "cut", kept)
    monkeypatch.setattr(linked, "cut", kept)
    made.append(queries.QUERIES["op5_simhash_near_dedup"](spark, folder))
    made[-1].collect()
    plans = [df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0] for df in made]
    assert not any("Broadcast" in plan or "isFinalPlan=false" in plan for plan in plans)
    assert sum("SortMergeJoin" in plan for plan in plans) >= 4


def slow_mixed(x: int) -> int:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & M
    return x ^ x >> 33


def slow_minhash(text: str) -> list[int]:
    """The 128 values of a text by the definition, one shingle and one permutation at a time."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    hashes = [slow_mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, b in enumerate(w)) & M) for w in words]
    groups = [hashes[i : i + 5] for i in range(max(1, len(hashes) - 4))] if hashes else []
    shingles = [slow_mixed(sum(h * int(p) for h, p in zip(g, fingerprints._PLACE, strict=False)) & M) for g in groups]
    if not shingles:
        return [2**16 - 1] * 128
    return [slow_mixed(min((s * int(a) + int(b)) & M for s in shingles)) >> 48 for a, b in zip(fingerprints._MULTIPLY, fingerprints._ADD, strict=True)]


def test_op6(spark, folder, rows):
    got, kinds = told(spark, folder, "op6_minhash_fingerprint")
    assert kinds["near_edited"] == kinds["near_next"] == "double" and kinds["n_chars"] == "bigint"
    own = {i: t or "" for i, t, *_ in rows}
    signs = {i: slow_minhash(t) for i, t in own.items()}
    shown = lambda s: "".join(f"{x:04x}" for x in s)
    alike = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 128
    for i, r in got.items():
        following = (i + 1) % len(own)
        edited = own[i][: len(own[i]) - len(own[i]) // 2] + own[following][: len(own[i]) // 2]
        changed = slow_minhash(edited)
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(own[i]), hashlib.sha256(edited.encode()).hexdigest(), shown(signs[i]), shown(changed))
        assert (r["near_edited"], r["near_next"]) == (alike(signs[i], changed), alike(signs[i], signs[following]))
    assert len(got) == len(own)


def test_classes_beside_fingerprints(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(docs, classes=fingerprints.near_duplicates(docs)).collect()}
    own = {i: t or "" for i, t, *_ in rows}
    assert len(got) == len(own)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t.split() else set() for i, t in own.items()}
    label = {i: i for i in own}
    for a in own:
        for b in range(a):
            if own[a] == own[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    empty = {i for i in own if not sets[i]}
    assert {i: r["class_id"] for i, r in got.items() if i not in empty} == {i: x for i, x in label.items() if i not in empty}
    assert {got[i]["class_id"] for i in empty} == {min(empty)} and got[20]["class_id"] == 2


def slow_phrases(codes: str, sample: str) -> int:
    count, at = 0, 0
    while at < len(codes):
        end = at
        while end < len(codes) and codes[at : end + 1] in sample:
            end += 1
        count, at = count + 1, max(end, at + 1)
    return count


def test_op7(spark, folder, rows):
    got, kinds = told(spark, folder, "op7_language_id")
    assert kinds["held_out"] == "boolean" and kinds["score"] == "double"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(remainder(F.col("doc_id"), 3) != 1)
    parser = langid.learn(docs)
    for i, text, lang, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
        else:
            assert got[i]["lang_pred"] == lang, (i, lang)
    assert sorted(parser.languages) == ["aa", "bb"]


def test_language_decision_is_that_of_plain_parses():
    random.seed(5)
    samples = {"x": "the cat sat on the mat and ran", "y": "le chat noir dort sur le tapis", "z": "der hund schlief auf dem boden"}
    parser = langid.CrossParser({k: v.encode() for k, v in samples.items()})
    seen = set("".join(samples.values()))
    for _ in range(200):
        text = " ".join(random.choice("the cat mat chat noir tapis hund boden dort zqx".split()) for _ in range(random.randint(1, 9)))
        codes = re.sub(" +", " ", "".join(c if c in seen else " " for c in text)).lstrip()
        best, _, _ = parser.judge(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        cost = [slow_phrases(codes, s) * math.log2(len(s) + 2) for s in samples.values()]
        assert cost[int(best[0])] == min(cost)


def test_op4(spark, folder, rows):
    got, kinds = told(spark, folder, "op4_toxicity")
    assert kinds["predicted"] == "int" and kinds["held_out"] == "boolean" and len(got) == len(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet").where(remainder(F.col("doc_id"), 5) != 0))

    def best_first(scores: list[float]) -> list[float]:
        """Scores of maximal segments, by taking out the best subsequence again and again."""
        best = max(((sum(scores[a:b]), a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0))
        return [] if best[0] <= 1e-12 else [*best_first(scores[: best[2]]), best[0], *best_first(scores[best[3] :])]

    for i, text, *_ in rows[:60]:
        positions, weights, n = toxicity.weigh(text or "", model)
        known = dict(zip(positions, weights, strict=True))
        nats = sum(x for s in best_first([known.get(k, model.default) for k in range(n)]) if (x := model.rate * s - model.offset - math.log(n)) > 0)
        want = 1 / (1 + math.exp(-max(-30, min(30, model.intercept + model.slope * math.log1p(nats)))))
        assert abs(got[i]["score"] - want) < 1e-9 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_short_and_odd_words(spark, texts):
    """Words of two letters teach and tell; letters whose lower case is longer keep their places."""
    docs = texts(*(" ".join(["qu" if i % 4 == 0 else "ba", "lom", "tir", "sen"] * 4) for i in range(200)))
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    assert toxicity.surprise("lom tir qu sen qu", model) > 0 == toxicity.surprise("lom tir sen", model)
    (a, b, _), *_ = toxicity.passages("İİ ½ lom QU tir", model)
    assert "İİ ½ lom QU tir"[a:b].endswith("QU")
    assert toxicity._WORD.findall(toxicity.lower("a½ Ⅷb x_y")) == ["a", "b", "x", "y"]


def test_op9(spark, folder, rows):
    got, kinds = told(spark, folder, "op9_suffix_array_dedup")
    assert {i: tuple(r)[1:] for i, r in got.items()} == slow_repeats([(i, t) for i, t, *_ in rows]) and kinds["kept_sha256"] == "string"


def test_op10(spark, folder, rows):
    found = queries.op10_best_fit_packing(spark, folder).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert {r["doc_id"]: r["length"] for r in found} == size and len(found) == len(rows)
    bins, _, final = packing.best_fit(np.array([size[i] for i in sorted(size)]))
    assert sorted(r["capacity"] for r in found) == sorted(final[bins].tolist())


def test_bins_hang_on_the_rows_alone(spark, texts):
    docs = texts(*(("w " * (i * 37 % 900)) for i in range(300)), (5, "w " * 185, None, None), (5, "w " * 185, None, None))
    whole = sorted(map(repr, packing.pack(docs.repartition(1), n_words(F.col("text")), shard=50).collect()))
    for pieces in (2, 5):
        assert sorted(map(repr, packing.pack(docs.repartition(pieces), n_words(F.col("text")), shard=50).collect())) == whole


def test_stages(spark, folder, rows):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"]: r["text"] for r in stage["language_id"](spark, docs, folder).collect()}
    assert set(kept) == {i for i, t, *_ in rows if re.search(r"[^\W\d_]", t or "")}
    label = components({i: slow_simhash(t) for i, t in kept.items()})
    one = stage["simhash_near_dedup"](spark, docs.where(F.col("doc_id").isin(list(kept))), folder)
    assert {r["doc_id"] for r in one.collect()} == {i for i in kept if label[i] == i} < set(kept)
    clean = stage["secret_scan"](spark, one, folder).collect()
    for r in clean:
        text, at, parts = kept[r["doc_id"]], 0, ""
        for a, b, k in plain_spans(text):
            if a >= at:
                parts += text[at:a] + f"[SECRET:{secrets.KINDS[k]}]"
            at = max(at, b)
        assert r["text"] == parts + text[at:] and (r["text"] == text or r["n_chars"] == len(r["text"]))
    assert any("[SECRET:assign]" in r["text"] for r in clean)
    mixed = [r["doc_id"] for r in stage["source_mixing"](spark, one, folder).collect()]
    goals = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(one.select("source", n_words(F.col("text")).alias("size"))).collect()}
    coin = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
    for r in one.collect():
        rate = goals[r["source"]][1] / goals[r["source"]][0]
        assert mixed.count(r["doc_id"]) == math.floor(rate) + (coin(r["doc_id"]) < rate % 1)
    packed = stage["best_fit_packing"](spark, one, folder).collect()
    assert {r["doc_id"]: r["length"] for r in packed} == {r["doc_id"]: len(r["text"].split()) for r in one.collect()}
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "bin_id", "position", "capacity"]


def test_noise_goes_and_short_texts_stay(spark, texts, rows):
    random.seed(3)
    noise = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)), " ".join("".join(random.choice("bcdfgqxz") for _ in range(7)) for _ in range(60))]
    docs = texts(*rows, *((1000 + i, t, None, None) for i, t in enumerate([*noise, "qxz", "torvi", "Ж"])))
    kept = {r["doc_id"] for r in langid.in_some_language(docs, langid.learn(docs)).collect()}
    assert kept == {i for i, t, *_ in rows if re.search(r"[^\W\d_]", t or "")} | {1002, 1003, 1004}


def test_columns_of_the_same_names_stay(texts):
    docs = texts("torvi linda makor", "torvi linda makor", "soldun perat").withColumns({c: F.lit("mine") for c in ("__score", "__rate", "__lang_pred", "__lower", "__copy", "__gone", "__digest", "__source")})
    for out in (langid.in_some_language(docs, langid.learn(docs)), mixing.mix_rows(docs, n_words(F.col("text"))), simhash.one_of_each(docs)):
        found = out.collect()
        assert out.columns == docs.columns and found and {r["__score"] for r in found} == {r["__copy"] for r in found} == {r["__gone"] for r in found} == {"mine"}


def test_too_many_languages(texts):
    docs = texts(*((i, "some text here", f"l{i}", None) for i in range(12)))
    with pytest.raises(ValueError):
        langid.learn(docs, most_languages=11)
    wide = langid.CrossParser({f"l{i}": bytes(random.Random(i).choices(range(128, 256), k=400)) for i in range(3)})
    wide.cells, wide.kind = wide.cells.astype(np.int64), np.int64
    assert wide.judge(np.frombuffer(bytes(range(128, 160)), np.uint8), np.array([0, 32]))[0].shape == (1,)


def test_recall_of_vectors(spark):
    """Pairs right above the threshold among 6,000 vectors, where buckets have six signs."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((3000, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((3000, 24))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.88, 0.93, (3000, 1))
    own = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    assert vectors.plan(len(own)).bits == 6
    products = own @ own.T
    np.fill_diagonal(products, 0)
    want = (products >= 0.9).sum(axis=1)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.vector_links(docs).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum() > 2000


def test_vectors_of_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (None, [1.0, 0.0]), (None, None), (3, [-0.0, 1.0]), (4, [0.0, 1.0]), (None, [7.0, -7.0])]
    got = vectors.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (3, 1, 3, True), (4, 1, 3, False), (None, 0, None, True)]))
