"""The operators on documents: brute force on small tables, and every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkwarden.llm import automaton, fingerprints, langid, mixing, packing, secrets, simhash, suffixes, toxicity
from inkwarden.llm.common import n_words, remainder

ODD = (None, "", " \t\n", "a", "two words", "word " * 3000, "same text here", "same text here", "é́ß — 漢字 \U0001f600")


@pytest.fixture(scope="module")
def odd(texts):
    """Nulls in every column, empty and long texts, repeated rows, and a column whose name clashes."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s") for i, t in enumerate(ODD)]
    return texts(*rows, (6, "same text here", "en", "s"), (None, None, None, None), (None, "no id", None, None)).withColumn("score", F.lit("mine")).withColumn("size", F.lit("mine"))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_automaton_equals_expressions():
    random.seed(5)
    for pattern in ("ab*c", "(a|bc)+d?", "[a-c]{2,}x", "a{3}|[^a]z"):
        dfa = automaton.determinise([pattern], anchored=True)
        for _ in range(300):
            s = "".join(random.choice("abcdxz") for _ in range(random.randint(0, 7)))
            state = dfa.start
            for byte in s.encode():
                state = dfa.step[state][dfa.classes[byte]]
            assert bool(dfa.accepts[state]) == bool(re.fullmatch(pattern, s)), (pattern, s)


def test_secrets_equal_expressions(texts):
    random.seed(7)
    parts = ["token", "Password", "api_key", "secret", " = ", "=", ":", '"', "AKIA", "ABCDEFGH12", "deadbeef", "0123456789abcdef", "x", "é", "\n", ",", "z_.", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36]
    own = ["".join(random.choice(parts) for _ in range(random.randint(0, 200))) for _ in range(300)]
    kinds = [("assign", re.compile(secrets.RULES[0].head + "([A-Za-z0-9+/_.=-]+)"), 8), ("access", re.compile("AKIA([A-Z0-9]+)"), 12), ("hex", re.compile("([0-9a-f]+)"), 32)]
    for row in secrets.find_secrets(texts(*own)).collect():
        text = own[row["doc_id"]]
        found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, least) in enumerate(kinds) for m in p.finditer(text) if len(m[m.lastindex]) >= least]
        told = ",".join(x[2] for x in sorted(found))
        assert row["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(x[1] == k for x in found) for k in range(3))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text, rule by rule, by Python's expressions."""
    found = []
    for number, rule in enumerate(secrets.RULES):
        for m in re.finditer(f"{rule.head}((?:{rule.tail})+)".replace("----((?:-)+)", "----(-+)"), text):
            if len(m[m.lastindex]) >= rule.least:
                found.append((m.start(), m.end(), number))
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_lanes_hide_no_secret(monkeypatch):
    """Lanes of a few bytes cut every span in many places."""
    random.seed(17)
    parts = ["token", "password", "api_key", " = ", "   ", "=", ":", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0123456789abcdef", "x", "\n", "-----BEGIN RSA PRIVATE KEY-----", "gho_" + "a" * 36, "xoxb-1234567890-x", "secret=token:ghp_", "-----BEGIN ", "-"]
    own = ["".join(random.choice(parts) for _ in range(random.randint(0, 60))) for _ in range(300)]
    raw = [t.encode() for t in own]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    for lane in (1, 3, 7, 64, 1024):
        monkeypatch.setattr(automaton.scan, "__defaults__", (lane,))
        found = secrets.spans(np.frombuffer(b"".join(raw), np.uint8), bounds)
        for i, text in enumerate(own):
            assert found.get(i, []) == plain_spans(text), (lane, text)


def test_secrets_of_one_long_line():
    """A megabyte of words without a line end, and one of a single value, take well under a second each."""
    words = ("some words and token here " * 45000).encode()
    value = b"token=" + b"a1B2" * 260000
    for raw, many in ((words, 0), (value, 1)):
        secrets.spans(np.frombuffer(raw[:5000], np.uint8), np.array([0, 5000]))
        start = time.perf_counter()
        found = secrets.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert len(found.get(0, [])) == many and time.perf_counter() - start < 1
    assert found[0] == [(0, len(value), 0)]


def test_secrets_odd(odd, empty, texts):
    rows = secrets.find_secrets(odd).collect()
    assert len(rows) == odd.count() and {r["spans"] for r in rows} == {""}
    assert secrets.find_secrets(empty).collect() == []
    clean = secrets.redact_secrets(odd)
    assert clean.columns == odd.columns and sorted(map(repr, clean.collect())) == sorted(map(repr, odd.collect()))
    hidden = secrets.redact_secrets(texts('say token = "abcdefgh123" ok').withColumn("n_chars", F.length("text"))).first()
    assert hidden["text"] == 'say [SECRET:assign]" ok' and hidden["n_chars"] == len(hidden["text"])
    clashing = texts("token=abcdefgh1").withColumns({"spans": F.lit("mine"), "n_hex": F.lit("mine"), "n_chars": F.lit(0)})
    assert secrets.find_secrets(clashing).first()["spans"] == "assign:0:15"
    assert secrets.redact_secrets(clashing).first()["spans"] == "mine"


def test_language_id(texts, odd, empty):
    random.seed(1)
    vocabulary = {"aa": ["tor", "lin", "mak", "sol"], "bb": ["éué", "oux", "rêt", "çan"]}
    make = lambda lang: " ".join("".join(random.choices(vocabulary[lang], k=3)) for _ in range(80))
    rows = [(i, make(lang := ("aa", "bb")[i % 2]), lang, "s") for i in range(60)]
    docs = texts(*rows, (60, None, None, "s"), (61, "123 ...", None, "s"), (62, "", None, "s"), (63, "zzqqjj xx", None, "s"))
    parser = langid.learn(docs.where(remainder(F.col("doc_id"), 3) != 1))
    told = {r["doc_id"]: r for r in langid.identify(docs, parser).collect()}
    assert all(told[i]["lang_pred"] == rows[i][2] for i in range(60))
    assert [told[i]["lang_pred"] for i in (60, 61, 62)] == ["und"] * 3 and told[60]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in told.values())
    clashing = langid.identify(odd, parser)
    assert clashing.count() == odd.count() and dict(clashing.dtypes)["score"] == "double"
    assert langid.identify(empty, parser).collect() == []
    none = langid.learn(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_phrases_equal_a_plain_parse():
    parser = langid.CrossParser({"x": b"the cat sat on the mat", "y": b"un chat noir dort"})
    for text in ("the mat sat", "chat noir", "zzz", "cat  --  CAT", ""):
        counts, _ = parser.phrases(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        codes = re.sub(" +", " ", "".join(c if c in "thecasonmunird" else " " for c in text.lower())).lstrip()
        for column, sample in enumerate(("the cat sat on the mat", "un chat noir dort")):
            plain, at = 0, 0
            while at < len(codes):
                end = at
                while end < len(codes) and codes[at : end + 1] in sample:
                    end += 1
                plain, at = plain + 1, max(end, at + 1)
            assert counts[0, column] == plain, (text, column)


def slow_simhash(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(odd, empty, texts):
    rows = simhash.near_duplicates(odd).collect()
    own = {r["doc_id"]: r["text"] for r in odd.where("doc_id IS NOT NULL").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["fp"] & (2**64 - 1) == slow_simhash(own[r["doc_id"]])
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[0] == by[1] == by[2] == 0 and by[6] == by[7] == 6 and len(rows) == odd.count()
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {0, 3, 4, 5, 6, 8, None}


def test_anchors_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 6), replace=False)) for b in base for _ in range(6)]
    fps = sorted({*map(int, base), *near})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {frozenset((signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want and want


def test_anchors_are_not_broadcast(spark):
    """The plan that ran, with anchors behind an exchange whose size Spark knows, as in near_duplicates."""
    found = simhash.links(spark.range(2000).select(F.xxhash64("id").alias("fp")).repartition(4, "fp"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert "Broadcast" not in plan


def test_fingerprints(odd, empty, texts):
    random.seed(2)
    own = [" ".join(random.choice("abcdefgh") + str(random.randint(0, 9)) for _ in range(random.randint(0, 300))) for _ in range(60)]
    rows = sorted(fingerprints.fingerprint(texts(*own)).collect(), key=lambda r: r["doc_id"])
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, r in enumerate(rows):
        following = own[(i + 1) % len(own)]
        edited = own[i][: len(own[i]) - len(own[i]) // 2] + following[: len(own[i]) // 2]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(own[i])
        assert abs(r["near_edited"] - like(shingles(own[i]), shingles(edited))) < 0.2
    told = fingerprints.fingerprint(odd).collect()
    assert len(told) == odd.count() and fingerprints.fingerprint(empty).collect() == []
    same = {r["fingerprint"] for r in told if r["doc_id"] in (6, 7)}
    assert len(same) == 1
    assert fingerprints.fingerprint(texts("only one here")).first()["near_next"] == 1.0


def test_minhash_classes(odd, empty, texts):
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghij", k=4))
    own = []
    for _ in range(12):
        base = [word() for _ in range(random.randint(3, 120))]
        for _ in range(6):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = word()
            own.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in own]
    label = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(texts(*own)).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) < len(own)
    both = texts((1, own[0], None, None), (1, "other words " * 9, None, None), (2, own[0], None, None), (None, "other words " * 9, None, None), (None, "alone", None, None))
    assert sorted(map(repr, ((r["doc_id"], r["class_id"]) for r in fingerprints.near_duplicates(both).collect()))) == sorted(map(repr, [(1, 1), (1, 1), (2, 1), (None, 1), (None, None)]))
    told = [(r["doc_id"], r["class_id"]) for r in fingerprints.near_duplicates(odd).collect()]
    assert len(told) == odd.count() and dict(told)[7] == 6 and dict(told)[1] == 0
    assert fingerprints.near_duplicates(empty).collect() == []


def slow_repeats(rows: list[tuple[int, str]]) -> dict[int, tuple]:
    seen: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            seen[raw[s : s + 50]] = min(i, seen.get(raw[s : s + 50], i))
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 49):
            gone[s : s + 50] |= seen[raw[s : s + 50]] < i
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats(odd, empty, texts):
    random.seed(4)
    passages = ["".join(random.choice("abcd é") for _ in range(n)) for n in (49, 50, 51, 90, 200)] + ["ab" * 60, "-" * 130]
    own = [(i, "".join(random.choice(passages)[random.randint(0, 3) :] if random.random() < 0.5 else "".join(random.choice("efgh") for _ in range(30)) for _ in range(random.randint(0, 8)))) for i in range(80)]
    random.shuffle(own)
    docs = texts(*((i, t, None, None) for i, t in own)).repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeats(docs, pack_bytes=2000).collect()}
    assert got == slow_repeats(own)
    assert len(suffixes.repeats(odd).collect()) == odd.count() and suffixes.repeats(empty).collect() == []
    with pytest.raises(TypeError):
        suffixes.repeats(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_repeats_of_a_phrase_among_changing_words(texts, monkeypatch):
    """One phrase between surroundings that mostly differ: its anchor is dealt out by what stands beside it."""
    random.seed(14)
    monkeypatch.setattr(suffixes, "HOT", 2)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(7))
    few = [word() for _ in range(3)]
    own = [(i, f"{word()} {random.choice((word(), few[0]))} {random.choice(few)} the same stock phrase of 34 bytes. {random.choice(few)} {random.choice((word(), few[1]))} {word()}" * random.randint(1, 3)) for i in range(120)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeats(texts(*((i, t, None, None) for i, t in own)).repartition(3), pack_bytes=900).collect()}
    assert got == slow_repeats(own) and any(r[1] for r in got.values())


def test_suffix_order():
    random.seed(6)
    data = np.frombuffer("".join(random.choice("ab") for _ in range(400)).encode() + b"c" * 60, np.uint8)
    at = np.array(random.sample(range(380), 120))
    group = np.sort(np.array([random.randint(0, 3) for _ in at]))
    order = suffixes.sort_suffixes(data, suffixes.prefix_hashes(data), at, group)
    keys = [(int(group[i]), data[at[i] : at[i] + 50].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(at)))


def test_large_groups_of_suffixes():
    """One phrase in changing surroundings gives one large group; equal windows, and time a suffix that doesn't grow."""
    rng = np.random.default_rng(8)
    n = 160_000
    data = rng.integers(97, 123, (n, 50)).astype(np.uint8)
    data[:, 10:34] = 45
    data[n // 2 :] = data[rng.integers(0, n // 2, n // 2)]
    at, ids = np.arange(n) * 50, rng.permutation(n).astype(np.int64)
    seen: dict[bytes, int] = {}
    for row, i in zip(data, ids.tolist(), strict=True):
        seen[row.tobytes()] = min(i, seen.get(row.tobytes(), i))
    began = time.thread_time()
    got = suffixes.least_id(data.reshape(-1), at, np.zeros(n, np.int64), ids)
    took = time.thread_time() - began
    assert got.tolist() == [seen[row.tobytes()] for row in data]
    assert suffixes.least_id(data.reshape(-1), at[:0], at[:0], ids[:0]).tolist() == []
    assert took < 0.5


def test_mixing(texts, odd, empty):
    docs = texts(*((i, "w " * (i % 7 + 1), None, ("a", "b", "c", None)[i % 4] if i < 396 else "tiny") for i in range(400)))
    rows = mixing.mix(docs, n_words(F.col("text"))).collect()
    total = sum(r["size"] for r in rows)
    by: dict[float, list] = {}
    for r in rows:
        by.setdefault((r["target"], r["source_size"]), []).append(r)
    assert abs(sum(t for t, _ in by) - total) < 1e-6 and all(t <= 3 * s + 1e-9 for t, s in by)
    for (target, _), own in by.items():
        assert abs(sum(r["size"] * r["copies"] for r in own) - target) <= 0.3 * target
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs, n_words(F.col("text"))).collect()))
    assert mixing.mix(odd, n_words(F.col("text"))).count() == odd.count() and mixing.mix(empty, n_words(F.col("text"))).collect() == []
    taken = mixing.mix_rows(docs, n_words(F.col("text"))).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in taken} == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    assert mixing.mix_rows(odd, n_words(F.col("text"))).columns == odd.columns


def test_packing(texts, odd, empty):
    sizes = np.random.default_rng(1).integers(0, 9000, 500)
    docs = texts(*(("w " * int(n)) for n in sizes))
    rows = packing.pack(docs, n_words(F.col("text")), shard=200).collect()
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: (r["position"], r["length"]))
        used = sum(r["length"] for r in own)
        assert len({r["capacity"] for r in own}) == 1 and own[0]["capacity"] == next(c for c in packing.CAPACITIES if c >= used)
        assert all(a["position"] + a["length"] == b["position"] for a, b in zip(own, own[1:], strict=False))
    covered: dict[int, int] = {}
    for r in rows:
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {i: int(n) for i, n in enumerate(sizes)}
    assert packing.pack(odd, n_words(F.col("text"))).count() == odd.count() and packing.pack(empty, n_words(F.col("text"))).collect() == []


def slow_best_fit(sizes: list[int], capacities: tuple[int, ...]) -> list[int]:
    """How full each bin is, by trying every open bin."""
    room, used, rest = [], [], sum(sizes)
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        if fits:
            i = min(fits)[1]
        else:
            c = min((c for c in capacities if c >= size), key=lambda c: packing.cost(c) / max(1, min(c, rest)))
            room.append(c)
            used.append(0)
            i = len(room) - 1
        room[i] -= size
        used[i] += size
        rest -= size
    return sorted(used)


def test_best_fit_equals_trying_all():
    for seed in range(20):
        sizes = np.random.default_rng(seed).integers(0, 700, 60)
        bins, _, final = packing.best_fit(sizes, (100, 300, 700))
        assert sorted(np.bincount(bins, sizes).astype(int).tolist()) == slow_best_fit(sizes.tolist(), (100, 300, 700)) and len(final) == bins.max() + 1


def test_segments_equal_all_maximal():
    """Ruzzo and Tompa's segments are what repeated removal of the best subsequence gives."""

    def slow(scores, lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
        return [] if best[0] <= 0 else [*slow(scores, lo, best[2]), (best[0], best[2], best[3] - 1), *slow(scores, best[3], hi)]

    random.seed(8)
    for _ in range(200):
        scores = [random.choice((-3, -2, -1, 1, 2, 4)) + random.random() / 100 for _ in range(9)]
        at = [i for i in range(9) if scores[i] > 0 or random.random() < 0.5]
        full = [scores[i] if i in at else -0.5 for i in range(9)]
        got = toxicity.segments(at, [scores[i] for i in at], -0.5)
        want = slow(full, 0, 9)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def test_toxicity(spark, texts, odd, empty):
    random.seed(9)
    calm = ["".join(random.choices(("lo", "mi", "ra", "ten"), k=3)) for _ in range(300)]
    make = lambda bad: " ".join(random.choice(("grukfel", "grukhan", "zorbast")) if bad and random.random() < 0.05 else random.choice(calm) for _ in range(150))
    docs = texts(*(make(i % 5 == 0) for i in range(400)))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    model = toxicity.learn(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    told = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([told[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    assert toxicity.score(empty, model).collect() == []
    assert toxicity.passages(f"{' '.join(calm[:40])} grukfel grukhan zorbast {' '.join(calm[:40])}", model)
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.learn(docs, labels.where("false"))).collect()} == {0}
