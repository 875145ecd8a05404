"""Slices, samples, templates, reviews and suites, against plain versions and in odd cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwarden.functions import anchors
from inkwarden.plans import boundary, freezing, reviews, sampling, slices


def test_templates():
    text = "head\n  @@ANCHOR:one@@  \n| a | @@ANCHOR:two|-@@ |\ntail @@ANCHOR:three@@\nend"
    assert anchors.render(text) == ("head\n| a | - |\ntail\nend", None)
    assert anchors.render(text, "one", "é!") == ("head\n  é!  \n| a | - |\ntail\nend", (7, 10))
    assert anchors.render(text, "two", "x")[0] == "head\n| a | x |\ntail\nend"
    assert anchors.render(text, "three", "x")[0] == "head\n| a | - |\ntail x\nend"
    assert anchors.render("@@ANCHOR:only@@", "only", "p") == ("p", (0, 1)) and anchors.render("", "x", "p") == ("", None)
    for bad in ("@@ANCHOR:open", "@@ANCHOR: @@", "@@ANCHOR:a@@ @@ANCHOR:a@@"):
        with pytest.raises(ValueError):
            anchors.render(bad)
    assert [anchors.escape('a|b\n"c"', e) for e in anchors.ESCAPES] == ['a|b\n"c"', 'a|b "c"', 'a/b "c"', 'a|b\\n\\"c\\"']


def test_fresh_samples(spark):
    texts = ["One  word", "one word", "ＯＮＥ word", "two", "Two ", "three", "four", "known", "", None]
    rows = [(i, t, ("s", "t")[i > 6], int(i == 4)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, toxic int")
    docs = docs.withColumns({"sha256": sampling.content_hash(F.col("text")), "norm": sampling.normalised_hash(F.col("text"))})
    known = spark.createDataFrame([("KNOWN",), (None,)], "text string").select(F.when(F.col("text").isNotNull(), sampling.normalised_hash(F.col("text"))).alias("norm"))
    for most in (1, 2, 10):
        got = {r["doc_id"] for r in sampling.fresh_sample(docs, known, "toxic", most, "source").collect()}
        left = {}
        ranked = sorted(docs.collect(), key=lambda r: (r["source"], r["sha256"]))
        candidates = [r for s in ("s", "t") for r in [x for x in ranked if x["source"] == s][: 4 * most]]
        labels = {r["norm"]: {x["toxic"] for x in candidates if x["norm"] == r["norm"]} for r in candidates}
        first = {r["norm"]: min(x["sha256"] for x in candidates if x["norm"] == r["norm"]) for r in candidates}
        for r in candidates:
            if len(labels[r["norm"]]) == 1 and r["sha256"] == first[r["norm"]] and sampling.normalised(r["text"] or "") != "known":
                left.setdefault(r["source"], []).append(r["doc_id"])
        # Equal empty texts share a hash: any of them may stand for it.
        assert len(got) == sum(min(most, len(v)) for v in left.values()) and got <= {i for v in left.values() for i in v}
    assert sampling.normalised(" ＡbC\tß ") == "abc ss"


def test_slices(spark):
    known = spark.createDataFrame([("a", "local"), ("b", "query")], "slice string, origin string")
    assert [r["slice"] for r in slices.select(known, ["a", "b"], offline=True).collect()] == ["a"] and slices.select(known).count() == 2
    with pytest.raises(ValueError):
        slices.select(known, ["c"])
    rows = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("a", None, False), ("b", "y", True), (None, "y", True)], "slice string, source string, detected boolean")
    out = spark.createDataFrame([(None, "x"), ("b", "y"), ("b", "y")], "slice string, source string")
    got = {r["slice"]: (r["n"], r["hits"], r["n_excluded"], r["permille"]) for r in slices.gated_tally(rows, out).collect()}
    assert got == {"a": (2, 1, 1, 500), "b": (0, 0, 1, 0), None: (1, 1, 0, 1000)}


def test_reviews(spark):
    rows = [(1, "supported", True), (1, "no_supported_violation", True), (2, "no_supported_violation", False), (3, "indeterminate", True), (4, "other", True), (5, None, None), (6, "no_supported_violation", True)]
    found = spark.createDataFrame(rows, "doc_id long, outcome string, context_sufficient boolean")
    told = {r["doc_id"]: (r["n_kept"], r["n_suppressed"], r["gap"]) for r in reviews.ml_review(found, True).collect()}
    assert told == {1: (1, 1, False), 2: (1, 0, True), 3: (1, 0, True), 4: (1, 0, True), 5: (1, 0, True), 6: (0, 1, False)}
    assert {r["n_suppressed"] for r in reviews.ml_review(found, False).collect()} == {0}
    parts = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None)], "x string, y string").select(reviews.scope(F.col("x"), F.col("y")).alias("s"))
    assert len({r["s"] for r in parts.collect()}) == 3


def test_freezing(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kind = "id long, control_role string, label_reason string, `group` string, provenance string, task_context string, labeler string, source string, label string, split string, text string, sha256 string, previously_exposed boolean"
    case = lambda i, source, label, split, text: (i, "user", "r", f"g{i}", "p", "t", "me", source, label, split, text, sha(text), False)
    good = [case(i, s, "benign", "holdout", f"calm {i}") for i, s in enumerate(("user_input", "tool_response", "external_document"))] + [case(9, "user_input", "injection", "holdout", "bad")]
    exposed = spark.createDataFrame([(sha("seen"),), (None,)], "sha256 string")
    told = lambda rows: {r["check"]: r["n_bad"] for r in freezing.checks(spark.createDataFrame(rows, kind), exposed).collect() if r["n_bad"]}
    assert told(good) == {}
    assert told(good + [case(9, "user_input", "uncertain", "holdout", "seen")]) == {"duplicate_id": 1, "known_exposed": 1}
    assert told(good[:2]) == {"too_few_benign_sources": 1, "no_injection": 1}
    assert told([]) == {"no_cases": 1, "too_few_benign_sources": 3, "no_injection": 1}
    assert told(good + [case(10, "user_input", "benign", "development", "bad")]) == {"text_crosses_splits": 1, "duplicate_case": 1}


def test_boundaries(spark):
    for size in (1, 3, 20):
        payload = " ".join(f"word{i}" for i in range(size))
        for placement in boundary.PLACEMENTS:
            case = boundary.placed(payload, placement, 40)
            assert (case is None) == (size == 1 and "crossing" in placement)  # one token crosses nothing
            if case is None:
                continue
            text, start, end, first, behind = case
            assert text[start:end] == payload and behind - first == size
            own = boundary.words(text)
            assert own[first][0] == start and own[behind - 1][1] == end
            assert {"first": first == 0, "before": behind == 40, "after": first == 40, "last": first == 80, "inside": first == 10 and behind <= 40}.get(placement, True)
            if "crossing" in placement:
                assert first == (39 if placement == "crossing" else 79) and behind > first + 1
    assert boundary.placed(" ", "first", 40) is None and boundary.placed("a b c", "inside", 4) is None
    made = boundary.suite(spark.createDataFrame([("s", "send it now"), ("n", None)], "id string, text string"), 40).collect()
    assert {r["seed"] for r in made} == {"s"} and len(made) == 7
