"""The whole scan as one plan: texts in, one verdict row each out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import examine, exports, scoring
from ..policy import Policy
from ..rules import BUILTIN, Ruleset
from ..shipping import ship
from . import outliers

@dataclass(frozen=True)
class Scanner:
    """Rules and policy; scan() is a function of DataFrames, so it runs on tables and stream batches alike.

    A verdict hangs on one text, and everything about a text stays in its own row: the plan reads once,
    has one Arrow round trip for whatever needs the bytes, and shuffles nothing. model gives
    (doc_id, raw) for documents, raw from 0 to 1000 or null where it can't tell.
    """

    ruleset: Ruleset = BUILTIN
    policy: Policy = Policy()
    resources: tuple[exports.Resource, ...] = ()
    model: Callable[[DataFrame], DataFrame] | None = None

    def findings(self, rows: DataFrame, excerpt: int | None = None) -> DataFrame:
        """rows (doc_id, text) with active, hidden (suppressed) and incomplete, before the display limits.

        excerpt: bytes of each excerpt, the policy's limit for display if None. Here the class filter is
        applied, once, to what is found by any means; suppressed findings are spared.
        """
        ship(rows.sparkSession)
        told = rows.select("doc_id", examine.examine(self.ruleset, self.policy, self.resources, excerpt)(F.col("text")).alias("e"))
        admitted = F.filter("e.active", lambda f: f["rule_class"].isin(*self.policy.classes))
        return told.select("doc_id", F.array_sort(admitted).alias("active"), F.array_sort("e.hidden").alias("hidden"), F.col("e.gaps").alias("incomplete"))

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, outcome, score, risk, decision, reasons, reasons_truncated, suppressed, incomplete) of every row.

        Null texts are empty and clean; texts over the input limit are not looked into and are
        inconclusive. Suppressed findings spend the budget of observations first.
        """
        policy = self.policy
        rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        rows = rows.withColumn("__big", F.octet_length("text") > policy.max_input_bytes)
        # The gate is inside the stage: an oversized text is emptied, so nothing downstream can run on it.
        rows = rows.withColumn("text", F.when(F.col("__big"), "").otherwise(F.col("text")))
        big = rows.select(F.struct("doc_id", "__big").alias("doc_id"), "text")
        told = self.findings(big).select("doc_id.doc_id", "doc_id.__big", "active", "hidden", "incomplete")
        spent = F.least(F.size("hidden"), F.lit(policy.max_observations))
        over = F.size("hidden") + F.size("active") > policy.max_observations
        reached = lambda c, cause: F.when(c, F.array(F.lit(cause))).otherwise(F.array().cast("array<string>"))
        told = told.withColumn("incomplete", F.array_sort(F.array_distinct(F.concat("incomplete", reached(over, "max_observations"), reached(F.col("__big"), "max_input_bytes")))))
        told = told.withColumn("active", F.slice("active", F.lit(1), policy.max_observations - spent)).withColumn("hidden", F.slice("hidden", 1, policy.max_observations))
        told = told.withColumns({"score": scoring.score_of(F.col("active")), "n_reasons": F.size("active"), "n_gaps": F.size("incomplete")})
        if self.model:
            told = outliers.ml_merge(told, self.model(rows.where("NOT __big")), policy.ml_threshold, policy.ml_impact).drop("raw")
        told = told.withColumns({"risk": scoring.band(F.col("score"), self.ruleset.bands), "outcome": scoring.outcome(F.col("n_reasons"), F.col("n_gaps"))})
        told = told.withColumn("decision", scoring.decision(F.col("outcome"), F.col("risk"), policy.threshold))
        return told.select("doc_id", "outcome", "score", "risk", "decision", F.slice("active", 1, policy.max_reasons).alias("reasons"), (F.size("active") > policy.max_reasons).alias("reasons_truncated"), F.slice("hidden", 1, policy.max_reasons).alias("suppressed"), "incomplete")
