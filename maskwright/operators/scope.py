"""What a conversation may restore: records, ledger, vault and tokens seen on the page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forms(vault: DataFrame) -> DataFrame:
    """Each record of a vault by either of its forms: key, token (each form), original."""
    both = F.filter(F.array("placeholder", "synthetic_value"), lambda x: x != "")
    keyed = vault.select(F.explode(both).alias("key"), both.alias("tokens"), F.col("original_text").alias("original"))
    return keyed.select("key", F.explode("tokens").alias("token"), "original")


def records(*shapes: DataFrame, key: str = "conv") -> DataFrame:
    """Records of several shapes (key, token, original or null) as one; of originals the later shape's wins."""
    rows = [s.select(key, "token", "original", F.lit(i).alias("shape")) for i, s in enumerate(shapes)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionAll(r)
    return every.groupBy(key, "token").agg(F.max_by("original", F.when(F.col("original").isNotNull(), F.col("shape")).otherwise(-1)).alias("original"))


def build_scope(record: DataFrame, ledger: DataFrame, observed: DataFrame, vault: DataFrame | None, key: str = "conv") -> DataFrame:
    """key, token, original and tolerant of everything that a conversation resolves.

    Pairs of the ledger come before those of the record; tokens without an original resolve by the
    vault, and every token brings the other form of its vault record. What only observation admits
    is not tolerant: it may be matched in its exact form alone.
    """
    carried = record.filter("original is not null").select(key, "token", "original", F.lit(1).alias("rank")).unionAll(ledger.select(key, "token", "original", F.lit(0)))
    found = carried
    if vault is not None:
        known = forms(vault)
        for tokens, rank in ((carried, 2), (record.filter("original is null"), 3), (observed, 4)):
            asked = tokens.select(key, F.col("token").alias("key_token")).distinct()
            found = found.unionAll(asked.join(known, F.col("key_token") == F.col("key")).select(asked[key], "token", "original", F.lit(rank)))
    best = found.groupBy(key, "token").agg(F.min_by("original", "rank").alias("original"), F.min("rank").alias("rank"))
    return best.select(key, "token", "original", (F.col("rank") < 4).alias("tolerant"))


def unresolved(seen: DataFrame, scope: DataFrame, key: str = "conv") -> DataFrame:
    """Distinct tokens seen in a conversation that its scope does not resolve."""
    return seen.select(key, "token").distinct().join(scope.select(key, "token"), [key, "token"], "left_anti")


def filed(filings: DataFrame, *, token: str = "token", place: str = "conv", ts: str = "ts") -> DataFrame:
    """Where each token lies now: the place of its latest filing."""
    return filings.groupBy(token).agg(F.max_by(place, ts).alias(place), F.max(ts).alias(ts))


def refiled(filings: DataFrame, new: DataFrame, *, token: str = "token", place: str = "conv", ts: str = "ts") -> DataFrame:
    """The filings and new ones, each once: filing the same rows again changes nothing."""
    return filings.select(token, place, ts).unionByName(new.select(token, place, ts)).distinct()


def owned(entries: DataFrame, emitted: DataFrame, key: str = "conv") -> DataFrame:
    """Entries (key, token, original) whose token the session itself put on the page (key, token)."""
    return entries.join(emitted.select(key, "token").distinct(), [key, "token"], "left_semi")


def ledger_kept(ledger: DataFrame, record: DataFrame, key: str = "conv") -> DataFrame:
    """The ledger without conversations that have a record already: theirs starts anew."""
    return ledger.join(record.select(key).distinct(), key, "left_anti")


def without(records_: DataFrame, place: str | None = None, key: str = "conv") -> DataFrame:
    """Records without those of one conversation, or, without a place, none."""
    return records_.filter(F.lit(False)) if place is None else records_.filter(~F.col(key).eqNullSafe(F.lit(place)))
