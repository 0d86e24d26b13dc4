"""Checks of answers against their sources, with verdicts of a judge as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def unsupported_numbers(answer: Column, sources: Column) -> Column:
    """Numbers of the answer that no source has."""
    return F.array_except(text.numbers(answer), text.numbers(F.array_join(sources, "\n")))


def numeric_layer(answer: Column, sources: Column) -> Column:
    """Sentences of the answer with a number that no source has; a sentence that also has a sourced one is a derivation and passes."""
    bad = lambda own, sourced: (F.size(F.array_except(own, sourced)) > 0) & (F.size(F.array_intersect(own, sourced)) == 0)
    found = lambda sourced: F.filter(text.sentences(answer), lambda s: text.once(text.numbers(s), lambda own: bad(own, sourced)))
    return text.once(text.numbers(F.array_join(sources, "\n")), found)


def gated(answers: DataFrame, verdicts: DataFrame, limit: float = 0.4, replacement: str = "资料中未找到可核实的内容。") -> DataFrame:
    """(id, action, answer): sentences without support are taken out; more than ``limit`` of them, and the answer is replaced.

    ``answers``: id, answer, sources (array of texts). ``verdicts``: id, item (sentence, from 0), supported.
    Answers that say that nothing was found pass as they are.
    """
    s = answers.select("id", F.posexplode(text.sentences(F.col("answer"))).alias("item", "sentence"))
    # Numbers meet as rows of their own, so the work grows with the texts' lengths, not with their product.
    own = s.select("id", "item", F.explode(text.numbers(F.col("sentence"))).alias("number"))
    sourced = answers.select("id", F.explode(text.numbers(F.array_join("sources", "\n"))).alias("number")).distinct().withColumn("sourced", F.lit(True))
    found = own.join(sourced, ["id", "number"], "left").groupBy("id", "item").agg(F.count("sourced").alias("with"), F.count("*").alias("all"))
    numbers_bad = F.coalesce((F.col("all") > 0) & (F.col("with") == 0), F.lit(False))
    judged = s.join(found, ["id", "item"], "left").join(verdicts.select("id", "item", "supported"), ["id", "item"], "left").withColumn("bad", numbers_bad | ~F.coalesce("supported", F.lit(True)))
    kept = F.array_sort(F.collect_list(F.when(~F.col("bad"), F.struct("item", "sentence"))))
    g = judged.groupBy("id").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"), kept.alias("kept")).join(answers.groupBy("id").agg(F.first("answer").alias("answer")), "id")
    passes = text.says_not_found(F.col("answer")) | (F.col("bad") == 0)
    action = F.when(passes, "pass").when(F.col("bad") / F.col("n") > limit, "replace").otherwise("trim")
    out = F.when(action == "pass", F.col("answer")).when(action == "replace", replacement).otherwise(F.array_join(F.transform("kept", lambda x: x["sentence"]), " "))
    return g.select("id", action.alias("action"), out.alias("answer"))


def supported_share(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Share of true verdicts, four decimals."""
    return verdicts.groupBy(*keys).agg(F.round(F.avg(F.col("supported").cast("int")), 4).alias("share"), F.count("*").alias("n"))


def quality_gate(tier: Column, answer: Column, n_sources: Column, top_score: Column) -> Column:
    """struct(verdict, warning) by tier: small talk passes; an empty answer fails; the rest depends on sources."""
    empty = F.trim(F.coalesce(answer, F.lit(""))) == ""
    verdict = F.when(empty, "fail").when(tier == "simple", "pass").when(text.says_not_found(answer), "refusal").when(n_sources == 0, "warn").when(top_score < 0.5, "weak").otherwise("pass")
    warning = F.when(verdict == "warn", "no sources").when(verdict == "weak", "low confidence").when(text.has_citation(answer) & (n_sources == 0), "unsourced citation")
    return F.struct(verdict.alias("verdict"), warning.alias("warning"))
