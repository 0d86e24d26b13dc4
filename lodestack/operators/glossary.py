"""Glossaries: merging term tables, and the terms of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The patterns of the four classes of terms; \b sees the letters of every script.
MULTI = r"(?U)\b[A-Z][A-Za-z0-9]*(?:[ ](?:of|for|and|the|in|with|to)?[ ]?[A-Z][A-Za-z0-9]*){1,3}\b"
ACRONYM = r"(?U)\b[A-Z]{2,12}\b"
MODEL = r"(?U)\b[A-Z][A-Za-z0-9]{0,10}(?:-[A-Z0-9][A-Za-z0-9]*)+\b"
PHRASE = r"(?U)\b[a-z]{3,}(?: [a-z]{3,}){1,2}\b"
# Words that no lower-case phrase has.
STOP = [
    "the", "and", "for", "with", "this", "that", "from", "are", "can", "will", "when", "where", "which", "into", "onto", "than", "then", "not", "but", "all", "any", "each", "per", "via", "use", "used",
    "using", "have", "has", "had", "was", "were", "been", "must", "should", "may", "might", "after", "before", "during", "between", "such", "same", "other", "more", "most", "less", "least", "only",
    "also", "both", "over", "under", "out", "off", "its", "his", "her", "our", "their", "there", "here", "what", "how", "why",
]
# Words of legal notices and stock sentences, which no lower-case phrase has either.
BOILERPLATE = [
    "notice", "copyright", "copyrights", "patent", "patents", "rights", "reserved", "asserted", "covered", "mentioned", "approved", "edition", "labels", "sheets", "liability", "warranty", "declined",
    "responsibility", "assumes", "disclaims", "permission", "without", "except", "provided", "reproduction", "transmission", "retrieval", "photocopying", "recording", "scanning", "information", "material",
    "materials", "products", "manufacturer", "supplier", "reference", "consult", "contact", "address", "establish", "ensure", "ensures", "appropriate", "applicable", "relevant", "following", "above",
    "below", "given", "shown", "listed", "described", "discussed",
]
# Everyday words of manuals, which no capitalised phrase has.
EVERYDAY = [
    "with", "note", "caution", "warning", "figure", "table", "chapter", "section", "page", "manual", "contents", "appendix", "revision", "continued", "example", "default", "description", "parameter",
    "parameters", "setting", "settings", "function", "display", "menu", "screen", "status", "system", "control", "operation", "installation", "maintenance", "troubleshooting", "overview", "introduction",
    "general", "item", "items", "step", "steps", "no", "yes", "on", "off", "ok", "id", "part", "name", "type", "size", "mode", "data", "time", "date", "led", "lcd", "usb", "ac", "dc", "rpm", "psi", "kpa",
    "mpa", "circuit", "diagram", "wiring", "power", "supply", "voltage", "current", "signal", "output", "input", "error", "alarm", "code", "press", "touch", "select", "enter", "set", "clear", "start", "stop",
    "open", "close", "this", "that", "these", "those",
]


def terms(docs: DataFrame, text_col: str = "text", least: int = 4, top: int = 4000) -> DataFrame:
    """(term, tf): candidates of four classes, each with its own least frequency.

    Capitalised phrases with an everyday word and lower-case phrases with a stop
    or boilerplate word are no candidates. A phrase of three words also counts
    as its two pairs. Terms that differ in case are one, with the highest
    count's spelling. ``top``: the report has that many terms at most.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    kinds = {"multi": MULTI, "acronym": ACRONYM, "model": MODEL, "phrase": PHRASE}
    tagged = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("term"))
    found = F.concat(*[F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), tagged(k)) for k, p in kinds.items()])
    # Counted first: what follows sees each distinct candidate once.
    raw = docs.select(F.explode(found).alias("r")).select("r.*").groupBy("kind", "term").agg(F.count("*").alias("tf"))
    without = lambda words, c: ~F.arrays_overlap(F.split(c, " +"), F.array(*map(F.lit, words)))
    p = F.col("term")
    is_multi, is_phrase, is_model = (F.col("kind") == k for k in ("multi", "phrase", "model"))
    kept = raw.filter(F.when(is_multi, without(EVERYDAY, F.lower(p))).when(is_phrase, without(STOP + BOILERPLATE, p)).when(is_model, F.length(p) >= 3).otherwise(True))
    three = is_phrase & (F.size(F.split(p, " ")) == 3)
    named = F.when(three, F.array(p, F.substring_index(p, " ", 2), F.substring_index(p, " ", -2))).when(is_model, F.array(F.lower(p))).otherwise(F.array(p))
    few = F.when(F.col("kind").isin("multi", "model"), least).otherwise(2 * least)
    counted = kept.select("kind", F.explode(named).alias("term"), "tf").groupBy("kind", "term").agg(F.sum("tf").alias("tf")).filter(F.col("tf") >= few)
    best = counted.groupBy(F.lower("term").alias("key")).agg(F.max_by("term", F.struct("tf", "term")).alias("term"), F.max("tf").alias("tf"))
    return best.orderBy(F.desc("tf"), "term").limit(top).select("term", "tf")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Term tables (en, tf, zh array) by lower-case term: arrays united in order, the old spelling and frequency kept."""
    side = lambda df, tag: df.select(F.lower(F.trim("en")).alias("key"), F.col("en").alias(f"en{tag}"), F.col("tf").alias(f"tf{tag}"), F.col("zh").alias(f"zh{tag}"))
    both = side(old, 0).join(side(new, 1), "key", "full_outer")
    none = F.array().cast("array<string>")
    return both.select(F.coalesce("en0", "en1").alias("en"), F.coalesce("tf0", "tf1").alias("tf"), F.array_distinct(F.concat(F.coalesce("zh0", none), F.coalesce("zh1", none))).alias("zh"))


def translations(terms_: DataFrame) -> DataFrame:
    """(zh, en): for each translation the longest term; of equals that of the higher frequency."""
    rows = terms_.select(F.explode("zh").alias("zh"), "en", "tf").filter("trim(zh) <> ''")
    w = Window.partitionBy("zh").orderBy(F.desc(F.length("en")), F.desc("tf"), "en")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").select("zh", "en")


def inferred_stems(queries: DataFrame, registry: DataFrame, least: float = 4, margin: float = 1.5, tie: float = 0.9) -> DataFrame:
    """(query_id, stems): the document families that a query's words point to, joined by two bars.

    A family scores the lengths of its mixed letter-digit words (three
    characters and more) and CJK runs that the query has. The best family is
    named if it has ``least`` points and ``margin`` times those of the second,
    else those within ``tie`` of it; a single one among them with most words in
    the query is named alone.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("base"), F.lit("[a-z0-9][a-z0-9-]*[a-z0-9]|[a-z0-9]"), F.lit(0)))
    runs = F.regexp_extract_all("base", F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    all_words = F.regexp_extract_all(F.lower("base"), F.lit("[a-z0-9][a-z0-9-]*[a-z0-9]|[a-z0-9]"), F.lit(0))
    mixed = F.filter(all_words, lambda w: (F.length(w) >= 3) & w.rlike("[0-9]") & w.rlike("[a-z]"))
    tokens = registry.select("base", F.explode(F.concat(mixed, runs)).alias("t")).groupBy("base", "t").agg(F.count("*").alias("times"))
    # A token that the query has is one of its substrings of a token's length: they meet by the whole token.
    q = queries.select("query_id", F.lower("text").alias("q"))
    lengths = F.broadcast(tokens.agg(F.collect_set(F.length("t")).alias("lengths")))  # one row
    places = q.crossJoin(lengths).select("query_id", "q", "lengths", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("q")))).alias("at"))
    parts = places.select("query_id", "q", F.explode(F.transform("lengths", lambda n: F.substring(F.col("q"), F.col("at"), n))).alias("t")).distinct()
    near = parts.join(tokens, "t")
    scored = near.groupBy("query_id", "q", "base").agg(F.sum(F.length("t") * F.col("times")).alias("score"))
    w = Window.partitionBy("query_id")
    placed = scored.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"))))
    ranked = placed.withColumns({"best": F.max("score").over(w), "second": F.max(F.when(F.col("place") == 2, F.col("score"))).over(w)})
    second = F.coalesce("second", F.lit(0))
    tops = ranked.filter((F.col("best") >= least) & (F.col("score") >= F.col("best") * tie)).join(registry.select("base", words.alias("words")), "base")
    raw = F.size(F.filter("words", lambda x: (F.length(x) >= 2) & F.contains(F.col("q"), x)))
    tops = tops.withColumns({"clear": F.col("best") >= second * margin, "close": second >= F.col("best") * tie, "raw": raw}).withColumn("most", F.max("raw").over(w))
    g = tops.groupBy("query_id").agg(F.max("clear").alias("clear"), F.max("close").alias("close"), F.array_sort(F.collect_list("base")).alias("all"), F.max_by("base", "score").alias("top"), F.collect_list(F.when(F.col("raw") == F.col("most"), F.col("base"))).alias("lead"), F.max("most").alias("most"))
    named = F.when(F.col("clear"), F.col("top")).when(F.col("close"), F.when((F.size("lead") == 1) & (F.col("most") > 0), F.get("lead", F.lit(0))).otherwise(F.array_join("all", "||")))
    return g.select("query_id", named.alias("stems")).filter("stems is not null")
