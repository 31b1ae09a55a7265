"""Finding items: free text search, ordered pattern rules and pattern corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.operators.bounded import small_or_shuffled

# ---- fixed values ----
SEARCH_LIMIT = 60
# ---- end of fixed values ----

# A rule table is code-sized; beyond this it is joined, not unrolled into one expression.
MAX_INLINE_RULES = 500


def search(items: DataFrame, facts: DataFrame, text: str | None) -> DataFrame:
    """Newest 60 whose name or maker contains the text; without text, those somebody owns."""
    if text:
        hits = items.where(F.lower("name").contains(text.lower()) | F.lower("maker").contains(text.lower()))
    else:
        hits = items.join(facts.select("item_id").distinct(), "item_id", "left_semi")
    return hits.orderBy(F.col("created_at").desc(), F.col("item_id").desc()).limit(SEARCH_LIMIT)


def classify(items: DataFrame, rules: list[dict]) -> DataFrame:
    """First matching rule by position: global rules anywhere, others only in their own country.

    Few rules become one CASE over the row: no join, and evaluation stops at the first hit. More of them are a table.
    """
    if len(rules) > MAX_INLINE_RULES:
        rows = [(r["priority"], r.get("country"), r["pattern"], bool(r["legend"])) for r in rules]
        return classify_table(items, items.sparkSession.createDataFrame(
            rows, "priority long, country string, pattern string, legend boolean"))
    text = F.col("_text")
    out: Column | None = None
    for rule in sorted(rules, key=lambda r: r["priority"]):
        hit = text.rlike("(?i)" + rule["pattern"])
        if not rule["legend"]:
            hit = hit & (F.col("country") == rule["country"])
        value = F.lit(rule["priority"]).cast("long")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    rule_column = F.lit(None).cast("long") if out is None else out
    return items.withColumn("_text", F.concat_ws(" ", "maker", "name")).withColumn("rule", rule_column).drop("_text")


def classify_table(items: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with rules (priority, country, pattern, legend) as a table of any length.

    The rules of a country, and the global ones, come as one array each, so an item meets them in one row: nothing is
    multiplied. Both arrays are as long as somebody wrote rules."""
    entry = F.sort_array(F.collect_list(F.struct("priority", "pattern")))
    local = rules.where(~F.col("legend")).groupBy("country").agg(entry.alias("_local"))
    everywhere = rules.where(F.col("legend")).agg(entry.alias("_global"))
    joined = items.join(small_or_shuffled(local), "country", "left").crossJoin(F.broadcast(everywhere))
    joined = joined.withColumn("_text", F.concat_ws(" ", "maker", "name"))

    def first(name: str) -> Column:
        hits = F.filter(F.coalesce(F.col(name), F.array()), lambda r: F.regexp_like(F.col("_text"), F.concat(F.lit("(?i)"), r["pattern"])))
        return F.try_element_at(hits, F.lit(1))["priority"].cast("long")

    return joined.withColumn("rule", F.least(first("_local"), first("_global"))).select(*items.columns, "rule")


def override(items: DataFrame, include: str, exclude: str, column: str, value: str, maker: str | None = None) -> DataFrame:
    """Correct `column` where the name contains one fragment and not another, and the maker a third; `hit` marks those rows."""
    hit = F.lower("name").contains(include.lower()) & ~F.lower("name").contains(exclude.lower())
    if maker is not None:
        hit = hit & F.lower("maker").contains(maker.lower())
    return items.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn(column, F.when(F.col("hit"), F.lit(value)).otherwise(F.col(column)))
