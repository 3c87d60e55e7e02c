"""Passages that bear on a claim: BM25 within each work, then a judgement of each claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblion.functions.text import is_number, tokens

# Fixed values.
K1, B, TOP, SUPPORT_AT, LEAST_CHARS = 1.5, 0.75, 4, 0.4, 5_000


def bm25(claims: DataFrame, passages: DataFrame, top: int = TOP, claim_tokens: Column | None = None, passage_tokens: Column | None = None) -> DataFrame:
    """claims(claim_id, work, claim), passages(work, idx, text) -> claim_id, work, idx, score, has_numbers, n.

    The best `top` passages of each claim; passage 0 takes the last place if it is not among them. Statistics are
    per work. Claims and passages meet on (work, token), with the passage side aggregated to one row a token.
    """
    words = passages.select("work", "idx", (tokens(F.col("text")) if passage_tokens is None else passage_tokens).alias("t"))
    sizes = words.select("work", "idx", F.size("t").alias("len"))
    stats = sizes.groupBy("work").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    counts = words.select("work", "idx", F.explode("t").alias("token")).groupBy("work", "idx", "token").agg(F.count("*").alias("c"))
    freq = counts.groupBy("work", "token").agg(F.count("*").alias("df"))
    query = claims.select("claim_id", "work", F.explode(tokens(F.col("claim")) if claim_tokens is None else claim_tokens).alias("token")).groupBy("claim_id", "work", "token").agg(F.count("*").alias("q"))
    query = query.withColumn("number", is_number(F.col("token")))
    wanted = query.where("number").groupBy("claim_id", "work").agg(F.count("*").alias("wanted"))
    hit = query.join(freq, ["work", "token"]).join(counts, ["work", "token"]).join(sizes, ["work", "idx"]).join(stats, "work")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    avg = F.when(F.col("avg_len") > 0, F.col("avg_len")).otherwise(1.0)
    tf = F.col("c") * (K1 + 1) / (F.col("c") + K1 * (1 - B + B * F.col("len") / avg))
    scored = hit.groupBy("claim_id", "work", "idx").agg(
        F.sum(idf * tf * F.col("q") * F.when(F.col("number"), 2.0).otherwise(1.0)).alias("score"), F.count_if("number").alias("numbers")
    )
    # passage 0 is a candidate even without a word in common
    zero = claims.select("claim_id", "work").distinct().join(passages.where("idx = 0").select("work", "idx"), "work").join(scored, ["claim_id", "work", "idx"], "left_anti")
    scored = scored.unionByName(zero.select("claim_id", "work", "idx", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("numbers")))
    scored = scored.join(wanted, ["claim_id", "work"], "left").withColumn("has_numbers", F.coalesce(F.col("numbers") >= F.col("wanted"), F.lit(False)))
    w = Window.partitionBy("claim_id", "work").orderBy(F.col("has_numbers").desc(), F.round("score", 9).desc(), "idx")
    ranked = scored.withColumn("n", F.row_number().over(w)).withColumn("zero_at", F.max(F.when(F.col("idx") == 0, F.col("n"))).over(Window.partitionBy("claim_id", "work")))
    late = F.coalesce(F.col("zero_at") > top, F.lit(False))
    kept = ranked.where((F.col("n") <= F.when(late, top - 1).otherwise(top)) | (late & (F.col("idx") == 0)))
    return kept.select("claim_id", "work", "idx", "score", "has_numbers", F.least("n", F.lit(top)).alias("n"))


def quote_in(quotes: DataFrame, texts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """quotes(quote_id, quote), texts(text_id, text) -> pairs where the text holds the quote word for word.

    With key columns it is an equi-join; without, the quotes must be few (they are broadcast, and their number is
    checked), for every text is tested against each.
    """
    if key:
        return quotes.join(texts, key).where(F.contains("text", "quote"))
    if quotes.limit(10_001).count() > 10_000:
        raise ValueError("too many quotes for a scan; give key columns to join on")
    return texts.join(F.broadcast(quotes), F.contains("text", "quote"))


def incomplete(n_chars: Column, paywalled: Column) -> Column:
    """Why a full text cannot be used; null if it can."""
    return F.when(paywalled, "paywall").when(n_chars < LEAST_CHARS, "too short")


def judge(hits: DataFrame, claims: DataFrame) -> DataFrame:
    """hits(claim_id, idx, quote, score), claims(claim_id, has_text, name_in_title) -> claim_id, verdict, reason, quote, score.

    Supported where the best passage scores SUPPORT_AT; a name in the title confirms what has no passage.
    """
    best = hits.groupBy("claim_id").agg(F.max(F.struct("score", (-F.col("idx")).alias("i"), "quote")).alias("b"))
    out = claims.join(best, "claim_id", "left").withColumn("score", F.col("b.score"))
    yes = F.coalesce(F.col("score") >= SUPPORT_AT, F.lit(False))
    verdict = F.when(yes | F.col("name_in_title"), "supported").otherwise("not_confirmed")
    reason = F.when(yes, "passage").when(F.col("name_in_title"), "name in title").when(~F.col("has_text"), "no text").otherwise("no passage bears it out")
    return out.select("claim_id", verdict.alias("verdict"), reason.alias("reason"), F.when(yes, F.col("b.quote")).alias("quote"), "score")


def lexical_score(claim: Column, passage: Column) -> Column:
    """The verifier shipped here: the share of the claim's distinct words that the passage has. It is no language model."""
    a, b = F.array_distinct(tokens(claim)), F.array_distinct(tokens(passage))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def each_claim_once(claims: DataFrame) -> DataFrame:
    return claims.dropDuplicates(["work", "claim"])


def previous_in(rows: DataFrame, group: list[str], order: str, column: str) -> DataFrame:
    """With the value of the row before as previous_<column>."""
    return rows.withColumn(f"previous_{column}", F.lag(column).over(Window.partitionBy(*group).orderBy(order)))


def carry_forward(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """Nulls of a column take the last value before them (ditto marks)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))
