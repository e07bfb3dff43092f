"""Quality classifier: perplexity under a model of trusted text, against a quantile per language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import kneser_ney
from trailmark.llm.words import words_of
from trailmark.operators.freeze import BROADCAST_ROWS, fits, frozen, join_attributes

# Symbols of an n-gram: they reach across the end of a word.
ORDER = 4
QUANTILE = 0.999
QUANTILE_ACCURACY = 20_000
# Ids, one long each, that are broadcast to mark the trusted rows; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _sizes(text: str | None) -> tuple[int, int]:
    words = words_of(text)
    return len(words), len(b"".join(words).decode("utf-8", "surrogatepass"))


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    quantile: float = QUANTILE,
    order: int = ORDER,
    array_entries: int = kneser_ney.ARRAY_ENTRIES,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """Per row of `docs`: the id, `n_words`, `perplexity`, `threshold`, `trusted`, `kept`.

    All rows whose id is among those of `trusted` train a Kneser-Ney model of their language, of
    n-grams that reach across words, so that the order of words counts. The
    threshold of a language is the given quantile of the perplexity, per character, of its trusted
    rows: under that model or, if larger, under models of one half of them each, for the rows of the
    other half, since texts that no model has seen are less likely than those it was made of. A row is kept if it does not exceed that. Rows without words have no perplexity and are
    not kept. A language without trusted words has no threshold, and its rows with words are kept.
    Null ids are never trusted; a null language is the language "". Repeated rows count as often
    as they occur and are judged alike. Empty tables give an empty result, other columns are ignored.
    """
    ids = frozen(
        trusted.select(F.col(id_column).alias("_trusted_id"))
        .filter("_trusted_id is not null")
        .distinct()
    )
    own = docs.select(id_column, text_column, lang_column)
    marks = F.broadcast(ids) if fits(ids, BROADCAST_IDS) else ids
    marked = own.join(marks, own[id_column] == F.col("_trusted_id"), "left").select(
        *own.columns, F.col("_trusted_id").isNotNull().alias("_trusted")
    )
    # A hash, so that ids that all leave the same rest are halved too.
    fold = F.pmod(F.xxhash64(id_column), F.lit(2))
    names = (text_column, lang_column)
    model, halves = kneser_ney.train_crossed(
        marked, F.col("_trusted"), fold, *names, order, array_entries, running=True
    )
    columns = [F.col(id_column).alias("id"), F.col("_trusted").alias("trusted")]

    def score(rows: DataFrame, by: kneser_ney.Model) -> DataFrame:
        return kneser_ney.scored(rows, columns, by, _sizes, ["n_words", "_chars"], id_column, *names)

    def tops(rows: DataFrame, name: str) -> DataFrame:
        top = F.percentile_approx("log_ppl", F.lit(quantile), F.lit(QUANTILE_ACCURACY))
        return rows.filter("log_ppl is not null").groupBy("_lang").agg(top.alias(name))

    scored = frozen(score(marked, model))
    others = [score(marked.filter(F.col("_trusted") & (fold == k)), halves[k]) for k in (0, 1)]
    unseen = others[0].unionByName(others[1])
    thresholds = frozen(
        tops(scored.filter("_row.trusted"), "_own")
        .join(tops(unseen, "_unseen"), "_lang")
        .select("_lang", F.greatest("_own", "_unseen").alias("_top"))
    )
    small = fits(thresholds, BROADCAST_ROWS)
    return join_attributes(scored, thresholds, "_lang", "left", small).select(
        F.col("_row.id").alias(id_column),
        "n_words",
        F.exp("log_ppl").alias("perplexity"),
        F.exp("_top").alias("threshold"),
        F.col("_row.trusted").alias("trusted"),
        (F.col("log_ppl").isNotNull() & F.coalesce(F.col("log_ppl") <= F.col("_top"), F.lit(True))).alias(
            "kept"
        ),
    )
