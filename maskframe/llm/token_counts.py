"""Exact token-length histogram with suffix sums.

Documents are aggregated by encoded length. From the histogram alone, suffix sums answer for
every context limit how many documents pass it, how many tokens a cut at the limit keeps or
loses, and which quantile the limit is. Null and empty texts have length 0. Special tokens written
in a text count as one, as in ``bpe``.
"""

from __future__ import annotations

import base64

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm._common import map_texts
from maskframe.llm.bpe import PATTERN, BytePairs

#: Letters of white space in a row that the rank encoder's pattern engine can't take; such texts are counted by ``BytePairs``.
BLANKS = 50_000


def lengths(docs: DataFrame, ranks_path: str, tokenizer_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encoded length of each text under a file of byte-pair ranks and the tokenizer file of the same vocabulary."""
    state: list = []

    def work(texts):
        import tiktoken

        if not state:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pairs = BytePairs(tokenizer_path)
            state.extend([tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=pairs.special), pairs, regex.compile(rf"\s{{{BLANKS}}}")])
        ranked, pairs, blanks = state
        out = []
        for t in texts:
            s = t.decode()
            plain = len(s) < BLANKS or blanks.search(s) is None
            out.append(len(ranked.encode(s, allowed_special="all", disallowed_special=()) if plain else pairs.encode([s])[0]))
        return [out]

    return map_texts(docs, text, work, T.StructType([T.StructField("n_tokens", T.LongType())]), keep or ["doc_id"])


def histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """One row a length: (n_tokens, n_docs)."""
    return lengths.groupBy(F.col(n_tokens).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """What each context limit costs, at every length that occurs.

    Columns: context_limit; n_docs of just that length; n_docs_over and tokens_over (longer
    ones, whole); truncated_total (sum of min(length, limit)); lost_tokens; total_tokens;
    quantile (share of documents of at most that length). Between two lengths the totals are
    linear in the limit. The windows see one row a distinct length, which the longest text
    bounds, not the number of documents.
    """
    up, down = Window.orderBy("n_tokens"), Window.orderBy(F.desc("n_tokens"))
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    h = h.withColumns({
        "docs_from": F.sum("n_docs").over(down),
        "tokens_from": F.sum("tokens").over(down),
        "docs_to": F.sum("n_docs").over(up),
        "tokens_to": F.sum("tokens").over(up),
    })
    over, more = F.col("docs_from") - F.col("n_docs"), F.col("tokens_from") - F.col("tokens")
    total = F.col("tokens_to") + more
    kept = F.col("tokens_to") + F.col("n_tokens") * over
    return h.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        over.alias("n_docs_over"),
        more.alias("tokens_over"),
        kept.alias("truncated_total"),
        (total - kept).alias("lost_tokens"),
        total.alias("total_tokens"),
        (F.col("docs_to") / (F.col("docs_to") + over)).alias("quantile"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that a share ``q`` of the documents does not pass."""
    marked = limits(histogram)
    return marked.filter(F.col("quantile") >= q).agg(F.min("context_limit").alias("n_tokens"))
