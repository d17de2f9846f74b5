"""Quality by hierarchical empirical Bayes: a document's own evidence on top of its site's posterior.

Document evidence is the log-likelihood ratio of its binned measures under the two labels. A site
(host) and each of its paths have a posterior share of good documents from labels and, where there
are none, from the evidence; paths shrink towards their host, hosts towards the whole. Prior strengths
come from how much the groups differ. Aggregates and joins of built-in functions alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.quality_rules import measures
from tidewatch.session import cut_lineage

# Measures with the upper ends of their bins. A measure that is null for a short text says nothing about it.
BINS: dict[str, tuple[str, tuple[float, ...]]] = {
    "length": ("n_words", (5, 20, 50, 200, 1000, 5000)),
    "word_length": ("if(n_words >= 20, word_chars / n_words, null)", (2, 3, 4, 5, 6, 8, 10, 15)),
    "symbols": ("n_symbols / greatest(n_words, 1)", (0, 0.02, 0.1, 0.3, 0.6, 1)),
    "duplicate_lines": ("if(n_lines > 1, n_dup_lines / n_lines, null)", (0, 0.1, 0.3, 0.6)),
    "repeats": ("if(n_words >= 20, n_repeat_words / n_words, null)", (0, 0.02, 0.1, 0.3, 0.6)),
    "stop_words": ("if(n_words >= 20, n_stops, null)", (0, 1, 3, 6, 12)),
    "shouts": ("n_shouts / greatest(n_words, 1)", (0, 0.05, 0.3, 0.6)),
}
SMOOTHING = 1.0
KEEP_AT = 0.5
_FLOOR = 1e-4


@dataclass(frozen=True)
class Priors:
    """The whole's share of good documents, and the strengths (in documents) of both levels' priors."""

    share: float
    host: float
    path: float


def _bin(name: str) -> Column:
    metric, ends = BINS[name]
    value = F.expr(metric)
    out = F.when(value.isNotNull(), F.lit(len(ends)))
    for i in reversed(range(len(ends))):
        out = F.when(value <= ends[i], i).otherwise(out)
    return out


def _logit(p: Column) -> Column:
    bounded = F.greatest(F.least(p, F.lit(1 - _FLOOR)), F.lit(_FLOOR))
    return F.log(bounded / (1 - bounded))


def _evidence(binned: DataFrame) -> Column:
    """The summed log-likelihood ratios of all bins, from one aggregate over the labelled rows.

    There are some 50 bins, so their counts pass through the driver as constants.
    """
    sums = []
    for name, (_, ends) in BINS.items():
        for b in range(len(ends) + 1):
            at = F.when(F.col(name) == b, 1.0).otherwise(0.0)
            sums += [F.sum(at * F.col("_y")).alias(f"{name}_{b}_good"), F.sum(at * (1 - F.col("_y"))).alias(f"{name}_{b}_bad")]
    got = {k: v or 0.0 for k, v in binned.where("_y is not null").agg(*sums).first().asDict().items()}
    total = F.lit(0.0)
    for name, (_, ends) in BINS.items():
        n = len(ends) + 1
        good, bad = ([got[f"{name}_{b}_{kind}"] + SMOOTHING for b in range(n)] for kind in ("good", "bad"))
        ratios = [F.lit(math.log(good[b] / sum(good)) - math.log(bad[b] / sum(bad))) for b in range(n)]
        # Spark takes an element of an array without nulls for not null, whatever its place is; so a silent measure is asked first.
        total = total + F.when(F.col(name).isNull(), F.lit(0.0)).otherwise(F.element_at(F.array(*ratios), F.coalesce(name, F.lit(0)) + 1))
    return total


def _strength(groups: DataFrame, within: str | None = None) -> float:
    """Prior strength from the moments of the groups' shares around that of what they shrink towards: the more they differ, the weaker.

    ``groups`` has n documents and s good ones a row. They are compared with the share of their ``within`` (hosts
    with the whole, paths with their own host), so what sets hosts apart says nothing about their paths.
    """
    parent = [] if within is None else [within]
    sums = groups.groupBy(*parent).agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss")
    )
    share = F.col("s") / F.col("n")
    var, spread, room = share * (1 - share), F.col("ss") - F.col("s") * share, F.col("n") - F.col("nn") / F.col("n") - (F.col("g") - 1)
    row = sums.where("n > 0 AND g > 1").agg(F.sum(spread - (F.col("g") - 1) * var).alias("more"), F.sum(room * var).alias("room")).first()
    if not row["room"] or row["room"] <= 0:
        return 10.0
    likeness = min(max(row["more"] / row["room"], 1e-3), 0.5)
    return 1 / likeness - 1


def classify(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", good: str = "quality"
) -> DataFrame:
    """One row per row of ``documents``: id, host, path, evidence, site_share, posterior and kept.

    ``site_share`` is the posterior of the path without the document itself, ``posterior`` adds the
    document's evidence to its log-odds, ``kept`` if that is at least one half. Hosts and paths that
    are null are groups of their own. Null texts count as empty. Of repeated labels the lowest counts; without
    labels of both kinds evidence is zero and all are kept. Very long texts count whole, repeated rows are documents of their own, an
    empty table gives an empty one. Other columns are not carried, whatever their names.
    """
    known = labels.where(F.col(good).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.min(F.col(good).cast("double")).alias("_y"))
    plain = documents.select(F.col(id_col).alias("_id"), F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path"), F.col(text).alias("_text"))
    binned = measures(plain, "_text").select("_id", "_host", "_path", *[_bin(name).alias(name) for name in BINS])
    rows = cut_lineage(binned.join(known, F.col("_id") == F.col("_label_id"), "left").drop("_label_id"))
    whole = rows.agg(F.avg("_y").alias("share"), F.count("_y").alias("n")).first()
    both = whole["n"] > 0 and 0 < whole["share"] < 1
    share = whole["share"] if both else 1 - _FLOOR
    odds = F.log(F.lit(share / (1 - share)))
    marked = rows.withColumn("_llr", _evidence(rows) if both else F.lit(0.0))
    marked = marked.withColumn("_e", F.coalesce("_y", 1 / (1 + F.exp(-(F.col("_llr") + odds)))))
    paths = cut_lineage(marked.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), F.sum("_e").alias("s")))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    priors = Priors(share, _strength(hosts), _strength(paths, "_host"))
    of_host = hosts.select(F.col("_host").alias("_h"), F.col("n").alias("_hn"), F.col("s").alias("_hs"))
    sites = paths.join(of_host, F.col("_host").eqNullSafe(F.col("_h"))).select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "n", "s", "_hn", "_hs")
    joined = marked.join(sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    # The document's own part is taken out of both levels, so its evidence counts once.
    host_share = (F.col("_hs") - F.col("_e") + priors.host * priors.share) / (F.col("_hn") - 1 + priors.host)
    path_share = (F.col("s") - F.col("_e") + priors.path * host_share) / (F.col("n") - 1 + priors.path)
    out = joined.withColumn("site_share", path_share).withColumn("posterior", 1 / (1 + F.exp(-(F.col("_llr") + _logit(F.col("site_share"))))))
    return out.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_llr").alias("evidence"),
        "site_share", "posterior", (F.col("posterior") >= KEEP_AT).alias("kept"),
    )
