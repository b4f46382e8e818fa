"""Ranking, calibration and correlation metrics of scored samples.

Ranks and curves are computed over a histogram of the distinct scores (score, positives, negatives), in
ordered buckets of it, so no task sees all samples nor all scores.  Undefined values
(one class only, no samples, no variance) are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwright.operators.ordered import sums_before, value_bucket
from stepwright.session import cut_lineage

# The inner edges of ten equal bins as sums of doubles come out.
EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)
EPS = 1e-7
#: Ranks that are broadcast: a few megabytes.
MOST_RANKS = 100_000
DIGITS = 6


def rounded(c: Column, name: str) -> Column:
    return F.round(c, DIGITS).alias(name)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def score_histogram(df: DataFrame, label: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Positives and negatives of each distinct score (per ``by``), each row counted ``weight`` times if given."""
    w = F.lit(1) if weight is None else F.col(weight)
    total = lambda hit: F.coalesce(F.sum(F.when(hit, w)), F.lit(0)).cast("bigint")
    return df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*(by or []), score).agg(
        total(F.col(label) == 1).alias("pos"), total(F.col(label) != 1).alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half, one row per ``by``."""
    by = by or []
    hist = score_histogram(df, label, score, by, weight)
    placed = sums_before(hist, value_bucket(hist, score), [score], {"below": "neg"}, by)
    sums = placed.withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select(*by, (F.col("pos") + F.col("neg")).alias("n"), rounded(_ratio(F.col("won"), F.col("pos") * F.col("neg")), "auc"))


def value_ranks(hist: DataFrame, value: str) -> DataFrame:
    """(value, avg_rank) of the distinct values of ``hist`` (value, n): ranks from 1, ties share their mean."""
    placed = sums_before(hist.select(value, "n"), value_bucket(hist, value), [value], {"before": "n"})
    return placed.select(value, (F.col("before") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def average_ranks(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, avg_rank): ranks from 1, ties share their mean; the ordered pass is over distinct values.

    The ranks go to the rows as a broadcast as long as there are at most MOST_RANKS of them, so a value that most rows
    have isn't gathered in one task; above that, values are spread by their number.
    """
    hist = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")))
    ranks = value_ranks(hist, value)
    few = F.broadcast(ranks) if hist.count() <= MOST_RANKS else ranks
    return df.filter(F.col(value).isNotNull()).select(key, value).join(few, value).select(key, value, "avg_rank")


def pr_auc(df: DataFrame, label: str, score: str, tie: str) -> DataFrame:
    """Mean precision at the positives, samples by falling score, ties in the order of ``tie``.

    Samples are range partitioned by (score, tie); a positive's place and the positives before it are those
    within its partition plus the sums of the partitions before it, of which there are few.
    """
    part = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(label, score, tie)
    part = part.repartitionByRange(F.col(score).desc(), F.col(tie).asc()).withColumn("_p", F.spark_partition_id())
    part = cut_lineage(part)  # both passes must see the same partitions
    sums = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_k"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k0"))
    inside = Window.partitionBy("_p").orderBy(F.col(score).desc(), F.col(tie).asc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = part.withColumn("_i", F.row_number().over(inside)).withColumn("_t", F.sum((F.col(label) == 1).cast("int")).over(inside)).join(offsets, "_p")
    precision = (F.col("_k0") + F.col("_t")) / (F.col("_n0") + F.col("_i"))
    return placed.filter(F.col(label) == 1).agg(rounded(F.avg(precision), "pr_auc"))


def class_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 at ``score >= threshold``; a ratio over nothing is 0, accuracy null."""
    said, true = F.col(score) >= threshold, F.col(label) == 1
    c = df.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"), F.count_if(~said & true).alias("fn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    precision, recall = zero(_ratio(F.col("tp"), F.col("tp") + F.col("fp"))), zero(_ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.select("tp", "fp", "tn", "fn", rounded(_ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), "accuracy"),
                    rounded(precision, "precision"), rounded(recall, "recall"), rounded(zero(_ratio(2 * precision * recall, precision + recall)), "f1"))


def brier(label: str, score: str) -> Column:
    return F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0)))


def log_loss(label: str, score: str) -> Column:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(score).cast("double")))
    return -F.avg(F.col(label) * F.ln(p) + (1 - F.col(label)) * F.ln(1 - p))


def bin_of(score: str) -> Column:
    """The number of inner edges below the score: bins are open on the left, the first one closed."""
    number = F.lit(0)
    for edge in EDGES:
        number = number + (F.col(score) > F.lit(edge)).cast("int")
    return number


def calibration(df: DataFrame, label: str, score: str) -> DataFrame:
    """All ten bins with count, mean score and share of positives, null where a bin is empty."""
    bins = df.sparkSession.range(len(EDGES) + 1).select(F.col("id").cast("int").alias("bin"))
    found = df.groupBy(bin_of(score).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s"), F.avg(F.col(label).cast("double")).alias("y"))
    return bins.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), rounded(F.col("s"), "mean_score"), rounded(F.col("y"), "pos_rate"))


def ece(df: DataFrame, label: str, score: str) -> DataFrame:
    """Expected calibration error over the ten bins."""
    bins = df.groupBy(bin_of(score).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s"), F.avg(F.col(label).cast("double")).alias("y"))
    return bins.agg(rounded(F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n"), "ece"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation from moments; null for less than two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    flat = (F.count(x) < 2) | (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    return F.when(~flat, F.covar_pop(x, y) / (F.nullif(F.stddev_pop(x), F.lit(0.0)) * F.nullif(F.stddev_pop(y), F.lit(0.0))))


def spearman(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rank correlation from the histogram of the pairs (x, y): a row a distinct pair is ranked and weighs its count."""
    pairs = cut_lineage(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("n")))
    side = lambda c, rank: value_ranks(pairs.groupBy(c).agg(F.sum("n").alias("n")), c).select(c, F.col("avg_rank").alias(rank))
    ranked = pairs.join(side("_x", "rx"), "_x").join(side("_y", "ry"), "_y")
    w, rx, ry = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    mean = (F.sum("n") + 1) / 2.0  # of ranks from 1, whatever the ties are
    sums = ranked.agg(F.sum("n").alias("n"), mean.alias("m"), F.sum(w * rx * ry).alias("xy"), F.sum(w * rx * rx).alias("xx"), F.sum(w * ry * ry).alias("yy"))
    part = lambda c: F.col(c) - F.col("n") * F.col("m") * F.col("m")
    flat = (F.col("n") < 2) | (part("xx") <= 0) | (part("yy") <= 0)
    return sums.select(rounded(F.when(~flat, part("xy") / F.sqrt(part("xx") * part("yy"))), "spearman"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def soft_bce(label: str, logit: str, w_pos: float = 1.0, w_neg: float = 1.0) -> Column:
    """Weighted cross entropy of soft labels on logits, in the stable form."""
    log_sig = lambda z: -F.log1p(F.exp(-F.abs(z))) + F.least(z, F.lit(0.0))
    z, y = F.col(logit), F.col(label)
    return -F.avg(F.lit(w_pos) * y * log_sig(z) + F.lit(w_neg) * (1 - y) * log_sig(-z))


def position_bucket(index: str) -> Column:
    i = F.col(index)
    return F.when(i.isNull(), "nan").when(i <= 5, i.cast("string")).when(i <= 10, "6-10").when(i <= 15, "11-15").when(i <= 20, "16-20").otherwise("21+")


def relative_bucket(index: str, count: str) -> Column:
    """The tenth of a trajectory in which a step lies."""
    tenth = F.least(F.lit(9), F.floor(F.lit(10) * (F.col(index) - 1) / F.greatest(F.lit(1), F.col(count)))).cast("int")
    return F.when(F.col(count).isNull() | F.col(index).isNull() | (F.col(count) <= 0), "nan").otherwise(F.concat(F.lit("["), (tenth * 10).cast("string"), F.lit("%,"), (tenth * 10 + 10).cast("string"), F.lit("%]")))


def length_bucket(tokens: str) -> Column:
    t = F.col(tokens)
    return F.when(t.isNull(), "nan").when(t <= 4096, "<=4K").when(t <= 8192, "4-8K").when(t <= 12288, "8-12K").when(t <= 16384, "12-16K").otherwise(">16K")


def bucket_metrics(df: DataFrame, label: str, score: str, bucket: Column) -> DataFrame:
    """Per bucket: count, share of positives, mean score, Brier score and AUC."""
    tagged = df.withColumn("bucket", bucket)
    plain = tagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col(label).cast("double")), "pos_rate"), rounded(F.avg(score), "mean_score"), rounded(brier(label, score), "brier"))
    return plain.join(roc_auc(tagged, label, score, ["bucket"]).select("bucket", "auc"), "bucket", "left")


def summary(df: DataFrame, label: str, score: str, by: str, mc: str) -> DataFrame:
    """Per split: AUC, Brier, accuracy, log loss and the correlation of the score with the success rate."""
    plain = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), rounded(brier(label, score), "brier"), rounded(F.avg(((F.col(score) >= 0.5) == (F.col(label) == 1)).cast("double")), "accuracy"),
        rounded(log_loss(label, score), "log_loss"), rounded(pearson(F.col(mc), F.col(score)), "mc_corr"))
    return plain.join(roc_auc(df, label, score, [by]).select(by, "auc"), by, "left")


def replicates(key: str, n_boot: int, seed: int = 42) -> Column:
    """The weights of a row in ``n_boot`` bootstrap replicates: Poisson(1) numbers drawn from a hash of its key.

    The weights make the resampling one aggregation of (rows x replicates) counters that combine on the map
    side; no row is drawn by position, so no global numbering is needed.
    """
    u = lambda b: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    draws = F.transform(F.sequence(F.lit(1), F.lit(n_boot)), lambda b: u(b))
    # The Poisson(1) distribution function at 0 to 6
    cdf = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    return F.transform(draws, lambda x: sum(((x >= F.lit(c)).cast("int") for c in cdf), F.lit(0)))


def bootstrap_ci(df: DataFrame, key: str, value: str, n_boot: int = 200, alpha: float = 0.05, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Percentile interval of the mean (per ``by``) over ``replicates``."""
    rows = df.filter(F.col(value).isNotNull()).select(*(by or []), value, F.posexplode(replicates(key, n_boot, seed)).alias("b", "w")).filter("w > 0")
    means = rows.groupBy(*(by or []), "b").agg((F.sum(F.col("w") * F.col(value).cast("double")) / F.sum("w")).alias("mean"))
    return means.groupBy(*(by or [])).agg(rounded(F.percentile("mean", F.lit(alpha / 2)), "low"), rounded(F.percentile("mean", F.lit(1 - alpha / 2)), "high"), F.count(F.lit(1)).alias("n_boot"))


def bootstrap_metric(df: DataFrame, key: str, columns: list[str], metric: Callable[[DataFrame, str, list[str]], DataFrame], value: str, n_boot: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of any metric that can weigh rows and be taken per group: ``metric`` gets rows (columns, w), the
    name of the weight and the columns to group by, and gives one row a group with ``value``; undefined replicates don't count."""
    rows = df.select(*columns, F.posexplode(replicates(key, n_boot, seed)).alias("b", "w")).filter("w > 0")
    found = metric(rows, "w", ["b"]).filter(F.col(value).isNotNull())
    return found.agg(rounded(F.percentile(value, F.lit(alpha / 2)), "low"), rounded(F.percentile(value, F.lit(1 - alpha / 2)), "high"), F.count(F.lit(1)).alias("n_boot"))
