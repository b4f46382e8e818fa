"""Same or nearly the same reports in training and held-out splits.

Every report is brought to its words (no case, markup, punctuation, white space) and hashed; equal
hashes are one class, so copies are handled once.  Classes that agree only in part are found by
hashes too, of word groups that nearly equal texts must share.  With n words in the longer text, at
least c = ceil(0.8 n) of them stand in the other one in order.

- Texts of up to SHORT words: order all words by a fixed global order, rare ones first.  The two first
  common words stand among the first n - c + 2 of either text; these words are hashed, or their pairs
  where both are frequent.
- Longer ones, of which pairs would be too many: of the words' n - 1 neighbourhoods at most n - c are
  broken on either side, so 3 c - 2 n - 1 pairs of neighbours are common; by the same argument, one of
  the first n - (3 c - 2 n - 1) of either text is, in an order of pairs of neighbours.

Texts of nearly SHORT words are hashed both ways, so no link can be missed, whatever the orders are;
the hashes of a text are linear in its words.  A parity map of all words goes with each hash and
turns away most chance meetings at the join.  An exact check of the common subsequence follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.splits import clean_split
from stepwright.llm.words import common_in_order, words
from stepwright.session import cut_lineage, document_batches, written

#: Common words, in order, against the longer text's words: at least FOUR of FIVE.
FOUR, FIVE = 4, 5
#: Texts of more words are hashed by pairs of neighbours.
SHORT = 160
#: The global order is by how many texts have a word (pair), counted in 2 ** SKETCH_BITS cells of their hashes: a count may be
#: too large, never too small.  What counts no more than FREQUENT is rare, and hashed alone.  The result doesn't depend on it.
FREQUENT, SKETCH_BITS = 48, 20
#: Instances whose ids are broadcast to pick their rows; beyond it Spark chooses how to join.
MOST_BROADCAST = 1_000_000
#: Signatures that a worker holds before it passes them on.
_SLICE = 200_000

_CUT = r"(?s)(?:\[?\s*(?:\.\.\.|…)\s*\]?)\s*(?:</\w+>\s*)*$"
_TAGGED = r"(?is)<report>(.*?)</report>"


def needed(n: int) -> int:
    """Words of a text of n that a partner has to share at least."""
    return -(-FOUR * n // FIVE)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def missing(statement: str | Column) -> Column:
    """Whether a statement is null, blank or cut short (it ends in an ellipsis)."""
    statement = F.col(statement) if isinstance(statement, str) else statement
    return statement.isNull() | (F.regexp_replace(statement, r"(?U)\s+", "") == "") | statement.rlike(_CUT)


def reports(instances: DataFrame, build_dataset: DataFrame) -> DataFrame:
    """(instance_id, report, splits) of every instance with rows in train, dev or test of ``build_dataset``.

    splits adds 1 for train, 2 for dev, 4 for test.  The report is the problem statement or, where that
    is missing, the text between the report tags of the first user message (of the smallest row_id that
    has one); it is null where there is neither.
    """
    split = clean_split("split")
    bit = F.when(split == "train", 1).when(split == "dev", 2).when(split == "test", 4).otherwise(0)
    placed = build_dataset.filter("instance_id IS NOT NULL").groupBy("instance_id").agg(F.bit_or(bit).alias("splits")).filter("splits > 0")
    stated = instances.filter(~missing("problem_statement")).groupBy("instance_id").agg(F.max("problem_statement").alias("statement"))
    placed = written(placed.join(stated, "instance_id", "left"))
    # only tags move, and only of instances that need one: their ids go to the rows or, where they are too many, the tags to them
    without = placed.filter("statement IS NULL").select("instance_id")
    first_user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    tag = F.regexp_extract(first_user, _TAGGED, 1).alias("tagged")
    rows = build_dataset.select("instance_id", "row_id", "messages")
    if without.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(without), "instance_id", "left_semi").select("instance_id", "row_id", tag)
    else:
        rows = rows.select("instance_id", "row_id", tag)
    tagged = rows.filter("tagged <> ''").groupBy("instance_id").agg(F.min_by("tagged", "row_id").alias("tagged"))
    return placed.join(tagged, "instance_id", "left").select("instance_id", F.coalesce("statement", "tagged").alias("report"), "splits")


def classes(df: DataFrame) -> DataFrame:
    """``df`` (instance_id, report, splits) with the class and the hashed words, in order, of each report.

    Reports without words have no class and are left out.
    """
    document_batches(df.sparkSession, 1_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            keep, ids, hashed = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = words(text)
                if not found:
                    continue
                if len(memo) > 200_000:
                    memo.clear()
                for w in found:
                    if w not in memo:
                        memo[w] = _hash(w)
                keep.append(i)
                ids.append(hashlib.blake2b(" ".join(found).encode("utf-8", "replace"), digest_size=16).digest())
                hashed.append([memo[w] for w in found])
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(2), pa.array(ids, pa.binary()), pa.array(hashed, pa.list_(pa.int64()))],
                names=["instance_id", "splits", "class_id", "words"])

    return df.select("instance_id", "report", "splits").mapInArrow(run, "instance_id string, splits int, class_id binary, words array<bigint>")


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of each pair."""
    with np.errstate(over="ignore"):
        x = first * _ODD[0] + (second ^ (second >> np.uint64(29))) * _ODD[1]
        x = (x ^ (x >> np.uint64(31))) * _ODD[2]
        return x ^ (x >> np.uint64(30))


def _numbered(x: np.ndarray) -> np.ndarray:
    """``x`` with the second, third... of equal values told apart by their number."""
    order = np.argsort(x, kind="stable")
    run = x[order]
    again = np.concatenate([[False], run[1:] == run[:-1]]) if len(x) else np.zeros(0, bool)
    if not again.any():
        return x
    place = np.arange(len(x))
    number = place - np.maximum.accumulate(np.where(again, 0, place))
    out = x.copy()
    out[order[again]] = _mixed(run[again], number[again].astype(np.uint64))
    return out


def common_neighbours(n: int) -> int:
    """The pairs of neighbours that a text of n words shares with any partner, at least."""
    least = 3 * needed(n) - 2 * n - 1  # a partner of n words or, if n + 1 need no more than n, of those
    return min(least, 3 * needed(n + 1) - 2 * n - 2) if needed(n + 1) <= n else least


def features(found: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(words, neighbours) of a text by which it is hashed, each numbered; None where a text isn't hashed by them."""
    n = len(found)
    alone = _numbered(found) if n <= SHORT else None
    beside = _numbered(_mixed(found[:-1], found[1:])) if FIVE * n > FOUR * SHORT else None
    return alone, beside


def _texts(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The word lists of an Arrow column."""
    values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        yield values[low:high]


def _cells(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def sketch(texts: DataFrame) -> np.ndarray:
    """The number of texts a cell of the features' hashes; 0 for cells with no more than FREQUENT.

    Counted where the texts are; of the fixed number of cells only those above FREQUENT reach the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(_cells(np.concatenate([f for f in features(w) if f is not None]))) for w in _texts(batch.column(0))]
            cells, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], names=["cell", "n"])

    counts = texts.select("words").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    return out


#: Bits of the parity map that goes with a signature: bit b is the parity of the number of words that fall on b, so
#: two maps differ in at most as many bits as the texts have words that aren't common to both.
_BITS = 256
_MAPS = [f"m{i}" for i in range(_BITS // 64)]


def _parity(found: np.ndarray) -> np.ndarray:
    odd = np.bincount((found & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures_of(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes of a text of which it shares one at least with every partner."""
    n = len(found)
    alone, beside = features(found)
    out = []
    if alone is not None:
        common = counts[_cells(alone)]
        order = np.lexsort((alone, common))[: n - needed(n) + 2]
        if n < 3:  # too short for two common words
            out.append(alone)
        else:
            rare, often = alone[order[common[order] == 0]], alone[order[common[order] > 0]]
            i, j = np.triu_indices(len(often), 1)
            out += [rare, _mixed(often[i], often[j])]
    if beside is not None:
        order = np.lexsort((beside, counts[_cells(beside)]))
        out.append(~beside[order[: n - common_neighbours(n)]])
    return np.unique(np.concatenate(out))


def signatures(texts: DataFrame, counts: np.ndarray, side: str) -> DataFrame:
    """(signature, <side>_class, <side>_n, <side>_m0...) of every class of ``texts`` (class_id, words)."""
    sent = texts.sparkSession.sparkContext.broadcast(counts)  # 8 MB, whatever the texts are
    names = ["signature", f"{side}_class", f"{side}_n", *[f"{side}_{m}" for m in _MAPS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            take, sizes, out, maps, held = [], [], [], [], 0

            def rows() -> pa.RecordBatch:
                lengths = np.array([len(o) for o in out])  # noqa: B023
                own = np.repeat(np.array(maps).reshape(-1, len(_MAPS)), lengths, axis=0)  # noqa: B023
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out).view(np.int64)), batch.column(0).take(pa.array(np.repeat(take, lengths))), pa.array(np.repeat(sizes, lengths).astype(np.int32)),  # noqa: B023
                     *[pa.array(np.ascontiguousarray(own[:, k])) for k in range(len(_MAPS))]], names=names)

            for i, found in enumerate(_texts(batch.column(1))):
                own = signatures_of(found, counts)
                take.append(i)
                sizes.append(len(found))
                out.append(own)
                maps.append(_parity(found))
                held += len(own)
                if held > _SLICE:
                    yield rows()
                    take, sizes, out, maps, held = [], [], [], [], 0
            if out:
                yield rows()

    kinds = ", ".join(f"{side}_{m} bigint" for m in _MAPS)
    return texts.select("class_id", "words").mapInArrow(run, f"signature bigint, {side}_class binary, {side}_n int, {kinds}")


def near_classes(texts: DataFrame) -> DataFrame:
    """(train_class, eval_class) of different classes of ``texts`` (class_id, splits, words) that agree in four
    fifths of the longer one's words, in order."""
    counts = sketch(texts)
    train = signatures(texts.filter(F.col("splits").bitwiseAND(1) > 0), counts, "train")
    held = signatures(texts.filter(F.col("splits").bitwiseAND(6) > 0), counts, "eval")
    longer, shorter = F.greatest("train_n", "eval_n"), F.least("train_n", "eval_n")
    differ = F.lit(0)
    for m in _MAPS:
        differ = differ + F.bit_count(F.col(f"train_{m}").bitwiseXOR(F.col(f"eval_{m}")))
    least = F.ceil(longer * F.lit(FOUR) / F.lit(FIVE))
    pairs = train.join(held, "signature").filter(
        (F.col("train_class") != F.col("eval_class")) & (shorter * FIVE >= longer * FOUR) & (differ <= longer + shorter - 2 * least))
    pairs = pairs.select("train_class", "eval_class").distinct()
    of = lambda side: texts.select(F.col("class_id").alias(f"{side}_class"), F.col("words").alias(f"{side}_words"))
    both = pairs.join(of("train"), "train_class").join(of("eval"), "eval_class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [common_in_order(a.tolist(), b.tolist(), needed(max(len(a), len(b)))) for a, b in zip(_texts(batch.column(2)), _texts(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("train_class", "eval_class", "train_words", "eval_words").mapInArrow(run, "train_class binary, eval_class binary")


def linked_classes(instances: DataFrame, build_dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (instance_id, splits, class_id), and the links (train_class, eval_class, exact) of their classes.

    A class with members on both sides is linked with itself, exactly.
    """
    members = written(classes(reports(instances, build_dataset)))
    texts = written(members.groupBy("class_id").agg(F.bit_or("splits").alias("splits"), F.first("words").alias("words")))
    near = near_classes(texts).withColumn("exact", F.lit(False))
    same = texts.filter("splits > 1 AND (splits & 1) = 1")
    links = near.unionByName(same.select(F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class"), F.lit(True).alias("exact")))
    return members.select("instance_id", "splits", "class_id"), links


def overlap_pairs(instances: DataFrame, build_dataset: DataFrame) -> DataFrame:
    """(instance_id_1, instance_id_2), the smaller first, each once: an instance in train and another one in dev or test
    whose reports agree.

    An instance that has rows on both sides is on both, but is no pair with itself.
    """
    members, links = linked_classes(instances, build_dataset)
    side = lambda name, bits: members.filter(F.col("splits").bitwiseAND(bits) > 0).select(F.col("class_id").alias(f"{name}_class"), F.col("instance_id").alias(f"{name}_id"))
    found = links.join(side("train", 1), "train_class").join(side("eval", 6), "eval_class").filter("train_id <> eval_id")
    return found.select(F.least("train_id", "eval_id").alias("instance_id_1"), F.greatest("train_id", "eval_id").alias("instance_id_2")).distinct()


def overlap_report(instances: DataFrame, build_dataset: DataFrame) -> DataFrame:
    """Pairs and held-out instances per held-out split and per source of the held-out and the training instance.

    A pair of instances delivered under several sources counts under each; split_pairs, split_exact and split_eval_instances
    are the totals of the split, each pair and instance once.  Pairs are counted from the members of the linked
    classes by split and source, and are never made.  Instances without a source have rows with a null one.
    """
    members, links = linked_classes(instances, build_dataset)
    members, links = written(members), written(links)
    source = instances.filter("source IS NOT NULL").select("instance_id", "source").distinct()
    by_source = _counted(members.join(source, "instance_id", "left"), links, ["source"], "n_")
    return by_source.join(_counted(members, links, [], "split_"), "eval_split")


def _counted(members: DataFrame, links: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """(eval_split, eval_<by>, train_<by>, <prefix>pairs, exact, eval_instances) of the members of ``links``.

    For each held-out class and value of a training member, the partners are summed over the links.  A member on
    both sides is one partner too many for itself, so those are counted apart: they lose one exact pair
    each, and are no overlap where that was the only one.
    """
    n = F.count(F.lit(1))
    value = lambda side: [F.col(c).alias(f"{side}_{c}") for c in by]
    both_by = [f"{s}_{c}" for s in ("eval", "train") for c in by]
    train_by, eval_by = [f"train_{c}" for c in by], [f"eval_{c}" for c in by]
    train = members.filter(F.col("splits").bitwiseAND(1) > 0).groupBy(F.col("class_id").alias("train_class"), *value("train")).agg(n.alias("n_train"))
    split = F.explode(F.filter(F.array(F.when(F.col("splits").bitwiseAND(2) > 0, "dev"), F.when(F.col("splits").bitwiseAND(4) > 0, "test")), lambda s: s.isNotNull()))
    held = members.filter(F.col("splits").bitwiseAND(6) > 0).withColumn("eval_split", split)
    evals = held.groupBy(F.col("class_id").alias("eval_class"), "eval_split", *value("eval")).agg(n.alias("n_eval"))
    partners = links.join(train, "train_class").groupBy("eval_class", *train_by).agg(
        F.sum("n_train").alias("partners"), F.sum(F.when(F.col("exact"), F.col("n_train")).otherwise(0)).alias("exact_partners"))
    met = evals.join(partners, "eval_class").withColumn("selves", F.lit(0).cast("bigint"))
    # members that are on both sides, by the values they have on each
    twice = held.filter(F.col("splits").bitwiseAND(1) > 0).select("instance_id", F.col("class_id").alias("eval_class"), "eval_split", *value("eval"))
    if by:
        twice = twice.join(members.select("instance_id", *value("train")), "instance_id")
    selves = twice.groupBy("eval_class", "eval_split", *both_by).agg(n.alias("selves"))
    zero = F.lit(0).cast("bigint")
    selves = selves.select(*[c for c in met.columns if c in selves.columns and c != "selves"], zero.alias("n_eval"), zero.alias("partners"), zero.alias("exact_partners"), "selves")
    joined = met.unionByName(selves).groupBy("eval_class", "eval_split", *both_by).agg(*[F.max(c).alias(c) for c in ("n_eval", "partners", "exact_partners", "selves")])
    alone = F.when(F.col("partners") == 1, F.col("selves")).otherwise(0)
    counts = joined.groupBy("eval_split", *eval_by, *train_by).agg(
        F.sum(F.col("n_eval") * F.col("partners") - F.col("selves")).alias(f"{prefix}pairs"), F.sum(F.col("n_eval") * F.col("exact_partners") - F.col("selves")).alias(f"{prefix}exact"),
        F.sum(F.col("n_eval") - alone).alias(f"{prefix}eval_instances"))
    return counts.filter(F.col(f"{prefix}pairs") > 0)
