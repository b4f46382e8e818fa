"""Evaluation texts leaking into training text.

The words of all test items are put into one generalised suffix automaton.  A document's words are
streamed through it; the state tells the longest ending of what was read that occurs in any item.
A match of MIN_WORDS words is a case at once.  Wherever a match has SEED words or more, the items and
places where it occurs are known from the state, and are checked by an alignment of the item with the
document around them: a passage of MIN_WORDS item words with at most one edit in ten has an unbroken
run of at least SEED words, so every case is met.

The runs of a passage give the span of the document to be taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stepwright.llm.words import word_places, words
from stepwright.session import document_batches

#: Item words in a row that make a case, and item words for each edit allowed.
MIN_WORDS, PER_EDIT = 25, 10
#: The items of an automaton are broadcast: those beyond so many words or bytes in all are handled in further passes.
MAX_ITEM_WORDS, MAX_ITEM_BYTES = 200_000, 8 << 20


def seed_length(min_words: int = MIN_WORDS, per_edit: int = PER_EDIT) -> int:
    """The run of unchanged words that any case has: w words with e = w // per_edit edits fall into at most e + 1 runs."""
    return min(-(-(w - w // per_edit) // (w // per_edit + 1)) for w in range(min_words, min_words + 20 * per_edit))


class Automaton:
    """Generalised suffix automaton over the words of items; states know where their words end.

    The places of a state are those of all states below it in the tree of suffix links.  They are kept in one list in the
    order of that tree, in which each state's are a range, so they take no more room than the items.
    """

    def __init__(self, items: list[list[int]], *lengths: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for number, item in enumerate(items):
            last = 0
            for place, word in enumerate(item):
                last = self._extend(last, word)
                ends.append((last, number, place))
        shortest_first = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        own = [0] * len(self.length)
        for state, _, _ in ends:
            own[state] += 1
        total = list(own)
        for state in reversed(shortest_first):
            total[self.link[state]] += total[state]
        self.low = [0] * len(self.length)
        free = list(own)  # where the next state below begins, after a state's own places
        for state in shortest_first:
            above = self.link[state]
            self.low[state], free[above] = free[above], free[above] + total[state]
            free[state] += self.low[state]
        self.high = [low + n for low, n in zip(self.low, total, strict=True)]
        self.numbers, self.places = [0] * len(ends), [0] * len(ends)
        at = list(self.low)
        for state, number, place in ends:
            self.numbers[at[state]], self.places[at[state]] = number, place
            at[state] += 1
        #: For each of ``lengths``, the state above each one that still has so many words.
        self.tops = {n: self._tops(n, shortest_first) for n in lengths}

    def _tops(self, least: int, shortest_first: list[int]) -> list[int]:
        tops = [0] * len(self.length)
        for state in shortest_first:
            above = self.link[state]
            tops[state] = tops[above] if self.length[above] >= least else state
        return tops

    def ends(self, state: int) -> Iterator[tuple[int, int]]:
        """(item, place) where the words of a state end."""
        low, high = self.low[state], self.high[state]
        return zip(self.numbers[low:high], self.places[low:high], strict=True)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        clone = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def matches(self, text: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(place in text, longest match that ends there, its state) of the matches of ``least`` words."""
        state, length = 0, 0
        following, link, lengths = self.next, self.link, self.length
        for place, word in enumerate(text):
            while state and word not in following[state]:
                state = link[state]
                length = lengths[state]
            if word in following[state]:
                state, length = following[state][word], length + 1
            if length >= least:
                yield place, length, state


def aligned(items: list[np.ndarray], texts: list[np.ndarray], band: int, min_words: int, per_edit: int) -> np.ndarray:
    """For each pair of a stretch of item words and the text around it, whether the text holds a passage of the item.

    ``texts[k]`` begins ``band`` words before the place that the first word of ``items[k]`` has on the seed's
    diagonal, and diagonals up to ``band`` off are looked at.  An alignment scores 1 for an item word and
    -per_edit for an edit; the best score is kept for each number of item words up to min_words, so a score of
    0 with min_words or more is found wherever it begins.  All pairs take each step together.
    """
    count, steps, wide = len(items), max(map(len, items)), 2 * band + 1
    item = np.full((count, steps), -3, np.int32)
    text = np.full((count, steps + 2 * band), -2, np.int32)
    for k, (i, t) in enumerate(zip(items, texts, strict=True)):
        item[k, : len(i)] = i
        text[k, : len(t)] = t
    lengths = np.array([len(i) for i in items])
    low = np.int16(-20_000)
    score = np.full((count, wide, min_words + 1), low, np.int16)
    score[:, :, 0] = 0
    done = np.zeros(count, bool)
    gain, loss = np.int16(1), np.int16(1 - per_edit)
    for step in range(steps):
        same = text[:, step : step + wide] == item[:, step : step + 1]
        kept = score + np.where(same, gain, loss)[:, :, None]  # the word is there, or another in its place
        kept[:, :-1] = np.maximum(kept[:, :-1], score[:, 1:] + loss)  # the word is left out
        now = np.full_like(score, low)
        now[:, :, 1:] = kept[:, :, :-1]
        np.maximum(now[:, :, -1], kept[:, :, -1], out=now[:, :, -1])
        for d in range(1, wide):  # a word is added in the text
            np.maximum(now[:, d], now[:, d - 1] - np.int16(per_edit), out=now[:, d])
        done |= (now[:, :, -1].max(axis=1) >= 0) & (step < lengths)
        now[:, :, 0] = 0
        score = np.maximum(now, low)
    return done


class Finder:
    """Items that texts give away.

    A case of 2 * min_words item words or more has a half that is a case as well, so only cases of less are
    looked for: their edits are at most ``band``, which bounds the diagonals around a seed, and they end less
    than 2 * min_words words from it.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS, per_edit: int = PER_EDIT):
        self.min_words, self.per_edit, self.seed = min_words, per_edit, seed_length(min_words, per_edit)
        self.band, self.reach = (2 * min_words - 1) // per_edit, 2 * min_words - 1
        self.numbers: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.items = [[self.numbers.setdefault(w, len(self.numbers)) for w in words(t)] for _, t in items]
        # what has too few words for a case is not looked for
        self.automaton = Automaton([i if len(i) >= min_words else [] for i in self.items], self.seed, min_words)
        self._known: dict[int, dict[int, list[int]]] = {}

    def _places(self, state: int) -> dict[int, list[int]]:
        """The places of a state by item; kept, since the states asked for (tops of one length) share no places."""
        known = self._known.get(state)
        if known is None:
            known = self._known[state] = {}
            for number, place in self.automaton.ends(state):
                known.setdefault(number, []).append(place)
        return known

    def whole(self, matches: list[tuple[int, int, int]]) -> set[int]:
        """The items of which ``min_words`` words stand unbroken."""
        top = self.automaton.tops[self.min_words]
        return set().union(*(self._places(s) for s in {top[state] for _, length, state in matches if length >= self.min_words}))

    def runs(self, matches: list[tuple[int, int, int]], known: set[int] | frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
        """Unbroken runs of at least ``seed`` words, but for ``known`` items: (item number, diagonal, first and last place in the item)."""
        open_runs: dict[tuple[int, int], list[int]] = {}
        top = self.automaton.tops[self.seed]
        for place, _, state in matches:
            for number, ends in self._places(top[state]).items():
                if number in known:
                    continue
                for end in ends:
                    key = (number, place - end)
                    run = open_runs.get(key)
                    if run is not None and run[1] == end - 1:
                        run[1] = end
                    else:
                        if run is not None:
                            yield (*key, *run)
                        open_runs[key] = [end - self.seed + 1, end]
        for key, run in open_runs.items():
            yield (*key, *run)

    def _read(self, text: str | None) -> tuple[list[int], list[tuple[int, int, int]]]:
        read = [self.numbers.get(w, -1) for w in words(text)]
        return read, list(self.automaton.matches(read, self.seed))

    def found(self, texts: list[str | None]) -> list[list[int]]:
        """Item ids that each text gives away, in the order of the items."""
        hits, runs, reads = [], [], []
        for text in texts:
            read, matches = self._read(text)
            hits.append(self.whole(matches))
            runs.append(list(self.runs(matches, hits[-1])))
            reads.append(read if runs[-1] else None)
        for (k, number, *_), yes in self._checked(runs, reads):
            if yes:
                hits[k].add(number)
        return [[self.ids[n] for n in sorted(h)] for h in hits]

    def spans(self, texts: list[str | None]) -> list[list[tuple]]:
        """(item id, first word, last word, share of the item's words) of each passage that a text holds.

        A passage reaches from its first to its last run of ``seed`` words; those of an item that are less than
        2 * min_words words apart are one.
        """
        reads, runs = [], []
        for text in texts:
            read, matches = self._read(text)
            reads.append(read)
            runs.append(list(self.runs(matches)))
        good: list[dict[int, list]] = [{} for _ in texts]
        for (k, number, diagonal, first, last), yes in self._checked(runs, reads):
            if yes:
                good[k].setdefault(number, []).append((first + diagonal, last + diagonal, first, last))
        return [[span for number in sorted(own) for span in self._joined(number, sorted(own[number]))] for own in good]

    def _joined(self, number: int, runs: list[tuple[int, int, int, int]]) -> Iterator[tuple]:
        groups: list[list] = []
        for run in runs:
            if groups and run[0] - groups[-1][1] <= self.reach:
                groups[-1][1] = max(groups[-1][1], run[1])
                groups[-1][2].append(run)
            else:
                groups.append([run[0], run[1], [run]])
        for low, high, members in groups:
            covered, upto = 0, -1
            for first, last in sorted(m[2:] for m in members):
                covered, upto = covered + max(0, last - max(first - 1, upto)), max(upto, last)
            yield self.ids[number], low, high, covered / len(self.items[number])

    def _checked(self, runs: list[list[tuple[int, int, int, int]]], reads: list[list[int] | None]) -> Iterator[tuple[tuple, bool]]:
        """((text, item, diagonal, first, last), whether it belongs to a passage) of all runs."""
        asked: list[tuple] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def answers() -> Iterator[tuple[tuple, bool]]:
            if pairs:
                good = aligned([p[0] for p in pairs], [p[1] for p in pairs], self.band, self.min_words, self.per_edit)
                yield from zip(asked, good, strict=True)
                asked.clear()
                pairs.clear()

        for k, own in enumerate(runs):
            for run in own:
                number, diagonal, first, last = run
                item = self.items[number]
                start, stop = max(0, last - self.reach), min(len(item), first + self.reach + 1)
                if last - first + 1 >= self.min_words:
                    yield (k, *run), True
                elif stop - start < self.min_words:
                    yield (k, *run), False
                else:
                    at = start + diagonal - self.band
                    around = [-2] * max(0, -at) + reads[k][max(0, at) : stop + diagonal + self.band]
                    asked.append((k, *run))
                    pairs.append((np.asarray(item[start:stop], np.int32), np.asarray(around, np.int32)))
                    if len(pairs) > 1_500:
                        yield from answers()
        yield from answers()


def _passes(items: DataFrame, item_id: str, most_words: int, most_bytes: int) -> list[list[tuple]]:
    """The items in groups of at most so many words and bytes; a larger item is a group of its own."""
    passes, n_words, n_bytes = [[]], 0, 0
    for row in items.select(item_id, "text").filter("text IS NOT NULL").orderBy(item_id).toLocalIterator():
        own, size = len(words(row.text)), len(row.text.encode("utf-8", "replace"))
        if passes[-1] and (n_words + own > most_words or n_bytes + size > most_bytes):
            passes.append([])
            n_words = n_bytes = 0
        n_words, n_bytes = n_words + own, n_bytes + size
        passes[-1].append((row[0], row.text))
    return passes


def _over_documents(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, columns: list[tuple[str, str, pa.DataType]], look, most_words: int, most_bytes: int) -> DataFrame:
    """(doc_id, item_id, columns): what ``look`` (finder, texts) finds in each document.

    The items (held-out tests, not the corpus) come to the driver; their automaton is built once per Python worker
    from the broadcast texts.  The results of several passes are united.
    """
    spark = documents.sparkSession
    document_batches(spark)
    doc_kind, item_kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType
    kinds = [to_arrow_type(item_kind), *[k for _, _, k in columns]]
    schema = ", ".join([f"`{doc_id}` {doc_kind}", f"`{item_id}` {item_kind.simpleString()}", *[f"{n} {k}" for n, k, _ in columns]])
    names = [doc_id, item_id, *[n for n, _, _ in columns]]

    def one(share: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(share)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = None
            for batch in batches:
                finder = finder or Finder(sent.value)
                take, rows = [], []
                for i, given in enumerate(look(finder, batch.column(1).to_pylist())):
                    take += [i] * len(given)
                    rows += given
                cells = zip(*rows, strict=True) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, k) for c, k in zip(cells, kinds, strict=True)]], names=names)

        return documents.select(doc_id, "text").mapInArrow(run, schema)

    result = None
    for share in _passes(items, item_id, most_words, most_bytes):
        found = one(share)
        result = found if result is None else result.unionByName(found)
    return result.distinct()


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", max_item_words: int = MAX_ITEM_WORDS, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of an item, each once.

    Items with less than MIN_WORDS words can't be given away; null texts match nothing.
    """
    look = lambda finder, texts: [[(i,) for i in given] for given in finder.found(texts)]
    return _over_documents(documents, items, doc_id, item_id, [], look, max_item_words, max_item_bytes)


def leak_spans(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", max_item_words: int = MAX_ITEM_WORDS, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, start, stop, n_words, coverage) of every passage: characters of the text from 0, stop after the last;
    the text's words between them, and the share of the item's words that its unbroken runs cover.

    The same documents and items as in ``leaks``.
    """
    def look(finder: Finder, texts: list[str | None]) -> list[list[tuple]]:
        out = []
        for text, found in zip(texts, finder.spans(texts), strict=True):
            places = word_places(text) if found else []
            out.append([(i, places[low][1], places[high][2], high - low + 1, share) for i, low, high, share in found])
        return out

    columns = [("start", "int", pa.int32()), ("stop", "int", pa.int32()), ("n_words", "int", pa.int32()), ("coverage", "double", pa.float64())]
    return _over_documents(documents, items, doc_id, item_id, columns, look, max_item_words, max_item_bytes)


def without_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", least_words: int = MIN_WORDS, least_coverage: float = 0.8) -> DataFrame:
    """(doc_id, text, n_spans, removed): every document without the passages of ``least_words`` words or more, or that cover
    ``least_coverage`` of an item; ``removed`` counts characters.

    Only spans move; a document without any stays as it is, null texts too.  Equal doc_ids are taken to have equal texts.
    """
    spans = leak_spans(documents, items, doc_id, item_id).filter((F.col("n_words") >= least_words) | (F.col("coverage") >= least_coverage))
    by_text = spans.groupBy(F.col(doc_id).alias("_doc")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_spans"))
    joined = documents.select(doc_id, "text").join(by_text, F.col(doc_id) == F.col("_doc"), "left")
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))
    step = lambda done, s: F.struct(
        F.greatest(done["at"], s["stop"]).alias("at"), F.concat(done["kept"], F.substring("text", done["at"] + 1, F.greatest(F.lit(0), s["start"] - done["at"]))).alias("kept"))
    cleaned = F.aggregate("_spans", none, step, lambda done: F.concat(done["kept"], F.substring("text", done["at"] + 1, F.length("text"))))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cleaned)
    out = joined.select(doc_id, text.alias("_text"), "text", F.coalesce(F.size("_spans"), F.lit(0)).alias("n_spans"))
    return out.select(doc_id, F.col("_text").alias("text"), "n_spans", F.coalesce(F.length("text") - F.length("_text"), F.lit(0)).alias("removed"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: the documents that give it away, 0 for those that none does."""
    counted = leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))
    return items.select("item_id", "suite").join(counted, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
