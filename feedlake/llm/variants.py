"""Spelling variant grouping: words one inserted, deleted or replaced code point
apart, and per word the much commoner near word it is a variant of.

Method: finite-state composition ``A o E o A`` of the minimised vocabulary
acceptor with a one-edit transducer and the acceptor again. The acceptor is
partitioned by initial states: a word of n letters is read from the state that
its first n / 2 letters lead to, and, in the mirrored acceptor, from the state
that its last n - n / 2 letters lead to. The edit of a pair lies in one of the
halves, so the pair shares one of these states with the same n (a longer word
joins the partition of n = its length - 1 too). A partition builds its minimal
acceptor, composes it and adds up, per word, the pairs it accepts: pairs
themselves never leave the task, a word has at most four partial sums.

Scale: a word stands in at most four partitions. A partition holds the words
of one length (and one more) that share half their letters; it is a task's
unit, its states are shared between words. Occurrences are counted with map-side
partial sums. Roots follow forms by pointer doubling; counts at least double
along a chain, so there are few rounds.

Defined cases: NULL and empty texts have no words; a NULL id reads as empty
text in the drop hash; repeated rows count as often as they stand; ties of
the form go to the smaller word in code point order; texts and words of any
length are whole. Extra columns are ignored, whatever their names. An empty
table gives no row."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import cut

#: Letters of a word once A-Z are lower-cased (fixed value).
RUN = "[a-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
#: A form is at least this many times as frequent as its variant.
RATIO = 2


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_every: int | None = None) -> DataFrame:
    """One row per occurrence of a word. With ``drop_every``, a run whose hash with
    the id is divisible by it loses one letter: a reproducible source of variants."""
    low = F.translate(F.col(text).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    if drop_every is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % drop_every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(occurrences: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    kept = occurrences.filter(F.char_length("word") >= min_length)
    return kept.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


# --- acceptor and composition of one partition

class Acceptor:
    """The minimal acyclic acceptor of sorted, distinct strings. A state is a number;
    states of the same right language are one."""

    def __init__(self, strings: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.reach: list[tuple[int, int]] = []  # least and greatest length accepted from the state
        self._known: dict = {}
        path: list[tuple[dict, bool]] = [({}, False)]  # states of the last string that may still change
        letters: list[str] = []
        for s in strings:
            same = 0
            while same < len(letters) and same < len(s) and letters[same] == s[same]:
                same += 1
            self._settle(path, letters, same)
            for c in s[same:]:
                letters.append(c)
                path.append(({}, False))
            path[-1] = (path[-1][0], True)
        self._settle(path, letters, 0)
        self.start = self._state(*path[0])

    def _settle(self, path: list, letters: list[str], depth: int) -> None:
        while len(letters) > depth:
            arcs, final = path.pop()
            path[-1][0][letters.pop()] = self._state(arcs, final)

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        sign = (final, tuple(arcs.items()))
        if sign not in self._known:
            self._known[sign] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            ends = [self.reach[t] for t in arcs.values()]
            lengths = [0] if final else []
            self.reach.append((min(lengths + [a + 1 for a, _ in ends], default=0), max(lengths + [b + 1 for _, b in ends], default=0)))
        return self._known[sign]

    def _can(self, state: int, length: int) -> bool:
        a, b = self.reach[state]
        return a <= length <= b

    def common(self, x: int, y: int, length: int) -> Iterator[str]:
        """The strings of ``length`` that both states accept."""
        path, stack = [], [(x, y, 0, "")]
        while stack:
            x, y, depth, c = stack.pop()
            del path[max(depth - 1, 0):]
            if depth:
                path.append(c)
            if depth == length:
                if self.final[x] and self.final[y]:
                    yield "".join(path)
                continue
            left, right = self.arcs[x], self.arcs[y]
            if len(left) > len(right):
                left, right = right, left
            stack.extend((left[c], right[c], depth + 1, c) for c in left
                         if c in right and self._can(left[c], length - depth - 1) and self._can(right[c], length - depth - 1))


def near_pairs(acceptor: Acceptor, length: int) -> Iterator[tuple[str, str]]:
    """What the acceptor, the one-edit transducer and the acceptor accept together:
    pairs of strings of ``length`` that differ by a replaced letter, and (shorter,
    longer) pairs of ``length`` and one more that differ by an inserted one."""
    if not acceptor.arcs:
        return
    edits: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def at(state: int, left: int) -> list[tuple[str, str]]:
        """Pairs of the edit done here, ``left`` letters before the shorter string's end."""
        if (state, left) not in edits:
            found = []
            arcs = sorted(acceptor.arcs[state].items())
            for i, (a, x) in enumerate(arcs):
                if left and acceptor._can(x, left - 1):
                    for b, y in arcs[i + 1:]:
                        if acceptor._can(y, left - 1):
                            found += [(a + s, b + s) for s in acceptor.common(x, y, left - 1)]
                if acceptor._can(x, left) and acceptor._can(state, left):
                    found += [(s, a + s) for s in acceptor.common(x, state, left)]
            edits[state, left] = found
        return edits[state, left]

    path, stack = [], [(acceptor.start, 0, "")]
    while stack:
        state, depth, c = stack.pop()
        del path[max(depth - 1, 0):]
        if depth:
            path.append(c)
        found = at(state, length - depth)
        if found:
            head = "".join(path)
            for u, v in found:
                yield head + u, head + v
        if depth < length:
            stack.extend((t, depth + 1, c) for c, t in acceptor.arcs[state].items())


def partial_sums(mirrored: bool, length: int, part: str, members: list[tuple[str, int]]) -> list[tuple]:
    """(word, near words, largest n of them, that word) over a partition's pairs."""
    split = len(part)
    rest = {(w[split:] if not mirrored else w[:len(w) - split][::-1]): (w, n) for w, n in members}
    half = length - split if mirrored else split  # letters that the forward partition shares
    seen, sums = set(), {}
    for u, v in near_pairs(Acceptor(sorted(rest)), length - split):
        (a, na), (b, nb) = rest[u], rest[v]
        if (a, b) in seen or mirrored and a[:half] == b[:half]:  # the forward partition has those
            continue
        seen.add((a, b))
        for w, other, n in ((a, b, nb), (b, a, na)):
            count, best = sums.get(w, (0, None))
            sums[w] = (count + 1, min(best, (-n, other)) if best else (-n, other))
    return [(w, c, -n, other) for w, (c, (n, other)) in sums.items()]


def _partitions(vocab: DataFrame, min_length: int) -> DataFrame:
    """(mirrored, length, part, word, n): each word in the partitions it may have near words in."""
    n = F.col("length")
    half = F.floor(n / 2).cast("int")
    lengths = F.filter(F.array(F.char_length("word"), F.char_length("word") - 1), lambda x: x >= min_length)
    rows = vocab.select("word", "n", F.explode(lengths).alias("length"))
    both = F.array(F.struct(F.lit(False).alias("mirrored"), F.substring("word", F.lit(1), half).alias("part")),
                   F.struct(F.lit(True).alias("mirrored"), F.reverse(F.substring(F.reverse("word"), F.lit(1), n - half)).alias("part")))
    return rows.select("length", "word", "n", F.explode(both).alias("x")).select("x.mirrored", "length", "x.part", "word", "n")


_SUMS = "word string, near bigint, best bigint, other string"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                          names=["word", "near", "best", "other"])
    key, members, done = None, [], []
    for batch in batches:
        for m, length, part, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (m, length, part) != key:
                if len(members) > 1:
                    done += partial_sums(*key, members)
                    if len(done) >= 10_000:
                        yield out(done)
                        done = []
                key, members = (m, length, part), []
            members.append((word, n))
    if len(members) > 1:
        done += partial_sums(*key, members)
    yield out(done)


def near_words(vocab: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n_near, best_n, best): its number of near words and the commonest of them."""
    parts = ["mirrored", "length", "part"]
    dealt = _partitions(vocab, min_length).repartition(*parts).sortWithinPartitions(*parts)
    sums = dealt.mapInArrow(_composed, _SUMS)
    first = F.min(F.struct((-F.col("best")).alias("n"), F.col("other").alias("w"))).alias("x")
    return sums.groupBy("word").agg(F.sum("near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, by pointer doubling."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                         F.col("next").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group(vocab: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary (word, n)."""
    vocab = cut(vocab.select("word", "n"))
    is_form = F.col("best_n") >= ratio * F.col("n")
    met = cut(vocab.join(near_words(vocab, min_length), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    return met.join(roots(met.filter("form IS NOT NULL")), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
