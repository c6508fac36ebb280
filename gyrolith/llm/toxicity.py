"""Toxicity by class-conditional Kneser-Ney models: characters within words, and words after words.

Spark counts how often each word occurs in toxic and in ordinary labelled documents, over all labelled rows
that are neither held out nor used to fit the regression. From these counts come two models of the next character
given up to nine before it, word start included; each class discounts its own counts and hands the freed mass to one
shared distribution of continuation counts, so an expression that is rare in a class falls back to what both have in
common. A character's evidence, log p(toxic) - log p(ordinary), then depends on its table entry alone: one value for
each known n-gram, one for each known context of an unknown n-gram, and 0 beyond.

Above them stand two models of a word given the word before, of the pairs that occur PAIR_LEAST times, whatever the
size of the input; their backoff goes to the class's words and from there to shared counts of continuations. What a known pair adds to the evidence of its word
is log p(word | before) / p(word), toxic less ordinary; a word after any other one keeps its own evidence.

N-grams are dealt by the last MIDDLE characters of their context, and by more of them where these have more than
SUFFIX_PLACES places. All that a continuation count, a total or a shorter
string's probability needs ends in these characters too, so each task makes its part of the table by itself;
strings of up to so many characters take counts from all words, and n-grams get their probabilities by a join. The
table has a row for each context that occurs CONTEXT_LEAST times. The most frequent contexts and pairs, up to fixed numbers, are
held by every task, which scores words by them. Words with a context that is not held are scored by a join with the table,
and pairs that are not held, but have their bit in a bitmap of the table's pairs, by a join with theirs, where the largest
gain that pairs of their slot have could bring them among the text's most toxic words.

The verdict compares length-normalised log-likelihoods: each word, given the one before, has a log-likelihood under
either class, and their difference is divided by the word's characters and PRIOR more, which speak for neither class. Toxic
expressions are a few words in long texts, so a text's difference is the mean of those of its STRONGEST most toxic words; it alone decides. A
logistic regression with one weight, at least 0, fitted on a bounded sample of labelled rows that gave no counts,
turns it into a score. One tokeniser serves counting and scoring; a word
holds letters of any script with their combining marks.

Defined results: null and empty texts have a difference of 0, so all score alike, and missing words of texts of fewer than STRONGEST count 0; repeated rows score alike; rows with
no doc_id are held out; with no labelled rows of one class every score is 0; a label that is null teaches nothing.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.common import bitmap, bitmap_bits, free_names, shared_folder, slices, tidied, written

#: Labelled rows that the regression is fitted on at most, by class (ordinary, toxic): those with the smallest hash.
LEARN_ROWS = (5_000, 2_500)
#: Length of the n-grams, the discount, and words or pairs that a worker remembers.
ORDER, DISCOUNT, MEMORY = 10, 0.75, 400_000
#: Bytes of texts that a worker scores at once, and words that it remembers from them.
SCORE_BYTES, SCORE_WORDS = 1 << 20, 250_000
#: Words whose differences make a text's, and characters that a word's length is counted as more than it has.
STRONGEST, PRIOR = 3, 20
#: Occurrences from which on a context has an entry of its own, and contexts that every task holds.
CONTEXT_LEAST, CONTEXTS = 2, 2_000_000
#: Rows whose number modulo FOLDS is 0 are held out, CALIBRATE fit the regression, the others give the counts.
FOLDS, CALIBRATE = 5, 4
#: Characters of a context that n-grams are dealt by, and contexts of an Arrow batch.
MIDDLE, WORD_ROWS = 3, 20_000
#: Places from which on such characters are too many for a task, and one more of them deals.
SUFFIX_PLACES = 2_000_000
#: A pair of words has an entry of its own if it occurs so often.
PAIR_LEAST = 20
#: Pairs of a text's words that a worker counts at once, distinct ones that it hands on at once, and all words for each part of the pairs.
PAIR_PLACES, PAIR_ROWS, PAIR_WORDS = 1_000_000, 1_000_000, 4_000_000
#: Slots of a piece of the table of largest gains, slots at most, and the gains that levels 1 to 255 stand for: from LOWEST on in steps.
PIECE, SLOTS, LOWEST, LEVEL = 4096, 1 << 23, -16.0, 0.125

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]{1,40}")
STEP, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def fold(key):
    """crc32 of the id as text, modulo 5, as a column."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def mixed(codes: np.ndarray) -> np.ndarray:
    """The hash of each character."""
    with np.errstate(over="ignore"):
        x = (codes.astype(np.uint64) + np.uint64(1)) * STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


class Framed:
    """Words between a start and an end character, laid end to end: the word of each place, and its place in the word."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        self.place = (np.arange(len(self.codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.own = mixed(self.codes)

    def earlier(self, hashes: np.ndarray) -> np.ndarray:
        """What stood one place before; 0 at a word's start."""
        before = np.zeros_like(hashes)
        before[1:] = hashes[:-1]
        before[self.place == 0] = 0
        return before

    def suffixes(self, order: int):
        """For k from 0 to `order`, the hash of the last k characters at each place; at a word's start, of what there is."""
        hashes = np.zeros_like(self.own)
        yield hashes
        for _ in range(order):
            with np.errstate(over="ignore"):
                hashes = self.own + self.earlier(hashes) * BASE
            yield hashes

    def last_two(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram, its context) at each place."""
        before = hashes = self.own
        for hashes in self.suffixes(order - 1):
            before = hashes
        with np.errstate(over="ignore"):
            context = self.earlier(before)
            return self.own + context * BASE, context


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each value summed by key."""
    found, at = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(at, v, len(found)) for v in values)


def at_keys(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """The value of each wanted key; each is looked up once, in order, which large tables answer much faster."""
    if not len(keys):
        return np.full(len(wanted), missing)
    own, at = np.unique(wanted, return_inverse=True)
    k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[k] == own, values[k], missing)[at]


def interpolated(p, there, longer, suffix, context, discount) -> np.ndarray:
    """Probabilities of suffixes from those of the suffixes one shorter; `there` tells where the longer string exists."""
    _, one = np.unique(longer[there], return_index=True)
    keys, count = grouped(suffix[there][one], np.ones(len(one)))
    _, one = np.unique(suffix[there], return_index=True)
    contexts, total, kinds = grouped(context[there][one], at_keys(keys, count, suffix[there][one], 0.0), np.ones(len(one)))
    all_n, n_kinds, n = at_keys(contexts, total, context, 0.0), at_keys(contexts, kinds, context, 0.0), at_keys(keys, count, suffix, 0.0)
    return np.where(there & (all_n > 0), (np.maximum(n - discount, 0) + discount * n_kinds * p) / np.maximum(all_n, 1), p)


def by_class(own, counts, shared, discount) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(evidence of n-grams, contexts in order, their evidence, their counts) from each n-gram's context, counts by class and shared probability."""
    p, freed, contexts, size = [], [], np.unique(own), 0.0
    for n in counts:
        keys, total, kinds = grouped(own, n, (n > 0).astype(float))
        size = size + total
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, np.minimum(1.0, discount * kinds / total), 1.0)
        all_n, rest = at_keys(keys, total, own, 0.0), at_keys(keys, back, own, 1.0)
        p.append(np.maximum(n - discount, 0) / np.maximum(all_n, 1e-300) * (n > 0) + rest * shared)
        freed.append(at_keys(keys, back, contexts, 1.0))
    return np.log(p[0] / p[1]).astype(np.float32), contexts, np.log(freed[0] / freed[1]).astype(np.float32), size


class Evidence:
    """log p(character | context, toxic) - log p(character | context, ordinary), by n-gram and by context."""

    def __init__(self, words: list[str], toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER, discount: float = DISCOUNT):
        self.order = order
        framed = Framed(words)
        inside = np.flatnonzero(framed.place > 0)
        gram, context = framed.last_two(order)
        grams, first, at = np.unique(gram[inside], return_index=True, return_inverse=True)
        at, first, word = at.astype(np.int32), inside[first], framed.word[inside]
        own = context[first]
        del gram, context
        shared = self._shared(framed, first, order, discount)
        del framed
        counts = [np.bincount(at, c[word].astype(float), len(grams)) for c in (toxic, ordinary)]
        self.by_gram, self.contexts, self.by_context, size = by_class(own, counts, shared, discount)
        kept = size >= CONTEXT_LEAST
        some = kept[np.searchsorted(self.contexts, own)]
        self.grams, self.by_gram, self.contexts, self.by_context = grams[some], self.by_gram[some], self.contexts[kept], self.by_context[kept]

    @classmethod
    def gathered(cls, table: DataFrame, order: int = ORDER) -> Evidence:
        """The rows (context, rest, codes, values) of a table of contexts, in memory."""
        rows, found = table.select("context", "rest", "codes", "values").toArrow().combine_chunks(), cls.__new__(cls)
        contexts = rows["context"].to_numpy().view(np.uint64)
        flat = [pa.chunked_array([x.flatten() for x in rows[c].chunks], kind).to_numpy() for c, kind in (("codes", pa.int32()), ("values", pa.float32()))]
        sizes = np.diff(np.concatenate([[0], np.cumsum(pc.list_value_length(rows["codes"]).to_numpy())])).astype(int)
        with np.errstate(over="ignore"):
            grams = mixed(flat[0]) + np.repeat(contexts, sizes) * BASE
        found.order, by, at = order, np.argsort(grams), np.argsort(contexts)
        found.grams, found.by_gram = grams[by], flat[1][by]
        found.contexts, found.by_context = contexts[at], rows["rest"].to_numpy()[at]
        return found

    @staticmethod
    def _shared(framed, first, order, discount) -> np.ndarray:
        """Kneser-Ney probability of each n-gram's last character given its context without the oldest character.

        A string's count is the number of characters that occur left of it, in either class. `first` has a
        place of each n-gram.
        """
        place = framed.place[first]
        p = np.full(len(place), 1.0 / max(100, len(np.unique(framed.own[first]))))
        context = suffix = before = None
        for k, hashes in enumerate(framed.suffixes(order)):  # here suffix has k - 1 characters, and context k - 2
            longer = hashes[first]
            if k >= 2:
                p = interpolated(p, place >= k - 1, longer, suffix, context, discount)
            suffix, context, before = longer, before, framed.earlier(hashes)[first]
        return p

    def of(self, words: list[str], missing: float = 0.0) -> np.ndarray:
        """The evidence of each word: the sum over its characters and its end; a context that isn't known counts as `missing`."""
        if not words:
            return np.empty(0)
        framed = Framed(words)
        inside = framed.place > 0
        gram, context = (x[inside] for x in framed.last_two(self.order))
        value = at_keys(self.contexts, self.by_context, context, np.nan)
        known = np.flatnonzero(~np.isnan(value))
        of_gram = at_keys(self.grams, self.by_gram, gram[known], np.nan)
        value[known] = np.where(np.isnan(of_gram), value[known], of_gram)
        return np.bincount(framed.word[inside], np.where(np.isnan(value), missing, value), len(words))


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights, bias last, by Newton's method; both classes weigh by the root of their share."""
    x = np.column_stack([x, np.ones(len(x))])
    share = y.mean()
    weight = np.where(y > 0, share**-0.5, (1 - share) ** -0.5)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return w


class Toxicity:
    """The fitted models: the tables of contexts and of pairs (v, w, n, e), what every task holds of them, and regression weights.

    `all_contexts` and `all_pairs` tell whether that is everything; if pairs are left, `bits` has a bit set for each of the table's,
    and `tops` the level of the largest gain in each slot.
    """

    def __init__(self, table: DataFrame, pairs: DataFrame, weights: np.ndarray | None = None):
        self.table, self.pairs, self.weights = table, pairs, weights
        some = frequent(table, "n", CONTEXTS)
        self.common, self.all_contexts = Evidence.gathered(some), some.count() == table.count()
        held = frequent(pairs, "n", MEMORY).select("v", "w", "e").toArrow()
        self.held = HeldPairs.of(pair_keys(*(word_hashes(held[c].to_pylist()) for c in ("v", "w"))), held["e"].to_numpy())
        n = pairs.count()
        self.all_pairs = len(held) == n
        self.bits = None if self.all_pairs else pair_bits(pairs, bitmap_bits(n))
        self.tops = None if self.all_pairs else pair_tops(pairs, min(SLOTS, max(PIECE, 1 << n.bit_length())))

    @property
    def evidence(self) -> Evidence:
        """The whole table in memory, for tables that are small."""
        return Evidence.gathered(self.table)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of each pair, from those of its words."""
    with np.errstate(over="ignore"):
        return mixed(v * BASE + w)


class HeldPairs(NamedTuple):
    """Hashes of pairs of words, in order, and their gains."""

    keys: np.ndarray
    gains: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, gains: np.ndarray) -> HeldPairs:
        by = np.argsort(keys)
        return cls(keys[by], gains[by])

    def get(self, pair: tuple[str | None, str], default: float | None = None) -> float | None:
        """The gain of one pair; `default` if it isn't held."""
        if None in pair or not len(self.keys):
            return default
        key = pair_keys(*(word_hashes([x]) for x in pair))[0]
        at = min(int(np.searchsorted(self.keys, key)), len(self.keys) - 1)
        return float(self.gains[at]) if self.keys[at] == key else default


def hashes_in(batches):
    """The hashes of words, as they come, for mapInArrow."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(word_hashes(batch.column(0).to_pylist()).view(np.int64))], names=["h"])


def pair_places(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each pair, from the hashes of its words."""
    return (pair_keys(v, w) & np.uint64(bits - 1)).astype(np.int64)


def pair_bits(pairs: DataFrame, bits: int) -> bytes:
    """A bitmap with the bits of all pairs (v, w) set."""

    def run(batches):
        for batch in batches:
            v, w = (word_hashes(batch.column(k).to_pylist()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_places(v, w, bits))], names=["p"])

    return bitmap(pairs.select("v", "w").mapInArrow(run, "p long"), bits)


def pair_tops(pairs: DataFrame, slots: int) -> bytes:
    """A byte for each slot: the level of the largest gain (e) of the pairs (v, w) whose place it is, rounded up; 0 where there is none."""

    def run(batches):
        for batch in batches:
            at = pair_places(*(word_hashes(batch.column(k).to_pylist()) for k in (0, 1)), slots)
            level = np.clip(np.ceil((batch.column(2).to_numpy() - LOWEST) / LEVEL) + 1, 1, 255)
            yield pa.RecordBatch.from_arrays([pa.array((at // PIECE).astype(np.int32)), pa.array((at % PIECE).astype(np.int32)), pa.array(level.astype(np.int32))], names=["k", "p", "level"])

    def piece(table: pa.Table) -> pa.Table:
        own = np.zeros(PIECE, np.uint8)
        np.maximum.at(own, table["p"].to_numpy(), table["level"].to_numpy().astype(np.uint8))
        return pa.table({"k": table["k"].slice(0, 1), "tops": pa.array([own.tobytes()], pa.binary())})

    places = pairs.select("v", "w", "e").mapInArrow(run, "k int, p int, level int").groupBy("k", "p").agg(F.max("level").alias("level"))
    out = bytearray(slots)
    for r in places.groupBy("k").applyInArrow(piece, "k int, tops binary").collect():
        out[r["k"] * PIECE : (r["k"] + 1) * PIECE] = r["tops"]
    return bytes(out)


class Scorer:
    """What a task knows of words: their evidence, NaN where a context isn't held, and their hash, by which held pairs are found.

    `pairs` are the held ones with their gains, or their hashes and gains as two arrays; `bits` is the bitmap of all the table's
    pairs, and `tops` the levels of their largest gains, where not all are held.
    """

    def __init__(self, evidence: Evidence, missing: float, pairs: dict[tuple[str, str], float] | tuple[np.ndarray, np.ndarray], bits: bytes | None, tops: bytes | None = None):
        self.evidence, self.missing = evidence, missing
        self.bits, self.tops = (None if x is None else np.frombuffer(x, np.uint8) for x in (bits, tops))
        if isinstance(pairs, dict):
            pairs = pair_keys(*(word_hashes([p[k] for p in pairs]) for k in (0, 1))), np.array(list(pairs.values()), float)
        by = np.argsort(pairs[0])
        self.keys, self.gains = pairs[0][by], pairs[1][by]
        self.likely = np.zeros(1 << min(22, max(10, (16 * len(by)).bit_length())), bool)  # whether any held pair has these last bits
        self.likely[self.slots(self.keys)] = True
        self.forget()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.likely) - 1)).astype(np.int64)

    def forget(self) -> None:
        self.seen, self.value, self.size, self.hash = {}, np.empty(0), np.empty(0, np.int64), np.empty(0, np.uint64)

    def codes(self, words: list[str]) -> np.ndarray:
        """A number for each word, by which `value`, `hash` and `size` are read."""
        if len(self.seen) > min(MEMORY, SCORE_WORDS):
            self.forget()
        seen = self.seen
        if new := list(set(words) - seen.keys()):
            seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
            self.value = np.concatenate([self.value, self.evidence.of(new, self.missing)])
            self.size = np.concatenate([self.size, np.array(list(map(len, new)), np.int64)])
            self.hash = np.concatenate([self.hash, word_hashes(new)])
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))

    def gain(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what the word before adds to each word, whether that pair is held); `first` has the places of texts' first words."""
        out, there = np.zeros(len(codes)), np.zeros(len(codes), bool)
        if len(codes) and len(self.keys):
            own = self.hash[codes]
            key = pair_keys(own[:-1], own[1:])
            may = self.likely[self.slots(key)]
            may[first[(first > 0) & (first < len(codes))] - 1] = False
            pair = np.flatnonzero(may) + 1
            k = np.minimum(np.searchsorted(self.keys, key[may]), len(self.keys) - 1)
            hit = self.keys[k] == key[may]
            out[pair[hit]], there[pair[hit]] = self.gains[k[hit]], True
        return out, there

    def most(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What the word before can add at most to the words at these places, none of them the first, if the pair isn't held."""
        own = self.hash[codes]
        level = self.tops[pair_places(own[places - 1], own[places], len(self.tops))]
        return np.where(level == 255, np.inf, np.maximum(0.0, LOWEST + (level.astype(float) - 1) * LEVEL))

    def elsewhere(self, codes: np.ndarray, first: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Whether each word and the one before may be a pair of the table that isn't held."""
        out = np.zeros(len(codes), bool)
        if self.bits is not None and len(codes):
            own = self.hash[codes]
            at = pair_places(own[:-1], own[1:], 8 * len(self.bits))
            out[1:] = self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
            out &= ~held
            out[first[first < len(codes)]] = False
        return out


def labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, toxic, fold) of the labelled rows to learn from: all that are outside the held-out fold."""
    own = labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("int").alias("__y")).withColumn("__fold", fold(F.col("__key")))
    return own.where("__fold <> 0 AND __key IS NOT NULL AND __y IN (0, 1)")


def fitting_rows(rows: DataFrame, most=LEARN_ROWS) -> DataFrame:
    """Of the labelled rows those that fit the regression, bounded by class."""
    own = rows.where(F.col("__fold") == CALIBRATE)
    first = [own.where(F.col("__y") == y).orderBy(F.xxhash64("__key"), "__key").limit(n) for y, n in enumerate(most)]
    return first[0].unionAll(first[1])


def counting_texts(own: DataFrame, known: DataFrame) -> DataFrame:
    """(__y, __text) of the labelled rows that give counts.

    A bitmap over their keys, of 32 MB at most, tells before the join which texts can be among them, so the others aren't shuffled.
    """
    some, spark = known.where(F.col("__fold") != CALIBRATE), own.sparkSession
    kinds = {df.schema["__key"].dataType.simpleString() for df in (own, some)}
    if len(kinds) > 1 or not kinds <= {"bigint", "int", "string"}:  # keys that are equal may have other hashes
        return own.join(some, "__key").select("__y", "__text")
    bits = bitmap_bits(some.count())
    at = F.pmod(F.xxhash64("__key"), F.lit(bits))
    marked = spark.sparkContext.broadcast(bitmap(some.select(at.alias("p")), bits))

    def marks(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((np.frombuffer(marked.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return own.where(F.pandas_udf(marks, "boolean")(at)).join(some, "__key").select("__y", "__text")


def frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, at most so many: all from a limit on that counts by powers of two tell."""
    power = F.floor(4 * F.log2(F.col(count).cast("double")))
    sizes, least = sorted(((r["p"], r["n"]) for r in rows.where(F.col(count) > 0).groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True), None
    for p, n in sizes:
        most -= n
        if most < 0:
            break
        least = p
    return rows.where(F.lit(False) if least is None else (F.col(count) > 0) & (power >= least))


def strings_before(words: DataFrame, depth: int, hot: set[str] | None) -> DataFrame:
    """(t, n): strings of up to `depth` + 1 characters and how often they occur; given `hot`, only those of that length with these before their last character."""

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                s = f"\x02{w}\x03"
                for k in range(2, depth + 2) if hot is None else (depth + 1,):
                    seen.update(t for i in range(len(s) - k + 1) if (t := s[i : i + k]) and (hot is None or t[1:-1] in hot))
            if len(seen) > MEMORY:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])

    return words.select("w").mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))


def probabilities(strings: DataFrame, length: int, shorter: DataFrame | None, discount: float) -> DataFrame:
    """(s, p): the shared probability of the last of so many characters given the others, from what (t) stands before and (s, p) of one less."""
    counts = strings.where(F.length("t") == length + 1).groupBy(F.expr("substring(t, 2)").alias("s")).agg(F.count("*").alias("k"))
    counts = counts.withColumn("c", F.expr(f"substring(s, 1, {length - 1})"))
    if shorter is None:
        counts = counts.withColumn("back", F.lit(1.0 / max(100, counts.count())))
    else:
        counts = counts.join(shorter.select(F.col("s").alias("rest"), F.col("p").alias("back")), F.expr("substring(s, 2)") == F.col("rest"))
    sums = counts.groupBy("c").agg(F.sum("k").alias("total"), F.count("*").alias("kinds"))
    p = (F.greatest(F.col("k") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("back")) / F.col("total")
    return counts.join(sums, "c").select("s", p.alias("p"))


def short_strings(words: DataFrame, folder: str, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, set[str]]:
    """((s, p), hot): the shared probability of strings that end somewhere in the words, and the ends of contexts with more than SUFFIX_PLACES places.

    Strings have up to MIDDLE characters, or more where all but the last are such an end. Hot ends are at most places / SUFFIX_PLACES
    of each length.
    """
    all_hot, new, found, p, depth = set(), None, [], None, MIDDLE
    while depth == MIDDLE or (new and depth < order):
        strings = written(strings_before(words, depth, new), f"{folder}/strings-{depth}")
        for k in range(1, MIDDLE + 1) if new is None else (depth,):
            p = written(probabilities(strings, k, p, discount), f"{folder}/short-{k}")
            found.append(p)
        ends = strings.where(F.length("t") == depth + 1).groupBy(F.expr(f"substring(t, 1, {depth})").alias("c")).agg(F.sum("n").alias("n"))
        new = {r["c"] for r in ends.where((F.col("n") > SUFFIX_PLACES) & ~F.col("c").startswith("\x02")).select("c").collect()}
        all_hot |= new
        depth += 1
    return reduce(DataFrame.unionAll, found), all_hot


def codes_of(strings: list[str], width: int) -> np.ndarray:
    """Characters as numbers, a row for each string, moved to the right; places before a string are -1."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.full((len(strings), width), -1, np.int64)
    out[np.arange(width) >= (width - sizes)[:, None]] = flat
    return out


def hashes_of(codes: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For k from 0 to `order`, the hash of a string's last k characters, and of these without the last one; of what there is."""
    own = np.where(codes >= 0, mixed(np.maximum(codes, 0)), np.uint64(0))
    whole, context, power = [np.zeros(len(codes), np.uint64)], [np.zeros(len(codes), np.uint64)] * 2, np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(order):
            if k:
                context.append(context[-1] + own[:, -1 - k] * power)
                power = power * BASE
            whole.append(whole[-1] + own[:, -1 - k] * power)
    return whole, context[: order + 1]


def context_table(words: DataFrame, folder: str, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(context, n, rest, codes, values) from words (w, toxic, ordinary): the evidence of each character known after a context, and of others."""
    short, hot = short_strings(words, folder, order, discount)

    def depth_of(context: str) -> int:
        k = MIDDLE
        while hot and k < order - 1 and len(context) >= k and context[-k:] in hot:
            k += 1
        return k

    def grams(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for w, t, o in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = f"\x02{w}\x03"
                for i in range(2, len(s) + 1):
                    n = found.setdefault(s[max(0, i - order) : i], [0, 0])
                    n[0] += t
                    n[1] += o
            keys = list(found)
            depths = [depth_of(g[:-1]) for g in keys]
            strings = ([g[:-1][-k:] for g, k in zip(keys, depths, strict=True)], [g[-min(len(g) - 1, k) :] for g, k in zip(keys, depths, strict=True)], keys)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in strings), pa.array(depths, pa.int32()), *(pa.array([found[g][k] for g in keys], pa.int64()) for k in (0, 1))], names=["m", "s", "g", "depth", "toxic", "ordinary"])

    def tables(batches):
        batches = list(batches)
        if not sum(len(b) for b in batches):
            return
        rows = pa.Table.from_batches(batches).group_by("g").aggregate([("toxic", "sum"), ("ordinary", "sum"), ("p", "max"), ("depth", "max")])
        codes, counts = codes_of(rows["g"].to_pylist(), order), [rows[c].to_numpy().astype(float) for c in ("toxic_sum", "ordinary_sum")]
        size, depth, p = (codes >= 0).sum(1), rows["depth_max"].to_numpy(), rows["p_max"].to_numpy()
        whole, context = hashes_of(codes, order)
        for k in range(MIDDLE + 1, order):
            p = interpolated(p, (size > k) & (k > depth), whole[k + 1], whole[k], context[k], discount)
        by_gram, contexts, rest, n = by_class(context[order], counts, p, discount)
        by = np.argsort(context[order], kind="stable")
        at = np.searchsorted(context[order][by], contexts)
        ends = pa.array([*at, len(by)], pa.int32())
        lists = (pa.ListArray.from_arrays(ends, pa.array(codes[by, -1], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(by_gram[by], pa.float32())))
        table = pa.Table.from_arrays([pa.array(contexts.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(rest), *lists], names=["context", "n", "rest", "codes", "values"])
        yield from table.filter(pc.greater_equal(table["n"], CONTEXT_LEAST)).to_batches(max_chunksize=WORD_ROWS)

    dealt = words.select("w", "toxic", "ordinary").mapInArrow(grams, "m string, s string, g string, depth int, toxic long, ordinary long").join(short, "s")
    return dealt.repartition("m").select("g", "depth", "p", "toxic", "ordinary").mapInArrow(tables, "context long, n long, rest float, codes array<int>, values array<float>")


def tallies(texts: DataFrame, found, schema: str) -> DataFrame:
    """Sums of `found`(words of a text), which yields tuples, by class: the tuple's columns, toxic and ordinary; texts (__y, __text)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        seen: dict[tuple, list[int]] = {}

        def made():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in keys], pa.string()) for c in range(len(names))), *(pa.array([n[c] for n in seen.values()], pa.int64()) for c in (1, 0))], names=[*names, "toxic", "ordinary"])

        for batch in slices(batches, 1):
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key, n in Counter(found(words_in(t))).items():
                    seen.setdefault(key, [0, 0])[y] += n
            if len(seen) > MEMORY:
                yield made()
                seen.clear()
        yield made()

    parts = texts.select("__y", "__text").mapInArrow(run, f"{schema}, toxic long, ordinary long")
    return parts.groupBy(*names).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def pair_parts(texts: DataFrame, able: np.ndarray, parts: int) -> DataFrame:
    """(part, data): pairs of able words with their counts by class, each pair in the part of its hash; texts (__y, __text), `able` the sorted hashes of words.

    Pairs are sorted and compressed in their parts, which takes a third of what rows of strings take.
    """
    held = texts.sparkSession.sparkContext.broadcast(able)

    def run(batches):
        names: list[str] = []
        number: dict[str, int] = {}
        counts, waiting, size = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

        def summed():
            """The counts so far: (v, w and class as one number, how often)."""
            keys, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.empty(0, np.int64),) * 2
            keys, n = grouped(np.concatenate([counts[0], keys]), np.concatenate([counts[1], n]))
            return keys, n.astype(np.int64)

        def made():
            keys, at = np.unique(counts[0] >> 1, return_inverse=True)
            by_class = [np.bincount(at, counts[1] * (counts[0] & 1 == y), len(keys)).astype(np.int64) for y in (1, 0)]
            text, hashes = pa.array(names, pa.string()), word_hashes(names)
            v, w = keys >> 31, keys & (1 << 31) - 1
            part = (pair_keys(hashes[v], hashes[w]) >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(np.array(names, object))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            by = np.lexsort((place[w], place[v], part))
            ends = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
            for k in range(parts):
                own = by[ends[k] : ends[k + 1]]
                if len(own):
                    table = pa.table({"v": text.take(pa.array(v[own])), "w": text.take(pa.array(w[own])), "toxic": by_class[0][own], "ordinary": by_class[1][own]})
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed_table(table)], pa.binary())], names=["part", "data"])

        for batch in slices(batches, 1):
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_in(t)
                if new := [w for w in set(words) if w not in number]:
                    hashes = word_hashes(new)
                    known = np.zeros(len(new), bool) if not len(held.value) else held.value[np.minimum(np.searchsorted(held.value, hashes), len(held.value) - 1)] == hashes
                    for word, there in zip(new, known.tolist(), strict=True):
                        number[word] = len(names) if there else -1
                        if there:
                            names.append(word)
                codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                v, w = codes[:-1], codes[1:]
                both = (v >= 0) & (w >= 0)
                waiting.append((v[both] << 31 | w[both]) << 1 | y)
                size += len(waiting[-1])
            if size > PAIR_PLACES or len(number) > MEMORY:
                counts, waiting, size = summed(), [], 0
            if len(counts[0]) > PAIR_ROWS or len(number) > MEMORY:
                yield from made()
                names, number, counts = [], {}, (np.empty(0, np.int64), np.empty(0, np.int64))
        counts = summed()
        yield from made()

    return texts.select("__y", "__text").mapInArrow(run, "part int, data binary")


def packed_table(table: pa.Table) -> bytes:
    """A table with its strings as numbers of a dictionary, compressed."""
    for k, c in enumerate(table.column_names):
        if pa.types.is_string(table.schema.field(c).type):
            table = table.set_column(k, c, table[c].combine_chunks().dictionary_encode())
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked_table(data: bytes) -> pa.Table:
    table = pa.ipc.open_stream(data).read_all()
    return table.cast(pa.schema([(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in table.schema]))


def pair_sums(parts: DataFrame, count: int, least: int) -> DataFrame:
    """(v, w, toxic, ordinary, kinds) from so many parts of pairs: pairs that occur `least` times, and for each w, with v null, how many words stand before it."""

    def run(batches):
        held, size = [], 0

        def summed():
            rows = pa.concat_tables(held).group_by(["v", "w"]).aggregate([("toxic", "sum"), ("ordinary", "sum")])
            return rows.select(["v", "w", "toxic_sum", "ordinary_sum"]).rename_columns(["v", "w", "toxic", "ordinary"])

        limit = PAIR_ROWS
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(unpacked_table(data))
                size += len(held[-1])
                if size > limit:
                    held = [summed()]
                    size = len(held[0])
                    limit = max(PAIR_ROWS, 2 * size)
        if not held:
            return
        rows = summed()
        kinds = rows.group_by("w").aggregate([("v", "count")])
        kept = rows.filter(pc.greater_equal(pc.add(rows["toxic"], rows["ordinary"]), least))
        yield from kept.append_column("kinds", pa.nulls(len(kept), pa.int64())).to_batches(max_chunksize=WORD_ROWS)
        none = pa.nulls(len(kinds), pa.int64())
        yield from pa.table({"v": pa.nulls(len(kinds), pa.string()), "w": kinds["w"], "toxic": none, "ordinary": none, "kinds": kinds["v_count"]}).to_batches(max_chunksize=WORD_ROWS)

    return parts.repartitionById(count, F.col("part")).select("data").mapInArrow(run, "v string, w string, toxic long, ordinary long, kinds long")


def pair_table(texts: DataFrame, words: DataFrame, folder: str, least: int = PAIR_LEAST, discount: float = DISCOUNT) -> DataFrame:
    """(v, w, n, e): pairs of words that occur often enough, and what v before w adds to the evidence of w.

    Both words of such a pair occur as often; pairs of other words have no part. Which words do is told by their hashes, eight bytes a word, in every task.
    """
    spark = texts.sparkSession
    all_n = words.agg(*(F.sum(c).alias(c) for c in ("toxic", "ordinary")), *(F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in ("toxic", "ordinary"))).first()
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(all_n["toxic"] + all_n["ordinary"]) // PAIR_WORDS))
    able = words.where(F.col("toxic") + F.col("ordinary") >= least).select("w").mapInArrow(hashes_in, "h long").toArrow()["h"].to_numpy()
    parts = pair_parts(texts, np.sort(able.view(np.uint64)), count)
    pairs = written(pair_sums(parts, count, least), f"{folder}/pairs")
    kinds = pairs.where("v IS NULL")
    all_kinds = kinds.agg(F.sum("kinds")).first()[0] or 1
    left = kinds.groupBy("w").agg((F.sum("kinds") / F.lit(all_kinds)).alias("left"))
    kept = pairs.where("v IS NOT NULL").drop("kinds")
    before = words.select(F.col("w").alias("v"), *(F.col(c).alias(f"v_{c}") for c in ("toxic", "ordinary")))
    own = words.select("w", *(F.col(c).alias(f"w_{c}") for c in ("toxic", "ordinary")))
    rows = written(kept.join(before, "v").join(own, "w").join(left, "w"), f"{folder}/kept-pairs")
    cut = lambda n: F.greatest(F.col(n) - discount, F.lit(0.0))
    known = lambda c: F.coalesce(F.try_divide(cut(c), F.col(f"v_{c}")), F.lit(0.0))
    back = rows.groupBy("v").agg(*((1 - F.sum(known(c))).alias(f"back_{c}") for c in ("toxic", "ordinary")))

    def gain(c: str):
        alone = cut(f"w_{c}") / all_n[c] + discount * all_n[f"k_{c}"] / all_n[c] * F.col("left")
        return F.ln((known(c) + F.col(f"back_{c}") * alone) / alone)

    return rows.join(back, "v").select("v", "w", (F.col("toxic") + F.col("ordinary")).alias("n"), (gain("toxic") - gain("ordinary")).alias("e"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows=LEARN_ROWS) -> Toxicity | None:
    """Models from all labelled documents, weighed by at most `rows` others of each class; None if one class has no rows."""
    kept = shared_folder(docs.sparkSession)
    known, own = labelled(labels, key, label), docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    with tidied():  # all but the models' tables go at the end
        folder = shared_folder(docs.sparkSession)
        texts = written(counting_texts(own, known), f"{folder}/texts")
        words = written(tallies(texts, lambda ws: ((w,) for w in ws), "w string"), f"{folder}/words")
        all_n = words.agg(F.sum("toxic"), F.sum("ordinary")).first()
        if not (all_n[0] and all_n[1]):
            return None
        table = written(context_table(words, folder), f"{kept}/contexts")
        model = Toxicity(table, written(pair_table(texts, words, folder), f"{kept}/pairs"))
        chosen = written(own.join(F.broadcast(fitting_rows(known, rows)), "__key").select("__y", "__text"), f"{folder}/fitting")
        scored = chosen.select("__y", *text_hash("__text")).join(features(chosen, model, "__text"), ["__r1", "__r2"])
        found = scored.select("__y", "f").toPandas()
    y = found["__y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    model.weights = logistic(np.array(found["f"].tolist()), y)
    model.weights[0] = max(model.weights[0], 0.0)  # what is likelier toxic never scores lower
    return model


def text_hash(text: str):
    return F.xxhash64(F.col(f"`{text}`")).alias("__r1"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("__r2")


def word_evidence(words: DataFrame, model: Toxicity) -> DataFrame:
    """(w, e) of distinct words (w), by a join of what follows their contexts with the table."""

    def places(batches):
        for batch in batches:
            if len(batch):
                framed = Framed(batch.column(0).to_pylist())
                inside = framed.place > 0
                _, context = framed.last_two(ORDER)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(framed.word[inside])), pa.array(context[inside].view(np.int64)), pa.array(framed.codes[inside].astype(np.int32))], names=["w", "context", "code"])

    value = F.coalesce(F.get("values", (F.array_position("codes", F.col("code")) - 1).cast("int")), F.col("rest"), F.lit(0.0)).cast("double")
    rows = words.select("w").mapInArrow(places, "w string, context long, code int").join(model.table, "context", "left")
    return rows.groupBy("w").agg(F.sum(value).alias("e"))


def text_parts(batches, scorer: Scorer):
    """(*rest, top, rare) of each text: the values of its strongest words that are certain, and the words that tables must tell. Bounded by SCORE_BYTES of texts at once."""
    for batch in slices(batches, size=SCORE_BYTES):
        lists = [words_in(t) for t in batch.column(0).to_pylist()]
        sizes = np.array(list(map(len, lists)), np.int64)
        ends = np.cumsum(sizes)
        flat, doc = list(chain.from_iterable(lists)), np.repeat(np.arange(len(lists)), sizes)
        codes, first = scorer.codes(flat), ends - sizes
        gain, paired = scorer.gain(codes, first)
        e = scorer.value[codes]
        later = scorer.elsewhere(codes, first, paired)
        open_ = np.isnan(e) | later
        x = (e + gain) / (scorer.size[codes] + 1 + PRIOR)
        certain = np.where(open_, -np.inf, x)
        top = []
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            best = np.sort(np.partition(certain[a:b], -STRONGEST)[-STRONGEST:] if b - a > STRONGEST else certain[a:b])[::-1]
            top.append(best[best > -np.inf].tolist())
        if scorer.tops is not None:  # what can't be among the strongest, whatever its pair adds, is not looked up
            least = np.array([t[-1] if len(t) == STRONGEST else -np.inf for t in top])
            some = np.flatnonzero(later & ~np.isnan(e))
            most = (e[some] + scorer.most(codes, some)) / (scorer.size[codes[some]] + 1 + PRIOR)
            open_[some[most < least[doc[some]]]] = False
        rare: list[list[dict]] = [[] for _ in lists]
        for (k, v, w, base, d), n in Counter((int(doc[p]), flat[p - 1] if later[p] else None, flat[p], None if np.isnan(e[p]) else float(e[p]), float(gain[p])) for p in np.flatnonzero(open_)).items():
            rare[k].append({"v": v, "w": w, "c": n, "e": base, "d": d})
        kind = pa.struct([("v", pa.string()), ("w", pa.string()), ("c", pa.int64()), ("e", pa.float64()), ("d", pa.float64())])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(top, pa.list_(pa.float64())), pa.array(rare, pa.list_(kind))], names=["__r1", "__r2", "top", "rare"])


def features(docs: DataFrame, model: Toxicity, text: str) -> DataFrame:
    """(__r1, __r2, f): the length-normalised difference of each distinct text, in an array of one."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    texts = docs.select(F.col(f"`{text}`").alias("t"))
    held = spark.sparkContext.broadcast((model.common, 0.0 if model.all_contexts else float("nan"), model.held, model.bits, model.tops))

    def parts(batches):
        yield from text_parts(batches, Scorer(*held.value))

    entry = "struct<v: string, w: string, c: bigint, e: double, d: double>"
    kind = f"__r1 long, __r2 long, top array<double>, rare array<{entry}>"
    made = written(texts.select("t", *text_hash("t")).mapInArrow(parts, kind), f"{folder}/parts")
    own = made.groupBy("__r1", "__r2").agg(F.first("top").alias("top"))
    mean = lambda xs: F.array(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / STRONGEST).alias("f")
    if model.all_contexts and model.all_pairs:
        return own.select("__r1", "__r2", mean(F.col("top")))

    rare = made.select("__r1", "__r2", F.explode("rare").alias("x")).select("__r1", "__r2", "x.*")
    words = written(rare.where("e IS NULL").select("w").distinct(), f"{folder}/words")
    known = written(word_evidence(words, model), f"{folder}/evidence")
    rare = rare.where("e IS NOT NULL").unionByName(rare.where("e IS NULL").drop("e").join(known, "w"))
    if not model.all_pairs:
        rare = rare.join(model.pairs.select("v", "w", F.col("e").alias("more")), ["v", "w"], "left").withColumn("d", F.col("d") + F.coalesce("more", F.lit(0.0)))
    value = (F.col("e") + F.col("d")) / (F.length("w") + 1 + PRIOR)
    rare = rare.groupBy("__r1", "__r2").agg(F.collect_set(F.struct("v", "w", "c", value.alias("e"))).alias("more"))
    own = own.join(rare, ["__r1", "__r2"], "left")
    more = F.coalesce("more", F.expr("array()").cast("array<struct<v: string, w: string, c: bigint, e: double>>"))
    several = F.flatten(F.transform(more, lambda x: F.array_repeat(x["e"], F.least(x["c"], F.lit(STRONGEST)).cast("int"))))
    return own.select("__r1", "__r2", mean(F.slice(F.sort_array(F.concat("top", several), asc=False), 1, STRONGEST)))


def score_documents(docs: DataFrame, model: Toxicity | None, text: str = "text", score: str = "toxicity") -> DataFrame:
    """The rows with their score, 0 to 1, in a column that replaces any of that name."""
    rest = [c for c in docs.columns if c.lower() != score.lower()]
    if text not in rest:
        raise ValueError("the text column's name is that of the score")
    if model is None:
        return docs.select(*(F.col(f"`{c}`") for c in rest), F.lit(0.0).alias(score))
    weights = [float(w) for w in model.weights]
    sum_of = sum((F.col("f")[k] * w for k, w in enumerate(weights[:-1])), F.lit(weights[-1]))
    r1, r2, own = free_names(rest, "__r1", "__r2", "__score")
    kept = shared_folder(docs.sparkSession)
    with tidied():
        scores = features(docs, model, text).select(F.col("__r1").alias(r1), F.col("__r2").alias(r2), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum_of))))).alias(own))
        scores = written(scores, f"{kept}/scores")
    found = docs.select(*(F.col(f"`{c}`") for c in rest), *(h.alias(r) for h, r in zip(text_hash(text), (r1, r2), strict=True))).join(scores, [r1, r2])
    return found.select(*(F.col(f"`{c}`") for c in rest), F.col(own).alias(score))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; learned from labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
