"""Spelling variants: words one edit apart, grouped under their common form.

Words come from runs of letters; how a run is read (lower-casing, the deletion that models
a typing slip) is `words_of`. Only words of MIN_CHARS code points and MIN_COUNT occurrences
over the whole corpus take part.

Candidates by PartEnum. A word is the multiset of its letters, a binary vector with one
dimension for each (letter, occurrence) such as ("e", 2). One inserted or deleted letter
changes one dimension, a replaced one two, so words one edit apart lie within Hamming
distance K = 2. The dimensions are hashed into N1 partitions of N2 parts each; by the
pigeonhole principle two vectors within K differ in at most ceil((K+1)/N1) - 1 = K2 dimensions
of some partition, and then agree exactly on at least N2 - K2 of its parts. So each word
signs every (partition, choice of N2 - K2 parts) with the letters it has there, and two
words one edit apart share at least one signature. The signature goes with the length, to
meet words of equal or next length only. Signatures are joined by equality; each candidate
pair is verified by the edit distance (built-in `levenshtein`).

A signature shared by more than HOT words (short words whose chosen parts are nearly empty)
is refined: its words sign again under another hashing of the dimensions, and the pair
must share both. Still exact: both levels find every pair within K. No pair is lost and no
group is met whole.

A word's form is its near word of largest count (ties: the smallest in code-point order),
if that count is at least FORM_RATIO times its own. Counts grow along forms, so following
them ends; the last is the root, found by pointer jumping (rounds grow with the logarithm
of the longest chain), each round written to the shared folder.

Defined cases: a null text has no runs; a null id is read as an empty id in the hash. A word
without near words has n_near 0, no form, and is its own root. Repeated rows count again.
An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import lower_ascii
from repoquarry.session import materialise

# Fixed values of the contract.
RUN = "[A-Za-zÀ-ÿ]+"
SLIP_EVERY = 199
MIN_CHARS, MIN_COUNT, FORM_RATIO = 6, 5, 5

# Distance, partitions, parts of each. One partition of six parts (each word signs the 15
# choices of 4 parts) was measured on the 56,518 words of sf0.1 against two of six (12
# choices of 5 parts of a half): 7.5 million candidate pairs instead of 40.7 million, the
# same 159,416 near pairs, a ninth of the time. Wider signatures meet fewer strangers.
K, N1, N2 = 2, 1, 6
HOT = 256  # words that share a signature before it is refined
_K2 = -(-(K + 1) // N1) - 1


def words_of(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): one row for each run of each text, lower-cased in A-Z, with one code point
    deleted where the crc32 of "<id>:<run>" is a multiple of SLIP_EVERY."""
    runs = docs.select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_i"),
        F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), 0)).alias("_r"),
    )
    run = lower_ascii(F.col("_r"))
    h = F.crc32(F.concat(F.col("_i"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    slipped = F.concat(F.expr("substring(_w, 1, _at)"), F.expr("substring(_w, _at + 2)"))
    marked = runs.select(run.alias("_w"), F.when(h % SLIP_EVERY == 0, at).alias("_at"))
    return marked.select(F.when(F.col("_at").isNull(), F.col("_w")).otherwise(slipped).alias("word"))


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of words long and frequent enough, over all rows (partial counts first)."""
    counted = words_of(docs, id, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.char_length("word") >= MIN_CHARS) & (F.col("n") >= MIN_COUNT))


def _elements(word: Column) -> Column:
    """The word as a set: each letter with its occurrence number."""
    chars = F.split(word, "")
    return F.transform(
        chars,
        lambda c, i: F.concat(c, F.lit(":"), F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))),
    )


def _choices() -> list[tuple[int, list[int]]]:
    return [(i, list(s)) for i in range(N1) for s in combinations(range(N2), N2 - _K2)]


def placed(word: Column, seed: int) -> Column:
    """The word's dimensions, each with its part under the hashing `seed`."""
    return F.transform(
        _elements(word), lambda e: F.struct(F.pmod(F.xxhash64(F.lit(seed), e), F.lit(N1 * N2)).alias("p"), e.alias("e"))
    )


def signatures(dims: Column, seed: int) -> Column:
    """Every PartEnum signature of a word's `placed` dimensions."""
    signs = []
    for number, (i, parts) in enumerate(_choices()):
        chosen = F.array(*[F.lit(i * N2 + p) for p in parts])
        kept = F.array_sort(F.transform(F.filter(dims, lambda x: F.array_contains(chosen, x["p"])), lambda x: x["e"]))
        signs.append(F.xxhash64(F.lit(seed), F.lit(number), kept))
    return F.array(*signs)


def _posts(words: DataFrame, key: Column, seed: int) -> DataFrame:
    """(_key, _len, word): a row for each signature, keyed also by `key`."""
    dims = words.select(key.alias("_g"), "word", placed(F.col("word"), seed).alias("_d"))
    signed = dims.select("_g", "word", F.explode(signatures(F.col("_d"), seed)).alias("_s"))
    return signed.select(F.xxhash64("_g", "_s").alias("_key"), F.char_length("word").alias("_len"), "word")


def _pairs(posts: DataFrame) -> DataFrame:
    """(a, b): words that share a key, of equal length with a < b, or b one longer."""
    a = posts.select("_key", F.col("_len").alias("_la"), F.col("word").alias("a"))
    b = posts.select("_key", F.col("_len").alias("_lb"), F.col("word").alias("b"))
    # Both sides grow with the vocabulary: never broadcast on an estimate.
    met = a.join(b.hint("merge"), "_key").where(
        ((F.col("_la") == F.col("_lb")) & (F.col("a") < F.col("b"))) | (F.col("_lb") == F.col("_la") + 1)
    )
    return met.select("a", "b")


def candidates(words: DataFrame) -> DataFrame:
    """(a, b): distinct pairs within Hamming distance K, and more; hot keys refined."""
    posts = materialise(_posts(words, F.lit(0), 1), "spelling-posts")
    sizes = posts.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > HOT).select("_key")
    cool = posts.join(hot, "_key", "left_anti")
    heavy = posts.join(hot, "_key", "left_semi")
    refined = _posts(heavy.select("_key", "word"), F.col("_key"), 2)
    return _pairs(cool).union(_pairs(refined)).distinct()


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a before b: pairs of words one inserted, deleted or replaced code point apart."""
    found = candidates(words)
    return found.where(F.levenshtein("a", "b", 1).between(1, 1))


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary."""
    vocab = materialise(vocabulary(docs, id, text), "spelling-vocabulary")
    pairs = materialise(near_pairs(vocab.select("word")), "spelling-pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    counted = both.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("_on")), "other")
    best = counted.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("_on")).alias("m"), F.col("other").alias("w"))).alias("_top"),
    )
    top = -F.col("_top.m")
    form = F.when(top >= FORM_RATIO * F.col("n"), F.col("_top.w"))
    rows = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        form.alias("form"), F.when(form.isNotNull(), top).alias("form_n"),
    )
    rows = materialise(rows, "spelling-forms")
    return rows.join(roots(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached by following forms, by pointer jumping."""
    step = materialise(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = step.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        moved = materialise(moved, "spelling-roots")
        changed = moved.join(step.withColumnRenamed("root", "_was"), "word").where(F.col("root") != F.col("_was"))
        if changed.isEmpty():
            return moved
        step = moved
