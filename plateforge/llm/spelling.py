"""Spelling variants by a rare-first q-gram prefix filter (operator 12).

One edit destroys two of a word's bigrams at most. So if all words order their
bigrams by the same global order, rarest first, two words that are one edit apart
share an undamaged bigram among the three first of each, at places that differ by
one at most, and the edit lies wholly to its left or wholly to its right. The join
key is that bigram with all that follows from this: the untouched side of the word,
the bigram's place, the length of the shorter word and, as one edit leaves one half
of the other side as it is, that half. Candidates of a key are verified by their
edit distance; a bucket holds only words that differ within half a side.

Bigrams are of 90 letters, so their counts (8,100 at most) are a table of a fixed
size, which the driver ships to the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .runtime import discard, materialise

LETTERS = 5
LEAST = 3
#: Of the runs of letters, each with a hash that this divides loses one letter (the planted misspellings).
SLIP = 97
PREFIX = 3
#: Distinct words that a worker counts before it hands them on.
HELD_WORDS = 200_000

# Runs of a-z and U+00C0 to U+00FF, as UTF-8 bytes.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")


def _slipped(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counted(slip: int, letters: int):
    def rows(counts):
        found = [(w.decode(), n) for w, n in counts.items() if len(w) >= letters]
        found = [(w, n) for w, n in found if len(w) >= letters]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    @kernel.lean
    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{name.as_py()}:".encode())
                for word, n in Counter(_RUN.findall((text.as_py() or "").encode().lower())).items():
                    h = zlib.crc32(word, start)
                    counts[_slipped(word, h) if slip and not h % slip else word] += n
                if len(counts) > HELD_WORDS:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    return run


def word_counts(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, slip: int = SLIP) -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, of at least `letters` code points and `least` occurrences in all texts.

    A run for which slip divides h, the CRC-32 of `<doc_id>:<run>`, loses its letter
    h % length; slip 0 leaves all as they are. Null and empty texts have no words, a
    null doc_id is written as nothing, repeated rows count each time, other columns
    are not read. Words are counted in the tasks that read them, some at a time, so
    what is shuffled is one row a word and lot, whatever the lengths of texts.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.col("text"))
    counts = rows.mapInArrow(_counted(slip, letters), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rare_first(word: str, order: dict[str, int]) -> list[int]:
    """Places of the word's three first bigrams in the global order: count, letters, place."""
    grams = sorted((order[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    return [i for _, _, i in grams[:PREFIX]]


def keys(word: str, order: dict[str, int]):
    """Join keys of a word: two words that are one edit apart share one, for words of four letters and more."""
    n = len(word)
    for p in rare_first(word, order):
        for short in (n, n - 1):
            rest = short - p - 2  # letters to the right of the bigram in the shorter word
            if rest >= 0:
                half = rest // 2
                yield f"a{short}.{p}.{word[: p + 2 + half]}"
                yield f"b{short}.{p}.{word[: p + 2]}.{word[n - rest + half :]}"
            rest = p - (n - short)  # letters to its left
            if rest >= 0:
                half = rest // 2
                yield f"c{short}.{rest}.{word[:half]}.{word[p:]}"
                yield f"d{short}.{rest}.{word[p - rest + half :]}"


def _keyed(order: dict[str, int]):
    def run(batches):
        for batch in batches:
            out = [(k, w) for w in batch.column(0).to_pylist() for k in set(keys(w, order))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["key", "word"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct words of (word) that are one inserted, deleted or replaced letter apart, once each.

    Words have four letters or more, all of a-z and U+00C0 to U+00FF.
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    order = {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}  # 90 * 90 rows at most
    keyed = materialise(words.select("word").mapInArrow(_keyed(order), "key string, word string"))
    left, right = keyed.select("key", F.col("word").alias("a")), keyed.select("key", F.col("word").alias("b"))
    return left.join(right, "key").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b") == 1)).select("a", "b").distinct()


def follow(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form), where no form leads back: the last form reached. Pointers double, so chains end in few rounds."""
    roots = materialise(links.select("word", F.col("form").alias("root")))
    while True:
        hop = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialise(roots.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(roots)
        roots = longer
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word of (word, n).

    form is the near word with the largest n (ties: the smallest in code-point order)
    where that is at least twice the word's own, else null; as n doubles with each
    form, forms never lead back. root is the last form from the word on, the word
    itself without one. An empty table gives none.
    """
    words = materialise(words.select("word", "n"))
    pairs = near_words(words)
    other = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    both = pairs.union(pairs.select("b", "a")).join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("form"))).alias("best"))
    far = words.join(both, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= 2 * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.m")).alias("n"))).alias("up"))
    found = materialise(far.select("word", "n", "n_near", F.col("up.form").alias("form"), F.col("up.n").alias("form_n")))
    roots = follow(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _half_bytes() -> list[int]:
    """The table of CRC-32 for four bits at a time."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


# DuckDB's levenshtein compares bytes, so the letters beyond ASCII become characters of one byte that no word has.
_NARROW = "translate({}, '" + "".join(map(chr, range(0xC0, 0x100))) + "', '" + "".join(map(chr, range(33, 97))).replace("'", "''") + "')"

#: CRC-32 by half bytes; near words by shared deletions, another way than the operator's.
ORACLE_SQL = f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT id, run, count(*) AS k, id || ':' || run AS s FROM t GROUP BY ALL),
y AS (SELECT id, run, k, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM r),
f AS (SELECT {_half_bytes()}::BIGINT[] AS f),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(f[(xor(f[(xor(c, x) & 15) + 1], xor(c, x) >> 4) & 15) + 1], xor(f[(xor(c, x) & 15) + 1], xor(c, x) >> 4) >> 4)), 4294967295::BIGINT) AS h FROM y, f),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, n, word AS part FROM v UNION SELECT word, n, left(word, i) || substr(word, i + 2) FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS i FROM v)),
p AS MATERIALIZED (SELECT DISTINCT a.word AS word, a.n AS n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.part = b.part AND a.word <> b.word WHERE levenshtein({_NARROW.format('a.word')}, {_NARROW.format('b.word')}) = 1),
g AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM p GROUP BY word),
o AS MATERIALIZED (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN g USING (word)),
c AS (WITH RECURSIVE c AS (SELECT word, word AS root FROM o UNION ALL SELECT c.word, o.form FROM c JOIN o ON c.root = o.word WHERE o.form IS NOT NULL) SELECT c.word AS word, arg_max(c.root, x.n) AS root FROM c JOIN v x ON c.root = x.word GROUP BY c.word)
SELECT word, form, root, n, n_near, form_n FROM o JOIN c USING (word)"""
