"""Spelling variants: words at edit distance one of each other, found by asymmetric q-chunks and grouped by frequency.

* Words are counted per task before they are exchanged.
* Of two words the shorter one contributes two disjoint chunks, its halves, and the other one its positional grams of the
  same lengths. One edit leaves one half whole, at its place or, behind an insertion, one further. So grams are wanted at
  these places only, and a pair meets under (length, half, chunk).
* A half that many words share would pair all of them. Words under such a key are split by the other half with one code
  point taken out, at the same place for a replacement: what still meets there differs in that code point only.
* Pairs are verified by their edit distance.
* Tables that grow with the words are joined by a sort. Spark takes a table for as large as its file, so chunks and places
  exploded from a small file of words would be broadcast, many times its size, through the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.scope import WorkTables, in_arrow
from rackpulse.llm.wordpiece_ids import LOWER

#: Words have at least so many code points and occurrences, and a form has so many times the occurrences of its variant.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
#: One of so many occurrences loses a code point.
DAMAGED = 31
#: Words that share a chunk before they are split by the rest of the word.
GROUP = 32
#: Crowded chunks that are broadcast.
BROADCAST_ROWS = 100_000
#: Code points that are read at a time, and distinct words that a task holds before it sends their counts on.
SLICE, HELD = 1 << 20, 500_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_OTHER = re.compile("[^a-zÀ-ÿ]")


def slices(text: str) -> Iterator[str]:
    """The text in parts that end between runs of letters."""
    at = 0
    while at < len(text):
        end = _OTHER.search(text, at + SLICE)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def damaged(run: str, crc: int, least: int) -> str | None:
    """The run, without one code point where its number asks for it; None if it is too short for a word."""
    if crc % DAMAGED == 0:
        at = crc % len(run)
        run = run[:at] + run[at + 1 :]
    return run if len(run) >= least else None


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """Rows (word, n): occurrences in all texts of words with ``least`` code points or more.

    Runs of letters of A-Z, a-z and from U+00C0 to U+00FF, only A-Z turned to small letters. A null key is written as no
    text in front of the colon of the number that decides on a run's damage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not raw.is_valid:
                    continue
                start = zlib.crc32(f"{name or ''}:".encode())
                own: Counter[str] = Counter()
                for part in slices(raw.as_py().translate(LOWER).decode("utf-8", "replace")):
                    own.update(_RUN.findall(part))
                for word, n in own.items():
                    if len(word) >= least and (kept := damaged(word, zlib.crc32(word.encode(), start), least)):
                        total[kept] += n
                if len(total) > HELD:
                    yield counted()
                    total.clear()
        yield counted()

    rows = docs.select(F.col(key).cast("string").alias("name"), F.col(text).cast("binary").alias("raw"))
    parts = rows.mapInArrow(in_arrow(run), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _half(length):
    return F.floor(length / 2).cast("int")


def _keys(words: DataFrame) -> DataFrame:
    """Rows (length, half, chunk, longer, word, rest): chunks of words of ``length``, and the grams of words one longer.

    ``rest`` is the word without the chunk or gram.
    """
    word, size = F.col("word"), F.length("word")

    def entries(longer: bool):
        length = size - F.lit(int(longer))
        half, step = _half(length), F.lit(int(longer))
        one = F.lit(1)
        front = F.struct(
            length.alias("length"), F.lit(0).alias("half"), F.substring(word, one, half).alias("chunk"), F.lit(longer).alias("longer"),
            F.substring(word, half + 1, size).alias("rest"),
        )
        back = F.struct(
            length.alias("length"), F.lit(1).alias("half"), F.substring(word, half + 1 + step, size).alias("chunk"), F.lit(longer).alias("longer"),
            F.substring(word, one, half + step).alias("rest"),
        )
        return [front, back]

    return words.select("word", F.explode(F.array(*entries(False), *entries(True))).alias("key")).select("key.*", "word")


_KEY = ["length", "half", "chunk"]


def _met(short: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (a, b) of words under one key; two of one length once."""
    x, y = short.select(*on, F.col("word").alias("a")), other.select(*on, "longer", F.col("word").alias("b"))
    return x.join(y.hint("merge"), on).filter("longer or a < b").select("a", "b")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct words that differ by exactly one inserted, deleted or replaced code point, each once."""
    keys = _keys(words)
    crowded = keys.groupBy(*_KEY).agg(F.count("*").alias("members")).filter(F.col("members") > GROUP).select(*_KEY)
    with WorkTables(words.sparkSession) as work:
        crowded = work.write(crowded, "crowded-chunks")
        crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded.hint("merge")
        few, many = keys.join(crowded, _KEY, "left_anti"), keys.join(crowded, _KEY, "left_semi")
        plain = _met(few.filter("not longer"), few, _KEY)
        place, cut = F.col("place"), F.length("rest")
        shorter = many.withColumn("place", F.explode(F.sequence(F.lit(1), cut)))
        shorter = shorter.withColumn("rest", F.concat(F.substring("rest", F.lit(1), place - 1), F.substring("rest", place + 1, cut)))
        split = [*_KEY, "place", "rest"]
        replaced = shorter.filter("not longer")
        inserted = shorter.filter("longer").withColumn("place", F.lit(0)).distinct()
        whole = many.filter("not longer").withColumn("place", F.lit(0))
        found = plain.unionByName(_met(replaced, replaced, split)).unionByName(_met(whole, inserted, split)).distinct()
        pairs = work.write(found.filter(F.levenshtein("a", "b", 1) == 1), "near-pairs")
        work.keep(pairs)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by following forms of forms; every form is more frequent, so that ends."""
    with WorkTables(forms.sparkSession) as work:
        now = work.write(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
        while not now.filter("moved").isEmpty():
            above = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
            jumped = now.select("word", "root").join(above.hint("merge"), "root", "left")
            jumped = jumped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
            before, now = now, work.write(jumped, "roots")
            work.drop(before)
        work.keep(now)
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = FORM_FACTOR) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one per word of the texts.

    A word has ``LEAST_COUNT`` occurrences or more. ``form`` is its near word with most occurrences, of equally frequent ones
    the first in the order of code points, if they are ``factor`` times its own or more; else null. ``root`` is where the
    forms lead to. Null and empty texts have no words, and no texts make no rows; repeated rows count each time; other columns
    of ``docs`` have no influence.
    """
    with WorkTables(docs.sparkSession) as work:
        words = work.write(count_words(docs, key, text).filter(F.col("n") >= LEAST_COUNT), "words")
        pairs = near_pairs(words.select("word"))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")).hint("merge"), "b")
        first = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
        best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), first.alias("first"))
        told = words.join(best.hint("merge"), "word", "left")
        enough = -F.col("first.less") >= F.lit(factor) * F.col("n")
        told = told.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("first.form")).alias("form"), F.when(enough, -F.col("first.less")).alias("form_n"),
        )
        told = work.write(told, "told")
        work.keep(told)
    roots = _roots(told.filter("form is not null"))
    return told.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The damage number by the polynomial of crc32, bit by bit, over the UTF-8 bytes of letters up to U+00FF.
ORACLE = """
with recursive runs as materialized (
  select doc_id, run, count(*) as c from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run
    from documents) group by all having length(run) >= 7
),
steps as materialized (
  select b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) as t
  from (select unnest(range(256))::ubigint as b)
),
lookup as materialized (select list(t order by b) as t from steps),
hashed as materialized (
  select run, c, xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
    lambda ch: case when unicode(ch) < 128 then [unicode(ch)::ubigint] else [195::ubigint, (unicode(ch) - 64)::ubigint] end))),
    lambda h, b: xor(h >> 8, t[(xor(h & 255, b) + 1)::bigint])), 4294967295) as h
  from runs, lookup
),
words as materialized (
  select word, sum(c)::bigint as n from (
    select c, case when h % 31 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= 7 group by word having sum(c) >= 2
),
cut as materialized (
  select word, i, substring(word, 1, i - 1) || substring(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)
),
near as materialized (
  select a.word as a, b.word as b from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select w.word, c.word from words w join cut c on c.rest = w.word
  union select c.word, w.word from words w join cut c on c.rest = w.word
),
told as materialized (
  select w.word, w.n, count(o.word) as n_near, max(o.n) as most, min(o.word) filter (o.n = top.n) as first
  from words w left join near on near.a = w.word left join words o on o.word = near.b
    left join (select near.a, max(o.n) as n from near join words o on o.word = near.b group by near.a) top on top.a = w.word
  group by w.word, w.n
),
forms as materialized (select word, n, n_near, case when most >= 10 * n then first end as form, case when most >= 10 * n then most end as form_n from told),
climb(word, root) as (
  select word, word from forms union all select c.word, f.form from climb c join forms f on f.word = c.root where f.form is not null
),
roots as (select c.word, c.root from climb c join forms f on f.word = c.root where f.form is null)
select word, form, root, n, n_near, form_n from forms join roots using (word)
"""
