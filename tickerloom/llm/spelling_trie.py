"""Spelling variants: words one edit apart, found by a frontier that walks a distributed trie.

A trie of all words lies in an edge table; a node is named by the text that leads to it (by its SHA-256 beyond ``NAMED`` code
points), so that the table needs no numbering. A frontier row is (word, position in it, node, edits). Without an edit a word
stands on its own prefix, so all rows with no edit are known at once: one for every position of every word. Each takes its
edit over an edge of another letter (replace the letter at the position, or insert one before it) and must then follow its
own letters: the frontier is joined with the edge table block of levels by block of levels, the first block together with
the edit, so that only edits with a continuation become rows. Rows that reach an end mark are neighbours. A deletion is the
insertion of the shorter word, turned round. Inserting a letter before an equal one is left to the place behind the run,
so each pair is found once.

A block has ``levels`` levels at first and twice as many in each further round: the rounds grow with the logarithm of the
longest word. ``levels=1`` takes the edit and one level in the first join. All words, edges and rows stay in Spark tables;
joins are on (node, letters), which adaptive execution splits where one key is frequent; an edge key has at most one row per
letter of the alphabet.

Cases: NULL texts have no words; a NULL id counts as empty text in the rule that drops code points; repeated rows count as often as
they occur; ties of ``n`` go to the word that is first in code-point order; a word without neighbours has ``n_near`` 0, no
form and itself as root; empty tables give an empty result; columns besides id and text are ignored. A word that holds
U+0000 (the end mark) is kept without neighbours. A word of m code points needs m edges, whose names are hashed in time m^2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, stored, table

#: Letters of a word, and what lies between words.
BREAK = "[^A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\u0000"
NAMED = 40


def runs(docs: DataFrame, shortest: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, word``: every run of letters with at least ``shortest`` code points, A-Z lower-cased, as often as it occurs."""
    cut = keyed(docs, key, text).select("doc_id", F.explode(F.split("text", BREAK)).alias("run"))
    return cut.where(F.length("run") >= shortest).select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))


def dropped_point(found: DataFrame, every: int) -> DataFrame:
    """``word``: the runs, one code point deleted where ``every`` divides the CRC-32 of ``<doc_id>:<word>``."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    marked = found.select("word", F.crc32(name).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    short = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return marked.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("word")).alias("word"))


def counted(words: DataFrame, shortest: int, least: int) -> DataFrame:
    """``word, n`` of the words with at least ``shortest`` code points and ``least`` occurrences."""
    sums = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return sums.where(F.col("n") >= least)


def _node(size: Column) -> Column:
    prefix = F.substr("x", F.lit(1), size)
    return F.when(size <= NAMED, prefix).otherwise(F.sha2(prefix, 256))


def _letters(start: Column, size: int) -> Column:
    """Up to ``size`` letters of a word with its end mark, from ``start`` (from 0) on."""
    return F.substr("x", start + 1, F.lit(size))


def _positions(words: DataFrame) -> DataFrame:
    marked = words.select("word", "n", F.concat("word", F.lit(END)).alias("x"))
    return marked.select("*", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))


def _edges(at: DataFrame, levels: int, skip: bool) -> DataFrame:
    """``node, letters -> to`` over a block of levels; with ``skip`` any one letter (``edge``) comes before them.

    A block that runs into an end mark leads to a word (``near``, ``near_n``) instead of a node.
    """
    start = F.col("i") + (1 if skip else 0)
    cut = (at.where(F.col("i") < F.length("word")) if skip else at).select(
        "word", "n", "x", "i", _node(F.col("i")).alias("node"), _letters(start, levels).alias("letters"),
        _letters(F.col("i"), 1).alias("edge"), start.alias("start"),
    )
    ends = F.endswith("letters", F.lit(END))
    full = cut.select(
        "node", "letters", *(["edge"] if skip else []),
        F.when(~ends, _node(F.col("start") + F.length("letters"))).alias("to"),
        F.when(ends, F.struct("word", "n")).alias("end"),
    )
    keys = ["node", "letters", *(["edge"] if skip else [])]
    one = full.groupBy(*keys).agg(F.max("to").alias("to"), F.max("end").alias("end"))
    return one.select(*keys, "to", F.col("end.word").alias("near"), F.col("end.n").alias("near_n"))


def neighbours(words: DataFrame, levels: int = 4) -> DataFrame:
    """``word, n, near, near_n``: all ordered pairs of the words (``word, n``, each once) that are one edit apart."""
    words = words.where(F.instr("word", END) == 0)
    at = _positions(words)
    i, size = F.col("i"), F.length("word")
    own = _letters(i, 1).alias("own")
    replace = at.where(i < size).select("word", "n", own, _node(i).alias("node"), _letters(i + 1, levels).alias("letters"), (i + 1 + levels).alias("next"), F.lit(False).alias("longer"))
    insert = at.select("word", "n", own, _node(i).alias("node"), _letters(i, levels).alias("letters"), (i + levels).alias("next"), F.lit(True).alias("longer"))
    state = ["word", "n", "longer", "next", F.col("to").alias("node"), "near", "near_n"]
    front = replace.unionByName(insert).join(_edges(at, levels, True), ["node", "letters"]).where(F.col("edge") != F.col("own")).select(*state)
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    reached, ended, step = levels, [], levels
    while True:
        front = stored(front, "frontier")
        ended.append(front.where("near IS NOT NULL"))
        if reached > longest:
            break
        going = front.where("near IS NULL").select("word", "n", "longer", "next", "node", F.concat("word", F.lit(END)).alias("x"))
        going = going.select("word", "n", "longer", (F.col("next") + step).alias("next"), "node", _letters(F.col("next"), step).alias("letters"))
        front = going.join(_edges(at.where(i > levels), step, False), ["node", "letters"]).select(*state)
        reached, step = reached + step, 2 * step
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    back = found.where("longer").select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.select("word", "n", "near", "near_n").unionByName(back)


def roots(links: DataFrame) -> DataFrame:
    """``word, root``: where the links (``word, form``, at most one per word, no circles) end; each round doubles the reach."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = now.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        longer = stored(longer, "roots")
        if not longer.where("moved").limit(1).count():
            return now
        now = longer.select("word", "root")


def variants(words: DataFrame, ratio: int = 5, levels: int = 4) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (``word, n``; rows of one word are added up)."""
    words = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = F.min(F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("less"), "near")))
    near = neighbours(words, levels).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = words.join(near, "word", "left").select(
        "word", F.col("best.near").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.less")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    last = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents"), 6)
    return variants(counted(dropped_point(found, 199), 6, 5))


#: The same in SQL: CRC-32 bit by bit, near words by equal remainders after one deletion, forms, and roots by recursion.
OP13_SQL = """
WITH RECURSIVE found AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS b FROM found
), bits AS (
  SELECT run, times, list_concat([4294967295::BIGINT], flatten(list_transform(b, lambda x: [256 + x, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))) AS steps FROM bytes
), hashed AS (
  SELECT run, times, xor(4294967295::BIGINT, list_reduce(steps, lambda c, x:
    xor((CASE WHEN x > 0 THEN xor(c, x - 256) ELSE c END) >> 1, CASE WHEN (CASE WHEN x > 0 THEN xor(c, x - 256) ELSE c END) & 1 = 1 THEN 3988292384 ELSE 0 END))) AS h
  FROM bits
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cut AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN words w ON w.word = cut.rest
  UNION SELECT w.word, cut.word FROM cut JOIN words w ON w.word = cut.rest
), best AS (
  SELECT near.word, count(*) AS n_near, first(near ORDER BY o.n DESC, near) AS near, max(o.n) AS near_n FROM near JOIN words o ON o.word = near.near GROUP BY near.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL
), last AS (
  SELECT walk.word, walk.root FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)
"""
