"""Quality rules by distribution divergence, of built-in functions only.

A document is held against its language by two histograms: of classes of characters, and of the language's ``COMMON`` most
frequent words with one bin for all others. The distance is Jensen and Shannon's, the root of the divergence in bits, from
0 to 1. The references are the same histograms over all documents of a language (``references``), so the corpus is read
twice; their size depends on the number of languages alone. A document that is too short for a histogram to mean anything
is not judged by it (``LEAST_CHARS``, ``LEAST_TOKENS``), and neither is one whose language has too little text
(``LEAST_REFERENCE``). Simple rules on words and on repetition come first and stand by themselves.

Each document is read as a whole within its row: repeated windows are found by sorting the hashes of its windows, and a
common word by a table of slots, so the work is n log n in its words. Nothing but partial sums is shuffled: one row for each
different word of each task, and those of one language combine before they meet. References are broadcast while there are
at most ``LANGUAGES`` of them, each of at most ``COMMON`` words of 64 bytes; beyond that rows are dealt by language and a
salt, so a language with most of the rows is not one task's.

Windows are compared by 64-bit hashes; two different ones of a text of a million words are taken for equal with a chance of
3e-8. Null texts have no words and lines, fail the base rules and are not kept; so are empty and blank ones. A null language
is a language of its own. Repeated rows are judged alike, an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import let, once
from millrace.llm import runtime

COMMON, LANGUAGES, SALTS = 50, 2000, 16
SLOTS = 512  # a power of two
LEAST_CHARS, LEAST_TOKENS, LEAST_REFERENCE = 200, 60, 1000
#: The greatest divergences (squares of distances) that a kept document has, of classes of characters and of common words;
#: a histogram of few words is far from any other by chance, so NOISE by the number of words is added.
FAR_CHARS, FAR_WORDS, NOISE = 0.11, 0.07, 10.0
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
_SPACE = r"[ \t-\r]+"
#: Classes of characters in the order in which they are taken out of a text; what is left is beyond ASCII, or control.
_CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "mark": "[!-~]+"}


def _between(text: Column, runs: str) -> Column:
    """What stands between runs of separators. Only the first and the last piece can be empty, so no piece is looked at one by one."""
    pieces = F.split(text, runs)

    def filled(x: Column) -> Column:
        first, last = (F.when(F.element_at(x, i) == "", 1).otherwise(0) for i in (1, -1))
        return F.slice(x, first + 1, F.greatest(F.size(x) - first - last, F.lit(0)))

    return let(pieces, filled)


def _tokens(text: Column) -> Column:
    """Runs of letters in lower case."""
    return _between(F.lower(text), r"[\x00-`{-\x7f]+")


def _classes(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``classes``, the counts of the classes of characters of words, and ``word_chars``, their sum. Each class is cut out of what the ones before have left.

    Blanks are cut out after the first class, which is most of a text, and counted with none.
    """
    first, *others = _CLASSES.values()
    out = docs.withColumn("__left0", F.col(text))
    for i, pattern in enumerate([first, _SPACE, *others]):
        out = out.withColumn(f"__left{i + 1}", F.regexp_replace(f"__left{i}", pattern, ""))
    n = len(_CLASSES) + 1
    size = lambda i: F.length(f"__left{i}").cast("bigint")
    counts = F.array(size(0) - size(1), *[size(i) - size(i + 1) for i in range(2, n)], size(n))
    return out.withColumn("classes", counts).withColumn("word_chars", size(0) - size(1) + size(2)).drop(*[f"__left{i}" for i in range(n + 1)])


def references(docs: DataFrame, lang: str = "lang", text: str = "text", common: int = COMMON) -> DataFrame:
    """``(lang, class_counts, tokens, words)`` of each language: the sums of the classes, the number of words, and ``(word, n)`` of the most frequent ones, ties by word.

    A word of more than 64 bytes is no common word.
    """
    plain = docs.select(F.col(f"`{lang}`").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n = len(_CLASSES) + 1
    chars = _classes(plain, "text").groupBy("lang").agg(F.array(*[F.sum(F.col("classes")[i]) for i in range(n)]).alias("class_counts"))
    counts = plain.select("lang", F.explode(_tokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = runtime.Workspace(docs.sparkSession).keep(counts, "words")
    total = counts.groupBy("lang").agg(F.sum("n").alias("tokens"))
    short = counts.where(F.octet_length("word") <= 64)
    # each of SALTS parts of a language has its most frequent words first, so the last window sees a few rows of each
    first = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "word")
    last = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    few = short.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS))).withColumn("r", F.row_number().over(first)).where(F.col("r") <= common)
    top = few.withColumn("r", F.row_number().over(last)).where(F.col("r") <= common)
    words = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word", "n"))), lambda x: F.struct(x["word"], x["n"])).alias("words"))  # at most ``common``
    out = chars.join(total.withColumnRenamed("lang", "l1"), F.col("lang").eqNullSafe(F.col("l1")), "left").join(words.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")), "left")
    empty = F.array().cast("array<struct<word:string,n:bigint>>")
    return out.select("lang", "class_counts", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("words", empty).alias("words"))


def _slot(word: Column) -> Column:
    return F.hash(word).bitwiseAND(SLOTS - 1)


def _slots(words: Column) -> Column:
    """For each slot the words that hash into it with their places, null if there are none."""
    placed = F.transform(words, lambda x, i: F.struct(_slot(x["word"]).alias("s"), x["word"].alias("word"), i.alias("i")))
    here = lambda p, s: F.transform(F.filter(p, lambda x: x["s"] == s), lambda x: F.struct(x["word"].alias("word"), x["i"].alias("i")))
    return let(placed, lambda p: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: let(here(p, s), lambda x: F.when(F.size(x) > 0, x))))


def _part(p: Column, q: Column) -> Column:
    """What a bin of shares p and q adds to the divergence, in bits."""
    side = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(0.0)
    return (side(p) + side(q)) / 2


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _share(n: Column, of: Column) -> Column:
    return n.cast("double") / F.greatest(of, F.lit(1)).cast("double")


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same bins."""
    whole = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    ends = F.struct(whole(counts).alias("a"), whole(reference).alias("b"))
    return let(ends, lambda n: F.sqrt(F.greatest(_total(F.zip_with(counts, reference, lambda x, y: _part(_share(x, n["a"]), _share(y, n["b"])))), F.lit(0.0))))


def word_distance(tokens: Column, words: Column, slots: Column, total: Column) -> Column:
    """Jensen-Shannon distance of a document's words and its language's, the common ones and all others as one bin."""

    def rank(t: Column) -> Column:
        here = F.get(slots, _slot(t))  # mostly null
        return F.get(F.filter(here, lambda x: x["word"] == t), F.lit(0))["i"]

    def judged(ranks: Column, n: Column) -> Column:
        """``ranks``: the ranks of the common ones of the document's n words, sorted."""
        places = F.slice(F.sequence(F.lit(0), F.size(ranks)), 1, F.size(ranks))
        ends = F.filter(places, lambda i: ~F.get(ranks, i).eqNullSafe(F.get(ranks, i + 1)))
        found = let(ends, lambda e: F.transform(e, lambda at, j: F.struct(F.get(ranks, at).alias("r"), (at - F.when(j > 0, F.get(e, j - 1)).otherwise(-1)).alias("n"))))

        def sums(f: Column) -> Column:
            share = lambda x: _share(F.get(words, x["r"])["n"], total)
            seen = _total(F.transform(f, lambda x: _part(_share(x["n"], n), share(x))))
            # bins that the document has not got add half of their share each
            every = _share(F.aggregate(words, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]), total)
            there = _total(F.transform(f, share))
            others = _part(_share(n - F.size(ranks), n), 1.0 - every)
            return F.sqrt(F.greatest(seen + (every - there) / 2 + others, F.lit(0.0)))

        return let(found, sums)

    ranks = let(F.transform(tokens, rank), lambda r: F.sort_array(F.array_compact(r)))
    return let(F.struct(ranks.alias("r"), F.size(tokens).alias("n")), lambda x: judged(x["r"], x["n"]))


def window_hashes(words: Column, k: int = WINDOW) -> Column:
    """A hash of each window of k words."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    return let(one, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + d) for d in range(1, k)])))


def repeated_words(windows: Column, k: int = WINDOW) -> Column:
    """How many words stand in a window of k words that the text has twice or more, of the hashes of all its windows.

    ``windows`` should be a column: an expression is worked out thrice, and what a lambda function is given is compared by
    interpreted code, where a column's elements are compared by generated code without an object for each.
    """

    def covered(at: Column) -> Column:
        """``at``: where such windows start, in order."""
        last = F.size(at) - 1
        each = F.transform(at, lambda x, i: F.when(i == last, k).otherwise(F.least(F.lit(k), F.get(at, i + 1) - x)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    def doubled(pairs: Column) -> Column:
        """``pairs``: (hash, place) in order."""
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        mine = F.filter(pairs, lambda x, i: same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(mine, lambda x: x["i"])), covered)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(F.sort_array(pairs), doubled)).cast("bigint")


def judge(docs: DataFrame, refs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, chars_distance, words_distance, kept)`` of each document.

    A distance is null where the document or its language has too little text.
    """
    spark = docs.sparkSession
    refs = runtime.Workspace(spark).keep(refs.select(F.col("lang").alias("__lang"), "class_counts", "tokens", "words", _slots(F.col("words")).alias("slots")), "references")
    plain = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if refs.limit(LANGUAGES + 1).count() <= LANGUAGES:
        both = plain.join(F.broadcast(refs), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    else:
        dealt = plain.withColumn("__salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        spread = refs.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = dealt.join(spread, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("__salt") == F.col("__s")), "left")
    counted = _classes(both, "text")
    base_words = _between(F.col("text"), _SPACE)
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    numbers = let(base_words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), window_hashes(w).alias("windows")))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    known = F.col("tokens") >= LEAST_REFERENCE
    chars = F.when(known & (F.col("word_chars") >= LEAST_CHARS), distance(F.col("classes"), F.col("class_counts")))
    words = F.when(known, let(_tokens(F.col("text")), lambda t: F.when(F.size(t) >= LEAST_TOKENS, F.struct(F.size(t).alias("n"), word_distance(t, F.col("words"), F.col("slots"), F.col("tokens")).alias("d")))))
    told = counted.select(
        "doc_id", once(numbers).alias("n"), "word_chars", F.col("classes")[list(_CLASSES).index("symbol")].alias("n_symbols"), dup.alias("n_dup_lines"), chars.alias("chars_distance"), words.alias("w")
    )
    told = told.withColumn("n_repeat_words", once(repeated_words(F.col("n.windows"))))
    failed = (F.col("n.n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n.n_words"))
    square = lambda c: F.coalesce(c * c, F.lit(0.0))
    far = (square(F.col("chars_distance")) > FAR_CHARS) | (square(F.col("w.d")) > FAR_WORDS + F.coalesce(NOISE / F.col("w.n"), F.lit(0.0)))
    return told.select(
        "doc_id", "n.n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "chars_distance", F.col("w.d").alias("words_distance"), (~failed & ~far).alias("kept")
    )


#: The same in DuckDB, for texts whose letters are lower-cased one to one.
ORACLE = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM w, unnest(range(1, len(w) - {WINDOW - 2})) r(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
steps AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS k FROM twice),
repeated AS (SELECT doc_id, sum(k)::BIGINT AS n_repeat_words FROM steps GROUP BY doc_id),
c0 AS (SELECT doc_id, lang, text, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS c0 FROM d),
c1 AS (SELECT *, regexp_replace(c0, '[a-z]', '', 'g') AS c1 FROM c0),
c2 AS (SELECT *, regexp_replace(c1, '[A-Z]', '', 'g') AS c2 FROM c1),
c3 AS (SELECT *, regexp_replace(c2, '[0-9]', '', 'g') AS c3 FROM c2),
c4 AS (SELECT *, regexp_replace(c3, '[#*$%&|<>]', '', 'g') AS c4 FROM c3),
c5 AS (SELECT *, regexp_replace(c4, '[!-~]', '', 'g') AS c5 FROM c4),
c AS (
  SELECT doc_id, lang, length(c0) AS word_chars,
    [length(c0) - length(c1), length(c1) - length(c2), length(c2) - length(c3), length(c3) - length(c4), length(c4) - length(c5), length(c5)] AS k,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM c5),
kinds AS (SELECT doc_id, lang, j, k[j] AS n FROM c, unnest(range(1, {len(_CLASSES) + 2})) r(j)),
ref_kinds AS (SELECT lang, j, sum(n) AS n FROM kinds GROUP BY lang, j),
tokens AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS t FROM d),
lengths AS (SELECT doc_id, lang, count(*) AS n FROM tokens GROUP BY doc_id, lang),
totals AS (SELECT lang, sum(n) AS tokens FROM lengths GROUP BY lang),
known AS (SELECT lang, tokens FROM totals WHERE tokens >= {LEAST_REFERENCE}),
counts AS (SELECT lang, t, count(*) AS n FROM tokens WHERE strlen(t) <= 64 GROUP BY lang, t),
common AS (SELECT lang, t, n FROM counts QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, t) <= {COMMON}),
ref_words AS (
  SELECT lang, t, n / tokens AS q FROM common JOIN known USING (lang)
  UNION ALL SELECT lang, NULL, 1 - coalesce(sum(n), 0) / any_value(tokens) FROM known LEFT JOIN common USING (lang) GROUP BY lang),
mine AS (SELECT doc_id, lang, c.t, count(*) AS n FROM tokens LEFT JOIN common c USING (lang, t) GROUP BY ALL),
shares AS (
  SELECT l.doc_id, coalesce(m.n, 0) / l.n AS p, r.q
  FROM lengths l JOIN ref_words r USING (lang) LEFT JOIN mine m ON m.doc_id = l.doc_id AND m.t IS NOT DISTINCT FROM r.t
  WHERE l.n >= {LEAST_TOKENS}),
kind_shares AS (
  SELECT c.doc_id, k.n / c.word_chars AS p, r.n / sum(r.n) OVER (PARTITION BY c.doc_id) AS q
  FROM c JOIN known USING (lang) JOIN kinds k USING (doc_id) JOIN ref_kinds r ON r.lang = c.lang AND r.j = k.j
  WHERE c.word_chars >= {LEAST_CHARS}),
far AS (
  SELECT doc_id, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS far_words FROM shares GROUP BY doc_id),
kind_far AS (
  SELECT doc_id, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS far_chars FROM kind_shares GROUP BY doc_id),
base AS (
  SELECT c.doc_id, len(w.w)::BIGINT AS n_words, c.word_chars, c.k[4] AS n_symbols, (len(c.lines) - len(list_distinct(c.lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(far_chars, 0) > {FAR_CHARS} OR coalesce(far_words, 0) > {FAR_WORDS} + coalesce({NOISE} / l.n, 0) AS far
  FROM c JOIN w USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN far USING (doc_id) LEFT JOIN kind_far USING (doc_id) LEFT JOIN lengths l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words OR far) AS kept
FROM base
"""
