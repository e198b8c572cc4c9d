r"""Line-first cleaning: rules judge each line, lines that fail go, and a text that loses too much is rejected.

A line (between \n) with a word fails by
- punctuation: no closing mark at its end, symbols (#*$%&|<>) for over a fifth of its words,
  or exclamation marks at the end of over half of three or more words;
- navigation: at most six words, the first of them one that menus have;
- boilerplate: a phrase that pages carry around their text.
Lines without a word neither fail nor count. A text is kept if the base rules pass and the failed
lines hold at most half of its word characters.

Everything is computed within the row: no shuffle, and no Python. Windows of three words are
compared by a 64-bit hash within one text.

Edge cases: null and blank texts have no words, so the base rules fail them; very long texts and
lines are handled like others (n log n in the text's words); repeated rows are judged one by one;
an empty table gives no rows; `clean` keeps extra columns.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import BLANKS
from lamella.tables import read

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
ENDINGS = [*".!?:;)]\"'…”’»"]
NAVIGATION = r"(?i)^(home|menu|next|previous|back|login|search|contact|about|share|sitemap|startseite|anmelden|impressum|inicio|siguiente|accueil|connexion|suivant)\b"
BOILERPLATE = (
    "lorem ipsum", "javascript", "all rights reserved", "privacy policy", "terms of use", "terms of service",
    "cookie policy", "accept cookies", "click here", "subscribe to", "sign up", "powered by",
    "alle rechte vorbehalten", "cookies akzeptieren", "todos los derechos reservados", "aceptar cookies", "tous droits", "accepter les cookies",
)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), "")


def _any_phrase(text: Column) -> Column:
    low = F.lower(text)
    return functools.reduce(operator.or_, (F.contains(low, F.lit(x)) for x in BOILERPLATE))


def _failed(line: Column, n: Column) -> Column:
    """The verdict on a line; what its text as a whole doesn't have (q_symbols, q_loud, q_phrase) isn't looked for in the line."""
    trimmed = F.rtrim(line, F.lit(BLANKS))
    loud = F.regexp_count(F.concat(F.translate(line, BLANKS, " " * len(BLANKS)), F.lit(" ")), F.lit("! "))
    return (
        ~F.substring(trimmed, -1, 1).isin(ENDINGS)
        | ((F.col("q_n_symbols") > 0) & (_count(line, SYMBOLS) * 5 > n))
        | (F.col("q_loud") & (n >= 3) & (loud * 2 > n))
        | ((n <= 6) & F.ltrim(trimmed, F.lit(BLANKS)).rlike(NAVIGATION))
        | (F.col("q_phrase") & _any_phrase(line))
    )


def _windows(words: Column) -> Column:
    """A hash of each window of three words, in order."""
    last = F.size(words) - 3
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def judged(docs: DataFrame) -> DataFrame:
    """docs with its base figures, the lines, and the verdict, in columns that begin with `q_`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("q_lines", F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), _words(x).alias("words"))))
    rows = rows.withColumn("q_word_chars", F.length(F.translate(text, BLANKS, "")).cast("long")).withColumn("q_n_symbols", _count(text, SYMBOLS).cast("long"))
    rows = rows.withColumn("q_loud", F.contains(text, F.lit("!"))).withColumn("q_phrase", _any_phrase(text))
    rows = rows.withColumn("q_words", F.flatten(F.transform("q_lines", lambda x: x["words"])))
    rows = rows.withColumn("q_n_words", F.size("q_words").cast("long")).withColumn("q_grams", _windows(F.col("q_words")))
    rows = rows.withColumn("q_full", F.filter("q_lines", lambda x: F.size(x["words"]) > 0))
    rows = rows.withColumn("q_n_dup_lines", (F.size("q_full") - F.size(F.array_distinct(F.transform("q_full", lambda x: x["line"])))).cast("long"))
    failed = lambda x: (F.size(x["words"]) > 0) & _failed(x["line"], F.size(x["words"]))
    rows = rows.withColumn("q_failed", F.transform("q_lines", lambda x: F.when(failed(x), F.length(F.array_join(x["words"], ""))).cast("long")))  # what goes with each line that fails
    rows = rows.withColumn("q_lost", F.aggregate("q_failed", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long"))))
    twice = F.size(F.array_distinct("q_grams")) < F.size("q_grams")  # most texts have no window twice
    rows = rows.withColumn("q_sorted", F.when(twice, F.array_sort(F.transform("q_grams", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    same = lambda a, b: a["h"] == b["h"]
    again = F.filter("q_sorted", lambda x, k: same(x, F.get("q_sorted", k - 1)) | same(x, F.get("q_sorted", k + 1)))
    rows = rows.withColumn("q_again", again)
    covered = F.array_distinct(F.flatten(F.transform("q_again", lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    rows = rows.withColumn("q_n_repeat_words", F.when(F.size("q_again") > 0, F.size(covered)).otherwise(0).cast("long"))
    rows = rows.withColumn("q_base_failed", (F.col("q_n_words") < LEAST_WORDS) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * 50))
    return rows.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_lost") * 2 <= F.col("q_word_chars")))


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, their text without the lines that failed; other columns as they are, whatever their names."""
    rows = judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"), "text")).filter("q_kept")
    stay = F.filter("q_lines", lambda x, i: F.get("q_failed", i).isNull())
    columns = {c: F.col(f"q_row.`{c}`").alias(c) for c in docs.columns}
    columns["text"] = F.array_join(F.transform(stay, lambda x: x["line"]), "\n").alias("text")
    return rows.select(*columns.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in names])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT r, unnest(range(0, len(words) - 2)) AS p, words FROM w WHERE len(words) >= 3),
g2 AS (SELECT r, p, words[p + 1] || ' ' || words[p + 2] || ' ' || words[p + 3] AS gram FROM g),
g3 AS (SELECT r, p FROM g2 QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rep AS (SELECT r, count(DISTINCT p + o) AS n FROM g3, (VALUES (0), (1), (2)) AS x(o) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l2 AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
              length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
              rtrim(regexp_replace(line, '[\x20\x09-\x0D]', ' ', 'g'), ' ') AS trimmed FROM l),
l3 AS (SELECT *, NOT regexp_matches(trimmed, '[.!?:;)\]"''…”’»]$')
        OR (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) * 5 > n
        OR (n >= 3 AND 2 * len(regexp_extract_all(trimmed || ' ', '! ')) > n)
        OR (n <= 6 AND regexp_matches(ltrim(trimmed, ' '), '(?i)^(home|menu|next|previous|back|login|search|contact|about|share|sitemap|startseite|anmelden|impressum|inicio|siguiente|accueil|connexion|suivant)\b'))
        OR regexp_matches(lower(line), 'lorem ipsum|javascript|all rights reserved|privacy policy|terms of use|terms of service|cookie policy|accept cookies|click here|subscribe to|sign up|powered by|alle rechte vorbehalten|cookies akzeptieren|todos los derechos reservados|aceptar cookies|tous droits|accepter les cookies') AS failed
       FROM l2 WHERE n > 0),
ln AS (SELECT r, count(*) - count(DISTINCT line) AS dups, sum(CASE WHEN failed THEN chars ELSE 0 END) AS lost FROM l3 GROUP BY r),
b AS (SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(ln.dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(ln.lost, 0) AS lost
      FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost * 2 <= word_chars AS kept
FROM b
"""
