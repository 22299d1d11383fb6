"""License scan by canonical digest lookup.

A text is normalised: small letters, no punctuation, no copyright notices at
the beginning of a line, one spelling for equivalent words, wherever its lines
are wrapped. The digest of the whole normalised text is then
looked up by a hash join in a table of known licence digests. Each line is
looked up in the same way, since a document often carries a one-line notice.

Only Spark SQL expressions are used. The known table is a parameter of at most
``MOST_KNOWN`` rows, checked, and therefore broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.llm.common import table
from fleetcast.llm.licence_texts import KNOWN, LONG, SPELLINGS

MOST_KNOWN = 5000

#: ASCII characters that are neither letters, digits nor line ends.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: In the SQL: what begins a copyright line once marks are gone.
COPYRIGHT = r"^ ?(copyright|©|c [0-9]{4}|all rights reserved)[^\n]*"

_M = MARKS[:-1]                                   # one mark
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"         # marks and line ends between two words
_END_OF_WORD = r"(?![a-z0-9])"
_ALL = rf"all{_M}++rights{_M}++reserved{_END_OF_WORD}"
#: Words behind "copyright" in running text; other words there are a holder.
RUNNING = ("notice notices holder holders owner owners license licenses licence licences law laws statement statements "
           "act treaty treaties protection claim claims interest interests permission disclaimer infringement "
           "and or in of on to is are for that which").split()
#: A full stop behind these (or a single letter) does not end a holder.
SHORT = "inc ltd co corp llc gmbh dr jr sr st al".split()


def words_of(text: str) -> list[str]:
    return re.sub(MARKS, " ", text.lower()).split()


def _spelt(words: list[str]) -> str:
    return _GAP.join(re.escape(w).replace("license", "licen[cs]e") for w in words)


def notice(known: list[tuple[str, str]]) -> str:
    """Expression (Java's) for the copyright notices at the beginning of a
    line of a text in small letters: the mark or word, year and holder, up to
    the line end, the end of the sentence or the first words of a known text.
    A line of running text that a wrap made to begin with "copyright" has a
    word of RUNNING next, or two words that are next in a known text."""
    openings, running = set(), {(w,) for w in RUNNING}
    for _, text in known:
        words = words_of(text)
        openings.add(tuple(words[:3]))
        running |= {tuple(words[i + 1:i + 3]) for i, w in enumerate(words[:-1])
                    if w == "copyright" and not re.fullmatch("c|©|yyyy|[0-9]{4}", words[i + 1])}
    any_of = lambda runs: "(?:" + "|".join(_spelt(list(r)) for r in sorted(runs) if r) + ")" + _END_OF_WORD
    head = (rf"(?:copyrights?{_END_OF_WORD}(?!{_GAP}{any_of(running)})(?=[^\n]*[^\x00-\x2F\x3A-\x60\x7B-\x7F])"
            rf"|©|c{_M}++[0-9]{{4}}|{_ALL}{_M}++by{_END_OF_WORD})")
    sentence = rf"(?<!(?:^|[^a-z0-9])(?:[a-z]|{'|'.join(SHORT)}))(?=\.{_M}++[^\n])"
    end = rf"(?<![\x00-\x2F\x3A-\x60\x7B-\x7F])(?:(?={_M}*+$)" + (rf"|(?={_GAP}{any_of(openings)})" if any(openings) else "") + rf"|{sentence})"
    return rf"(?md)^{_M}*+(?:(?:{head}[^\n]*?{end}|{_ALL}){_M}*+)+"


def normal_lines(text: Column, known: list[tuple[str, str]] = KNOWN + LONG) -> Column:
    """The normalised text with its line ends; null is empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), notice(known), " ")
    out = F.regexp_replace(out, MARKS, " ")
    for word, usual in SPELLINGS:
        out = F.replace(out, F.lit(word), F.lit(usual))
    return out


def whole(lines: Column) -> Column:
    out = F.trim(F.regexp_replace(lines, r"[ \n]+", " "))
    for word, usual in SPELLINGS:
        if " " in word:                           # may have been on two lines
            out = F.replace(out, F.lit(word), F.lit(usual))
    return out


def digest(normal: Column) -> Column:
    return F.sha2(normal, 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN + LONG) -> DataFrame:
    """``digest`` and ``license_id`` of each known text; of texts that
    normalise alike, the smallest id."""
    if len(known) > MOST_KNOWN:
        raise ValueError(f"{len(known)} known texts; the broadcast is bounded by {MOST_KNOWN}")
    texts = spark.createDataFrame(known, "license_id string, text string")
    return (texts.select("license_id", digest(whole(normal_lines(F.col("text"), known))).alias("digest"))
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN + LONG, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, ``canonical_sha256`` of the whole normalised
    text, ``license_id`` of the known text it equals (null if none),
    ``n_license_lines`` (lines that equal a known text) and ``line_licenses``
    (their distinct ids, sorted, comma-separated; empty if none).

    Null, empty and copyright-only texts normalise to nothing and match
    nothing. Repeated rows and null keys each give their row.
    """
    table_ = known_digests(docs.sparkSession, known).filter(F.col("digest") != F.sha2(F.lit(""), 256))
    ids = {r.digest: r.license_id for r in table_.collect()}          # at most MOST_KNOWN rows
    name = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    rows = docs.select(F.col(key), normal_lines(F.col(text), known).alias("_lines"))
    rows = rows.select(key, digest(whole(F.col("_lines"))).alias("canonical_sha256"),
                       F.transform(F.split("_lines", "\n"), lambda x: digest(whole(x))).alias("_lines"))
    wanted = F.array(*map(F.lit, ids))
    rows = (rows.withColumn("_hits", F.filter("_lines", lambda x: F.array_contains(wanted, x)))
            .withColumn("n_license_lines", F.size("_hits").cast("long"))
            .withColumn("line_licenses", F.array_join(F.array_sort(F.array_distinct(
                F.transform("_hits", lambda x: F.element_at(name, x)))), ",")))
    look = F.broadcast(table_.select(F.col("digest").alias("_digest"), "license_id"))
    return (rows.join(look, F.col("canonical_sha256") == F.col("_digest"), "left")
            .select(key, "canonical_sha256", "license_id", "n_license_lines", "line_licenses"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The same scan in DuckDB's SQL."""
    lines = f"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{MARKS}', ' ', 'g'), '(?m){COPYRIGHT}', '', 'g')"
    for word, usual in SPELLINGS:
        lines = f"replace({lines}, {_sql_text(word)}, {_sql_text(usual)})"
    known = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)
    whole_ = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'), ' ')"
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256({whole_.format(lines)}) AS digest FROM (VALUES {known}) AS k(license_id, text))
  WHERE digest <> sha256('') GROUP BY digest),
docs AS (SELECT doc_id, {lines} AS lines FROM documents),
hits AS (
  SELECT d.doc_id, count(*) AS n, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS ids
  FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM docs) AS d
  JOIN known AS k ON k.digest = sha256({whole_.format('line')}) GROUP BY d.doc_id)
SELECT d.doc_id, sha256({whole_.format('d.lines')}) AS canonical_sha256, k.license_id,
       coalesce(h.n, 0) AS n_license_lines, coalesce(h.ids, '') AS line_licenses
FROM docs AS d LEFT JOIN known AS k ON k.digest = sha256({whole_.format('d.lines')})
LEFT JOIN hits AS h ON h.doc_id = d.doc_id"""
