"""Licences of files by TF-IDF cosine to templates, and by inheritance from directories.

The sentences and lines of a file that speak of licences are its statement; a text with wordings of licence files is
compared as a whole, too. A statement of more words than a notice has is a long licence or a text about licences: it is compared as a
whole only, so a licence that is no template isn't taken for another one. Distinct statements and such texts are compared with templates (headers, notices, whole
licences) as sparse TF-IDF vectors, whose document frequencies count all files with one and the templates. A file
whose statement holds at least half of its words, or which is near a licence as a whole, is a licence file of its
directory. A file without a licence of its own gets that of the nearest directory above it (its own included) that has
one. Everything is DataFrame functions.

Null texts count as empty. Empty texts and texts without a statement have no licence of their own. Of several licence
files in a directory the one with the greatest cosine counts, on ties the licence that comes first by name. Null parts
of a path become "_". Every input row gives one row. Repeated rows count as files of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from .common import table, text_of
from .licence_texts import BODIES, HEADERS

#: Least cosine of a statement and its template, and of a whole text.
COSINE, WHOLE_COSINE = 0.5, 0.75
#: Least cosine of a text of more than so many words: long texts of one kind share their common words.
LONG_WORDS, LONG_COSINE = 500, 0.93
#: Words of the distinct sentences of a statement, beyond which it is no notice and only the whole text can match.
NOTICE_WORDS = 150
CUE = r"(?i)licen[cs]|copyright|all rights reserved|public domain|spdx"
#: Ends of sentences and lines.
END = r"[.!?;]\s+|\n"
#: Wordings of licence files; lines may break within them.
BODY = r"(?i)permission\s+(is\s+hereby\s+granted|to\s+use,\s+copy)|redistribution\s+and\s+use\s+in\s+source|terms\s+and\s+conditions\s+for\s+use|(general|mozilla)\s+public\s+license|free\s+documentation\s+license|artistic\s+license|creative\s+commons\s+legal\s+code|free\s+and\s+unencumbered|provided\s+.as.is"
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
TEMPLATES = HEADERS + BODIES


def statement_of(text: Column) -> Column:
    """The sentences and lines of a text that speak of licences."""
    return F.array_join(F.filter(F.split(text, END), lambda part: part.rlike(CUE)), "\n")


def body_of(text: Column) -> Column:
    """The text as a whole where it has wordings of licence files, else empty."""
    return F.when(text.rlike(BODY), text).otherwise(F.lit(""))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def match_templates(statements: DataFrame, least: float = COSINE) -> DataFrame:
    """statement, licence, cosine for rows (statement, files): distinct statements and how many files have each.

    Only statements that reach the least cosine with a template are in the result. The templates are few. Between the two
    a statement goes by its 128-bit digest.
    """
    named = statements.select("statement", F.unhex(F.md5("statement")).alias("id"), "files")
    spark = statements.sparkSession
    templates = spark.createDataFrame([(at, name, text) for at, (name, text) in enumerate(TEMPLATES)], "template int, licence string, text string")
    known = templates.select("template", "licence", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    seen = named.select("id", "files", F.explode(_terms(F.col("statement"))).alias("term")).groupBy("id", "files", "term").agg(F.count("*").alias("tf"))
    held = seen.groupBy("term").agg(F.sum("files").alias("df")).unionByName(known.groupBy("term").agg(F.count("*").alias("df")))
    held = held.groupBy("term").agg(F.sum("df").alias("df"))
    total = (statements.agg(F.sum("files")).first()[0] or 0) + len(TEMPLATES)
    idf = held.select("term", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighed = seen.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    templated = known.join(idf, "term").select("template", "licence", "term", (F.col("tf") * F.col("idf")).alias("v"))
    norms = templated.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_t"))
    lengths = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_s"))
    dots = weighed.join(F.broadcast(templated), "term").groupBy("id", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(F.broadcast(norms), "template").join(lengths, "id")
    cosine = cosine.select("id", "licence", F.round(F.col("dot") / F.col("norm_t") / F.col("norm_s"), 6).alias("cosine"))
    best = cosine.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("least"), "licence")).alias("best"))
    best = best.filter(-F.col("best.least") >= least).join(named.select("id", "statement"), "id")
    return best.select("statement", F.col("best.licence").alias("licence"), (-F.col("best.least")).alias("cosine"))


def licences(files: DataFrame) -> DataFrame:
    """file_id, path, licence, cosine, origin (own, inherited or none) and licensed_by (a directory) for rows
    (file_id, path, text)."""
    text = text_of()
    own = files.select("file_id", "path", statement_of(text).alias("statement"), body_of(text).alias("body"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"))
    own = cut_lineage(own.withColumn("directory", F.regexp_replace("path", "/[^/]*$", "")))  # the texts are read once
    speaks = (F.col("statement") != "") | (F.col("body") != "")
    stated = own.filter(speaks)
    # Cut here, the table of matches is small and the joins with it are plain joins, of which large keys can be split.
    each = stated.select(F.explode(F.filter(F.array_distinct(F.array("statement", "body")), lambda x: x != "")).alias("statement"))
    matched = cut_lineage(match_templates(each.groupBy("statement").agg(F.count("*").alias("files"))))
    of_statement = matched.select("statement", F.struct((-F.col("cosine")).alias("least"), "licence").alias("stated"))
    of_body = matched.filter(F.col("cosine") >= WHOLE_COSINE).select(F.col("statement").alias("body"), F.struct((-F.col("cosine")).alias("least"), "licence").alias("whole"))
    with_body = stated.filter(F.col("body") != "").join(of_body, "body", "left")
    enough = (F.col("words") <= LONG_WORDS) | (-F.col("whole.least") >= LONG_COSINE)
    with_body = with_body.withColumn("whole", F.when(enough, F.col("whole")))
    found = stated.filter(F.col("body") == "").withColumn("whole", F.lit(None).cast(of_body.schema["whole"].dataType)).unionByName(with_body)
    words_in = lambda text: F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    notice = words_in(F.array_join(F.array_distinct(F.split("statement", "\n")), " ")) <= NOTICE_WORDS
    found = found.join(of_statement, "statement", "left").withColumn("own", F.least(F.when(notice, F.col("stated")), "whole"))
    statement_words = words_in(F.col("statement"))
    by_directory = found.filter(F.col("own").isNotNull() & (F.col("whole").isNotNull() | (statement_words * 2 >= F.col("words"))))
    by_directory = by_directory.groupBy("directory").agg(F.min("own").alias("best"))
    by_directory = by_directory.select(F.col("directory").alias("above"), F.col("best.licence").alias("licence"), (-F.col("best.least")).alias("cosine"))
    # Each directory once against the directories above it; files then meet their own directory only.
    parts = F.split("directory", "/")
    above = own.select("directory").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
    above = above.withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(by_directory, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "licence", "cosine")).alias("from"))
    # Most files have no statement: as one key of a join they would be one task.
    silent = own.filter(~speaks).select("file_id", "path", "directory", F.lit(None).cast(found.schema["own"].dataType).alias("own"))
    out = found.select("file_id", "path", "directory", "own").unionByName(silent).join(cut_lineage(nearest), "directory", "left")
    out = out.withColumns({"own_licence": F.col("own.licence"), "own_cosine": -F.col("own.least")})
    has = F.col("own_licence").isNotNull()
    return out.select(
        "file_id",
        "path",
        F.coalesce("own_licence", "from.licence").alias("licence"),
        F.when(has, F.col("own_cosine")).otherwise(F.col("from.cosine")).alias("cosine"),
        F.when(has, "own").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("from.above")).alias("licensed_by"),
    )


def document_path() -> Column:
    """The test documents have no paths: source/language/thousand/id stands for one."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("_"))
    return F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(F.floor(F.col("doc_id") / 1000)), part(F.col("doc_id")))


def op4_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document."""
    docs = table(spark, sf_dir, "documents")
    found = licences(docs.select(F.col("doc_id").alias("file_id"), document_path().alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")


def _oracle() -> str:
    """The same in DuckDB."""
    quoted = lambda x: x.replace("'", "''")
    values = ", ".join(f"({at}, '{name}', '{quoted(text)}')" for at, (name, text) in enumerate(TEMPLATES))
    terms = f"unnest(regexp_extract_all(lower({{}}), '{TERM}'))"
    words = "len(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"
    return f"""
WITH templates(template, licence, body) AS (VALUES {values}),
own AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), coalesce((doc_id // 1000)::VARCHAR, '_'), coalesce(doc_id::VARCHAR, '_')) AS path,
    coalesce(list_aggregate(list_filter(string_split_regex(coalesce(text, ''), '{END}'), lambda l: regexp_matches(l, '{CUE}')), 'string_agg', chr(10)), '') AS statement,
    CASE WHEN regexp_matches(coalesce(text, ''), '{BODY}') THEN text ELSE '' END AS whole,
    {words.format("coalesce(text, '')")} AS words FROM documents),
files AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS directory FROM own),
stated AS (SELECT statement, count(*) AS files FROM (SELECT statement FROM files WHERE statement <> '' UNION ALL SELECT whole FROM files WHERE whole <> '' AND whole <> statement) GROUP BY statement),
seen AS (SELECT statement, files, term, count(*) AS tf FROM (SELECT statement, files, {terms.format("statement")} AS term FROM stated) GROUP BY ALL),
known AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, {terms.format("body")} AS term FROM templates) GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM (SELECT term, files AS n FROM seen UNION ALL SELECT term, 1 FROM known) GROUP BY term),
idf AS (SELECT term, ln(((SELECT coalesce(sum(files), 0) + {len(TEMPLATES)} FROM stated) + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df),
w AS (SELECT statement, term, tf * idf AS w FROM seen JOIN idf USING (term)),
v AS (SELECT template, licence, term, tf * idf AS v FROM known JOIN idf USING (term)),
cosines AS (SELECT statement, licence, round(sum(w * v) / any_value(nv) / any_value(nw), 6) AS cosine FROM w JOIN v USING (term)
    JOIN (SELECT template, sqrt(sum(v * v)) AS nv FROM v GROUP BY template) USING (template)
    JOIN (SELECT statement, sqrt(sum(w * w)) AS nw FROM w GROUP BY statement) USING (statement) GROUP BY statement, template, licence),
matched AS (SELECT statement, licence, cosine FROM cosines WHERE cosine >= {COSINE}
    QUALIFY row_number() OVER (PARTITION BY statement ORDER BY cosine DESC, licence) = 1),
noted AS (SELECT *, {words.format("array_to_string(list_distinct(string_split(statement, chr(10))), ' ')")} <= {NOTICE_WORDS} AS notice FROM files),
found AS (SELECT f.*, CASE WHEN b.cosine IS NULL OR s.cosine > b.cosine OR (s.cosine = b.cosine AND s.licence < b.licence) THEN s.licence ELSE b.licence END AS own_licence,
    greatest(s.cosine, b.cosine) AS own_cosine, b.cosine IS NOT NULL AS near FROM noted f LEFT JOIN matched s ON s.statement = f.statement AND f.notice LEFT JOIN matched b ON b.statement = f.whole AND f.whole <> '' AND b.cosine >= CASE WHEN f.words > {LONG_WORDS} THEN {LONG_COSINE} ELSE {WHOLE_COSINE} END),
by_directory AS (SELECT directory, own_licence AS licence, own_cosine AS cosine FROM found WHERE own_licence IS NOT NULL AND (near OR {words.format("statement")} * 2 >= words)
    QUALIFY row_number() OVER (PARTITION BY directory ORDER BY own_cosine DESC, own_licence) = 1),
nearest AS (SELECT d.directory, b.directory AS above, b.licence, b.cosine FROM (SELECT DISTINCT directory FROM files) d
    JOIN by_directory b ON d.directory = b.directory OR starts_with(d.directory, b.directory || '/')
    QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(b.directory) DESC) = 1)
SELECT doc_id, path, coalesce(own_licence, licence) AS licence, CASE WHEN own_licence IS NOT NULL THEN own_cosine ELSE cosine END AS cosine,
    CASE WHEN own_licence IS NOT NULL THEN 'own' WHEN licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    CASE WHEN own_licence IS NULL THEN above END AS licensed_by
FROM found LEFT JOIN nearest USING (directory)"""


ORACLE = _oracle()
