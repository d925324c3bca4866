"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory (operator 1).

1. A file's notices are found in its whole text: each line with a licence cue, all paragraphs (parted by blank
   lines) with one together, and the whole text of a file called LICENSE, LICENCE, COPYING, UNLICENSE or NOTICE. A
   notice's words (letters, digits and dots, lower case; comment marks do not count) make a sparse vector with
   idf = ln((1 + files) / (1 + files with the word)) + 1 over all notices; so do the templates, which are short
   notices, standard headers and full texts. The licence of the template with the largest cosine, if it is at least
   `least`, is the file's own; the whole text counts before the paragraphs, these before the lines (a single line
   of a long licence may not tell its version), and ties go to the smaller name.
2. A licence file licenses its directory; of several in one the best cosine counts, then the smaller path. A
   file without an own licence takes that of the nearest ancestor directory that has one: each path is joined
   with its ancestor directories, and the deepest match stays.

Null texts and texts without a notice have no own licence; null paths inherit nothing; repeated rows are
scanned each; an empty table gives an empty result; extra columns are ignored.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm._spark import cut
from tidewave.llm.templates import TEMPLATES

CUE = r"(?i)licen[cs]e|copyright|rights reserved|redistribut|permission (?:is hereby|to use)|public domain|provided .?as.is|free software"
FILES = r"(?i)^(?:un)?(?:licen[cs]e|copying|notice)(?:[.-][a-z0-9.-]+)?$"


def _terms(text: str) -> Column:
    return F.expr(f"regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.-][a-z0-9]+)*', 0)")


def _with_cue(parts: Column) -> Column:
    return F.filter(parts, lambda x: x.rlike(CUE))


def header(text: str = "text") -> Column:
    """The lines of a text with a licence cue, null if there are none."""
    return F.when(F.col(text).rlike(CUE), F.array_join(_with_cue(F.split(F.col(text), "\n")), "\n"))


def notices(text: str = "text", path: str = "path") -> Column:
    """The notices of a file as structs (rank, notice): 0 its whole text, 1 its paragraphs, 2 a line; null if there are none."""
    t = F.col(text)
    lines = _with_cue(F.split(t, "\n"))
    paragraphs = F.array_join(_with_cue(F.split(t, r"\n[^\S\n]*\n")), "\n")
    named = F.coalesce(F.regexp_extract(path, "[^/]*$", 0).rlike(FILES), F.lit(False))
    ranked = lambda parts, rank: F.transform(parts, lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("notice")))
    whole = F.filter(F.array(t), lambda x: named)
    return F.when(t.rlike(CUE) | named, F.concat(ranked(whole, 0), ranked(F.array(paragraphs), 1), ranked(F.array_distinct(lines), 2)))


def own_licences(noticed: DataFrame, least: float = 0.5) -> DataFrame:
    """file, own, cosine of the files (file, notices) with a licence of their own: one row for each file, a number of its path and text."""
    spark = noticed.sparkSession
    templates = spark.createDataFrame([(i, own, notice) for i, (own, notice) in enumerate(TEMPLATES)], "template int, own string, notice string")
    each = noticed.where("notices is not null").select("file", "notices").distinct().select("file", F.inline("notices")).where("notice <> ''").withColumn("key", F.xxhash64("notice"))
    texts = each.groupBy("key").agg(F.min("notice").alias("notice"), F.count("*").alias("files"))  # equal notices are scanned once
    terms = cut(texts.select("key", "files", F.explode(_terms("notice")).alias("term")).groupBy("key", "files", "term").agg(F.count("*").alias("tf")))
    total = float(terms.select("key", "files").distinct().agg(F.sum("files")).first()[0] or 0)
    idf = terms.groupBy("term").agg((F.log((1.0 + total) / (1.0 + F.sum("files"))) + 1).alias("idf"))
    vector = cut(terms.join(idf, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("w")))
    other = templates.select("template", "own", F.explode(_terms("notice")).alias("term")).groupBy("template", "own", "term").agg(F.count("*").alias("tf")).join(idf, "term", "left")
    other = cut(other.select("template", "own", "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0) + F.log(F.lit(1.0 + total)))).alias("v")))
    length = other.groupBy("template").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("length"))
    size = vector.groupBy("key").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("size"))
    dots = vector.join(F.broadcast(other), "term").groupBy("key", "template", "own").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))  # the templates are fixed
    scored = dots.join(F.broadcast(length), "template").join(size, "key").withColumn("cosine", F.round(F.col("dot") / (F.col("length") * F.col("size")), 9))
    first = F.struct((-F.col("cosine")).alias("c"), "own")
    # cut, so that the files are shuffled to it anew and those of a very common notice can be split
    best = cut(scored.where(F.col("cosine") >= least).groupBy("key").agg(F.min(first).alias("x")).select("key", "x.own", (-F.col("x.c")).alias("cosine")))
    found = each.select("file", "key", "rank").join(best, "key")
    return found.groupBy("file").agg(F.min(F.struct("rank", (-F.col("cosine")).alias("c"), "own")).alias("x")).select("file", "x.own", (-F.col("x.c")).alias("cosine"))


def scan(files: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, path, licence, how (own, inherited or none), cosine and from_path for each row of files (doc_id, path, text)."""
    noticed = cut(files.select("doc_id", "path", notices().alias("notices")).withColumn("file", F.xxhash64("path", "notices")))  # the texts are read once
    found = cut(own_licences(noticed, least))
    own = noticed.select("doc_id", "path", "file", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    named = cut(own.join(found, "file", "left").drop("file"))
    rank = F.struct((-F.col("cosine")).alias("c"), "path", "own")
    licensed = named.where("own is not null").where(F.regexp_extract("path", "[^/]*$", 0).rlike(FILES)).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    licensed = licensed.groupBy("dir").agg(F.min(rank).alias("x")).select(F.col("dir").alias("at"), F.col("x.own").alias("given"), F.col("x.path").alias("from_path"))
    depth = F.size(F.split("dir", "/"))
    dirs = named.where("own is null and dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/")))).alias("at"))
    nearest = above.join(licensed, "at").groupBy("dir").agg(F.max_by(F.struct("given", "from_path"), F.length("at")).alias("y"))
    out = named.join(cut(nearest), "dir", "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own", "y.given").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("y.given").isNotNull(), "inherited").otherwise("none").alias("how"),
        "cosine",
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("y.from_path")).alias("from_path"),
    )
