"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is its non-blank lines. A line goes if it lies in a run of WINDOW lines that also stands at an
earlier place, or if it has LONG characters and stands at an earlier place by itself. A document of fewer
than WINDOW lines is one run, which is held against other such documents.

Line hashes are winnowed: the leftmost least hash of each WINDOW consecutive ones is a fingerprint, so any
run of WINDOW lines that two places share has one in common. Fingerprints, and long lines, are counted over
the corpus first; those that stand at one place only, most of them, go no further. The others are extended both
ways to the runs of WINDOW lines of which they are the least, and each run is joined to the first
place that has the same; runs that follow each other add up to longer ones. As every place is held against all
earlier ones, and not against that of one document, no repeated run is missed, and no pairs of places are made.

None of the tables joined has a bound on its size, so all are joined by sorting and none is broadcast.
Earlier means smaller (doc_id, text hash, line); null doc_ids come last. Rows with one doc_id and one text are one document.
Lines and texts are told apart by 128-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import Saved, spare

WINDOW, LONG = 3, 32


def digest(x: Column) -> Column:
    return F.unhex(F.md5(x.cast("binary")))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def every_line(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_table(docs: DataFrame, long: int) -> DataFrame:
    """doc_id, t (hash of the text), h (hashes of its non-blank lines) and long (whether each has `long` characters) of each distinct document with such lines."""
    lines = F.filter(every_line(F.col("text")), lambda x: F.trim(x) != "")
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"), F.transform(lines, digest).alias("h"), F.transform(lines, lambda x: F.char_length(x) >= long).alias("long"))
    return table.where(F.size("h") > 0).dropDuplicates(["doc_id", "t"])


def windows(h: Column, window: int) -> Column:
    """Start (from 0), place of the leftmost least hash, and hash of each run of `window` lines; of all lines, under a name of their own, if there are fewer."""

    def one(start: Column, own: Column, name: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.array_position(own, F.array_min(own)).cast("int") - 1).alias("p"), digest(name).alias("w"))

    def joined(own: Column) -> Column:
        return F.array_join(F.transform(own, F.hex), "")

    many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - window, F.lit(0))), lambda i: let(F.slice(h, i + 1, window), lambda own: one(i, own, joined(own))))
    return F.when(F.size(h) >= window, many).otherwise(F.array(one(F.lit(0), h, F.concat(F.lit("all:"), joined(h)))))


def later(places: DataFrame, key: str) -> DataFrame:
    """Rows of (key, doc_id, t, p, ...) whose key stands at several places, and `first`: whether theirs is the first one."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "p")
    first = places.groupBy(key).agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").select(key, "least")
    same = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("t") == F.col("least.t")) & (F.col("p") == F.col("least.p"))
    return places.join(first.hint("merge"), key).withColumn("first", same).drop("least")


def repeated_runs(docs: DataFrame, saved: Saved, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """doc_id, t and gone (numbers of the non-blank lines to delete) of the documents with later repeated runs."""
    table = line_table(docs, long)
    if window == 1:
        prints = table.select("doc_id", "t", F.posexplode("h").alias("p", "g"))
        return later(saved.save(prints, "prints"), "g").where("not first").groupBy("doc_id", "t").agg(F.collect_set("p").alias("gone"))
    placed = table.withColumn("runs", windows(F.col("h"), window))
    # A line is a fingerprint if some run has its least hash there, and goes into the count if it is long.
    runs = F.transform(F.filter("runs", lambda x: x["p"] == F.col("p")), lambda x: F.struct(x["start"].alias("start"), x["w"].alias("w")))
    prints = placed.select("doc_id", "t", "runs", F.size("h").alias("m"), F.posexplode(F.arrays_zip("h", "long")).alias("p", "line"))
    prints = prints.select("doc_id", "t", "p", "m", F.col("line.h").alias("g"), F.col("line.long").alias("long"), runs.alias("runs")).where("long or size(runs) > 0")
    repeated = saved.save(later(saved.save(prints, "prints"), "g"), "repeated")
    alone = repeated.where("long and not first").select("doc_id", "t", F.array("p").alias("gone"))
    extended = repeated.select("doc_id", "t", "m", F.explode("runs").alias("run")).select("doc_id", "t", "m", F.col("run.start").alias("p"), F.col("run.w").alias("w"))
    within = later(extended, "w").where("not first").select("doc_id", "t", F.sequence("p", F.least(F.col("p") + window, F.col("m")) - 1).alias("gone"))
    return alone.union(within).groupBy("doc_id", "t").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def rewritten(docs: DataFrame, window: int, long: int) -> tuple[DataFrame, Column, str, str]:
    """The rows of docs with what they lose, the text that is left, and the names of two further columns: non-blank lines, and how many go."""
    saved = Saved(docs.sparkSession)
    own_id, own_text, own_gone, n_lines, n_gone = spare(docs.columns, "id", "t", "gone", "lines", "removed")
    gone = saved.last(repeated_runs(docs, saved, window, long), "gone").select(F.col("doc_id").alias(own_id), F.col("t").alias(own_text), F.col("gone").alias(own_gone))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(gone.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (digest(text) == F.col(own_text)), "left")

    def cut(every: Column, places: Column) -> Column:
        deleted = F.transform(own_gone, lambda i: F.get(places, i))
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), deleted), lambda i: F.get(every, i)), "\n")

    kept = let(every_line(F.col("text")), lambda every: let(F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: F.trim(F.get(every, i)) != ""), lambda places: cut(every, places)))
    counted = F.size(F.filter(every_line(F.col("text")), lambda x: F.trim(x) != "")).cast("long")
    removed = F.coalesce(F.size(own_gone), F.lit(0)).cast("long")
    return joined.withColumns({n_lines: counted, n_gone: removed}), F.when(F.col(own_gone).isNotNull(), kept).otherwise(F.col("text")), n_lines, n_gone


def rewrite(docs: DataFrame, window: int = WINDOW, long: int = LONG, emptied: bool = True) -> DataFrame:
    """docs with `text` less its later repeated lines; without `emptied`, rows that lose all their lines go.

    With a window of 1 every line that stands at an earlier place goes, however short. Lines keep their order, blank ones
    stay. A null text stays null, an empty one empty; a document of repeated lines only becomes empty or blank. All
    other columns, whatever their names, and repeated rows stay.
    """
    table, kept, n_lines, n_gone = rewritten(docs, window, long)
    if not emptied:
        table = table.where((F.col(n_gone) == 0) | (F.col(n_gone) < F.col(n_lines)))
    return table.select(*[kept.alias("text") if c == "text" else docs[c] for c in docs.columns])


def counts(docs: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed, kept_chars and kept_md5 of each row; a null text counts as empty."""
    table, kept, n_lines, n_gone = rewritten(docs.select("doc_id", "text"), window, long)
    out = table.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_gone).alias("n_removed"), F.coalesce(kept, F.lit("")).alias("kept"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("kept").cast("long").alias("kept_chars"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


#: The definition in SQL for WINDOW 3 and LONG 32, without fingerprints: all runs of three lines are numbered by place.
ORACLE_SQL = """
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS t FROM documents),
every AS (SELECT doc_id, t, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT doc_id, t, i, line, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY doc_id, t) AS m
      FROM every WHERE trim(line, ' ') <> '' WINDOW w AS (PARTITION BY doc_id, t ORDER BY i)),
run AS (SELECT doc_id, t, p, m, CASE WHEN m < 3 THEN 'all' || chr(10) || line || coalesce(chr(10) || lead(line) OVER o, '')
                                     ELSE 'run' || chr(10) || line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o END AS w
        FROM l WINDOW o AS (PARTITION BY doc_id, t ORDER BY p)),
again AS (SELECT doc_id, t, p, m FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, t, p) AS r FROM run WHERE w IS NOT NULL AND (m >= 3 OR p = 0)) WHERE r > 1),
gone AS (SELECT doc_id, t, unnest(generate_series(p, least(p + 3, m) - 1)) AS p FROM again
         UNION SELECT doc_id, t, p FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, t, p) AS r FROM l WHERE length(line) >= 32) WHERE r > 1),
n AS (SELECT l.doc_id, l.t, l.i, gone.p IS NOT NULL AS off FROM l LEFT JOIN gone ON gone.doc_id IS NOT DISTINCT FROM l.doc_id AND gone.t = l.t AND gone.p = l.p),
r AS (SELECT every.doc_id, every.t, count(n.i) AS n_lines, count(*) FILTER (n.off) AS n_removed, coalesce(string_agg(every.line, chr(10) ORDER BY every.i) FILTER (n.off IS NULL OR NOT n.off), '') AS kept
      FROM every LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM every.doc_id AND n.t = every.t AND n.i = every.i GROUP BY every.doc_id, every.t)
SELECT s.doc_id, r.n_lines::BIGINT AS n_lines, r.n_removed::BIGINT AS n_removed, length(r.kept)::BIGINT AS kept_chars, md5(r.kept) AS kept_md5
FROM documents s JOIN r ON r.doc_id IS NOT DISTINCT FROM s.doc_id AND r.t = md5(coalesce(s.text, ''))
"""
